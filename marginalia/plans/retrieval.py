
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.keys import plain_address, words
from marginalia.functions.vectors import cosine_to
from marginalia.operators import recall as R
from marginalia.operators.graph import catalogue, related
from marginalia.plans import Registry
from marginalia.operators.policies import POLICY_OF_ANY_VERB, policy_conflicts
from marginalia.plans.store import AS_OF, CLAIMS, CLAIMS_SQL, DOCS_SQL, VALID_SQL, _EFFECTIVE, _NEWEST, at, claims, documents, once
from marginalia.sources.files import glob_regex, path_matches, skip_reason
from marginalia.sources.transcripts import preferences, turns
from marginalia.sources.tables import table

registry = Registry()
add = registry.add

QUERY, SCOPE = "review queues for the team", "platform"
#: Shorter than the store's, so that the bound shows in the test data.
SMALL_FILE = 4096


def _score_sql(text: str, q: str) -> str:
    terms = "[" + ", ".join(f"'{t}'" for t in X.query_tokens(q)) + "]"
    toks = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"
    return f"""least(greatest(CASE WHEN list_has_all({toks}, {terms}) THEN 0.1 ELSE 0 END::DOUBLE,
        len(list_filter({toks}, lambda x: list_contains({terms}, x))) * 0.1::DOUBLE * 0.65::DOUBLE), 0.4::DOUBLE)"""


_BOOST = "CASE authority WHEN 'official-doc' THEN 0.25 WHEN 'adr' THEN 0.2 WHEN 'team-convention' THEN 0.15 WHEN 'jira-resolved' THEN 0.1 ELSE 0 END::DOUBLE"
_FRESH = f"""CASE WHEN expires_at <= TIMESTAMP '{AS_OF}' THEN 'expired' WHEN updated_at IS NULL THEN 'unknown'
    WHEN updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 120 DAY THEN 'stale' ELSE 'fresh' END"""
_FRESH_RANK = "CASE freshness WHEN 'fresh' THEN 0 WHEN 'stale' THEN 2 WHEN 'expired' THEN 3 ELSE 1 END"
_ELIGIBLE = f"""(SELECT * FROM ({_EFFECTIVE}) WHERE scope = '{SCOPE}' AND status IN ('verified', 'inferred')
    AND coalesce(source_config_id, '') NOT IN (SELECT source_config_id FROM source_configs WHERE status = 'deleted'))"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _sources(spark, sf):
    return table(spark, sf, "source_configs").select("source_config_id", "status")


@add("h05_recall", f"""SELECT claim_id, round(text_score, 6) AS text_score, round(rank_score, 6) AS rank_score, freshness FROM (
      SELECT *, text_score + confidence + {_BOOST} AS rank_score, {_FRESH} AS freshness FROM (SELECT *, {_score_sql('claim_text', QUERY)} AS text_score FROM {_ELIGIBLE}) WHERE text_score > 0)
    ORDER BY {_FRESH_RANK}, rank_score DESC, updated_at DESC, claim_id LIMIT 20""")  # fmt: skip
def h05(spark, sf):
    return _rounded(R.recall_text(claims(spark, sf), _sources(spark, sf), QUERY, SCOPE, at(), 20), "text_score", "rank_score")


def _first_vector(spark, sf) -> list[float]:
    """The vector that is searched for: that of the first claim that has one. One row."""
    v = table(spark, sf, "claims").where("embedding is not null and size(embedding) = 48").orderBy("claim_id").select("embedding").first()
    return list(v[0]) if v else [1.0] * 48


@add("h06_hybrid", f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM claims WHERE embedding IS NOT NULL AND len(embedding) = 48 ORDER BY claim_id LIMIT 1),
    vec AS (SELECT DISTINCT ON (claim_id) claim_id, embedding FROM claims),
    c AS (SELECT e.*, {_score_sql('claim_text', QUERY)} AS text_score,
             CASE WHEN len(embedding) = 48 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0
                  THEN coalesce(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q.v)), 0) ELSE 0 END AS vector_score
          FROM {_ELIGIBLE} e JOIN vec USING (claim_id) CROSS JOIN q),
    pool AS (SELECT * FROM (SELECT * FROM c WHERE text_score > 0 ORDER BY text_score DESC, claim_id LIMIT 30) UNION
             SELECT * FROM (SELECT * FROM c WHERE vector_score > 0 ORDER BY vector_score DESC, claim_id LIMIT 30))
    SELECT claim_id, round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score, round(rank_score, 6) AS rank_score, freshness FROM (
      SELECT *, text_score + 0.45 * vector_score + confidence + {_BOOST} AS rank_score, {_FRESH} AS freshness FROM pool)
    ORDER BY {_FRESH_RANK}, rank_score DESC, updated_at DESC, claim_id LIMIT 10""")  # fmt: skip
def h06(spark, sf):
    c = once(spark, sf, "claims", "claim_id", *CLAIMS, "embedding")
    out = R.recall_hybrid(c, _sources(spark, sf), QUERY, _first_vector(spark, sf), SCOPE, at(), 10)
    return _rounded(out, "text_score", "vector_score", "rank_score")


@add("h07_chunks", f"""SELECT chunk_id, document_id, title, round(text_score, 6) AS text_score FROM (
      SELECT c.chunk_id, c.document_id, c.chunk_index, d.title, d.ingested_at, {_score_sql('c.content', QUERY)} AS text_score
      FROM (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, chunk_index, content FROM chunks) c JOIN {DOCS_SQL} d ON d.document_id = c.document_id WHERE d.status <> 'deleted')
    WHERE text_score > 0 ORDER BY text_score DESC, ingested_at DESC, chunk_index, chunk_id LIMIT 20""")  # fmt: skip
def h07(spark, sf):
    c = once(spark, sf, "chunks", "chunk_id", "document_id", "chunk_index", "content", instead={"content": ("text_score", X.text_score(F.col("content"), QUERY))})
    return _rounded(R.recall_chunks(c, documents(spark, sf, "title", "ingested_at", "status"), QUERY, 20), "text_score")


QUERIES = ["review queues for the team", "retry budgets per run", "evidence quotes and conflict reports"]


@add("f09_best_of", "WITH r AS (" + " UNION ALL ".join(f"""SELECT * FROM (SELECT {i} AS query_id, claim_id, text_score + confidence + {_BOOST} AS rank_score, {_FRESH} AS freshness FROM (
      SELECT *, {_score_sql('claim_text', q)} AS text_score FROM {_ELIGIBLE}) WHERE text_score > 0 ORDER BY {_FRESH_RANK}, rank_score DESC, updated_at DESC, claim_id LIMIT 20)"""
    for i, q in enumerate(QUERIES)) + f""") SELECT query_id, claim_id, round(rank_score, 6) AS rank_score, freshness FROM r
    QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY {_FRESH_RANK}, rank_score DESC, query_id) = 1""")  # fmt: skip
def f09(spark, sf):
    """Several queries' results, each claim once."""
    c, s = claims(spark, sf), _sources(spark, sf)
    results = [R.recall_text(c, s, q, SCOPE, at(), 20).withColumn("query_id", F.lit(i)) for i, q in enumerate(QUERIES)]
    best = R.best_of(reduce(DataFrame.unionByName, results), "claim_id")
    return _rounded(best.select("query_id", "claim_id", "rank_score", "freshness"), "rank_score")


@add("h10_candidates", f"""SELECT claim_id, status, round(s + confidence + {_BOOST}, 6) AS rank_score FROM (
    SELECT *, {_score_sql('claim_text', QUERY)} AS s FROM {CLAIMS_SQL} WHERE scope = '{SCOPE}' AND status NOT IN ('deprecated', 'expired')) WHERE s > 0
    ORDER BY s + confidence + {_BOOST} DESC, claim_id LIMIT 20""")  # fmt: skip
def h10(spark, sf):
    """The claims that a new one might contradict."""
    c = claims(spark, sf).where((F.col("scope") == SCOPE) & R.active_status(F.col("status"), True)).withColumn("s", X.text_score(F.col("claim_text"), QUERY)).where("s > 0")
    c = c.withColumn("rank_score", F.col("s") + F.col("confidence") + R.authority_boost(F.col("authority")))
    return c.orderBy(F.desc("rank_score"), "claim_id").limit(20).select("claim_id", "status", F.round("rank_score", 6).alias("rank_score"))


@add("f03_nearest", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q.v)), 6) AS similarity FROM embeddings, q
    ORDER BY greatest(0, list_cosine_similarity(embedding::DOUBLE[], q.v)) DESC, vec_id LIMIT 20""")  # fmt: skip
def f03(spark, sf):
    """An exact top-k by cosine in one scan; the number is the feature."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    s = e.select("vec_id", cosine_to(F.col("embedding"), list(q[0]) if q else [1.0]).alias("similarity")).where("similarity is not null")
    return _rounded(s.orderBy(F.desc("similarity"), "vec_id").limit(20), "similarity")


@add("h04_labels", """WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1)
    SELECT label, count(*) AS vectors, round(avg(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q.v))), 6) AS similarity FROM embeddings, q GROUP BY label""")  # fmt: skip
def h04(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id = 1").select("embedding").first()
    sim = cosine_to(F.col("embedding"), list(q[0]) if q else [1.0])
    return e.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(sim), 6).alias("similarity"))


_GRAPH = """nodes AS (
      SELECT 'region-' || r_regionkey AS node, r_name AS name, 'region' AS type, 0.5::DOUBLE + 0.05::DOUBLE * least(5, r_regionkey % 6) AS confidence FROM region
      UNION ALL SELECT 'nation-' || n_nationkey, n_name, 'nation', 0.5::DOUBLE + 0.05::DOUBLE * least(5, n_nationkey % 6) FROM nation
      UNION ALL SELECT 'supplier-' || s_suppkey, s_name, 'supplier', 0.5::DOUBLE + 0.05::DOUBLE * least(5, s_suppkey % 6) FROM supplier
      UNION ALL SELECT 'part-' || p_partkey, p_name || ' #' || p_partkey, 'part', 0.5::DOUBLE + 0.05::DOUBLE * least(5, p_partkey % 6) FROM part),
    edges AS (SELECT *, src || '>' || type || '>' || dst AS edge_id FROM (
      SELECT 'nation-' || n_nationkey AS src, 'part_of' AS type, 'region-' || n_regionkey AS dst, 0.9::DOUBLE AS confidence FROM nation
      UNION ALL SELECT 'supplier-' || s_suppkey, 'located_in', 'nation-' || s_nationkey, 0.8::DOUBLE FROM supplier
      UNION ALL SELECT 'supplier-' || l_suppkey, 'supplies', 'part-' || l_partkey, least(1::DOUBLE, 0.5::DOUBLE + 0.05::DOUBLE * count(*)) FROM lineitem GROUP BY l_suppkey, l_partkey))"""


@add("h11_related", f"""WITH {_GRAPH},
    seed AS (SELECT node FROM nodes WHERE contains(lower(name), 'asia') ORDER BY confidence DESC, node LIMIT 12),
    one AS (SELECT * FROM edges WHERE src IN (SELECT node FROM seed) OR dst IN (SELECT node FROM seed) ORDER BY confidence DESC, edge_id LIMIT 16),
    front AS (SELECT src AS node FROM one UNION SELECT dst FROM one),
    two AS (SELECT * FROM edges WHERE src IN (SELECT node FROM front) OR dst IN (SELECT node FROM front) ORDER BY confidence DESC, edge_id LIMIT 20)
    SELECT edge_id, src, type, dst, round(confidence, 6) AS confidence, min(distance) AS distance, max(score) AS score FROM (
      SELECT *, 1 AS distance, 1::DOUBLE AS score FROM one UNION ALL SELECT *, 2, 0.65::DOUBLE FROM two)
    GROUP BY edge_id, src, type, dst, confidence ORDER BY distance, confidence * max(score) DESC, edge_id LIMIT 20""")  # fmt: skip
def h11(spark, sf):
    nodes, edges = catalogue({t: table(spark, sf, t) for t in ("region", "nation", "supplier", "part", "lineitem")})
    return _rounded(related(nodes, edges, "asia", limit=20), "confidence")


@add("c11_edge_names", f"""WITH {_GRAPH} SELECT e.type, s.type AS from_type, d.type AS to_type, count(*) AS edges, round(avg(e.confidence), 6) AS confidence
    FROM edges e JOIN nodes s ON s.node = e.src JOIN nodes d ON d.node = e.dst GROUP BY ALL""")  # fmt: skip
def c11(spark, sf):
    """Edges with both their ends."""
    nodes, edges = catalogue({t: table(spark, sf, t) for t in ("region", "nation", "supplier", "part", "lineitem")})
    end = lambda k, t: nodes.select(F.col("node").alias(k), F.col("type").alias(t))
    j = edges.join(end("src", "from_type"), "src").join(end("dst", "to_type"), "dst")
    return j.groupBy("type", "from_type", "to_type").agg(F.count("*").alias("edges"), F.round(F.avg("confidence"), 6).alias("confidence"))


@add("d13_edge_ranks", f"""WITH {_GRAPH} SELECT dst, min(confidence) AS least, max(confidence) AS most, count(*) AS edges FROM edges WHERE type = 'supplies' GROUP BY dst""")
def d13(spark, sf):
    _, edges = catalogue({t: table(spark, sf, t) for t in ("region", "nation", "supplier", "part", "lineitem")})
    return edges.where("type = 'supplies'").groupBy("dst").agg(F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.count("*").alias("edges"))


# ---- extraction


@add("i02_bullet_claims", r"""WITH l AS (SELECT document_id, unnest(string_split_regex(content, '\r?\n')) AS line FROM """ + DOCS_SQL + r"""),
    b AS (SELECT DISTINCT document_id, trim(regexp_replace(substr(trim(regexp_replace(line, '\s+', ' ', 'g')), 3), '\s+', ' ', 'g')) AS claim FROM l
          WHERE regexp_matches(trim(regexp_replace(line, '\s+', ' ', 'g')), '^[-*] ')),
    g AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY claim) AS nth FROM b WHERE octet_length(encode(claim)) BETWEEN 20 AND 260
      AND NOT regexp_matches(lower(claim), '^(?:""" + "|".join(X.CODE_STARTS) + r""") ') AND NOT contains(claim, ' := ') AND NOT contains(claim, ' => ')
      AND NOT contains(claim, '($') AND NOT contains(claim, '`)') AND length(claim) - length(replace(replace(claim, '{', ''), '}', '')) < 2 AND length(claim) - length(replace(claim, ';', '')) < 2)
    SELECT document_id, claim FROM g WHERE nth <= 25""")  # fmt: skip
def i02(spark, sf):
    """Claims written as bullets."""
    return documents(spark, sf, "content").select("document_id", F.explode(X.bullet_claims(F.col("content"))).alias("claim"))


_TRIM_SQL = lambda c: rf"regexp_replace({c}, '^[\s\x{{0b}}\x{{85}}\p{{Z}}]+|[\s\x{{0b}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_CLEAN_SQL = lambda c: _TRIM_SQL(rf"regexp_replace({c}, '\s+', ' ', 'g')")


@add("i02_claims", rf"""WITH a AS (SELECT document_id, list_transform(string_split(content, chr(10)), lambda x: {_TRIM_SQL("x")}) AS a FROM {DOCS_SQL} WHERE content IS NOT NULL),
    l AS (SELECT document_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM a),
    f AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS fences FROM l),
    k AS (SELECT document_id, i, line, starts_with(line, '- ') OR starts_with(line, '* ') AS bullet FROM f WHERE NOT starts_with(line, '```') AND fences % 2 = 0),
    s AS (SELECT document_id, unnest(regexp_extract_all(string_agg(line, chr(10) ORDER BY i), '[A-Z][^.!?]{{39,260}}[.!?]')) AS raw FROM k WHERE NOT bullet AND NOT starts_with(line, '#') AND line <> '' GROUP BY document_id),
    b AS (SELECT document_id, {_CLEAN_SQL("substr(line, 3)")} AS claim FROM k WHERE bullet
      UNION SELECT document_id, {_CLEAN_SQL("raw")} FROM s WHERE regexp_matches({_CLEAN_SQL("raw")}, '(?i)\b(?:""" + "|".join(X.POLICY_WORDS) + r""")\b')),
    g AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY claim) AS nth FROM b WHERE octet_length(encode(claim)) BETWEEN 20 AND 260
      AND NOT regexp_matches(lower(claim), '^(?:""" + "|".join(X.CODE_STARTS) + r""") ') AND NOT contains(claim, ' := ') AND NOT contains(claim, ' => ')
      AND NOT contains(claim, '($') AND NOT contains(claim, '`)') AND length(claim) - length(replace(replace(claim, '{', ''), '}', '')) < 2 AND length(claim) - length(replace(claim, ';', '')) < 2)
    SELECT document_id, claim FROM g WHERE nth <= 25""")  # fmt: skip
def i02_claims(spark, sf):
    """Claims written as bullets or as sentences with a word of policy, outside of fenced code."""
    return documents(spark, sf, "content").select("document_id", F.explode(X.extracted_claims(F.col("content"))).alias("claim"))


def _redact_sql(c: str) -> str:
    for p, to in X.REDACTIONS:
        c = f"regexp_replace({c}, '{p}', '{to.replace('$', chr(92))}', 'g')"
    return c


@add("i04_redacted", f"""SELECT document_id, md5(r) AS digest, (length(r) - length(replace(r, '[REDACTED_', ''))) // 10 AS marks FROM (
    SELECT document_id, {_redact_sql("coalesce(content, '') || ' mail ops' || document_id || '@example.org or call 081234567890, API_TOKEN'")} AS r FROM {DOCS_SQL})""")  # fmt: skip
def i04(spark, sf):
    """Texts without addresses, numbers and names of secrets; each text gets a line that has some."""
    t = F.concat(F.coalesce("content", F.lit("")), F.lit(" mail ops"), F.col("document_id"), F.lit("@example.org or call 081234567890, API_TOKEN"))
    d = documents(spark, sf, "content").select("document_id", X.redacted(t).alias("r"))
    marks = F.expr("(length(r) - length(replace(r, '[REDACTED_', ''))) div 10")
    return d.select("document_id", F.md5("r").alias("digest"), marks.alias("marks"))


_CONTEXT = "(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(X.SECRET_STARTS) + r")[^\n.]{0,180}"


@add("i04_contexts", f"""SELECT document_id, len(list_filter(regexp_extract_all({_redact_sql("coalesce(content, '')")}, '{_CONTEXT}'),
    lambda m: {" OR ".join(f"contains(lower(m), '{w}')" for w in X.SECRET_WORDS)})) AS contexts FROM {DOCS_SQL}""")  # fmt: skip
def i04_contexts(spark, sf):
    """How many passages about secrets are blacked out in each text."""
    n = F.size(F.split(X.fully_redacted(F.coalesce("content", F.lit(""))), r"\[REDACTED_SECRET_CONTEXT\]")) - 1
    return documents(spark, sf, "content").select("document_id", n.alias("contexts"))


@add("i06_tokens", r"""SELECT document_id, greatest(1, n * 4 // 3, CAST(ceil(length(t) / 4.0) AS BIGINT))::BIGINT AS to_store, greatest(CAST(ceil(octet_length(encode(t)) / 4.0) AS BIGINT), n)::BIGINT AS to_send FROM (
    SELECT document_id, coalesce(content, '') AS t, len(list_filter(string_split_regex(coalesce(content, ''), '\s+'), lambda x: x <> '')) AS n FROM """ + DOCS_SQL + ")")  # fmt: skip
def i06(spark, sf):
    """Both estimates of a text's size."""
    return documents(spark, sf, "content").select("document_id", X.ingest_tokens(F.col("content")).alias("to_store"), X.packet_tokens(F.col("content")).alias("to_send"))


def _part_sql(c: str) -> str:
    t = rf"""trim(regexp_replace(regexp_replace(lower({c}), '^[\s"''`.,;:()\[\]{{}}]+|[\s"''`.,;:()\[\]{{}}]+$', '', 'g'), '\s+', ' ', 'g'))"""
    return f"regexp_replace({t}, '^(?:the|a|an) ', '')"


#: The store's claims speak of running and keeping where a policy speaks of using.
_POLICY_TEXT = r"(?i)^\s*(.+?)\s+(must|should|shall)\s+(not\s+)?(\w+)\s+(.+?)\s+(?:within|for|before|during)\s+(.+?)\s*[.!]?\s*$"


@add("i09_contradictions", rf"""WITH p AS (
      SELECT scope, {_part_sql("m[1]")} AS subject, lower(m[2]) AS strength, trim(m[3]) <> '' AS negated, lower(m[4]) || ' ' || {_part_sql("m[5]")} AS object FROM (
        SELECT scope, [regexp_extract(claim_text, r, 1), regexp_extract(claim_text, r, 2), regexp_extract(claim_text, r, 3), regexp_extract(claim_text, r, 4), regexp_extract(claim_text, r, 5)] AS m
        FROM {CLAIMS_SQL}, (SELECT '{_POLICY_TEXT}' AS r) WHERE regexp_matches(claim_text, r)))
    SELECT scope, object, count(DISTINCT subject) AS subjects, count(*) FILTER (WHERE negated) AS against, count(*) FILTER (WHERE NOT negated) AS in_favour,
           CASE WHEN bool_or(strength IN ('must', 'shall')) THEN 'high' ELSE 'medium' END AS severity
    FROM p WHERE subject <> '' GROUP BY scope, object HAVING bool_or(negated) AND NOT bool_and(negated)""")  # fmt: skip
def i09(spark, sf):
    """What some policies of a scope ask for and others forbid: one row per contradiction, not per pair of claims."""
    t, g = F.col("claim_text"), lambda i: F.regexp_extract("claim_text", _POLICY_TEXT, i)
    p = claims(spark, sf).where(t.rlike(_POLICY_TEXT)).select(
        "scope", X.policy_part(g(1)).alias("subject"), F.lower(g(2)).alias("strength"), (F.trim(g(3)) != "").alias("negated"),
        F.concat(F.lower(g(4)), F.lit(" "), X.policy_part(g(5))).alias("object"),
    )
    c = p.where("subject <> ''").groupBy("scope", "object").agg(
        F.count_distinct("subject").alias("subjects"), F.count_if("negated").alias("against"), F.count_if(~F.col("negated")).alias("in_favour"),
        F.when(F.bool_or(F.col("strength").isin("must", "shall")), "high").otherwise("medium").alias("severity"),
    )
    return c.where("against > 0 and in_favour > 0")


@add("i09_policy_conflicts", rf"""WITH p AS (
      SELECT scope, {_part_sql("m[1]")} AS subject, lower(m[4]) AS verb, {_part_sql("m[6]")} AS purpose, {_part_sql("m[5]")} AS value, trim(m[3]) <> '' AS negated, lower(m[2]) <> 'should' AS hard FROM (
        SELECT scope, [{", ".join(f"regexp_extract(claim_text, r, {i})" for i in range(1, 7))}] AS m
        FROM {CLAIMS_SQL}, (SELECT '{POLICY_OF_ANY_VERB}' AS r) WHERE regexp_matches(claim_text, r)))
    SELECT scope, subject, verb, purpose, 'opposite' AS kind, value, 1 AS options, count(*) FILTER (WHERE NOT negated) AS in_favour, count(*) FILTER (WHERE negated) AS against, CASE WHEN bool_or(hard) THEN 'high' ELSE 'medium' END AS severity
    FROM p WHERE subject <> '' AND value <> '' GROUP BY scope, subject, verb, purpose, value HAVING bool_or(negated) AND NOT bool_and(negated)
    UNION ALL SELECT scope, subject, verb, purpose, 'different', NULL, count(DISTINCT value), count(*), 0, CASE WHEN bool_or(hard) THEN 'high' ELSE 'medium' END
    FROM p WHERE subject <> '' AND value <> '' AND NOT negated GROUP BY scope, subject, verb, purpose HAVING count(DISTINCT value) > 1""")  # fmt: skip
def i09_policy_conflicts(spark, sf):
    """What policies on one subject and purpose contradict each other in."""
    return policy_conflicts(claims(spark, sf))


_NAME = r"[A-Za-z][A-Za-z0-9\-]*"


@add("i12_relations", "SELECT type, lower(src) AS src, lower(dst) AS dst, count(*) AS mentions FROM (" + " UNION ALL ".join(
    rf"""SELECT '{k}' AS type, regexp_extract(m, '(?i)({_NAME})\s+{v}\s+(?:the\s+)?({_NAME})', 1) AS src, regexp_extract(m, '(?i)({_NAME})\s+{v}\s+(?:the\s+)?({_NAME})', 2) AS dst
    FROM (SELECT unnest(regexp_extract_all(claim_text, '(?i){_NAME}\s+{v}\s+(?:the\s+)?{_NAME}')) AS m FROM {CLAIMS_SQL})""" for k, v in X.RELATIONS.items()
) + ") WHERE lower(src) <> lower(dst) GROUP BY ALL")
def i12(spark, sf):
    """Relations that claims state between names, and how often."""
    found = []
    for k, v in X.RELATIONS.items():
        whole = rf"(?i){_NAME}\s+{v}\s+(?:the\s+)?{_NAME}"
        parts = rf"(?i)({_NAME})\s+{v}\s+(?:the\s+)?({_NAME})"
        hit = F.transform(F.regexp_extract_all("claim_text", F.lit(whole), F.lit(0)), lambda m: F.struct(
            F.lit(k).alias("type"), F.lower(F.regexp_extract(m, parts, 1)).alias("src"), F.lower(F.regexp_extract(m, parts, 2)).alias("dst")))  # noqa: B023
        found.append(hit)
    r = claims(spark, sf).select(F.explode(F.concat(*found)).alias("r")).select("r.*").where("src <> dst")
    return r.groupBy("type", "src", "dst").agg(F.count("*").alias("mentions"))


@add("i20_quotes", rf"""SELECT evidence_id, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(q, x))) / len(w)::DOUBLE ELSE 0 END, 6) AS score FROM (
      SELECT e.evidence_id, regexp_extract_all(lower(c.claim_text), '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(lower(e.quote), '[\p{{L}}\p{{N}}]+') AS q
      FROM (SELECT DISTINCT ON (evidence_id) evidence_id, claim_id, quote FROM evidence WHERE quote IS NOT NULL) e JOIN {CLAIMS_SQL} c ON c.claim_id = e.claim_id)""")  # fmt: skip
def i20(spark, sf):
    """How much of its claim a quote holds. Claims with many quotes are salted."""
    from marginalia.operators.skew import salted_left_join

    e = table(spark, sf, "evidence").where("quote is not null").select("evidence_id", "claim_id", "quote").dropDuplicates(["evidence_id"])
    j = salted_left_join(e, claims(spark, sf).select("claim_id", "claim_text"), "claim_id", F.col("evidence_id"), how="inner")
    return j.select("evidence_id", F.round(X.quote_score(F.col("claim_text"), F.col("quote")), 6).alias("score"))


@add("i22_addresses", r"""SELECT address, count(*) AS listed, count(DISTINCT source_url) AS spellings FROM (
      SELECT source_url, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) || substr(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)) + 1) AS address
      FROM (SELECT source_url, regexp_replace(regexp_replace(source_url, '#.*$', '', 's'), '/+$', '') AS b FROM document_snapshots)) GROUP BY address""")  # fmt: skip
def i22(spark, sf):
    s = table(spark, sf, "document_snapshots").select("source_url", plain_address(F.col("source_url")).alias("address"))
    return s.groupBy("address").agg(F.count("*").alias("listed"), F.count_distinct("source_url").alias("spellings"))


@add("i26_intents", "SELECT " + "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in X.INTENTS.items())
     + " ELSE 'general' END AS intent, suite, count(*) AS items FROM (SELECT text, coalesce(source, 'none') AS suite FROM documents) GROUP BY ALL")
def i26(spark, sf):
    """What documents seem to be about, by the first keyword that is met."""
    low, out = F.lower("text"), F.lit("general")
    for k, ws in reversed(X.INTENTS.items()):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in ws]), k).otherwise(out)
    return table(spark, sf, "documents").groupBy(out.alias("intent"), F.coalesce("source", F.lit("none")).alias("suite")).agg(F.count("*").alias("items"))


@add("i23_paths", r"""SELECT path, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(source_url, '[a-z]+/[a-z]+\.(?:md|go|ts|json)')) AS path FROM """ + DOCS_SQL + """) GROUP BY path""")
def i23(spark, sf):
    d = documents(spark, sf, "source_url").select(F.explode(F.regexp_extract_all("source_url", F.lit(r"[a-z]+/[a-z]+\.(?:md|go|ts|json)"), F.lit(0))).alias("path"))
    return d.groupBy("path").agg(F.count("*").alias("mentions"))


# ---- sources


INCLUDE, EXCLUDE = ["**/*.md"], ["ba*/", "**/da*.md"]
_PATH = "regexp_extract(source_url, '^[a-z]+://[^/]+/(.*)$', 1)"


@add("a02_globs", f"""SELECT source_type, count(*) AS documents FROM (SELECT source_type, {_PATH} AS p FROM {DOCS_SQL}) WHERE regexp_matches(p, '{"|".join(map(glob_regex, INCLUDE))}')
    AND NOT regexp_matches(p, '{"|".join(map(glob_regex, EXCLUDE))}') GROUP BY ALL""")  # fmt: skip
def a02(spark, sf):
    d = documents(spark, sf, "source_type", "source_url").withColumn("p", F.regexp_extract("source_url", "^[a-z]+://[^/]+/(.*)$", 1))
    return d.where(path_matches(F.col("p"), INCLUDE, EXCLUDE)).groupBy("source_type").agg(F.count("*").alias("documents"))


@add("a05_skipped", rf"""SELECT document_id, CASE WHEN octet_length(encode(content)) > {SMALL_FILE} THEN 'too_large'
    WHEN regexp_matches({_PATH}, '(?i)\.(?:pb|gen|min)\.[a-z]+$|(?:^|/)generated/') OR regexp_matches(substr(content, 1, 8192), '(?i)code generated .* do not edit|@generated|auto-generated file') THEN 'generated'
    WHEN contains(substr(content, 1, 8192), chr(0)) THEN 'binary' END AS reason FROM {DOCS_SQL}""")  # fmt: skip
def a05(spark, sf):
    p = F.regexp_extract("source_url", "^[a-z]+://[^/]+/(.*)$", 1)
    return documents(spark, sf, "source_url", "content").select("document_id", skip_reason(p, F.col("content"), SMALL_FILE).alias("reason"))


@add("a06_titles", rf"""SELECT document_id, CASE WHEN t <> '' THEN t ELSE {_PATH} END AS title FROM (
    SELECT document_id, source_url, trim(regexp_replace(regexp_extract(coalesce(content, ''), '(?m)^[ \t]*# +([^\r\n]+)', 1), '\s+', ' ', 'g')) AS t FROM {DOCS_SQL})""")  # fmt: skip
def a06(spark, sf):
    d = documents(spark, sf, "source_url", "content")
    return d.select("document_id", X.title_of(F.col("content"), F.regexp_extract("source_url", "^[a-z]+://[^/]+/(.*)$", 1)).alias("title"))


@add("a07_fingerprints", f"""SELECT document_id, sha256(coalesce(source_config_id, '') || chr(10) || coalesce(source_url, '') || chr(10) || 'sha256:' || sha256(coalesce(content, ''))) AS fingerprint FROM {DOCS_SQL}""")
def a07(spark, sf):
    d = documents(spark, sf, "source_config_id", "source_url", "content")
    parts = [F.coalesce("source_config_id", F.lit("")), F.coalesce("source_url", F.lit("")), F.concat(F.lit("sha256:"), F.sha2(F.coalesce("content", F.lit("")), 256))]
    return d.select("document_id", F.sha2(F.concat_ws("\n", *parts), 256).alias("fingerprint"))


@add("a16_pending", f"""SELECT source_config_id, state, count(*) AS documents FROM (
      SELECT source_config_id, CASE WHEN state = 'unchanged' THEN state WHEN row_number() OVER (PARTITION BY source_config_id, state = 'unchanged' ORDER BY source_url, scope) > 100 THEN 'deferred' ELSE state END AS state FROM (
        SELECT n.source_config_id, n.source_url, n.scope, CASE WHEN o.sums IS NULL THEN 'new' WHEN list_contains(o.sums, n.content_checksum) THEN 'unchanged' ELSE 'changed' END AS state
        FROM (SELECT source_config_id, source_url, scope, content_checksum FROM {_NEWEST}) n LEFT JOIN (
          SELECT source_config_id, scope, source_url, list(DISTINCT content_checksum) AS sums FROM source_documents GROUP BY 1, 2, 3) o
          ON o.source_config_id = n.source_config_id AND o.scope = n.scope AND o.source_url = n.source_url)) GROUP BY ALL""")  # fmt: skip
def a16(spark, sf):
    """What a run has to read anew: at most 100 documents a source, the rest deferred. The number is the feature."""
    from pyspark.sql import Window

    key = ["source_config_id", "scope", "source_url"]
    s = table(spark, sf, "document_snapshots")
    new = s.groupBy(*key).agg(F.max_by("content_checksum", F.struct("snapshot_no", "delivery_no", "ingested_at", "content_checksum")).alias("sum"))
    old = table(spark, sf, "source_documents").groupBy(*key).agg(F.collect_set("content_checksum").alias("sums"))
    state = F.when(F.col("sums").isNull(), "new").when(F.array_contains("sums", F.col("sum")), "unchanged").otherwise("changed")
    j = new.join(old, key, "left").select(*key, state.alias("state"))
    every = j.groupBy("source_config_id", "state").agg(F.count("*").alias("documents"))
    w = Window.partitionBy("source_config_id").orderBy("source_url", "scope")
    taken = j.where("state <> 'unchanged'").withColumn("nth", F.row_number().over(w)).where("nth <= 100").groupBy("source_config_id", "state").agg(F.count("*").alias("taken"))
    b = every.join(taken, ["source_config_id", "state"], "left")
    kept = F.when(F.col("state") == "unchanged", F.col("documents")).otherwise(F.coalesce("taken", F.lit(0)))
    out = b.select("source_config_id", F.explode(F.array(F.struct("state", kept.alias("documents")), F.struct(F.lit("deferred").alias("state"), (F.col("documents") - kept).alias("documents")))).alias("x"))
    return out.groupBy("source_config_id", F.col("x.state").alias("state")).agg(F.sum("x.documents").alias("documents")).where("documents > 0")


@add("a25_turns", r"""SELECT role, count(*) AS turns, count(DISTINCT doc_id) AS documents FROM (
    SELECT doc_id, CASE lower(regexp_extract(m, '(\w+)', 1)) WHEN 'human' THEN 'user' WHEN 'customer' THEN 'user' WHEN 'agent' THEN 'assistant' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant'
      ELSE lower(regexp_extract(m, '(\w+)', 1)) END AS role FROM (
      SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(13), chr(10)), '(?mi)^[ \t]*(?:user|human|customer|assistant|agent|ai|bot|system|tool)[ \t]*:')) AS m FROM documents)) GROUP BY role""")  # fmt: skip
def a25(spark, sf):
    return turns(table(spark, sf, "documents"), "doc_id", "text").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("doc_id").alias("documents"))


# ---- anchors, citations, summaries


@add("h18_anchors", rf"""SELECT claim_id, evidence_id, round(s, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY s DESC, evidence_id) AS nth FROM (
        SELECT claim_id, evidence_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: list_contains(q, x))) / len(w)::DOUBLE ELSE 0 END AS s FROM (
          SELECT c.claim_id, e.evidence_id, regexp_extract_all(lower(c.claim_text), '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(lower(e.quote), '[\p{{L}}\p{{N}}]+') AS q
          FROM (SELECT DISTINCT ON (evidence_id) evidence_id, claim_id, quote FROM evidence WHERE quote IS NOT NULL) e JOIN {CLAIMS_SQL} c ON c.claim_id = e.claim_id))
      WHERE s >= 0.65) WHERE nth = 1""")  # fmt: skip
def h18(spark, sf):
    """The quote that holds most of its claim, if that is 0.65 or more. One aggregation; claims with many quotes are salted before."""
    from marginalia.operators.skew import salted_left_join

    e = table(spark, sf, "evidence").where("quote is not null").select("evidence_id", "claim_id", "quote").dropDuplicates(["evidence_id"])
    j = salted_left_join(e, claims(spark, sf).select("claim_id", "claim_text"), "claim_id", F.col("evidence_id"), how="inner")
    s = j.select("claim_id", "evidence_id", X.quote_score(F.col("claim_text"), F.col("quote")).alias("s")).where("s >= 0.65")
    best = s.groupBy("claim_id").agg(F.min(F.struct((-F.col("s")).alias("far"), "evidence_id")).alias("b"))
    return best.select("claim_id", "b.evidence_id", F.round(-F.col("b.far"), 6).alias("score"))


_RECALLED = f"""(SELECT *, row_number() OVER (ORDER BY {_FRESH_RANK}, rank_score DESC, updated_at DESC, claim_id) AS place FROM (
    SELECT *, text_score + confidence + {_BOOST} AS rank_score, {_FRESH} AS freshness FROM (SELECT *, {_score_sql('claim_text', QUERY)} AS text_score FROM {_ELIGIBLE}) WHERE text_score > 0)
    ORDER BY {_FRESH_RANK}, rank_score DESC, updated_at DESC, claim_id LIMIT 20)"""


def _recalled(spark, sf) -> DataFrame:
    """The 20 best claims with their addresses."""
    r = R.recall_text(claims(spark, sf), _sources(spark, sf), QUERY, SCOPE, at(), 20)
    return claims(spark, sf).select("claim_id", "source_url", "updated_at").join(F.broadcast(r), "claim_id")  # 20 rows


@add("d17_quality", f"""SELECT count(*) AS hits, round(max(rank_score), 6) AS top, round(avg(rank_score), 6) AS mean, count(DISTINCT source_url) AS addresses,
    round((SELECT max(n) FROM (SELECT count(*) AS n FROM {_RECALLED} WHERE source_url IS NOT NULL GROUP BY source_url)) / count(*)::DOUBLE, 6) AS dominant,
    count(*) FILTER (WHERE source_url IS NULL) AS unsourced FROM {_RECALLED}""")  # fmt: skip
def d17(spark, sf):
    """How good a recall's result is: its scores, and how many addresses it rests on."""
    r = _recalled(spark, sf)
    by = r.groupBy("source_url").agg(F.count("*").alias("n"), F.sum("rank_score").alias("s"), F.max("rank_score").alias("m"))
    some = F.col("source_url").isNotNull()
    return by.agg(
        F.sum("n").alias("hits"), F.round(F.max("m"), 6).alias("top"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.count("source_url").alias("addresses"),
        F.round(F.max(F.when(some, F.col("n"))) / F.sum("n"), 6).alias("dominant"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("unsourced"),
    )


@add("d19_citations", f"""SELECT 'C' || row_number() OVER (ORDER BY first) AS citation, source_url, claims FROM (
    SELECT source_url, min(place) AS first, count(*) AS claims FROM {_RECALLED} WHERE source_url IS NOT NULL GROUP BY 1)""")  # fmt: skip
def d19(spark, sf):
    """The addresses of a recall's result, numbered as they are first met."""
    from pyspark.sql import Window

    order = [R.freshness_rank(F.col("freshness")), F.desc("rank_score"), F.desc("updated_at"), "claim_id"]
    r = _recalled(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # 20 rows at most
    c = r.where("source_url is not null").groupBy("source_url").agg(F.min("place").alias("first"), F.count("*").alias("claims"))
    n = F.row_number().over(Window.orderBy("first"))
    return c.select(F.concat(F.lit("C"), n.cast("string")).alias("citation"), "source_url", "claims")


# What the last part of a name tells of its kind.
NAME_KINDS = {"service": ["service", "gateway", "worker", "console", "runner"], "system": ["store", "cache", "index", "sink", "planner"], "team": ["team"]}
_NAMES = r"(?:team-[a-z]+|[a-z]+-(?:" + "|".join(NAME_KINDS["service"] + NAME_KINDS["system"]) + "))"
_KIND_SQL = "CASE WHEN name LIKE 'team-%' THEN 'team' " + " ".join(f"WHEN split_part(name, '-', 2) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in NAME_KINDS.items() if k != "team") + " END"


@add("i11_entities", f"""SELECT name, {_KIND_SQL} AS kind, count(*) AS mentions, count(DISTINCT document_id) AS documents, round(0.5::DOUBLE + 0.05::DOUBLE * least(count(*), 5), 6) AS confidence
    FROM (SELECT document_id, unnest(regexp_extract_all(content, '{_NAMES}')) AS name FROM {DOCS_SQL}) GROUP BY name""")  # fmt: skip
def i11(spark, sf):
    """Names of services, systems and teams in documents, counted by document first."""
    n = documents(spark, sf, "content").select("document_id", F.explode(F.regexp_extract_all("content", F.lit(_NAMES), F.lit(0))).alias("name"))
    by = n.groupBy("name", "document_id").agg(F.count("*").alias("n")).groupBy("name").agg(F.sum("n").alias("mentions"), F.count("*").alias("documents"))
    end = F.split_part("name", F.lit("-"), F.lit(2))
    kind = F.when(F.col("name").startswith("team-"), "team")
    for k in ("service", "system"):
        kind = kind.when(end.isin(NAME_KINDS[k]), k)
    return by.select("name", kind.alias("kind"), "mentions", "documents", F.round(0.5 + 0.05 * F.least("mentions", F.lit(5)), 6).alias("confidence"))


@add("l22_summaries", f"""WITH t AS (SELECT source_config_id, string_agg(title, ', ' ORDER BY title) AS titles FROM (
      SELECT source_config_id, title, row_number() OVER (PARTITION BY source_config_id ORDER BY title) AS nth FROM (
        SELECT DISTINCT source_config_id, title FROM {DOCS_SQL} WHERE status <> 'deleted' AND title IS NOT NULL)) WHERE nth <= 5 GROUP BY 1),
    d AS (SELECT source_config_id, count(*) AS n FROM {DOCS_SQL} WHERE status <> 'deleted' AND source_config_id IS NOT NULL GROUP BY 1),
    c AS (SELECT source_config_id, count(*) AS n FROM {CLAIMS_SQL} GROUP BY 1)
    SELECT d.source_config_id, 'source ' || d.source_config_id || ': ' || d.n || ' documents, ' || coalesce(c.n, 0) || ' claims; ' || coalesce(t.titles, '') AS summary
    FROM d LEFT JOIN c ON c.source_config_id = d.source_config_id LEFT JOIN t ON t.source_config_id = d.source_config_id""")  # fmt: skip
def l22(spark, sf):
    """One line on each source: what it holds, and its first five titles."""
    from pyspark.sql import Window

    d = documents(spark, sf, "source_config_id", "title", "status").where("status <> 'deleted' and source_config_id is not null")
    w = Window.partitionBy("source_config_id").orderBy("title")
    t = d.where("title is not null").select("source_config_id", "title").distinct().withColumn("nth", F.row_number().over(w)).where("nth <= 5")
    t = t.groupBy("source_config_id").agg(F.array_join(F.array_sort(F.collect_list("title")), ", ").alias("titles"))
    c = claims(spark, sf).groupBy("source_config_id").agg(F.count("*").alias("claims"))
    s = d.groupBy("source_config_id").agg(F.count("*").alias("documents")).join(c, "source_config_id", "left").join(t, "source_config_id", "left")
    line = F.format_string("source %s: %d documents, %d claims; %s", "source_config_id", "documents", F.coalesce("claims", F.lit(0)), F.coalesce("titles", F.lit("")))
    return s.select("source_config_id", line.alias("summary"))


@add("b18_filtered", f"""SELECT scope, conflict_type, count(DISTINCT conflict_id) AS conflicts FROM conflicts WHERE severity IN ('blocking', 'high', 'medium') AND status <> 'resolved'
    AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL""")  # fmt: skip
def b18(spark, sf):
    """Conflicts under conditions put together from what is asked for."""
    asked = {"severity": ["blocking", "high", "medium"], "not_status": ["resolved"], "until": at()}
    conds = [F.col("severity").isin(asked["severity"]), ~F.col("status").isin(asked["not_status"]), F.col("created_at") <= asked["until"]]
    c = once(spark, sf, "conflicts", "conflict_id", "scope", "conflict_type", "severity", "status", "created_at").where(reduce(lambda a, b: a & b, conds))
    return c.groupBy("scope", "conflict_type").agg(F.count("*").alias("conflicts"))


@add("c10_cited_from_deleted", f"""SELECT e.claim_id, count(DISTINCT e.document_id) AS documents FROM evidence e JOIN {DOCS_SQL} d ON d.document_id = e.document_id
    WHERE d.status = 'deleted' AND e.claim_id IS NOT NULL GROUP BY 1""")  # fmt: skip
def c10(spark, sf):
    """Claims that rest on deleted documents: a semi-join with the few that are."""
    gone = documents(spark, sf, "status").where("status = 'deleted'").select("document_id")
    e = table(spark, sf, "evidence").where("claim_id is not null").select("claim_id", "document_id").distinct()
    return e.join(gone, "document_id", "left_semi").groupBy("claim_id").agg(F.count("*").alias("documents"))


@add("d11_weak_claims", f"""SELECT c.scope, count(*) AS claims FROM {CLAIMS_SQL} c WHERE status IN ('verified', 'inferred') AND NOT EXISTS (
    SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND e.source_url = c.source_url AND e.quote IS NOT NULL) GROUP BY ALL""")  # fmt: skip
def d11(spark, sf):
    """Trusted claims without a quote from their own address, by scope."""
    q = table(spark, sf, "evidence").where("quote is not null").select("claim_id", "source_url").distinct()
    c = claims(spark, sf).where(R.active_status(F.col("status"))).select("claim_id", "scope", "source_url")
    return c.join(q, ["claim_id", "source_url"], "left_anti").groupBy("scope").agg(F.count("*").alias("claims"))


@add("i25_stable_ids", f"""SELECT document_id, 'ent_' || substr(sha256(coalesce(scope, '') || chr(0) || lower(coalesce(title, ''))), 1, 24) AS stable_id FROM {DOCS_SQL}""")
def i25(spark, sf):
    d = documents(spark, sf, "scope", "title")
    key = F.concat_ws("\0", F.coalesce("scope", F.lit("")), F.lower(F.coalesce("title", F.lit(""))))
    return d.select("document_id", F.concat(F.lit("ent_"), F.substring(F.sha2(key, 256), 1, 24)).alias("stable_id"))
