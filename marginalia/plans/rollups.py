
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.chunks import chunked
from marginalia.functions.temporal import instant, policy_seconds, schedule_seconds
from marginalia.operators import recall as R
from marginalia.operators.loads import most_open
from marginalia.operators.skew import salted_left_join, spread
from marginalia.plans import Registry
from marginalia.plans.retrieval import QUERY, SCOPE, _BOOST, _score_sql, i12
from marginalia.plans.retrieval import registry as retrieval
from marginalia.plans.store import AS_OF, AS_OF_EVENTS, CLAIMS_SQL, DOCS_SQL, JOBS_SQL, _AGE, _CRON, _READ, _once, at, claims, documents, jobs, once
from marginalia.sources.tables import micros, table

registry = Registry()
add = registry.add


def _mapped(c: Column, pairs: dict, default) -> Column:
    out = default if isinstance(default, Column) else F.lit(default)
    for k, v in reversed(pairs.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _case(c: str, pairs: dict, default: str) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


# ---- intake

# The languages of files by their endings.
LANGUAGES = {"md": "markdown", "markdown": "markdown", "py": "python", "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript",
             "jsx": "javascript", "java": "java", "rs": "rust", "sql": "sql", "sh": "shell", "yaml": "yaml", "yml": "yaml", "json": "json"}
_ENDING = r"\.([A-Za-z]+)/*(?:[?#].*)?$"


@add("a04_kinds", rf"""SELECT {_case("lower(regexp_extract(source_url, '" + _ENDING + "', 1))", LANGUAGES, "'other'")} AS language, source_type,
    count(*) AS documents FROM {DOCS_SQL} GROUP BY ALL""")  # fmt: skip
def a04(spark, sf):
    """Documents by the language that the ending of their address tells."""
    e = F.lower(F.regexp_extract("source_url", _ENDING, 1))
    return documents(spark, sf, "source_url", "source_type").groupBy(_mapped(e, LANGUAGES, "other").alias("language"), "source_type").agg(F.count("*").alias("documents"))


@add("a11_warnings", f"""SELECT d.document_id, concat_ws(',', CASE WHEN d.source_url IS NOT NULL AND u.n > 1 THEN 'duplicate_url' END,
      CASE WHEN d.source_updated_at IS NULL THEN 'missing_timestamp' END, CASE WHEN s.scope <> d.scope THEN 'scope_mismatch' END,
      CASE WHEN trim(coalesce(d.title, '')) = '' THEN 'missing_title' END) AS warnings
    FROM {DOCS_SQL} d LEFT JOIN source_configs s ON s.source_config_id = d.source_config_id
    LEFT JOIN (SELECT source_url, count(*) AS n FROM {DOCS_SQL} GROUP BY 1) u ON u.source_url = d.source_url""")  # fmt: skip
def a11(spark, sf):
    """What is odd about each delivered document. Addresses are counted by an aggregation, not by a window over each."""
    d = documents(spark, sf, "source_url", "source_config_id", "source_updated_at", "scope", "title")
    many = d.groupBy("source_url").agg(F.count("*").alias("n")).where("n > 1 and source_url is not null")
    d = salted_left_join(d, many, "source_url", F.col("document_id"))
    d = salted_left_join(d, table(spark, sf, "source_configs").select("source_config_id", F.col("scope").alias("home")), "source_config_id", F.col("document_id"))
    found = F.concat_ws(",", F.when(F.col("n") > 1, "duplicate_url"), F.when(F.col("source_updated_at").isNull(), "missing_timestamp"),
                        F.when(F.col("home") != F.col("scope"), "scope_mismatch"), F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "missing_title"))
    return d.select("document_id", found.alias("warnings"))


@add("a21_exported", """SELECT event_id, to_json({'id': event_id, 'kind': event_type, 'actor': user_id}) AS line FROM events""")
def a21(spark, sf):
    """Events as lines of JSON; ``write.text`` of the lines is the export."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("actor"))).cast("string").alias("line"))


@add("b17_json_path", """SELECT CAST(props->>'k' AS BIGINT) % 10 AS k, count(*) AS events FROM events GROUP BY ALL""")
def b17(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("bigint") % 10
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count("*").alias("events"))


# ---- readiness of sources

_EVERY = f"coalesce(CASE {_AGE} END, {_CRON}, 86400)"
_OPEN = ("queued", "running", "retry")


def _every() -> Column:
    return F.coalesce(policy_seconds(F.col("freshness_policy")), schedule_seconds(F.col("schedule_cron")), F.lit(86400))


def _sources(spark, sf) -> DataFrame:
    d = documents(spark, sf, "source_config_id", "ingested_at").where(F.col("ingested_at") <= at())
    read = d.groupBy("source_config_id").agg(F.max("ingested_at").alias("last_read"))
    return table(spark, sf, "source_configs").join(read, "source_config_id", "left")


@add("b12_overdue", f"""SELECT s.source_config_id, coalesce(s.status = 'active' AND epoch(TIMESTAMP '{AS_OF}' - coalesce(last_read, s.created_at)) >
    {_EVERY} * CASE WHEN last_read IS NULL THEN 1 ELSE 2 END, false) AS overdue FROM source_configs s LEFT JOIN {_READ} r USING (source_config_id)""")  # fmt: skip
def b12(spark, sf):
    """Sources read longer ago than twice their interval (a day if they have none), or never within one."""
    age = (micros(at()) - micros(F.coalesce("last_read", "created_at"))) / 1_000_000
    late = (F.col("status") == "active") & (age > _every() * F.when(F.col("last_read").isNull(), 1).otherwise(2))
    return _sources(spark, sf).select("source_config_id", F.coalesce(late, F.lit(False)).alias("overdue"))


_READY = f"""(SELECT s.source_config_id, s.status, coalesce(l.status IN {_OPEN}, false) AS open_job, l.status AS last_job,
    coalesce(s.status = 'active', false) AND NOT coalesce(l.status IN {_OPEN}, false)
      AND coalesce(l.last_success IS NULL OR epoch(TIMESTAMP '{AS_OF_EVENTS}' - l.last_success) > {_EVERY}, false) AS ready
    FROM source_configs s LEFT JOIN (SELECT source, arg_max(status, (updated_at, job_id)) AS status, max(updated_at) FILTER (WHERE status = 'succeeded') AS last_success
      FROM {JOBS_SQL} WHERE updated_at <= TIMESTAMP '{AS_OF_EVENTS}' GROUP BY 1) l ON l.source = 'src' || CAST(substr(s.source_config_id, 5, 2) AS INT))"""


def _ready(spark, sf) -> DataFrame:
    """Sources with their last job, and whether the next may be queued: active, none open, never a success or one too long ago."""
    j = jobs(spark, sf).where(F.col("updated_at") <= at(AS_OF_EVENTS))
    last = j.groupBy("source").agg(F.max_by("status", F.struct("updated_at", "job_id")).alias("last_job"), F.max(F.when(F.col("status") == "succeeded", F.col("updated_at"))).alias("last_success"))
    s = table(spark, sf, "source_configs").withColumn("source", F.concat(F.lit("src"), F.substring("source_config_id", 5, 2).try_cast("int").cast("string")))
    s = s.join(last, "source", "left").withColumn("open_job", F.coalesce(F.col("last_job").isin(*_OPEN), F.lit(False)))
    age = (micros(at(AS_OF_EVENTS)) - micros("last_success")) / 1_000_000
    ready = F.coalesce(F.col("status") == "active", F.lit(False)) & ~F.col("open_job") & F.coalesce(F.col("last_success").isNull() | (age > _every()), F.lit(False))
    return s.select("source_config_id", "status", "open_job", "last_job", ready.alias("ready"))


@add("b11_ready", f"SELECT * FROM {_READY}")
def b11(spark, sf):
    return _ready(spark, sf)


@add("d06_readiness", f"""SELECT status, count(*) AS sources, count(*) FILTER (WHERE ready) AS ready, count(*) FILTER (WHERE open_job) AS busy,
    count(*) FILTER (WHERE last_job IS NULL) AS never FROM {_READY} GROUP BY ALL""")  # fmt: skip
def d06(spark, sf):
    return _ready(spark, sf).groupBy("status").agg(F.count("*").alias("sources"), F.count_if("ready").alias("ready"), F.count_if("open_job").alias("busy"), F.count_if(F.col("last_job").isNull()).alias("never"))


_HINTS = {"failed": "retry", "running": "wait", "queued": "wait", "retry": "wait", "succeeded": "none"}


@add("f07_triage", f"""SELECT source_config_id, band, {_case('last_job', _HINTS, "'enqueue'")} AS hint FROM (SELECT *, CASE WHEN status = 'failed' THEN 0 WHEN last_job = 'failed' THEN 1
    WHEN ready THEN 2 WHEN open_job THEN 3 WHEN status = 'active' THEN 4 WHEN status = 'paused' THEN 5 ELSE 6 END AS band FROM {_READY}) ORDER BY band, source_config_id LIMIT 10""")  # fmt: skip
def f07(spark, sf):
    """The ten sources that need a look first, and what to do."""
    s, last = F.col("status"), F.col("last_job")
    band = F.when(s == "failed", 0).when(last == "failed", 1).when(F.col("ready"), 2).when(F.col("open_job"), 3).when(s == "active", 4).when(s == "paused", 5).otherwise(6)
    t = _ready(spark, sf).withColumn("band", band).orderBy("band", "source_config_id").limit(10)
    return t.select("source_config_id", "band", _mapped(last, _HINTS, "enqueue").alias("hint"))


# ---- rollups

_EDGES = f"""(SELECT conflict_type AS kind, primary_claim_id AS a, conflicting_claim_id AS b, created_at FROM {_once('conflicts', 'conflict_id', 'conflict_type, primary_claim_id, conflicting_claim_id, created_at')}
    UNION ALL SELECT 'supersedes', claim_id, supersedes_claim_id, created_at FROM {CLAIMS_SQL} WHERE coalesce(supersedes_claim_id, '') <> '')"""


def _edges(spark, sf) -> DataFrame:
    c = once(spark, sf, "conflicts", "conflict_id", "conflict_type", "primary_claim_id", "conflicting_claim_id", "created_at")
    c = c.select(F.col("conflict_type").alias("kind"), F.col("primary_claim_id").alias("a"), F.col("conflicting_claim_id").alias("b"), "created_at")
    s = claims(spark, sf).where("coalesce(supersedes_claim_id, '') <> ''")
    return c.union(s.select(F.lit("supersedes"), "claim_id", "supersedes_claim_id", "created_at"))


@add("d04_edges", f"""SELECT kind, count(*) AS edges, count(DISTINCT a) AS starts, count(DISTINCT b) AS ends, max(created_at) AS last FROM {_EDGES} GROUP BY ALL""")
def d04(spark, sf):
    return _edges(spark, sf).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("a").alias("starts"), F.count_distinct("b").alias("ends"), F.max("created_at").alias("last"))


@add("d05_tokens", rf"""SELECT source_type, count(*) AS documents, sum(greatest(CAST(ceil(octet_length(encode(coalesce(content, ''))) / 4.0) AS BIGINT),
    len(list_filter(string_split_regex(coalesce(content, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))))::BIGINT AS tokens FROM {DOCS_SQL} GROUP BY ALL""")  # fmt: skip
def d05(spark, sf):
    return documents(spark, sf, "source_type", "content").groupBy("source_type").agg(F.count("*").alias("documents"), F.sum(X.packet_tokens(F.col("content"))).alias("tokens"))


@add("d16_signals", """SELECT event_type AS mode, CASE WHEN value IS NULL THEN 'none' WHEN value < 5 THEN 'weak' WHEN value < 20 THEN 'fair' ELSE 'strong' END AS signal,
    count(*) AS times, count(DISTINCT user_id) AS users, round(sum(value), 4) AS weight FROM events GROUP BY ALL""")  # fmt: skip
def d16(spark, sf):
    v = F.col("value")
    signal = F.when(v.isNull(), "none").when(v < 5, "weak").when(v < 20, "fair").otherwise("strong")
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("mode"), signal.alias("signal"))
    return g.agg(F.count("*").alias("times"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("weight"))


# What a scope should have of each.
TARGETS = {"claims": 20, "documents": 15, "trusted": 10, "addresses": 15}
_WANTED = _case("measure", TARGETS, "0")


@add("d18_coverage", f"""SELECT scope, measure, got, {_WANTED} AS wanted, got >= {_WANTED} AS met FROM (UNPIVOT (
      SELECT scope, coalesce(c, 0) AS claims, coalesce(t, 0) AS trusted, coalesce(d, 0) AS documents, coalesce(u, 0) AS addresses FROM
      (SELECT scope, count(*) AS c, count(*) FILTER (WHERE status IN ('verified', 'inferred')) AS t FROM {CLAIMS_SQL} WHERE scope IS NOT NULL GROUP BY 1) FULL JOIN
      (SELECT scope, count(*) AS d, count(DISTINCT source_url) AS u FROM {DOCS_SQL} WHERE scope IS NOT NULL GROUP BY 1) USING (scope))
    ON claims, trusted, documents, addresses INTO NAME measure VALUE got)""")  # fmt: skip
def d18(spark, sf):
    """Each scope's counts against what it should have; both sides are rolled up before they meet."""
    c = claims(spark, sf).where("scope is not null").groupBy("scope").agg(F.count("*").alias("claims"), F.count_if(R.active_status(F.col("status"))).alias("trusted"))
    d = documents(spark, sf, "scope", "source_url").where("scope is not null").groupBy("scope").agg(F.count("*").alias("documents"), F.count_distinct("source_url").alias("addresses"))
    j = c.join(d, "scope", "full").fillna(0)
    got = j.unpivot("scope", ["claims", "trusted", "documents", "addresses"], "measure", "got")
    wanted = _mapped(F.col("measure"), TARGETS, 0)
    return got.select("scope", "measure", "got", wanted.alias("wanted"), (F.col("got") >= wanted).alias("met"))


_WEIGHTS = {"claim": 10, "quote": 5, "document": 2}  # hundredths


@add("d21_impact", f"""SELECT name, least(1, sum(w) / 100.0::DOUBLE)::DOUBLE AS score, string_agg(DISTINCT why, ',' ORDER BY why) AS reasons FROM (
      SELECT source_url AS name, 'claim' AS why, 10 AS w FROM {CLAIMS_SQL} UNION ALL SELECT source_url, 'document', 2 FROM {DOCS_SQL}
      UNION ALL SELECT source_url, 'quote', 5 FROM {_once('evidence', 'evidence_id', 'source_url')}) WHERE coalesce(name, '') <> ''
    GROUP BY 1 ORDER BY least(1, sum(w) / 100.0::DOUBLE) DESC, name LIMIT 20""")  # fmt: skip
def d21(spark, sf):
    """The addresses that most rests on: what cites each adds up, to 1 at most. There are three reasons, so their set is small."""
    parts = [(claims(spark, sf), "claim"), (documents(spark, sf, "source_url"), "document"), (once(spark, sf, "evidence", "evidence_id", "source_url"), "quote")]
    u = reduce(DataFrame.union, [d.select(F.col("source_url").alias("name"), F.lit(k).alias("why"), F.lit(_WEIGHTS[k]).alias("w")) for d, k in parts])
    g = u.where("coalesce(name, '') <> ''").groupBy("name").agg(F.least(F.lit(1.0), F.sum("w") / 100).alias("score"), F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))
    return g.orderBy(F.desc("score"), "name").limit(20)


# The penalty of each share of bad claims, and from what share on it counts.
PENALTIES = {"dead": (20, 0.25), "unsourced": (15, 0.1), "unsure": (10, 0.2), "old": (25, 0.3)}
_BAD_SQL = {"dead": "status IN ('deprecated', 'expired')", "unsourced": "coalesce(source_url, '') = ''", "unsure": "confidence < 0.5", "old": f"expires_at <= TIMESTAMP '{AS_OF}'"}


@add("d23_health", "SELECT scope, 100 - (" + " + ".join(f"CASE WHEN {k} > {s} THEN {p} ELSE 0 END" for k, (p, s) in PENALTIES.items()) + ") AS score, concat_ws(','," +
     ", ".join(f"CASE WHEN {k} > {s} THEN '{k}' END" for k, (p, s) in PENALTIES.items()) + ") AS signals FROM (SELECT scope, " +
     ", ".join(f"count(*) FILTER (WHERE {c}) / count(*)::DOUBLE AS {k}" for k, c in _BAD_SQL.items()) + f" FROM {CLAIMS_SQL} GROUP BY 1)")
def d23(spark, sf):
    """Each scope's score: 100 less what is wrong with its claims, and what that is."""
    bad = {"dead": F.col("status").isin("deprecated", "expired"), "unsourced": F.coalesce("source_url", F.lit("")) == "", "unsure": F.col("confidence") < 0.5, "old": F.col("expires_at") <= at()}
    g = claims(spark, sf).groupBy("scope").agg(*[(F.count_if(c) / F.count("*")).alias(k) for k, c in bad.items()])
    lost = sum((F.when(F.col(k) > s, p).otherwise(0) for k, (p, s) in PENALTIES.items()), F.lit(0))
    return g.select("scope", (100 - lost).alias("score"), F.concat_ws(",", *[F.when(F.col(k) > s, k) for k, (p, s) in PENALTIES.items()]).alias("signals"))


@add("d27_most_open", """WITH i AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS e FROM events),
    m AS (SELECT event_type, t, sum(d) AS d FROM (SELECT event_type, s AS t, 1 AS d FROM i WHERE e > s UNION ALL SELECT event_type, e, -1 FROM i WHERE e > s) GROUP BY ALL),
    r AS (SELECT event_type, t, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS n FROM m)
    SELECT event_type, max(n)::BIGINT AS most, arg_min(t, (-n, t)) AS at_us FROM r GROUP BY 1""")  # fmt: skip
def d27(spark, sf):
    """The most calls of a kind under way at once; a call lasts as many minutes as its value says."""
    e = table(spark, sf, "events").select("event_type", micros("ts").alias("s"), F.floor("value").alias("n"))
    return most_open(e.withColumn("e", F.col("s") + F.col("n") * 60_000_000), "event_type", "s", "e")


@add("d30_weighted", f"""SELECT scope, round(sum(authority_score * length(content)) / nullif(sum(CASE WHEN authority_score IS NOT NULL THEN length(content) END), 0), 6) AS authority FROM {DOCS_SQL} GROUP BY ALL""")
def d30(spark, sf):
    d, n = documents(spark, sf, "scope", "authority_score", "content"), F.length("content")
    by = F.sum(F.when(F.col("authority_score").isNotNull(), n))
    return d.groupBy("scope").agg(F.round(F.sum(F.col("authority_score") * n) / F.when(by != 0, by), 6).alias("authority"))


@add("d31_runs", f"""SELECT CAST(date_trunc('day', updated_at) AS DATE) AS day, count(*) AS jobs, sum(documents_seen)::BIGINT AS documents, count(*) FILTER (WHERE status = 'failed') AS failed FROM {JOBS_SQL} GROUP BY ALL""")
def d31(spark, sf):
    return jobs(spark, sf).groupBy(F.to_date("updated_at").alias("day")).agg(F.count("*").alias("jobs"), F.sum("documents_seen").alias("documents"), F.count_if(F.col("status") == "failed").alias("failed"))


# ---- searches


@add("h09_documents", f"""SELECT document_id, round(max(s), 6) AS rank_score, count(*) AS chunks FROM (SELECT document_id, {_score_sql('content', QUERY)} AS s
    FROM (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, content FROM chunks)) WHERE s > 0 AND document_id IS NOT NULL GROUP BY 1 ORDER BY max(s) DESC, count(*) DESC, document_id LIMIT 20""")  # fmt: skip
def h09(spark, sf):
    """The twenty documents whose chunks meet a query best."""
    c = once(spark, sf, "chunks", "chunk_id", "document_id", "content").where("document_id is not null")
    c = c.select("document_id", X.text_score(F.col("content"), QUERY).alias("s")).where("s > 0")
    g = c.groupBy("document_id").agg(F.max("s").alias("rank_score"), F.count("*").alias("chunks"))
    return g.orderBy(F.desc("rank_score"), F.desc("chunks"), "document_id").limit(20).withColumn("rank_score", F.round("rank_score", 6))


_MET = f"SELECT claim_id, confidence, {_score_sql('claim_text', QUERY)} AS s FROM {CLAIMS_SQL} WHERE scope = '{SCOPE}'"


@add("h12_linked", f"""WITH met AS (SELECT claim_id FROM ({_MET}) WHERE s > 0),
    far AS (SELECT CASE WHEN a IN (FROM met) THEN b ELSE a END AS claim_id, count(*) AS links FROM {_EDGES} WHERE (a IN (FROM met)) <> (b IN (FROM met)) GROUP BY 1)
    SELECT c.claim_id, links, round(coalesce(confidence, 0) + 0.3 * least(links, 3) / 3.0, 6) AS rank_score FROM far JOIN {CLAIMS_SQL} c ON c.claim_id = far.claim_id""")  # fmt: skip
def h12(spark, sf):
    """Claims that a query does not meet, but that edges tie to ones it meets. Both ends are looked up by joins, never by OR."""
    c = claims(spark, sf)
    met = c.where(F.col("scope") == SCOPE).withColumn("s", X.text_score(F.col("claim_text"), QUERY)).where("s > 0").select("claim_id")
    e = _edges(spark, sf).where("a is not null and b is not null")
    far = lambda a, b: e.select(F.col(a).alias("claim_id"), F.col(b).alias("far")).join(met, "claim_id", "left_semi").select(F.col("far").alias("claim_id"))
    links = far("a", "b").union(far("b", "a")).join(met, "claim_id", "left_anti").groupBy("claim_id").agg(F.count("*").alias("links"))
    score = F.coalesce("confidence", F.lit(0.0)) + F.lit(0.3) * F.least("links", F.lit(3)) / 3.0
    return c.select("claim_id", "confidence").join(links, "claim_id").select("claim_id", "links", F.round(score, 6).alias("rank_score"))


# What a rank gains by the level of a summary, here a document's kind.
LEVELS = {"code": 0.3, "mcp": 0.2, "markdown": 0.15}


@add("h13_summaries", f"""SELECT document_id, round(s + {_case('source_type', LEVELS, '0.1')}::DOUBLE, 6) AS rank_score FROM (
    SELECT d.*, {_score_sql("concat_ws(' ', title, content)", QUERY)} AS s FROM {DOCS_SQL} d WHERE source_config_id IS NULL OR source_config_id NOT IN
      (SELECT source_config_id FROM source_configs WHERE status = 'deleted' AND source_config_id IS NOT NULL)) WHERE s > 0
    ORDER BY s + {_case('source_type', LEVELS, '0.1')}::DOUBLE DESC, document_id LIMIT 20""")  # fmt: skip
def h13(spark, sf):
    """The twenty best documents by title and text with their level's boost; those of deleted sources are hidden."""
    gone = table(spark, sf, "source_configs").where("status = 'deleted'").select("source_config_id")
    d = documents(spark, sf, "source_type", "source_config_id", "title", "content").join(gone, "source_config_id", "left_anti")
    d = d.withColumn("s", X.text_score(F.concat_ws(" ", "title", "content"), QUERY)).where("s > 0")
    d = d.select("document_id", (F.col("s") + _mapped(F.col("source_type"), LEVELS, 0.1)).alias("rank_score"))
    return d.orderBy(F.desc("rank_score"), "document_id").limit(20).withColumn("rank_score", F.round("rank_score", 6))


@add("h14_reranked", f"""SELECT claim_id, round(base, 6) AS base_rank_score, round(base + 0.2 * r, 6) AS rank_score FROM (
      SELECT claim_id, s + {_BOOST} AS base, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 0 ELSE least(greatest(confidence, 0), 1) END AS r
      FROM (SELECT *, {_score_sql('claim_text', QUERY)} AS s FROM {CLAIMS_SQL} WHERE scope = '{SCOPE}') WHERE s > 0 ORDER BY base DESC, claim_id LIMIT 15)
    ORDER BY base + 0.2 * r DESC, claim_id LIMIT 5""")  # fmt: skip
def h14(spark, sf):
    """A pool of three times as many, ranked again by a second score held to [0, 1]; an unusable one is 0."""
    c = claims(spark, sf).where(F.col("scope") == SCOPE).withColumn("s", X.text_score(F.col("claim_text"), QUERY)).where("s > 0")
    c = c.select("claim_id", "confidence", (F.col("s") + R.authority_boost(F.col("authority"))).alias("base")).orderBy(F.desc("base"), "claim_id").limit(15)
    r = F.when(F.col("confidence").isNull() | F.isnan("confidence"), 0.0).otherwise(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    c = c.withColumn("rank_score", F.col("base") + 0.2 * r).orderBy(F.desc("rank_score"), "claim_id").limit(5)
    return c.select("claim_id", F.round("base", 6).alias("base_rank_score"), F.round("rank_score", 6).alias("rank_score"))


# ---- texts


@add("i21_leading_quotes", r"""SELECT document_id, md5(CASE WHEN q <> '' THEN q ELSE h END) AS digest, length(CASE WHEN q <> '' THEN q ELSE h END) AS chars FROM (
    SELECT document_id, left(coalesce(content, ''), 240) AS h, regexp_extract(left(coalesce(content, ''), 240), '(?s)^.{40,}[.\n;]') AS q FROM """ + DOCS_SQL + ")")  # fmt: skip
def i21(spark, sf):
    """The head of each text, up to the last full stop, line end or semicolon after 40 of 240 characters."""
    d = documents(spark, sf, "content").withColumn("h", F.left(F.coalesce("content", F.lit("")), F.lit(240)))
    q = F.regexp_extract("h", r"(?s)^.{40,}[.\n;]", 0)
    return d.withColumn("q", F.when(q != "", q).otherwise(F.col("h"))).select("document_id", F.md5("q").alias("digest"), F.length("q").alias("chars"))


# Other words for a status.
SYNONYMS = {"ok": "verified", "current": "verified", "obsolete": "deprecated", "outdated": "deprecated", "retired": "deprecated", "disputed": "challenged"}


@add("i28_statuses", f"""SELECT {_case('t', SYNONYMS, 't')} AS status, count(*) AS updates, count(*) FILTER (WHERE t <> raw) AS respelt FROM (
    SELECT coalesce(lower(trim(status)), '') AS t, coalesce(status, '') AS raw FROM claim_updates) GROUP BY ALL""")  # fmt: skip
def i28(spark, sf):
    u = table(spark, sf, "claim_updates").select(F.coalesce("status", F.lit("")).alias("raw")).withColumn("t", F.lower(F.trim("raw")))
    return u.groupBy(_mapped(F.col("t"), SYNONYMS, F.col("t")).alias("status")).agg(F.count("*").alias("updates"), F.count_if(F.col("t") != F.col("raw")).alias("respelt"))


@add("i35_repeated", """SELECT user_id, props, count(DISTINCT event_id) AS times FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY ALL HAVING count(DISTINCT event_id) >= 2""")
def i35(spark, sf):
    """The same failure of the same user twice or more."""
    e = table(spark, sf, "events").where("event_type = 'error' and props is not null").select("user_id", "props", "event_id").distinct()
    return e.groupBy("user_id", "props").agg(F.count("event_id").alias("times")).where("times >= 2")


@add("i36_modules", rf"""SELECT CASE WHEN p LIKE 'src/%/%' THEN regexp_extract(p, '^src/[^/]+') ELSE string_split(p, '/')[1] END AS module, count(*) AS documents FROM (
    SELECT regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/*', '') AS p FROM {DOCS_SQL} WHERE source_url IS NOT NULL) GROUP BY ALL""")  # fmt: skip
def i36(spark, sf):
    """Documents by module: what is below ``src``, else the first part of the path."""
    p = documents(spark, sf, "source_url").where("source_url is not null").select(F.regexp_replace("source_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/*", "").alias("p"))
    m = F.when(F.col("p").like("src/%/%"), F.regexp_extract("p", "^src/[^/]+", 0)).otherwise(F.element_at(F.split("p", "/"), 1))
    return p.groupBy(m.alias("module")).agg(F.count("*").alias("documents"))


# ---- mutations


@add("j04_refreshing", f"""SELECT source_config_id, CASE WHEN hit THEN 'deprecated' ELSE status END AS status, count(*) AS claims, round(sum(CASE WHEN hit THEN 0 ELSE confidence END), 4) AS confidence FROM (
    SELECT *, coalesce(source_config_id IN (SELECT source_config_id FROM source_configs WHERE source_type = 'markdown'), false) AND status IN ('verified', 'inferred') AS hit FROM {CLAIMS_SQL}) GROUP BY ALL""")  # fmt: skip
def j04(spark, sf):
    """The claims after a refresh of all markdown sources has begun: their trusted claims wait, deprecated and at confidence 0."""
    s = table(spark, sf, "source_configs").where("source_type = 'markdown'").select("source_config_id", F.lit(True).alias("of_it"))
    c = salted_left_join(claims(spark, sf).select("claim_id", "source_config_id", "status", "confidence"), s, "source_config_id", F.col("claim_id"))
    hit = F.coalesce("of_it", F.lit(False)) & R.active_status(F.col("status"))
    return c.groupBy("source_config_id", F.when(hit, "deprecated").otherwise(F.col("status")).alias("status")).agg(
        F.count("*").alias("claims"), F.round(F.sum(F.when(hit, 0.0).otherwise(F.col("confidence"))), 4).alias("confidence"))


@add("j09_entities", f"""SELECT lower(trim(title)) AS name, max(authority_score) AS authority_score, arg_max(source_url, (ingested_at, document_id)) FILTER (WHERE source_url IS NOT NULL AND ingested_at IS NOT NULL) AS source_url,
    count(*) AS mentions FROM {DOCS_SQL} WHERE trim(coalesce(title, '')) <> '' GROUP BY 1""")  # fmt: skip
def j09(spark, sf):
    """Names merged regardless of letter case: the greatest score, the last known address."""
    d = documents(spark, sf, "title", "authority_score", "source_url", "ingested_at").where("trim(coalesce(title, '')) <> ''")
    last = F.max_by("source_url", F.when(F.col("source_url").isNotNull() & F.col("ingested_at").isNotNull(), F.struct("ingested_at", "document_id")))
    return d.groupBy(F.lower(F.trim("title")).alias("name")).agg(F.max("authority_score").alias("authority_score"), last.alias("source_url"), F.count("*").alias("mentions"))


@add("j10_challenged", f"""SELECT c.claim_id, n AS detections, round(greatest(0, confidence - 0.25 * n), 6) AS confidence FROM {CLAIMS_SQL} c JOIN (
    SELECT unnest([primary_claim_id, conflicting_claim_id]) AS k, count(*) AS n FROM {_once('conflicts', 'conflict_id', 'primary_claim_id, conflicting_claim_id')} GROUP BY 1) x ON x.k = c.claim_id""")  # fmt: skip
def j10(spark, sf):
    """Claims that conflicts name on either side: each detection takes a quarter of confidence, down to 0."""
    c = once(spark, sf, "conflicts", "conflict_id", "primary_claim_id", "conflicting_claim_id")
    n = c.select(F.explode(F.array("primary_claim_id", "conflicting_claim_id")).alias("claim_id")).where("claim_id is not null").groupBy("claim_id").agg(F.count("*").alias("detections"))
    left = F.greatest(F.lit(0.0), F.col("confidence") - 0.25 * F.col("detections"))
    return claims(spark, sf).select("claim_id", "confidence").join(n, "claim_id").select("claim_id", "detections", F.round(F.when(F.col("confidence").isNull(), 0.0).otherwise(left), 6).alias("confidence"))


@add("k04_finished", f"""SELECT job_id, CASE WHEN status <> 'failed' THEN status WHEN attempts < max_attempts THEN 'retry' ELSE 'failed' END AS next_status,
    CASE WHEN status = 'failed' AND attempts < max_attempts THEN CAST(least(900, 30 * pow(2, attempts - 1)) AS BIGINT) END AS wait_s FROM {JOBS_SQL}""")  # fmt: skip
def k04(spark, sf):
    """What becomes of each job: a failed one is tried again after 30 s, then twice as long, 900 s at most, while attempts are left."""
    again = (F.col("status") == "failed") & (F.col("attempts") < F.col("max_attempts"))
    wait = F.least(F.lit(900), 30 * F.pow(F.lit(2), F.col("attempts") - 1)).cast("bigint")
    return jobs(spark, sf).select("job_id", F.when(again, "retry").otherwise(F.col("status")).alias("next_status"), F.when(again, wait).alias("wait_s"))


# ---- chunks, names and relations


@add("i01_chunks")
def i01(spark, sf):
    """The chunks that every document is cut into; texts are whole, and each leaves the JVM once."""
    d = spread(documents(spark, sf, "content"))
    c = d.select("document_id", F.posexplode(chunked(F.col("content"))).alias("chunk_index", "content"))
    return c.select("document_id", "chunk_index", F.octet_length("content").alias("bytes"), F.md5("content").alias("digest"))


@add("h08_hybrid_chunks", f"""WITH ch AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, chunk_index, content, embedding FROM chunks),
    q AS (SELECT embedding::DOUBLE[] AS v FROM chunks WHERE embedding IS NOT NULL AND len(embedding) = 48 ORDER BY chunk_id LIMIT 1),
    c AS (SELECT ch.*, d.ingested_at, {_score_sql('ch.content', QUERY)} AS text_score,
        CASE WHEN len(embedding) = 48 AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0
             THEN coalesce(greatest(0, list_cosine_similarity(embedding::DOUBLE[], q.v)), 0) ELSE 0 END AS vector_score
      FROM ch JOIN {DOCS_SQL} d ON d.document_id = ch.document_id CROSS JOIN q WHERE d.status <> 'deleted'),
    pool AS (SELECT * FROM (SELECT * FROM c WHERE text_score > 0 ORDER BY text_score DESC, chunk_id LIMIT 30) UNION
             SELECT * FROM (SELECT * FROM c WHERE vector_score > 0 ORDER BY vector_score DESC, chunk_id LIMIT 30))
    SELECT chunk_id, document_id, round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score, round(text_score + 0.45 * vector_score, 6) AS rank_score
    FROM pool ORDER BY text_score + 0.45 * vector_score DESC, ingested_at DESC, chunk_index, chunk_id LIMIT 10""")  # fmt: skip
def h08(spark, sf):
    c = once(spark, sf, "chunks", "chunk_id", "document_id", "chunk_index", "content", "embedding")
    q = table(spark, sf, "chunks").where(F.size("embedding") == 48).orderBy("chunk_id").select("embedding").first()
    out = R.recall_chunks_hybrid(c, documents(spark, sf, "ingested_at", "status"), QUERY, list(q[0]) if q else [1.0] * 48, 10)
    return out.select("chunk_id", "document_id", *[F.round(x, 6).alias(x) for x in ("text_score", "vector_score", "rank_score")])


_STEM = r"([^/]+?)(?:\.[A-Za-z]+)?/*$"


@add("h17_resolved", rf"""WITH n AS (SELECT lower(trim(title)) AS name, 0 AS alias, authority_score, document_id FROM {DOCS_SQL} UNION ALL
      SELECT lower(regexp_extract(source_url, '{_STEM}', 1)), 1, authority_score, document_id FROM {DOCS_SQL}),
    asked AS (SELECT DISTINCT lower(trim(title)) AS name FROM document_snapshots UNION SELECT lower(regexp_extract(source_url, '{_STEM}', 1)) FROM document_snapshots)
    SELECT DISTINCT ON (name) name, document_id, alias = 1 AS by_alias FROM n JOIN asked USING (name) WHERE name <> '' ORDER BY name, alias, coalesce(authority_score, 0) DESC, document_id""")  # fmt: skip
def h17(spark, sf):
    """The document that each name stands for: by title first, then by file name; then the greater authority. One aggregation, no window."""
    d = documents(spark, sf, "title", "source_url", "authority_score")
    stem = F.lower(F.regexp_extract("source_url", _STEM, 1))
    far = -F.coalesce("authority_score", F.lit(0.0))
    names = F.array(F.struct(F.lower(F.trim("title")).alias("name"), F.lit(0).alias("alias")), F.struct(stem.alias("name"), F.lit(1).alias("alias")))
    n = d.select(F.explode(names).alias("n"), far.alias("far"), "document_id").where("n.name <> ''")
    best = n.groupBy("n.name").agg(F.min(F.struct("n.alias", "far", "document_id")).alias("b"))
    asked = table(spark, sf, "document_snapshots").select(F.explode(F.array(F.lower(F.trim("title")), stem)).alias("name")).distinct()
    return best.join(asked, "name", "left_semi").select("name", "b.document_id", (F.col("b.alias") == 1).alias("by_alias"))


@add("i17_relation_conflicts", f"""SELECT src, dst, count(*) FILTER (WHERE type <> 'should_not_use') AS kinds_for, sum(mentions)::BIGINT AS mentions,
    CASE WHEN bool_or(type = 'should_use') THEN 'high' ELSE 'medium' END AS severity FROM ({retrieval.sql['i12_relations']})
    WHERE type IN ('should_use', 'uses', 'should_not_use') GROUP BY ALL HAVING bool_or(type = 'should_not_use') AND bool_or(type <> 'should_not_use')""")  # fmt: skip
def i17(spark, sf):
    """Names that some claims say to use and others not to use: one row per pair of names."""
    no = F.col("type") == "should_not_use"
    r = i12(spark, sf).where(F.col("type").isin("should_use", "uses", "should_not_use")).groupBy("src", "dst").agg(
        F.count_if(~no).alias("kinds_for"), F.count_if(no).alias("_no"), F.sum("mentions").alias("mentions"),
        F.when(F.bool_or(F.col("type") == "should_use"), "high").otherwise("medium").alias("severity"))
    return r.where("_no > 0 and kinds_for > 0").drop("_no")


@add("i30_instants", """SELECT form, count(*) AS texts, count(t) AS read, count(*) FILTER (WHERE t = whole) AS exact FROM (
    SELECT form, whole, CASE form WHEN 'second' THEN date_trunc('second', ts) WHEN 'day' THEN date_trunc('day', ts) END AS t FROM (
      SELECT ts, date_trunc('second', ts) AS whole, CASE event_id % 3 WHEN 0 THEN 'second' WHEN 1 THEN 'day' ELSE 'other' END AS form FROM events)) GROUP BY ALL""")  # fmt: skip
def i30(spark, sf):
    """Instants written as text and read again."""
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    e = table(spark, sf, "events").select(F.when(k == 0, "second").when(k == 1, "day").otherwise("other").alias("form"), instant(text).alias("t"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("whole"))
    return e.groupBy("form").agg(F.count("*").alias("texts"), F.count("t").alias("read"), F.count_if(F.col("t") == F.col("whole")).alias("exact"))


# ---- more of the store


@add("b16_citing", f"""SELECT scope, count(*) AS claims FROM {CLAIMS_SQL} c JOIN (SELECT claim_id, array_agg(DISTINCT source_url) AS urls FROM evidence WHERE claim_id IS NOT NULL GROUP BY 1) e
    ON e.claim_id = c.claim_id WHERE list_contains(urls, 'manual://note') GROUP BY ALL""")  # fmt: skip
def b16(spark, sf):
    """Claims whose citations contain an address: as a semi-join, so no claim's citations are ever collected."""
    e = table(spark, sf, "evidence").where("source_url = 'manual://note'").select("claim_id").distinct()
    return claims(spark, sf).join(e, "claim_id", "left_semi").groupBy("scope").agg(F.count("*").alias("claims"))


@add("d25_passed", f"SELECT scope, round(avg(CASE WHEN met THEN 1 ELSE 0 END), 6) AS share, count(*) FILTER (WHERE NOT met) AS failed FROM ({registry.sql['d18_coverage']}) GROUP BY ALL")
def d25(spark, sf):
    return d18(spark, sf).groupBy("scope").agg(F.round(F.avg(F.col("met").cast("int")), 6).alias("share"), F.count_if(~F.col("met")).alias("failed"))


@add("e02_first_of_address", f"""SELECT source_url, document_id, nth FROM (SELECT source_url, document_id, row_number() OVER (PARTITION BY source_url ORDER BY ingested_at, document_id) AS nth
    FROM {DOCS_SQL} WHERE source_url IS NOT NULL AND ingested_at IS NOT NULL) WHERE nth <= 2""")  # fmt: skip
def e02(spark, sf):
    """The first two documents of each address; the limit is applied before the shuffle as well."""
    d = documents(spark, sf, "source_url", "ingested_at").where("source_url is not null and ingested_at is not null")
    nth = F.row_number().over(Window.partitionBy("source_url").orderBy("ingested_at", "document_id"))
    return d.withColumn("nth", nth).where("nth <= 2").select("source_url", "document_id", "nth")


@add("j03_inserted", f"""SELECT c.claim_id, CASE WHEN c.status = 'deprecated' AND coalesce(u.status, '') NOT IN ('verified', 'inferred') THEN c.status ELSE coalesce(u.status, c.status) END AS status,
      round(greatest(c.confidence, u.confidence), 6) AS confidence FROM {CLAIMS_SQL} c JOIN (SELECT claim_id, arg_max({{'status': nullif(lower(trim(status)), ''), 'confidence': confidence}}, (received_at, update_id)) AS u
      FROM claim_updates WHERE claim_id IS NOT NULL AND received_at IS NOT NULL AND update_id IS NOT NULL GROUP BY 1) ON c.claim_id = claim_id_1""".replace("SELECT claim_id, arg_max", "SELECT claim_id AS claim_id_1, arg_max"))
def j03(spark, sf):
    """Claims after the last update of each has been put in: a deprecated one wakes only for a trusted status; the greater confidence stays."""
    u = table(spark, sf, "claim_updates").where("claim_id is not null and received_at is not null and update_id is not null")
    s = F.lower(F.trim("status"))
    u = u.groupBy("claim_id").agg(F.max_by(F.struct(F.when(s != "", s).alias("status"), "confidence"), F.struct("received_at", "update_id")).alias("u"))
    j = claims(spark, sf).select("claim_id", "status", "confidence").join(u, "claim_id")
    stays = (F.col("status") == "deprecated") & ~F.coalesce(F.col("u.status"), F.lit("")).isin("verified", "inferred")
    status = F.when(stays, F.col("status")).otherwise(F.coalesce("u.status", "status"))
    return j.select("claim_id", status.alias("status"), F.round(F.greatest("confidence", "u.confidence"), 6).alias("confidence"))


@add("j06_evidence_once", """SELECT claim_id, count(*) AS given, count(DISTINCT sha256(concat_ws('|', coalesce(document_id, ''), coalesce(quote, '')))) AS kept FROM evidence WHERE claim_id IS NOT NULL GROUP BY ALL""")
def j06(spark, sf):
    """How much evidence of each claim was given, and how much of it is new: by hash, added up before a hot claim's rows meet."""
    h = F.sha2(F.concat_ws("|", F.coalesce("document_id", F.lit("")), F.coalesce("quote", F.lit(""))), 256)
    e = table(spark, sf, "evidence").where("claim_id is not null").groupBy("claim_id", h.alias("h")).agg(F.count("*").alias("n"))
    return e.groupBy("claim_id").agg(F.sum("n").alias("given"), F.count("*").alias("kept"))


@add("k03_enqueued", f"""SELECT source_config_id FROM (SELECT r.source_config_id, s.authority_score FROM {_READY} r JOIN source_configs s USING (source_config_id) WHERE ready)
    ORDER BY coalesce(authority_score, 0) DESC, source_config_id LIMIT 10""")  # fmt: skip
def k03(spark, sf):
    """The sources whose next job is queued, ten a round at most."""
    s = table(spark, sf, "source_configs").select("source_config_id", F.coalesce("authority_score", F.lit(0.0)).alias("p"))
    return _ready(spark, sf).where("ready").join(s, "source_config_id").orderBy(F.desc("p"), "source_config_id").limit(10).select("source_config_id")


@add("k11_pruned", f"""SELECT source, count(*) AS windows, count(*) FILTER (WHERE w < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 25 HOUR) AS pruned FROM (
    SELECT DISTINCT source, date_trunc('hour', updated_at) AS w FROM {JOBS_SQL}) GROUP BY ALL""")  # fmt: skip
def k11(spark, sf):
    """Hourly windows of each source, and those that ended over a day ago and go."""
    w = jobs(spark, sf).select("source", F.date_trunc("hour", "updated_at").cast("timestamp_ntz").alias("w")).distinct()
    old = micros("w") < micros(at(AS_OF_EVENTS)) - F.lit(25 * 3_600_000_000)
    return w.groupBy("source").agg(F.count("*").alias("windows"), F.count_if(old).alias("pruned"))
