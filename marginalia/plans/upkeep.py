
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import entities as E
from marginalia.functions import text as X
from marginalia.functions.temporal import policy_seconds, schedule_seconds
from marginalia.operators import upkeep as U
from marginalia.plans import Registry
from marginalia.plans.store import AS_OF, AS_OF_EVENTS, CLAIMS_SQL, DOCS_SQL, JOBS_SQL, at, claims, documents, jobs, once
from marginalia.session import shared_dir
from marginalia.sources import transcripts as T
from marginalia.sources.jsonl import read_jsonl, without_lineage
from marginalia.sources.tables import micros, table

registry = Registry()
add = registry.add


# ---- mutations


@add("j02_replaced", f"""WITH new AS (SELECT document_id, document_id || '#' || (nth - 1) AS chunk_id, part AS content FROM (
      SELECT document_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS nth FROM (
        SELECT document_id, list_filter(string_split(replace(content, chr(13), ''), chr(10) || chr(10)), lambda x: trim(x) <> '') AS parts FROM {DOCS_SQL} WHERE status = 'stale' AND content IS NOT NULL))),
    old AS (SELECT DISTINCT ON (chunk_id) document_id, chunk_id, content FROM (SELECT chunk_id, min(document_id) AS document_id, min(content) AS content FROM chunks GROUP BY 1)),
    next AS (SELECT * FROM old WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT document_id, chunk_id, content FROM new)
    SELECT document_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars, count(*) FILTER (WHERE contains(chunk_id, '#')) AS fresh FROM next GROUP BY 1""")  # fmt: skip
def j02(spark, sf):
    """Chunks after stale documents were cut anew at blank lines: theirs are replaced, the others stay."""
    parts = F.filter(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n\n"), lambda x: F.trim(x) != "")
    d = documents(spark, sf, "content", "status").where("status = 'stale' AND content IS NOT NULL").select("document_id", F.posexplode(parts).alias("n", "content"))
    new = d.select("document_id", F.concat("document_id", F.lit("#"), F.col("n").cast("string")).alias("chunk_id"), "content")
    old = table(spark, sf, "chunks").groupBy("chunk_id").agg(F.min("document_id").alias("document_id"), F.min("content").alias("content"))
    c = U.replaced(old, new, "document_id").groupBy("document_id")
    return c.agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.count_if(F.contains("chunk_id", F.lit("#"))).alias("fresh"))


@add("j05_refreshed", f"""WITH a AS (SELECT DISTINCT source_url FROM {DOCS_SQL} WHERE status = 'stale' AND source_url IS NOT NULL),
    e AS (SELECT evidence_id, min(source_url) AS source_url, min(claim_id) AS claim_id FROM evidence GROUP BY 1),
    s AS (SELECT DISTINCT claim_id AS summary, source_url FROM e WHERE claim_id IS NOT NULL AND source_url IS NOT NULL)
    SELECT 'edges' AS what, count(*) FILTER (WHERE coalesce(source_url, '') NOT IN (SELECT source_url FROM a)) AS kept, count(*) FILTER (WHERE source_url IN (SELECT source_url FROM a)) AS gone FROM e
    UNION ALL SELECT 'summaries', count(DISTINCT summary) FILTER (WHERE summary NOT IN (SELECT summary FROM s WHERE source_url IN (SELECT source_url FROM a))),
      count(DISTINCT summary) FILTER (WHERE summary IN (SELECT summary FROM s WHERE source_url IN (SELECT source_url FROM a))) FROM s""")  # fmt: skip
def j05(spark, sf):
    """Evidence as edges and claims as summaries of the addresses that they cite, when stale documents are read anew."""
    e = table(spark, sf, "evidence").groupBy("evidence_id").agg(F.min("source_url").alias("source_url"), F.min("claim_id").alias("claim_id")).withColumn("status", F.lit("active"))
    s = e.where("claim_id IS NOT NULL AND source_url IS NOT NULL").select(F.col("claim_id").alias("summary"), "source_url").distinct()
    edges, kept = U.refreshed(e, s, documents(spark, sf, "source_url", "status").where("status = 'stale'"))
    gone = F.count_if(F.col("status") == "deprecated")
    a = edges.agg((F.count("*") - gone).alias("kept"), gone.alias("gone")).select(F.lit("edges").alias("what"), "kept", "gone")
    n = s.select("summary").distinct().withColumn("was", F.lit(1)).join(kept.select("summary").distinct().withColumn("is", F.lit(1)), "summary", "left")
    return a.unionByName(n.agg(F.count("is").alias("kept"), (F.count("was") - F.count("is")).alias("gone")).select(F.lit("summaries").alias("what"), "kept", "gone"))


@add("j08_forgotten", f"""WITH r AS (SELECT conflicting_claim_id AS claim_id, bool_or(severity IN ('high', 'blocking')) AS permanent FROM conflicts WHERE status = 'resolved' AND conflicting_claim_id IS NOT NULL GROUP BY 1)
    SELECT c.scope, CASE WHEN r.claim_id IS NOT NULL THEN 'deprecated' ELSE c.status END AS status, count(*) AS claims,
      count(CASE WHEN NOT coalesce(r.permanent, false) AND c.confidence > 0.5 THEN 1 END) AS can_wake FROM {CLAIMS_SQL} c LEFT JOIN r USING (claim_id) GROUP BY ALL""")  # fmt: skip
def j08(spark, sf):
    """Claims after those that lost a conflict were forgotten, for good where it was severe."""
    r = table(spark, sf, "conflicts").where("status = 'resolved'").select(F.col("conflicting_claim_id").alias("claim_id"), F.col("severity").isin("high", "blocking").alias("permanent"))
    c = claims(spark, sf).select("claim_id", "scope", "status", F.when(F.col("confidence") > 0.5, "reactivate").alias("tag"))
    return U.forgotten(c, r).groupBy("scope", "status").agg(F.count("*").alias("claims"), F.count("tag").alias("can_wake"))


@add("j11_resolved", f"""WITH c AS (SELECT conflict_id, min(status) AS status, min(severity) AS severity, min(created_at) AS created_at FROM conflicts WHERE conflict_id IS NOT NULL GROUP BY 1),
    v AS (SELECT *, CASE severity WHEN 'low' THEN 'suppressed' WHEN 'medium' THEN 'resolved' WHEN 'high' THEN 'reviewing' END AS to_ FROM c WHERE created_at < TIMESTAMP '{AS_OF}')
    SELECT c.conflict_id, coalesce(v.to_, c.status) AS status, CASE WHEN v.to_ IS NOT NULL THEN CASE WHEN v.to_ IN ('resolved', 'suppressed') THEN 'by age' END WHEN c.status IN ('resolved', 'suppressed') THEN 'before' END AS resolution,
      CASE WHEN v.to_ IN ('resolved', 'suppressed') THEN v.created_at + INTERVAL 1 DAY END AS resolved_at FROM c LEFT JOIN v USING (conflict_id)""")  # fmt: skip
def j11(spark, sf):
    """Conflicts after a verdict on the older ones."""
    c = table(spark, sf, "conflicts").where("conflict_id IS NOT NULL").groupBy("conflict_id").agg(*[F.min(x).alias(x) for x in ("status", "severity", "created_at")])
    c = c.withColumns({"resolution": F.when(F.col("status").isin("resolved", "suppressed"), "before"), "resolved_at": F.lit(None).cast("timestamp_ntz")})
    to = F.when(F.col("severity") == "low", "suppressed").when(F.col("severity") == "medium", "resolved").when(F.col("severity") == "high", "reviewing")
    v = c.where(F.col("created_at") < at()).select("conflict_id", to.alias("to"), F.lit("by age").alias("note"), (F.col("created_at").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("at"))
    return U.resolved(c, v).select("conflict_id", "status", "resolution", "resolved_at")


def _summary(when: str) -> str:
    return f"""SELECT scope, source_type, count(*) AS documents, count(DISTINCT source_url) AS addresses, max(authority) AS authority, max(CASE WHEN status = 'stale' THEN 'yes' END) AS stale
      FROM {DOCS_SQL} WHERE ingested_at {when} TIMESTAMP '{AS_OF}' GROUP BY ALL"""


@add("j12_summaries", f"""WITH o AS ({_summary('<')}), n AS ({_summary('>=')})
    SELECT coalesce(n.scope, o.scope) AS scope, coalesce(n.source_type, o.source_type) AS source_type, CASE WHEN n.documents IS NOT NULL THEN n.documents ELSE o.documents END AS documents,
      CASE WHEN n.documents IS NOT NULL THEN n.addresses ELSE o.addresses END AS addresses, coalesce(n.authority, o.authority) AS authority, coalesce(n.stale, o.stale) AS stale
    FROM o FULL JOIN n ON o.scope IS NOT DISTINCT FROM n.scope AND o.source_type IS NOT DISTINCT FROM n.source_type""")  # fmt: skip
def j12(spark, sf):
    """Summaries by scope and kind, old ones overwritten by newer, their metadata merged."""
    d = documents(spark, sf, "scope", "source_type", "source_url", "authority", "status", "ingested_at")

    def summaries(x: DataFrame) -> DataFrame:
        g = x.groupBy("scope", "source_type").agg(
            F.count("*").alias("documents"), F.count_distinct("source_url").alias("addresses"), F.max("authority").alias("a"), F.max(F.when(F.col("status") == "stale", "yes")).alias("s")
        )
        some = F.filter(F.array(F.struct(F.lit("authority").alias("k"), F.col("a").alias("v")), F.struct(F.lit("stale").alias("k"), F.col("s").alias("v"))), lambda e: e["v"].isNotNull())
        return g.withColumn("metadata", F.map_from_entries(some)).drop("a", "s")

    m = U.merged_summaries(summaries(d.where(F.col("ingested_at") < at())), summaries(d.where(F.col("ingested_at") >= at())), ["scope", "source_type"])
    return m.select("scope", "source_type", "documents", "addresses", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("authority", "stale")])


_OBSERVED = """(SELECT user_id, event_type, count(*) AS times, CASE WHEN event_type = 'click' THEN 'raw' WHEN event_type = 'view' THEN 'challenged' WHEN event_type = 'purchase' THEN 'accepted' ELSE 'rejected' END AS status
    FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL)"""


@add("j13_observations", f"""SELECT status_before, status, refused, count(*) AS observations, sum(times)::BIGINT AS times, min(proposal_id) AS first_proposal FROM (
    SELECT o.status AS status_before, CASE WHEN p.pid IS NOT NULL AND o.status IN ('raw', 'challenged') THEN 'proposed' ELSE o.status END AS status,
      p.pid IS NOT NULL AND o.status IN ('accepted', 'rejected') AS refused, times, CASE WHEN o.status IN ('raw', 'challenged') THEN p.pid END AS proposal_id
    FROM {_OBSERVED} o LEFT JOIN (SELECT user_id, min(event_id) AS pid FROM events WHERE event_id % 97 = 0 GROUP BY 1) p USING (user_id)) GROUP BY ALL""")  # fmt: skip
def j13(spark, sf):
    """Repeated observations as one each, and what becomes of them when proposals rest on them."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type").distinct()
    t = F.col("event_type")
    kind = F.when(t == "click", "raw").when(t == "view", "challenged").when(t == "purchase", "accepted").otherwise("rejected")
    o = e.groupBy("user_id", "event_type").agg(F.count("*").alias("times")).withColumns({"status": kind, "status_before": kind, "proposal_id": F.lit(None).cast("bigint")})
    p = table(spark, sf, "events").where("event_id % 97 = 0").select("user_id", F.col("event_id").alias("proposal_id"))
    return U.linked(o, p, "user_id").groupBy("status_before", "status", "refused").agg(F.count("*").alias("observations"), F.sum("times").alias("times"), F.min("proposal_id").alias("first_proposal"))


@add("j17_marks", f"""WITH r AS (SELECT source, updated_at AS moment, status = 'succeeded' AS ok, documents_seen < 5 AS drained FROM {JOBS_SQL} WHERE status IN ('succeeded', 'failed')),
    m AS (SELECT source, max(moment) FILTER (WHERE ok AND drained) AS last_success_at, max(moment) FILTER (WHERE NOT ok) AS last_error_at FROM r GROUP BY 1)
    SELECT m.*, (SELECT count(*) FROM r WHERE r.source = m.source AND NOT ok AND (last_success_at IS NULL OR moment > last_success_at)) AS errors_since FROM m""")  # fmt: skip
def j17(spark, sf):
    """When each source last succeeded with all it had, when it last failed, and how often since."""
    r = jobs(spark, sf).where(F.col("status").isin("succeeded", "failed"))
    return U.source_marks(r.select("source", F.col("updated_at").alias("at"), (F.col("status") == "succeeded").alias("ok"), (F.col("documents_seen") < 5).alias("drained")))


@add("j21_code_claims", f"""SELECT status, count(*) AS claims FROM (
    SELECT CASE WHEN EXISTS (SELECT 1 FROM {DOCS_SQL} d WHERE d.source_type IN ('code', 'git') AND d.scope = c.scope AND d.source_url = c.source_url) THEN 'deprecated' ELSE c.status END AS status FROM {CLAIMS_SQL} c) GROUP BY 1""")  # fmt: skip
def j21(spark, sf):
    d = documents(spark, sf, "scope", "source_url", "source_type").withColumn("is_code", F.col("source_type").isin("code", "git"))
    return U.retired_code_claims(claims(spark, sf).select("claim_id", "scope", "source_url", "status"), d).groupBy("status").agg(F.count("*").alias("claims"))


@add("j25_requests", f"""SELECT status_before, action, status, done, count(*) AS jobs, sum(max_attempts)::BIGINT AS attempts_allowed FROM (
    SELECT status AS status_before, CASE job_id % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'cancel' END AS action,
      CASE WHEN job_id % 3 = 0 AND status IN ('failed', 'canceled') THEN 'queued' WHEN job_id % 3 = 1 AND status IN ('queued', 'retry') THEN 'canceled' ELSE status END AS status,
      CASE WHEN job_id % 3 = 0 THEN status IN ('failed', 'canceled') WHEN job_id % 3 = 1 THEN status IN ('queued', 'retry') END AS done,
      CASE WHEN job_id % 3 = 0 AND status IN ('failed', 'canceled') THEN greatest(max_attempts, attempts + 1) ELSE max_attempts END AS max_attempts FROM {JOBS_SQL}) GROUP BY ALL""")  # fmt: skip
def j25(spark, sf):
    """Jobs after a third of them was asked to run again and a third to stop."""
    j = jobs(spark, sf)
    action = F.when(F.col("job_id") % 3 == 0, "retry").when(F.col("job_id") % 3 == 1, "cancel")
    done = U.job_requests(j.withColumns({"status_before": F.col("status"), "action": action}), j.select("job_id", action.alias("action")))
    return done.groupBy("status_before", "action", "status", "done").agg(F.count("*").alias("jobs"), F.sum("max_attempts").alias("attempts_allowed"))


@add("i31_backoff", f"SELECT attempts, least(900, 30 * CAST(pow(2, attempts - 1) AS BIGINT))::BIGINT AS seconds, count(*) AS jobs FROM {JOBS_SQL} GROUP BY ALL")
def i31(spark, sf):
    return jobs(spark, sf).groupBy("attempts", U.backoff_seconds(F.col("attempts")).alias("seconds")).agg(F.count("*").alias("jobs"))


# ---- names in texts

_IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_AROUND = E.AROUND.replace("'", "''")
_CANON = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '{_AROUND}', '', 'g'), '{E.ARTICLES}', ''), '\s+', ' ', 'g'), '{_AROUND}', '', 'g')"
_P = "string_split(lower(replace({}, '-', ' ')), ' ')"
_NAMED = rf"""(SELECT DISTINCT document_id, lower(name) AS name FROM (
      SELECT document_id, {_CANON('x')} AS name FROM (SELECT document_id, unnest(regexp_extract_all(content, '{E.TICKED}', 1)) AS x FROM t)
      UNION ALL SELECT document_id, name FROM (SELECT document_id, {_CANON('x')} AS name FROM (SELECT document_id, unnest(regexp_extract_all(content, '{E.PHRASE}')) AS x FROM t) WHERE regexp_matches(x, '^[A-Z]'))
        WHERE lower(name) IN {_IN(E.TECHNOLOGIES)} OR {_P.format('name')}[-1] IN {_IN(E.SUFFIXES)} OR (NOT regexp_matches(name, '[a-z]') AND regexp_matches(name, '[A-Z][^A-Z]*[A-Z]'))
          OR (len({_P.format('name')}) > 1 AND list_has_any({_P.format('name')}, {_LIST(E.SUFFIXES + E.TECHNOLOGIES)}))) WHERE octet_length(encode(name)) >= 2)"""
_TEXTS = f"t AS (SELECT document_id, coalesce(title, '') || '. ' || coalesce(content, '') AS content FROM {DOCS_SQL})"


def _texts(spark, sf) -> DataFrame:
    d = documents(spark, sf, "title", "content")
    return d.select("document_id", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit(""))).alias("content"))


@add("i14_merged", f"""WITH {_TEXTS}, m AS (SELECT name, count(*) AS mentions FROM {_NAMED} GROUP BY 1)
    SELECT name, mentions, round(0.5::DOUBLE + 0.05::DOUBLE * least(mentions, 5), 6) AS confidence,
      CASE WHEN {_P.format('name')}[-1] IN {_IN(E.TYPES['team'])} THEN 'team' WHEN {_P.format('name')}[-1] IN {_IN(E.TYPES['service'])} THEN 'service' WHEN {_P.format('name')}[-1] IN {_IN(E.TYPES['system'])} THEN 'system'
        WHEN name IN {_IN(E.TECHNOLOGIES)} OR list_has_any({_P.format('name')}, {_LIST(E.TECHNOLOGIES)}) THEN 'technology' ELSE 'unknown' END AS type FROM m""")  # fmt: skip
def i14(spark, sf):
    """The names in all documents, each once, with its type, how many documents speak of it, and how sure that makes it."""
    n = _texts(spark, sf).select(F.explode(E.entity_names(F.col("content"))).alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))
    return n.select("name", "mentions", F.round(0.5 + 0.05 * F.least("mentions", F.lit(5)), 6).alias("confidence"), E.entity_type(F.col("name")).alias("type"))


_LISTED = r"(?i)(team-[a-z]+)\s+(uses|owns)\s+([a-z][a-z0-9-]*(?:(?:\s*,\s*|\s*,?\s+and\s+|\s*,?\s+or\s+)(?:its\s+|the\s+)?[a-z][a-z0-9-]*)*)"
_INSTEAD = r"(?i)(team-[a-z]+)\s+uses\s+[a-z][a-z0-9-]*\s+instead\s+of\s+([a-z][a-z0-9-]*)"
_SPLIT = r"(?i)\s*,\s*|\s*,?\s+(?:and|or)\s+"


@add("i12_listed", rf"""SELECT type, src, dst, count(DISTINCT claim_id) AS mentions, min(claim_id) AS first_claim FROM (
    SELECT claim_id, lower(regexp_extract(claim_text, '{_LISTED}', 2)) AS type, lower(regexp_extract(claim_text, '{_LISTED}', 1)) AS src,
      regexp_replace(lower(unnest(regexp_split_to_array(regexp_extract(claim_text, '{_LISTED}', 3), '{_SPLIT}'))), '^(its|the) ', '') AS dst FROM {CLAIMS_SQL} WHERE regexp_matches(claim_text, '{_LISTED}')
    UNION ALL SELECT claim_id, 'avoids', lower(regexp_extract(claim_text, '{_INSTEAD}', 1)), lower(regexp_extract(claim_text, '{_INSTEAD}', 2)) FROM {CLAIMS_SQL} WHERE regexp_matches(claim_text, '{_INSTEAD}'))
    WHERE dst <> '' GROUP BY ALL""")  # fmt: skip
def i12_listed(spark, sf):
    """What teams use and own, each name of a list by itself, and what they use something else instead of; of each relation the first claim."""
    c = claims(spark, sf).select("claim_id", "claim_text")
    part = lambda p, i: F.lower(F.regexp_extract("claim_text", p, i))
    names = F.transform(F.split(part(_LISTED, 3), _SPLIT), lambda x: F.regexp_replace(x, "^(its|the) ", ""))
    listed = c.where(F.col("claim_text").rlike(_LISTED)).select("claim_id", part(_LISTED, 2).alias("type"), part(_LISTED, 1).alias("src"), F.explode(names).alias("dst"))
    other = c.where(F.col("claim_text").rlike(_INSTEAD)).select("claim_id", F.lit("avoids").alias("type"), part(_INSTEAD, 1).alias("src"), part(_INSTEAD, 2).alias("dst"))
    r = listed.unionByName(other).where("dst <> ''").groupBy("type", "src", "dst")
    return r.agg(F.count_distinct("claim_id").alias("mentions"), F.min("claim_id").alias("first_claim"))


@add("i18_warnings", f"""WITH r AS ({registry.sql['i12_listed']}), p AS (SELECT src, dst, bool_or(type IN ('uses', 'owns')) AS yes, bool_or(type = 'avoids') AS no, sum(mentions)::BIGINT AS mentions FROM r GROUP BY ALL),
    u AS (SELECT src, count(*) AS choices FROM r WHERE type = 'uses' GROUP BY 1)
    SELECT 'opposing' AS warning, 'high' AS severity, src, dst AS about, mentions FROM p WHERE yes AND no
    UNION ALL SELECT 'one for another', 'medium', a.src, a.dst, a.mentions FROM r a WHERE a.type = 'avoids' AND a.dst IN (SELECT dst FROM r WHERE type IN ('uses', 'owns') AND src <> a.src)
    UNION ALL SELECT 'many choices', 'low', src, NULL, choices FROM u WHERE choices > 1""")  # fmt: skip
def i18(spark, sf):
    """What is odd in the relations of each name: one that it both uses and avoids, one that it avoids and others use, more than one of a kind. By counts per name, not by pairs of relations."""
    from marginalia.session import written

    r = written(i12_listed(spark, sf), "relations")
    p = r.groupBy("src", "dst").agg(F.bool_or(F.col("type").isin("uses", "owns")).alias("yes"), F.bool_or(F.col("type") == "avoids").alias("no"), F.sum("mentions").alias("mentions"))
    a = p.where("yes AND no").select(F.lit("opposing").alias("warning"), F.lit("high").alias("severity"), "src", F.col("dst").alias("about"), "mentions")
    # Who uses a name: two of them suffice to tell whether another than the one that avoids it does.
    users = r.where(F.col("type").isin("uses", "owns")).groupBy("dst").agg(F.min("src").alias("one"), F.max("src").alias("other"))
    b = r.where("type = 'avoids'").join(users, "dst").where("one <> src OR other <> src").select(F.lit("one for another").alias("warning"), F.lit("medium").alias("severity"), "src", F.col("dst").alias("about"), "mentions")
    c = r.where("type = 'uses'").groupBy("src").agg(F.count("*").alias("mentions")).where("mentions > 1")
    return a.unionByName(b).unionByName(c.select(F.lit("many choices").alias("warning"), F.lit("low").alias("severity"), "src", F.lit(None).cast("string").alias("about"), "mentions"))


@add("i24_mentioned", rf"""WITH p AS (SELECT document_id, lower(trim(content)) AS t, lower(trim(title)) AS n, list_filter(regexp_split_to_array(lower(trim(title)), '[/\-_.: ]+'), lambda x: x <> '') AS parts FROM {DOCS_SQL}),
    h AS (SELECT *, len(list_filter(parts, lambda x: octet_length(encode(x)) >= 3 AND contains(t, x))) AS hits FROM p)
    SELECT document_id, coalesce(t <> '' AND n <> '' AND (contains(t, n) OR (hits > 0 AND hits >= least(2, len(parts)))), false) AS met FROM h""")  # fmt: skip
def i24(spark, sf):
    """Whether each text speaks of its own title."""
    return documents(spark, sf, "title", "content").select("document_id", E.mentions_entity(F.col("content"), F.col("title")).alias("met"))


# ---- settings and small rules

_SPEC = """(SELECT source_config_id, connector_kind, status, schedule_cron, CASE WHEN connector_kind IN ('git', 'wiki') THEN to_json({'repo': base_url, 'branch': CASE WHEN authority_score > 0.5 THEN 'main' END, 'max_files': CAST(CAST(round(authority_score * 100) AS BIGINT) AS VARCHAR)})
    ELSE to_json({'url': '  ' || base_url || ' ', 'limit': CASE WHEN status = 'active' THEN 'many' ELSE '25' END, 'include_code': 'true'}) END AS config FROM source_configs)"""


def setting(config: Column, *names: str) -> Column:
    """The first of several names of a setting that a JSON object has, trimmed; null if it is blank."""
    v = F.coalesce(*[F.when(F.trim(F.get_json_object(config, f"$.{n}")) != "", F.trim(F.get_json_object(config, f"$.{n}"))) for n in names])
    return v


@add("a12_specs", f"""SELECT source_config_id, coalesce(nullif(trim(config->>'repo'), ''), nullif(trim(config->>'url'), '')) AS root, coalesce(nullif(trim(config->>'branch'), ''), 'main') AS branch,
    coalesce(TRY_CAST(coalesce(config->>'max_files', config->>'limit') AS BIGINT), 100) AS most, coalesce(config->>'include_code' = 'true', false) AS code FROM {_SPEC}""")  # fmt: skip
def a12(spark, sf):
    """What each source's settings say, whatever they are called, with defaults for what is missing or no number."""
    s = table(spark, sf, "source_configs")
    trees = F.to_json(F.struct(F.col("base_url").alias("repo"), F.when(F.col("authority_score") > 0.5, "main").alias("branch"), F.round(F.col("authority_score") * 100).cast("bigint").cast("string").alias("max_files")))
    limit = F.when(F.col("status") == "active", "many").otherwise("25")
    others = F.to_json(F.struct(F.concat(F.lit("  "), "base_url", F.lit(" ")).alias("url"), limit.alias("limit"), F.lit("true").alias("include_code")))
    c = s.select("source_config_id", F.when(F.col("connector_kind").isin("git", "wiki"), trees).otherwise(others).alias("config"))
    g = lambda *names: setting(F.col("config"), *names)
    return c.select(
        "source_config_id", g("repo", "url").alias("root"), F.coalesce(g("branch"), F.lit("main")).alias("branch"),
        F.coalesce(g("max_files", "limit").try_cast("bigint"), F.lit(100)).alias("most"), F.coalesce(g("include_code") == "true", F.lit(False)).alias("code"),
    )


@add("a24_lines", """SELECT event_type, count(*) AS events, count(v) AS numbers, round(sum(v), 4) AS total FROM (SELECT event_type, CASE WHEN event_id % 10 <> 3 THEN value END AS v FROM events WHERE event_id % 7 <> 0) GROUP BY ALL""")
def a24(spark, sf):
    """Events written as lines of JSON with comments between them and places to fill in, and read back."""
    import uuid

    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 3, "{{nothing}}").otherwise(F.to_json(F.struct(F.col("value").alias("v")))).alias("v"), "event_type")
    line = F.concat(F.lit('{"kind": '), F.to_json(F.array("event_type")), F.lit(', "value": '), "v", F.lit("}"))
    e = e.select(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("  # "), line)).otherwise(line).alias("line"))
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    e.write.text(path)
    back = read_jsonl(spark, path, "kind array<string>, value struct<v: double>", {"nothing": "null"})
    g = back.groupBy(F.get("kind", F.lit(0)).alias("event_type"))
    return g.agg(F.count("*").alias("events"), F.count("value.v").alias("numbers"), F.round(F.sum("value.v"), 4).alias("total"))


@add("a27_lineage", f"""SELECT document_id, authority, CASE WHEN source_type IS NULL THEN 1 ELSE 2 END AS kept FROM {DOCS_SQL} WHERE authority IS NOT NULL""")
def a27(spark, sf):
    """What callers may say about their documents, without what only the store may."""
    d = documents(spark, sf, "authority", "source_type", "source_config_id").where("authority IS NOT NULL")
    m = F.map_from_arrays(F.array(*map(F.lit, ("authority", " Source_Config_ID", "kind", "ingestion_status"))), F.array("authority", "source_config_id", "source_type", F.lit("done")))
    m = without_lineage(m)
    return d.select("document_id", F.try_element_at(m, F.lit("authority")).alias("authority"), F.size(F.map_filter(m, lambda _, v: v.isNotNull())).alias("kept"))


_DUE = f"status = 'active' AND (coalesce(TRY_CAST(json_extract_string(freshness_policy, '$.max_age_hours') AS BIGINT), 0) > 0 OR schedule_cron IN ('@hourly', '@daily') OR regexp_matches(coalesce(schedule_cron, ''), '^@every\\s+[1-9][0-9]*[smhd]$'))"


@add("j25_schedulable", f"SELECT source_config_id, coalesce({_DUE}, false) AS can_be_queued FROM source_configs")
def j25_schedulable(spark, sf):
    """Which sources a schedule may queue: active ones whose policy or schedule tells when."""
    s = table(spark, sf, "source_configs")
    told = policy_seconds(F.col("freshness_policy")).isNotNull() | schedule_seconds(F.col("schedule_cron")).isNotNull()
    return s.select("source_config_id", ((F.col("status") == "active") & told).alias("can_be_queued"))


@add("b05_historical", f"""SELECT scope, count(*) FILTER (WHERE status IN ('verified', 'inferred')) AS now, count(*) FILTER (WHERE status IN ('verified', 'inferred', 'expired')) AS historical,
    count(*) FILTER (WHERE status IN ('verified', 'inferred', 'expired') AND expires_at <= TIMESTAMP '{AS_OF}') AS over FROM {CLAIMS_SQL} GROUP BY 1""")  # fmt: skip
def b05(spark, sf):
    """A recall of history takes expired claims too, whether or not they hold."""
    s = F.col("status")
    past = s.isin("verified", "inferred", "expired")
    return claims(spark, sf).groupBy("scope").agg(F.count_if(s.isin("verified", "inferred")).alias("now"), F.count_if(past).alias("historical"), F.count_if(past & (F.col("expires_at") <= at())).alias("over"))


@add("b15_any_of", "SELECT status, count(*) AS conflicts FROM (SELECT DISTINCT conflict_id, status, primary_claim_id, conflicting_claim_id FROM conflicts) WHERE primary_claim_id IN (SELECT claim_id FROM evidence WHERE quote IS NULL AND claim_id IS NOT NULL) OR conflicting_claim_id IN (SELECT claim_id FROM evidence WHERE quote IS NULL AND claim_id IS NOT NULL) GROUP BY 1")
def b15(spark, sf):
    """Conflicts of which either claim is among given ones: two semi-joins and a union, as an OR over two keys would compare all with all."""
    c = table(spark, sf, "conflicts").select("conflict_id", "status", "primary_claim_id", "conflicting_claim_id").distinct()
    ids = table(spark, sf, "evidence").where("quote IS NULL AND claim_id IS NOT NULL").select("claim_id").distinct()
    hit = lambda k: c.join(ids, F.col(k) == F.col("claim_id"), "left_semi")
    return hit("primary_claim_id").union(hit("conflicting_claim_id")).distinct().groupBy("status").agg(F.count("*").alias("conflicts"))


@add("b16_contains", """SELECT k, count(*) AS events FROM (SELECT TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_contains(props, '{"k": 7}') OR json_contains(props, '{"k": 11}')) GROUP BY 1""")
def b16_contains(spark, sf):
    """Events whose properties, as JSON, contain given ones."""
    k = F.from_json("props", "map<string,string>")
    has = lambda v: F.coalesce(F.try_element_at(k, F.lit("k")) == F.lit(str(v)), F.lit(False))
    e = table(spark, sf, "events").where(has(7) | has(11))
    return e.groupBy(F.try_element_at(k, F.lit("k")).try_cast("bigint").alias("k")).agg(F.count("*").alias("events"))


def clamped(limit: Column, low: int, high: int, default: int) -> Column:
    """A limit that is asked for: outside of its range, or null, the default holds, not the nearer end."""
    return F.when(limit.between(low, high), limit).otherwise(F.lit(default))


@add("b19_limits", "SELECT CASE WHEN value::BIGINT BETWEEN 1 AND 20 THEN value::BIGINT ELSE 5 END AS recall, CASE WHEN value::BIGINT BETWEEN 1 AND 100 THEN value::BIGINT ELSE 50 END AS list, count(*) AS requests FROM (SELECT floor(value) AS value FROM events WHERE value IS NOT NULL) GROUP BY ALL")
def b19(spark, sf):
    n = F.floor("value")
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy(clamped(n, 1, 20, 5).alias("recall"), clamped(n, 1, 100, 50).alias("list")).agg(F.count("*").alias("requests"))


@add("c04_lateral", f"""SELECT document_id, words, share FROM {DOCS_SQL} d, LATERAL (SELECT len(list_filter(string_split_regex(coalesce(d.content, ''), '\\s+'), lambda x: x <> '')) AS words) w,
    LATERAL (SELECT round(CASE WHEN length(d.content) > 0 THEN w.words / length(d.content)::DOUBLE ELSE 0 END, 6) AS share) s""")  # fmt: skip
def c04(spark, sf):
    """Values that rest on values of the same row: plain columns, one after the other."""
    d = documents(spark, sf, "content").withColumn("words", F.size(F.filter(F.split(F.coalesce("content", F.lit("")), r"\s+"), lambda x: x != "")))
    return d.select("document_id", "words", F.round(F.when(F.length("content") > 0, F.col("words") / F.length("content")).otherwise(0.0), 6).alias("share"))


WEIGHTS = [("blocking", 8, "page"), ("high", 4, "mail"), ("medium", 2, "list"), ("low", 1, None)]


@add("c13_values", "WITH w(severity, weight, way) AS (VALUES " + ", ".join(f"('{s}', {n}, {'NULL' if v is None else repr(v)})" for s, n, v in WEIGHTS) + ") SELECT scope, way, sum(weight)::BIGINT AS weight FROM (SELECT DISTINCT conflict_id, scope, severity FROM conflicts) JOIN w USING (severity) GROUP BY ALL")
def c13(spark, sf):
    """Conflicts joined to values that are given with the query; four rows, so they are broadcast."""
    w = spark.createDataFrame(WEIGHTS, "severity string, weight bigint, way string")
    c = table(spark, sf, "conflicts").select("conflict_id", "scope", "severity").distinct()
    return c.join(F.broadcast(w), "severity").groupBy("scope", "way").agg(F.sum("weight").alias("weight"))


@add("c17_fan_out", f"""SELECT c.claim_id, count(*) AS pairs, count(DISTINCT d.document_id) AS documents FROM {CLAIMS_SQL} c JOIN {DOCS_SQL} d ON d.scope = c.scope AND d.source_url = c.source_url GROUP BY 1""")
def c17(spark, sf):
    """Claims and the documents at their address, of whatever kind: each pair counts in a list, each document once in a count. Documents are counted per address before they meet the claims."""
    d = documents(spark, sf, "scope", "source_url").where("scope IS NOT NULL AND source_url IS NOT NULL").groupBy("scope", "source_url").agg(F.count("*").alias("n"))
    return claims(spark, sf).select("claim_id", "scope", "source_url").join(d, ["scope", "source_url"]).select("claim_id", F.col("n").alias("pairs"), F.col("n").alias("documents"))


@add("c18_parts", f"""WITH e AS (SELECT evidence_id, min(claim_id) AS claim_id, min(document_id) AS document_id FROM evidence GROUP BY 1), a AS (SELECT claim_id, count(*) AS anchors, count(DISTINCT document_id) AS cited FROM e WHERE claim_id IS NOT NULL GROUP BY 1),
    k AS (SELECT claim_id, count(DISTINCT conflict_id) AS conflicts FROM (SELECT conflict_id, primary_claim_id AS claim_id FROM conflicts UNION SELECT conflict_id, conflicting_claim_id FROM conflicts) WHERE claim_id IS NOT NULL GROUP BY 1)
    SELECT c.claim_id, coalesce(anchors, 0) AS anchors, coalesce(cited, 0) AS cited, coalesce(conflicts, 0) AS conflicts FROM {CLAIMS_SQL} c LEFT JOIN a USING (claim_id) LEFT JOIN k USING (claim_id) WHERE status IN ('verified', 'inferred')""")  # fmt: skip
def c18(spark, sf):
    """The parts of a packet by claim: its anchors, the documents that they cite, its conflicts; each part is added up before they meet."""
    e = table(spark, sf, "evidence").groupBy("evidence_id").agg(F.min("claim_id").alias("claim_id"), F.min("document_id").alias("document_id")).where("claim_id IS NOT NULL")
    a = e.groupBy("claim_id", "document_id").agg(F.count("*").alias("n")).groupBy("claim_id").agg(F.sum("n").alias("anchors"), F.count("document_id").alias("cited"))
    f = table(spark, sf, "conflicts")
    k = f.select("conflict_id", F.explode(F.array("primary_claim_id", "conflicting_claim_id")).alias("claim_id")).where("claim_id IS NOT NULL").distinct().groupBy("claim_id").agg(F.count("conflict_id").alias("conflicts"))
    c = claims(spark, sf).where(F.col("status").isin("verified", "inferred")).select("claim_id")
    return c.join(a, "claim_id", "left").join(k, "claim_id", "left").fillna(0, ["anchors", "cited", "conflicts"])


@add("i07_truncated", f"""SELECT document_id, length(q) AS quote_chars, md5(q) AS quote, length(s) AS short_chars FROM (SELECT document_id, CASE WHEN length(content) > 240 THEN left(content, 240) || '...' ELSE content END AS q,
    CASE WHEN length(content) > 48 THEN left(content, 48) || '...' ELSE content END AS s FROM {DOCS_SQL} WHERE content IS NOT NULL)""")  # fmt: skip
def i07(spark, sf):
    """Texts cut to a quote and to twelve tokens of four; characters are never cut in two."""
    d = documents(spark, sf, "content").where("content IS NOT NULL")
    cut = lambda n: F.when(F.length("content") > n, F.concat(F.left("content", F.lit(n)), F.lit("..."))).otherwise(F.col("content"))
    return d.select("document_id", F.length(cut(240)).alias("quote_chars"), F.md5(cut(240)).alias("quote"), F.length(cut(48)).alias("short_chars"))


@add("i27_trust", f"""SELECT authority, score, status, count(*) AS documents FROM (SELECT CASE WHEN coalesce(trim(source_config_id), '') <> '' THEN coalesce(nullif(authority, ''), 'official-doc')
      WHEN coalesce(authority, '') NOT IN ('', 'manual-unverified') THEN authority ELSE 'manual-unverified' END AS authority,
    CASE WHEN coalesce(trim(source_config_id), '') <> '' OR coalesce(authority, '') NOT IN ('', 'manual-unverified') THEN round(coalesce(nullif(authority_score, 0), 0.75), 6) ELSE 0.35 END AS score,
    CASE WHEN coalesce(trim(source_config_id), '') <> '' OR coalesce(authority, '') NOT IN ('', 'manual-unverified') THEN 'verified' ELSE 'unverified' END AS status FROM {DOCS_SQL}) GROUP BY ALL""")  # fmt: skip
def i27(spark, sf):
    """How far documents are trusted as they come in: those of a source or with an authority are, others are not."""
    d = documents(spark, sf, "source_config_id", "authority", "authority_score")
    own = F.coalesce(F.trim("source_config_id"), F.lit("")) != ""
    named = ~F.coalesce("authority", F.lit("")).isin("", "manual-unverified")
    a = F.when(own, F.coalesce(F.when(F.col("authority") != "", F.col("authority")), F.lit("official-doc"))).when(named, F.col("authority")).otherwise("manual-unverified")
    s = F.when(own | named, F.round(F.coalesce(F.nullif("authority_score", F.lit(0.0)), F.lit(0.75)), 6)).otherwise(0.35)
    return d.groupBy(a.alias("authority"), s.alias("score"), F.when(own | named, "verified").otherwise("unverified").alias("status")).agg(F.count("*").alias("documents"))


@add("i32_rounded", "SELECT event_id, round(value * 100) / 100 AS rounded FROM events WHERE value IS NOT NULL")
def i32(spark, sf):
    """Two places, half away from zero, of the product as it is held."""
    return table(spark, sf, "events").where("value IS NOT NULL").select("event_id", (F.round(F.col("value") * 100) / 100).alias("rounded"))


@add("i33_typed", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, nullif(trim(json_extract_string(props, '$.k')), '') AS text, TRY_CAST(json_extract_string(props, '$.none') AS DOUBLE) IS NULL AS absent FROM events")
def i33(spark, sf):
    """A property of JSON as a number and as a text, and one that isn't there."""
    v = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", v.try_cast("double").alias("number"), F.nullif(F.trim(v), F.lit("")).alias("text"), F.get_json_object("props", "$.none").try_cast("double").isNull().alias("absent"))


@add("f08_sorted", f"""SELECT scope, claim_id, nth FROM (SELECT scope, claim_id, row_number() OVER (PARTITION BY scope ORDER BY CASE status WHEN 'verified' THEN 0 WHEN 'inferred' THEN 1 WHEN 'challenged' THEN 2 ELSE 3 END, confidence DESC, claim_id) AS nth FROM {CLAIMS_SQL} WHERE confidence IS NOT NULL) WHERE nth <= 8""")
def f08(spark, sf):
    """The first eight claims of each scope as packets list them; ids settle what is even."""
    rank = F.when(F.col("status") == "verified", 0).when(F.col("status") == "inferred", 1).when(F.col("status") == "challenged", 2).otherwise(3)
    w = Window.partitionBy("scope").orderBy(rank, F.desc("confidence"), "claim_id")
    return claims(spark, sf).where("confidence IS NOT NULL").withColumn("nth", F.row_number().over(w)).where("nth <= 8").select("scope", "claim_id", "nth")


@add("h21_seeds", r"""WITH s AS (SELECT document_id, list_filter([lower(trim(title)), lower(regexp_extract(source_url, '([^/]+?)(?:\.[A-Za-z]+)?/*$', 1)), lower(trim(source_type)), lower(trim(scope)), lower(trim(authority))], lambda x: x IS NOT NULL AND x <> '') AS a FROM """ + DOCS_SQL + """)
    SELECT document_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:4], '|') AS seeds FROM s""")  # fmt: skip
def h21(spark, sf):
    """Up to four names to begin a search with, in order, each once whatever its letter case."""
    d = documents(spark, sf, "title", "source_url", "source_type", "scope", "authority")
    a = F.array(F.lower(F.trim("title")), F.lower(F.regexp_extract("source_url", r"([^/]+?)(?:\.[A-Za-z]+)?/*$", 1)), *[F.lower(F.trim(c)) for c in ("source_type", "scope", "authority")])
    return d.select("document_id", F.array_join(F.slice(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != ""))), 1, 4), "|").alias("seeds"))


@add("a08_blobs", r"""SELECT document_id, CASE WHEN contains(host, 'gitlab') THEN web || '/-/blob/' || sha || '/' || path WHEN contains(host, 'bitbucket') THEN web || '/src/' || sha || '/' || path ELSE web || '/blob/' || sha || '/' || path END AS address FROM (
    SELECT document_id, 'https://' || h || '.example/' || lower(source_type) AS web, h || '.example' AS host, md5(document_id) AS sha, replace(replace(replace(replace(regexp_replace(path, '^/+', ''), '%', '%25'), ' ', '%20'), '#', '%23'), '?', '%3F') AS path FROM (
      SELECT document_id, source_type, CASE source_type WHEN 'git' THEN 'gitlab' WHEN 'wiki' THEN 'bitbucket' ELSE 'code' END AS h, regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM """ + DOCS_SQL + " WHERE source_url IS NOT NULL AND source_type IS NOT NULL))")  # fmt: skip
def a08(spark, sf):
    """The address of each document's file at its host."""
    from marginalia.sources.git import blob_address

    d = documents(spark, sf, "source_type", "source_url").where("source_url IS NOT NULL AND source_type IS NOT NULL")
    t = F.col("source_type")
    web = F.concat(F.lit("https://"), F.when(t == "git", "gitlab").when(t == "wiki", "bitbucket").otherwise("code"), F.lit(".example/"), F.lower(t))
    return d.select("document_id", blob_address(web, F.md5("document_id"), F.regexp_replace("source_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")).alias("address"))


# ---- code, batches, serial runs, folded streams

_FILES = """(SELECT p_partkey AS id, 'src/m' || (p_partkey % 7) || '/f' || p_partkey || '.ts' AS path, 'import { a } from "../m' || (p_partkey % 3) || '/f' || (p_partkey % 50) || '"' || chr(10) || 'import "lib' || (p_partkey % 5) || '"' || chr(10)
    || 'const x = require(''./f' || (p_partkey % 11) || '.js'')' || chr(10) || 'export default function make' || p_partkey || '() {}' || chr(10) || 'export const size' || (p_size % 4) || ' = 1' AS content FROM part)"""
_FOUND = " UNION ALL ".join(f"SELECT id, path, '{k}' AS kind, unnest(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM {_FILES}" for k, p in __import__("marginalia.functions.code", fromlist=["SCRIPT"]).SCRIPT.items())


@add("i15_imports", rf"""SELECT kind, CASE WHEN name LIKE '../%' THEN 'src/' || substr(name, 4) WHEN name LIKE './%' THEN regexp_replace(path, '[^/]+$', '') || regexp_replace(substr(name, 3), '\.js$', '') ELSE name END AS target,
    count(DISTINCT id) AS files FROM (SELECT DISTINCT * FROM ({_FOUND})) GROUP BY ALL""")  # fmt: skip
def i15(spark, sf):
    """What files of script import, require, export and define, relative imports resolved; the files are written out of the parts."""
    from marginalia.functions.code import SCRIPT, code_edges, resolved_import

    p = lambda n: F.col("p_partkey") % n
    s = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    content = s(
        'import { a } from "../m', p(3), "/f", p(50), '"\nimport "lib', p(5), "\"\nconst x = require('./f", p(11), ".js')\nexport default function make", F.col("p_partkey"), "() {}\nexport const size", F.col("p_size") % 4, " = 1"
    )
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), s("src/m", p(7), "/f", F.col("p_partkey"), ".ts").alias("path"), content.alias("content"))
    e = f.select("id", "path", F.explode(code_edges(F.col("content"), SCRIPT)).alias("e"))
    return e.groupBy("e.kind", resolved_import(F.col("path"), F.col("e.name")).alias("target")).agg(F.count_distinct("id").alias("files"))


_GO_FILES = """(SELECT s_suppkey AS id, 'package p' || (s_suppkey % 4) || chr(10) || chr(10) || 'import (' || chr(10) || chr(9) || '"fmt"' || chr(10) || chr(9) || 'x "lib/n' || s_nationkey || '"' || chr(10) || ')' || chr(10) || 'type T' || (s_suppkey % 6)
    || ' struct {' || chr(10) || '}' || chr(10) || 'func (t *T) Run' || (s_suppkey % 3) || '() {' || chr(10) || '}' || chr(10) || 'func make' || s_nationkey || '[V any](v V) {' || chr(10) || '}' AS content FROM supplier)"""
_GO_FOUND = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, unnest(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS name FROM {_GO_FILES}" for k, p in __import__("marginalia.functions.code", fromlist=["GO"]).GO.items())


@add("i16_definitions", f"SELECT kind, name, count(DISTINCT id) AS files FROM ({_GO_FOUND}) GROUP BY ALL")
def i16(spark, sf):
    """Packages, imports, functions, methods and types of files that are written out of the suppliers."""
    from marginalia.functions.code import GO, code_edges

    s = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    content = s("package p", k % 4, '\n\nimport (\n\t"fmt"\n\tx "lib/n', n, '"\n)\ntype T', k % 6, " struct {\n}\nfunc (t *T) Run", k % 3, "() {\n}\nfunc make", n, "[V any](v V) {\n}")
    e = table(spark, sf, "supplier").select(k.alias("id"), F.explode(code_edges(content, GO)).alias("e"))
    return e.groupBy("e.kind", "e.name").agg(F.count_distinct("id").alias("files"))


@add("a26_planned", f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY document_id) AS nth FROM (
      SELECT document_id, coalesce(source_config_id, '') || strftime(ingested_at, '%Y-%m') AS run, octet_length(encode(coalesce(content, '')))::BIGINT AS bytes, 1 + length(coalesce(content, '')) // 1200 AS chunks FROM {DOCS_SQL}) WHERE run IS NOT NULL),
    f AS (SELECT run, nth, document_id, 0 AS batch, 1 AS n, bytes AS b, chunks AS c FROM d WHERE nth = 1
      UNION ALL SELECT d.run, d.nth, d.document_id, CASE WHEN n + 1 > 6 OR b + bytes > 12000 OR c + chunks > 12 THEN batch + 1 ELSE batch END, CASE WHEN n + 1 > 6 OR b + bytes > 12000 OR c + chunks > 12 THEN 1 ELSE n + 1 END,
        CASE WHEN n + 1 > 6 OR b + bytes > 12000 OR c + chunks > 12 THEN bytes ELSE b + bytes END, CASE WHEN n + 1 > 6 OR b + bytes > 12000 OR c + chunks > 12 THEN chunks ELSE c + chunks END FROM f JOIN d ON d.run = f.run AND d.nth = f.nth + 1)
    SELECT document_id, run, batch FROM f""")  # fmt: skip
def a26(spark, sf):
    """Each month's documents of a source in batches of at most 6 documents, 12,000 bytes and 12 chunks."""
    from marginalia.operators.planning import planned

    d = documents(spark, sf, "source_config_id", "ingested_at", "content")
    text = F.coalesce("content", F.lit(""))
    run = F.concat(F.coalesce("source_config_id", F.lit("")), F.date_format("ingested_at", "yyyy-MM"))
    d = d.select("document_id", run.alias("run"), F.lit(1).alias("n"), F.octet_length(text).cast("bigint").alias("bytes"), F.expr("1 + length(coalesce(content, '')) div 1200").alias("chunks"))
    return planned(d, "run", ["document_id"], {"n": 6, "bytes": 12_000, "chunks": 12}).select("document_id", "run", "batch")


@add("k06_serial", f"""WITH j AS (SELECT source, job_id, epoch_us(updated_at) AS moment, 30000000 * (1 + documents_seen * documents_seen) AS took FROM {JOBS_SQL}),
    s AS (SELECT *, sum(took) OVER (PARTITION BY source ORDER BY moment, job_id) AS s FROM j),
    e AS (SELECT *, s + max(moment - s + took) OVER (PARTITION BY source ORDER BY moment, job_id ROWS UNBOUNDED PRECEDING) AS ends FROM s)
    SELECT source, count(*) AS jobs, max(ends - took - moment)::BIGINT AS longest_wait_us, (sum(ends - took - moment) // 1000000)::BIGINT AS waited_s, max(ends)::BIGINT AS done_us FROM e GROUP BY 1""")  # fmt: skip
def k06(spark, sf):
    """How long jobs wait if each source's run one after the other, as against all at once. The waits of 300,000 jobs of a source add up to more microseconds than 64 bits hold."""
    from marginalia.operators.loads import serial_ends

    j = jobs(spark, sf).select("source", "job_id", micros("updated_at").alias("at_us"), (F.lit(30_000_000) * (1 + F.col("documents_seen") * F.col("documents_seen"))).alias("took_us"))
    g = serial_ends(j, "source", "job_id", "at_us", "took_us").groupBy("source")
    return g.agg(F.count("*").alias("jobs"), F.max("waited_us").alias("longest_wait_us"), F.expr("sum(cast(waited_us AS decimal(20, 0))) div 1000000").alias("waited_s"), F.max("end_us").alias("done_us"))


@add("k08_folded", "SELECT event_type, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY 1")
def k08(spark, sf):
    """Events delivered as a stream of files and folded into a table of which each batch writes the next version; the cursor moves on when a version is written."""
    import uuid

    from marginalia.streaming.intake import keep_snapshot

    path = f"{shared_dir(spark)}/folded-{uuid.uuid4().hex}"
    counts = lambda d: d.groupBy("event_type").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = counts(batch)
        both = new if old is None else old.unionByName(new)
        return both.groupBy("event_type").agg(F.sum("events").alias("events"), F.max("last_event").alias("last_event"))

    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    q = keep_snapshot(stream.select("event_type", "event_id"), path, f"{path}-cursor", merge)
    q.awaitTermination()
    versions = [r["batchId"] for r in q.recentProgress if r["numInputRows"]]
    return spark.read.parquet(f"{path}/v={max(versions)}") if versions else counts(table(spark, sf, "events"))


_ROLE = "(?:user|human|customer|assistant|agent|ai|bot|system|tool)"
_USER = "(?:user|human|customer)"


@add("i37_preferences", rf"""WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?mi)^([ \t]*{_ROLE}[ \t]*:)', chr(1) || '\1', 'g'), chr(1))) AS part FROM documents),
    t AS (SELECT doc_id, lower(regexp_replace(part, '(?i)^[ \t]*{_USER}[ \t]*:', '')) AS said FROM p WHERE regexp_matches(part, '(?i)^[ \t]*{_USER}[ \t]*:'))
    SELECT doc_id, count(*) AS turns, count(*) FILTER (WHERE len(list_filter({T.PREFERS!r}, lambda m: contains(said, m))) > 0 AND len(list_filter({T.DENIES!r}, lambda m: contains(said, m))) = 0) AS preferences FROM t GROUP BY 1""".replace('"i don\'t want"', "'i don''t want'"))  # fmt: skip
def i37(spark, sf):
    """How many of each conversation's turns of users state a preference."""
    t = T.turns(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").where("role = 'user'")
    n = T.preferences(t).groupBy("doc_id").agg(F.count("*").alias("p"))
    every = t.groupBy("doc_id").agg(F.count("*").alias("turns"))
    return every.join(n, "doc_id", "left").select("doc_id", "turns", F.coalesce("p", F.lit(0)).alias("preferences"))
