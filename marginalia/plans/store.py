
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.keys import none_if_blank, plain_address, plain_key, words
from marginalia.functions.temporal import freshness, policy_seconds, schedule_seconds, valid_at
from marginalia.functions.text import bullet_claims  # noqa: F401
from marginalia.functions.text import packet_tokens
from marginalia.operators.asof import held_when
from marginalia.operators.changes import expired, latest, retired, upserted, with_feedback
from marginalia.operators.limits import limited
from marginalia.operators.packing import packed
from marginalia.operators.ranks import nearest_ranks
from marginalia.operators.recall import active_status, not_superseded, refresh_due
from marginalia.operators.skew import salted_left_join
from marginalia.plans import Registry
from marginalia.plans.numbered import _P1, claim_history
from marginalia.sources.tables import micros, table

registry = Registry()
add = registry.add

#: The instant of queries on the store's tables, and of those on the event table.
AS_OF, AS_OF_EVENTS = "2025-07-01 00:00:00", "2024-01-20 00:00:00"


def at(t: str = AS_OF) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{t}'")


def once(spark: SparkSession, sf: str, name: str, key: str, *cols: str, instead: dict[str, tuple[str, Column]] | None = None, first: str | None = None) -> DataFrame:
    """A table's rows without repeats, of the columns asked for; of rows that differ under one key always the same one, whatever order they come in.

    ``instead``: by column, a name and an expression on it; the expression is worked out where the rows are, and stands in the column's place in the
    shuffle and the result (so that long texts stay where they are). ``first``: of rows that differ, the one with the smallest value of this column, nulls last.
    """
    t = table(spark, sf, name).select(key, *cols)
    if not cols:
        return t.distinct()
    kept = [(instead or {}).get(c, (c, F.col(c))) for c in cols]
    h = F.xxhash64(*cols)
    rows = t.select(key, F.struct(*[e.alias(n) for n, e in kept]).alias("_r"), (F.struct(F.isnull(first), first, h) if first else h).alias("_h"))
    return rows.groupBy(key).agg(F.min_by("_r", "_h").alias("_r")).select(key, *[f"_r.{n}" for n, _ in kept])


def _once(name: str, key: str, cols: str) -> str:
    return f"(SELECT DISTINCT ON ({key}) {key}, {cols} FROM {name})"


CLAIMS = ("scope", "status", "confidence", "authority", "valid_from", "expires_at", "supersedes_claim_id", "source_config_id", "source_url", "source_type", "created_at", "updated_at", "claim_text")
CLAIMS_SQL = _once("claims", "claim_id", ", ".join(CLAIMS))
DOCS_SQL = _once("source_documents", "document_id", "source_type, source_url, source_config_id, title, scope, content, content_checksum, source_updated_at, authority, authority_score, freshness_status, status, ingested_at")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, sf, "claims", "claim_id", *CLAIMS)


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return once(spark, sf, "source_documents", "document_id", *cols)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The event table read as ingestion jobs."""
    kind = {"click": "succeeded", "view": "queued", "purchase": "running", "signup": "retry"}
    status = F.lit("failed")
    for k, v in kind.items():
        status = F.when(F.col("event_type") == k, v).otherwise(status)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), status.alias("status"), F.col("ts").alias("updated_at"),
        F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("heartbeat_at"), (1 + F.col("event_id") % 3).alias("attempts"), F.lit(3).alias("max_attempts"),
        (F.col("event_id") % 7).alias("documents_seen"), (F.col("event_id") % 4).alias("priority"),
    )


JOBS_SQL = """(SELECT event_id AS job_id, 'src' || (user_id % 20) AS source,
    CASE event_type WHEN 'click' THEN 'succeeded' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'running' WHEN 'signup' THEN 'retry' ELSE 'failed' END AS status,
    ts AS updated_at, CASE WHEN event_id % 11 <> 0 THEN ts END AS heartbeat_at, 1 + event_id % 3 AS attempts, 3 AS max_attempts,
    event_id % 7 AS documents_seen, event_id % 4 AS priority FROM events)"""
VALID_SQL = f"(valid_from IS NULL OR valid_from <= TIMESTAMP '{AS_OF}') AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"


# ---- predicates


@add("b02_valid_at", f"SELECT scope, status, count(*) AS claims FROM {CLAIMS_SQL} WHERE {VALID_SQL} GROUP BY ALL")
def b02(spark, sf):
    return claims(spark, sf).where(valid_at(at())).groupBy("scope", "status").agg(F.count("*").alias("claims"))


_EFFECTIVE = f"""SELECT * FROM {CLAIMS_SQL} c WHERE {VALID_SQL} AND NOT EXISTS (
    SELECT 1 FROM {CLAIMS_SQL} n WHERE n.supersedes_claim_id = c.claim_id AND n.scope = c.scope AND n.claim_id <> c.claim_id
      AND n.status IN ('verified', 'inferred') AND {VALID_SQL.replace('valid_from', 'n.valid_from').replace('expires_at', 'n.expires_at')})"""


@add("b03_effective", f"SELECT scope, status, count(*) AS claims, round(avg(confidence), 6) AS confidence FROM ({_EFFECTIVE}) GROUP BY ALL")
def b03(spark, sf):
    """Claims that hold and have no superseder that does."""
    return not_superseded(claims(spark, sf), at()).groupBy("scope", "status").agg(F.count("*").alias("claims"), F.round(F.avg("confidence"), 6).alias("confidence"))


@add("b04_active", f"""SELECT authority, count(*) FILTER (WHERE status IN ('verified', 'inferred')) AS trusted,
    count(*) FILTER (WHERE status NOT IN ('deprecated', 'expired')) AS alive FROM {CLAIMS_SQL} GROUP BY ALL""")  # fmt: skip
def b04(spark, sf):
    s = F.col("status")
    return claims(spark, sf).groupBy("authority").agg(F.count_if(active_status(s)).alias("trusted"), F.count_if(active_status(s, True)).alias("alive"))


@add("b06_freshness", f"""SELECT scope, CASE WHEN expires_at <= TIMESTAMP '{AS_OF}' THEN 'expired' WHEN updated_at IS NULL THEN 'unknown'
    WHEN updated_at < TIMESTAMP '{AS_OF}' - INTERVAL 120 DAY THEN 'stale' ELSE 'fresh' END AS freshness, count(*) AS claims FROM {CLAIMS_SQL} GROUP BY ALL""")  # fmt: skip
def b06(spark, sf):
    return claims(spark, sf).groupBy("scope", freshness(at(), "updated_at").alias("freshness")).agg(F.count("*").alias("claims"))


_READ = f"(SELECT source_config_id, max(ingested_at) AS last_read, count(*) AS documents FROM {DOCS_SQL} WHERE ingested_at <= TIMESTAMP '{AS_OF}' GROUP BY 1)"
_AGE = "".join(
    f" WHEN regexp_matches(freshness_policy->>'max_age_{n}', '^[1-9][0-9]*$') THEN CAST(freshness_policy->>'max_age_{n}' AS BIGINT) * {u}"
    for n, u in (("seconds", 1), ("minutes", 60), ("hours", 3600), ("days", 86400))
)
_CRON = r"""CASE WHEN schedule_cron = '@hourly' THEN 3600 WHEN schedule_cron = '@daily' THEN 86400
    WHEN regexp_matches(schedule_cron, '^@every\s+[1-9][0-9]*[smhd]$') THEN CAST(regexp_extract(schedule_cron, '([0-9]+)', 1) AS BIGINT) *
      CASE right(schedule_cron, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 ELSE 86400 END END"""


@add("b10_refresh_due", f"""SELECT *, coalesce(status = 'active' AND (age > max_age OR age > every), false) AS due FROM (
      SELECT s.source_config_id, s.status, coalesce(documents, 0) AS documents, CASE {_AGE} END AS max_age, {_CRON} AS every,
             epoch(TIMESTAMP '{AS_OF}' - coalesce(last_read, s.created_at))::BIGINT AS age
      FROM source_configs s LEFT JOIN {_READ} r USING (source_config_id))""")  # fmt: skip
def b10(spark, sf):
    """Each source with the documents read from it until now, its intervals, and whether it is due."""
    d = documents(spark, sf, "source_config_id", "ingested_at").where(F.col("ingested_at") <= at())
    read = d.groupBy("source_config_id").agg(F.max("ingested_at").alias("last_read"), F.count("*").alias("documents"))
    s = table(spark, sf, "source_configs").join(read, "source_config_id", "left").withColumn("since", F.coalesce("last_read", "created_at"))
    due = F.coalesce(refresh_due(at(), F.col("since")), F.lit(False))
    return s.select(
        "source_config_id", "status", F.coalesce("documents", F.lit(0)).alias("documents"), policy_seconds(F.col("freshness_policy")).alias("max_age"),
        schedule_seconds(F.col("schedule_cron")).alias("every"), F.floor((micros(at()) - micros("since")) / 1_000_000).alias("age"), due.alias("due"),
    )


@add("b14_ilike", f"SELECT scope, count(*) AS claims FROM {CLAIMS_SQL} WHERE claim_text ILIKE '%review queues%' GROUP BY ALL")
def b14(spark, sf):
    return claims(spark, sf).where(F.col("claim_text").ilike("%review queues%")).groupBy("scope").agg(F.count("*").alias("claims"))


@add("b20_next_page", f"""SELECT evidence_id, created_at FROM {_once('evidence', 'evidence_id', 'created_at')}
    WHERE created_at > TIMESTAMP '{AS_OF}' OR (created_at = TIMESTAMP '{AS_OF}' AND evidence_id > 'evd_8') ORDER BY created_at, evidence_id LIMIT 100""")  # fmt: skip
def b20(spark, sf):
    """The page behind a cursor; its size is the feature."""
    e = once(spark, sf, "evidence", "evidence_id", "created_at")
    behind = (F.col("created_at") > at()) | ((F.col("created_at") == at()) & (F.col("evidence_id") > "evd_8"))
    return e.where(behind).orderBy("created_at", "evidence_id").limit(100)


# ---- joins


@add("c01_chunks_by_document", f"""SELECT d.status, d.source_type, count(*) AS chunks, sum(length(c.content))::BIGINT AS chars FROM
    (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, content FROM chunks) c JOIN {DOCS_SQL} d ON d.document_id = c.document_id GROUP BY ALL""")  # fmt: skip
def c01(spark, sf):
    c = once(spark, sf, "chunks", "chunk_id", "document_id", "content").select("document_id", F.length("content").alias("n"))
    j = salted_left_join(c, documents(spark, sf, "status", "source_type"), "document_id", F.col("n"), how="inner")
    return j.groupBy("status", "source_type").agg(F.count("*").alias("chunks"), F.sum("n").alias("chars"))


@add("c02_live_sources", f"""SELECT coalesce(s.status, 'none') AS source_status, count(*) AS claims FROM {CLAIMS_SQL} c
    LEFT JOIN source_configs s ON s.source_config_id = c.source_config_id WHERE coalesce(s.status, 'active') <> 'deleted' GROUP BY ALL""")  # fmt: skip
def c02(spark, sf):
    s = table(spark, sf, "source_configs").select("source_config_id", F.col("status").alias("source_status"))
    j = salted_left_join(claims(spark, sf).select("claim_id", "source_config_id"), s, "source_config_id", F.col("claim_id"))
    j = j.where(F.coalesce("source_status", F.lit("active")) != "deleted")
    return j.groupBy(F.coalesce("source_status", F.lit("none")).alias("source_status")).agg(F.count("*").alias("claims"))


@add("c03_claims_of_documents", f"""SELECT c.scope, count(*) AS claims, count(d.n) AS cited, sum(d.n)::BIGINT AS documents FROM {CLAIMS_SQL} c LEFT JOIN (
    SELECT scope, coalesce(source_type, '') AS t, coalesce(source_url, '') AS u, count(*) AS n FROM {DOCS_SQL} GROUP BY ALL) d
    ON d.scope = c.scope AND d.t = coalesce(c.source_type, '') AND d.u = coalesce(c.source_url, '') GROUP BY ALL""")  # fmt: skip
def c03(spark, sf):
    """Claims by whether a document of their scope, kind and address is there; a null kind or address equals an empty one."""
    key = F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in ("scope", "source_type", "source_url")]))
    d = documents(spark, sf, "scope", "source_type", "source_url").where("scope is not null").groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    c = claims(spark, sf).select("claim_id", "scope", key.alias("k"))
    return salted_left_join(c, d, "k", F.col("claim_id")).groupBy("scope").agg(F.count("*").alias("claims"), F.count("n").alias("cited"), F.sum("n").alias("documents"))


@add("c05_best_chunk", """SELECT document_id, chunk_id, n FROM (SELECT document_id, chunk_id, length(content) AS n,
    row_number() OVER (PARTITION BY document_id ORDER BY length(content) DESC, chunk_index, chunk_id) AS nth FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)
    WHERE document_id IS NOT NULL) WHERE nth = 1""")  # fmt: skip
def c05(spark, sf):
    """Each document's longest chunk: one aggregation, no window."""
    c = table(spark, sf, "chunks").where("document_id is not null").select("document_id", "chunk_id", "chunk_index", F.length("content").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("far"), "chunk_index", "chunk_id")).alias("b")
    return c.groupBy("document_id").agg(best).select("document_id", "b.chunk_id", (-F.col("b.far")).alias("n"))


@add("c06_first_chunks", """SELECT document_id, md5(string_agg(content, chr(10) ORDER BY chunk_index, chunk_id)) AS digest, count(*) AS chunks FROM (
    SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS nth FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)
    WHERE document_id IS NOT NULL) WHERE nth <= 4 GROUP BY 1""")  # fmt: skip
def c06(spark, sf):
    """A digest of each document's first four chunks. The window's limit is applied before the shuffle as well."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    c = once(spark, sf, "chunks", "chunk_id", "document_id", "chunk_index", "content").where("document_id is not null")
    c = c.withColumn("nth", F.row_number().over(w)).where("nth <= 4")
    g = c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content"))).alias("p"))
    return g.select("document_id", F.md5(F.array_join(F.transform("p", lambda p: p["content"]), "\n")).alias("digest"), F.size("p").cast("bigint").alias("chunks"))


@add("c07_superseded", f"SELECT claim_id FROM {CLAIMS_SQL} WHERE {VALID_SQL} EXCEPT SELECT claim_id FROM ({_EFFECTIVE})")
def c07(spark, sf):
    c = claims(spark, sf)
    return c.where(valid_at(at())).select("claim_id").join(not_superseded(c, at()).select("claim_id"), "claim_id", "left_anti")


@add("c08_unquoted", f"""SELECT claim_id, status FROM {CLAIMS_SQL} c WHERE status IN ('verified', 'inferred') AND NOT EXISTS (
    SELECT 1 FROM evidence e WHERE e.claim_id = c.claim_id AND trim(coalesce(e.quote, '')) <> '')""")  # fmt: skip
def c08(spark, sf):
    """Trusted claims without any quote. The quotes are reduced to distinct claims first, so hot claims cost nothing."""
    q = table(spark, sf, "evidence").where(F.trim(F.coalesce("quote", F.lit(""))) != "").select("claim_id").distinct()
    return claims(spark, sf).where(active_status(F.col("status"))).select("claim_id", "status").join(q, "claim_id", "left_anti")


@add("c09_unresolved", f"""SELECT job_id, source FROM {JOBS_SQL} j WHERE status = 'failed' AND NOT EXISTS (
    SELECT 1 FROM {JOBS_SQL} n WHERE n.status = 'succeeded' AND n.source = j.source AND n.updated_at > j.updated_at)""")  # fmt: skip
def c09(spark, sf):
    """Failed jobs with no later success of their source: against the last success alone, not against every one."""
    j = jobs(spark, sf)
    last = j.where("status = 'succeeded'").groupBy("source").agg(F.max("updated_at").alias("last"))
    f = salted_left_join(j.where("status = 'failed'"), last, "source", F.col("job_id"))
    return f.where("last is null or last <= updated_at").select("job_id", "source")


@add("c12_touching", f"""SELECT DISTINCT conflict_id FROM conflicts WHERE primary_claim_id IN (SELECT claim_id FROM {CLAIMS_SQL} WHERE status = 'expired')
    OR conflicting_claim_id IN (SELECT claim_id FROM {CLAIMS_SQL} WHERE status = 'expired')""")  # fmt: skip
def c12(spark, sf):
    """Conflicts with an expired claim on either side: two semi-joins."""
    old = claims(spark, sf).where("status = 'expired'").select("claim_id")
    c = table(spark, sf, "conflicts").select("conflict_id", "primary_claim_id", "conflicting_claim_id")
    side = lambda k: c.join(old.select(F.col("claim_id").alias(k)), k, "left_semi").select("conflict_id")
    return side("primary_claim_id").union(side("conflicting_claim_id")).distinct()


_SEVERITY = {"blocking": 4, "high": 3, "medium": 2, "low": 1}


@add("c14_linked", f"""SELECT claim_id, worst, round(confidence + 0.3 * worst / 4, 6) AS score FROM {CLAIMS_SQL} c JOIN (
    SELECT primary_claim_id, max(CASE severity WHEN 'blocking' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS worst
    FROM conflicts GROUP BY 1) x ON x.primary_claim_id = c.claim_id""")  # fmt: skip
def c14(spark, sf):
    """Claims linked by conflicts, scored by the worst."""
    sev = F.lit(0)
    for k, v in _SEVERITY.items():
        sev = F.when(F.col("severity") == k, v).otherwise(sev)
    x = table(spark, sf, "conflicts").groupBy(F.col("primary_claim_id").alias("claim_id")).agg(F.max(sev).alias("worst"))
    return claims(spark, sf).join(x, "claim_id").select("claim_id", "worst", F.round(F.col("confidence") + 0.3 * F.col("worst") / 4, 6).alias("score"))


@add("c16_held_when_cited", _P1 + """, e AS (SELECT DISTINCT ON (evidence_id) evidence_id, claim_id, created_at FROM evidence)
    SELECT coalesce(v.status, 'none') AS status, count(*) AS evidence FROM e LEFT JOIN versions v
    ON v.claim_id = e.claim_id AND v.s <= e.created_at AND (v.e IS NULL OR v.e > e.created_at) GROUP BY ALL""")  # fmt: skip
def c16(spark, sf):
    """The status that a claim had when it was cited: a point-in-time join against the full history."""
    e = once(spark, sf, "evidence", "evidence_id", "claim_id", "created_at").withColumn("at_us", micros("created_at"))
    h = held_when(e.select("evidence_id", "claim_id", "at_us"), claim_history(spark, sf).drop("supersedes_claim_id"), "claim_id", "at_us")
    return h.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("evidence"))


# ---- aggregates


@add("d01_documents", f"""SELECT scope, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'stale') AS stale,
    count(*) FILTER (WHERE status = 'deleted') AS deleted, count(DISTINCT source_url) AS addresses FROM {DOCS_SQL} GROUP BY ALL""")  # fmt: skip
def d01(spark, sf):
    s = F.col("status")
    d = documents(spark, sf, "scope", "status", "source_url")
    return d.groupBy("scope").agg(F.count("*").alias("total"), *[F.count_if(s == k).alias(k) for k in ("active", "stale", "deleted")], F.count_distinct("source_url").alias("addresses"))


@add("d02_claims", f"""SELECT c.scope, count(DISTINCT c.claim_id) AS total, count(DISTINCT c.claim_id) FILTER (WHERE c.status IN ('verified', 'inferred')) AS trusted,
    count(DISTINCT c.claim_id) FILTER (WHERE e.claim_id IS NOT NULL) AS with_evidence FROM {CLAIMS_SQL} c LEFT JOIN evidence e ON e.claim_id = c.claim_id GROUP BY ALL""")  # fmt: skip
def d02(spark, sf):
    """Counts of claims, and of those with evidence: evidence is made distinct first, so nothing fans out."""
    e = table(spark, sf, "evidence").select("claim_id").distinct().withColumn("cited", F.lit(True))
    j = claims(spark, sf).select("claim_id", "scope", "status").join(e, "claim_id", "left")
    return j.groupBy("scope").agg(F.count("*").alias("total"), F.count_if(active_status(F.col("status"))).alias("trusted"), F.count("cited").alias("with_evidence"))


@add("d03_trusted_from_code", f"""SELECT c.scope, count(DISTINCT c.claim_id) AS claims FROM {CLAIMS_SQL} c JOIN evidence e ON e.claim_id = c.claim_id
    JOIN {DOCS_SQL} d ON d.document_id = e.document_id WHERE d.source_type = 'code' AND c.status IN ('verified', 'inferred') GROUP BY ALL""")  # fmt: skip
def d03(spark, sf):
    code = documents(spark, sf, "source_type").where("source_type = 'code'").select("document_id")
    e = table(spark, sf, "evidence").select("claim_id", "document_id").join(code, "document_id", "left_semi").select("claim_id").distinct()
    return claims(spark, sf).where(active_status(F.col("status"))).join(e, "claim_id", "left_semi").groupBy("scope").agg(F.count("*").alias("claims"))


@add("d07_duplicate_groups", """SELECT event_type, count(*) AS groups, sum(n)::BIGINT AS rows_in FROM (SELECT event_type, user_id, props, count(*) AS n FROM events
    GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL""")  # fmt: skip
def d07(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", "user_id", "props").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("event_type").agg(F.count("*").alias("groups"), F.sum("n").alias("rows_in"))


@add("d08_ingestion", f"""SELECT count(*) AS jobs, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'succeeded' AND updated_at > TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 24 HOUR AND updated_at <= TIMESTAMP '{AS_OF_EVENTS}') AS done_in_a_day,
    count(*) FILTER (WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 10 MINUTE)) AS stuck,
    sum(documents_seen)::BIGINT AS documents FROM {JOBS_SQL}""")  # fmt: skip
def d08(spark, sf):
    s, now = F.col("status"), micros(at(AS_OF_EVENTS))
    age = now - micros("updated_at")
    stuck = (s == "running") & F.coalesce(now - micros("heartbeat_at") > 600_000_000, F.lit(True))
    return jobs(spark, sf).agg(
        F.count("*").alias("jobs"), F.count_if(s == "queued").alias("queued"), F.count_if(s == "failed").alias("failed"),
        F.count_if((s == "succeeded") & (age < 86_400_000_000) & (age >= 0)).alias("done_in_a_day"), F.count_if(stuck).alias("stuck"), F.sum("documents_seen").alias("documents"),
    )


@add("d09_conflicts", """SELECT scope, count(DISTINCT conflict_id) FILTER (WHERE status IN ('open', 'reviewing')) AS open,
    count(DISTINCT conflict_id) FILTER (WHERE status IN ('open', 'reviewing') AND severity IN ('blocking', 'high')) AS grave FROM conflicts GROUP BY ALL""")  # fmt: skip
def d09(spark, sf):
    c = once(spark, sf, "conflicts", "conflict_id", "scope", "status", "severity")
    is_open = F.col("status").isin("open", "reviewing")
    return c.groupBy("scope").agg(F.count_if(is_open).alias("open"), F.count_if(is_open & F.col("severity").isin("blocking", "high")).alias("grave"))


@add("d10_jobs_of_sources", f"""SELECT source, count(*) AS jobs, count(*) FILTER (WHERE status = 'failed') AS failed, max(updated_at) FILTER (WHERE status = 'succeeded') AS last_success,
    round(avg(attempts), 6) AS attempts FROM {JOBS_SQL} GROUP BY ALL""")  # fmt: skip
def d10(spark, sf):
    s = F.col("status")
    return jobs(spark, sf).groupBy("source").agg(
        F.count("*").alias("jobs"), F.count_if(s == "failed").alias("failed"), F.max(F.when(s == "succeeded", F.col("updated_at"))).alias("last_success"), F.round(F.avg("attempts"), 6).alias("attempts")
    )


@add("d12_addresses_of_claims", """SELECT claim_id, string_agg(DISTINCT source_url, '|' ORDER BY source_url) AS addresses FROM (
    SELECT claim_id, source_url, dense_rank() OVER (PARTITION BY claim_id ORDER BY source_url) AS nth FROM evidence WHERE claim_id IS NOT NULL AND source_url IS NOT NULL)
    WHERE nth <= 20 GROUP BY 1""")  # fmt: skip
def d12(spark, sf):
    """The first 20 addresses that a claim is cited from, in order."""
    e = table(spark, sf, "evidence").select("claim_id", "source_url").where("claim_id is not null and source_url is not null").distinct()
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("claim_id").orderBy("source_url"))).where("nth <= 20")
    return e.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_list("source_url")), "|").alias("addresses"))


_SCOPED = ["source_documents", "document_snapshots", "claims", "claim_updates", "conflicts", "source_configs"]


@add("d14_scopes", "SELECT scope, " + ", ".join(f"count(*) FILTER (WHERE t = '{t}') AS {t}" for t in _SCOPED) + ", count(*) AS total FROM ("
     + " UNION ALL ".join(f"SELECT '{t}' AS t, scope FROM {t}" for t in _SCOPED) + ") WHERE scope IS NOT NULL GROUP BY ALL")
def d14(spark, sf):
    """What each scope holds: each table counted where it lies, then a small union."""
    parts = [table(spark, sf, t).where("scope is not null").groupBy("scope").agg(F.count("*").alias("n")).withColumn("t", F.lit(t)) for t in _SCOPED]
    u = reduce(DataFrame.unionByName, parts)
    return u.groupBy("scope").agg(*[F.coalesce(F.sum(F.when(F.col("t") == t, F.col("n"))), F.lit(0)).alias(t) for t in _SCOPED], F.sum("n").alias("total"))


@add("d15_find_scopes", """SELECT scope, sum(score)::BIGINT AS score FROM (
    SELECT scope, CASE WHEN lower(scope) = 'team' THEN 1000 WHEN lower(scope) LIKE 'team%' THEN 800 WHEN lower(scope) LIKE '%team%' THEN 300 ELSE 0 END + least(count(*), 99) AS score
    FROM claims WHERE scope IS NOT NULL GROUP BY scope) GROUP BY scope ORDER BY score DESC, scope LIMIT 10""")  # fmt: skip
def d15(spark, sf):
    """The ten scopes that meet a name best; the number is the feature."""
    low = F.lower("scope")
    name = F.when(low == "team", 1000).when(low.startswith("team"), 800).when(low.contains("team"), 300).otherwise(0)
    g = table(spark, sf, "claims").where("scope is not null").groupBy("scope").agg(F.least(F.count("*"), F.lit(99)).alias("n"))
    return g.select("scope", (name + F.col("n")).alias("score")).orderBy(F.desc("score"), "scope").limit(10)


@add("d20_evidence_of_sources", """SELECT source_url, count(DISTINCT evidence_id) AS quotes, count(DISTINCT claim_id) AS claims FROM evidence WHERE source_url IS NOT NULL
    GROUP BY 1 ORDER BY quotes DESC, source_url LIMIT 20""")  # fmt: skip
def d20(spark, sf):
    """The 20 addresses cited most; the number is the feature."""
    e = once(spark, sf, "evidence", "evidence_id", "source_url", "claim_id").where("source_url is not null")
    g = e.groupBy("source_url").agg(F.count("*").alias("quotes"), F.count_distinct("claim_id").alias("claims"))
    return g.orderBy(F.desc("quotes"), "source_url").limit(20)


@add("d26_metrics", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, {'t': ts, 'i': event_id}) AS last FROM events GROUP BY ALL""")
def d26(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last")
    )


@add("a23_metric_lines", """SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def a23(spark, sf):
    """Counters as lines of a metrics page."""
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.select(F.format_string('events_total{type="%s"} %d', "event_type", "n").alias("line"))


@add("d28_percentiles", """SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY ALL""")
def d28(spark, sf):
    """Nearest-rank percentiles."""
    return nearest_ranks(table(spark, sf, "events"), "event_type", "value", {"p50": 50, "p95": 95})


@add("d29_coverage", f"""SELECT c.scope, round(avg(CASE WHEN e.claim_id IS NOT NULL THEN 1 ELSE 0 END), 6) AS cited, count(DISTINCT c.source_config_id) AS sources
    FROM {CLAIMS_SQL} c LEFT JOIN (SELECT DISTINCT claim_id FROM evidence) e ON e.claim_id = c.claim_id GROUP BY ALL""")  # fmt: skip
def d29(spark, sf):
    e = table(spark, sf, "evidence").select("claim_id").distinct().withColumn("cited", F.lit(1))
    j = claims(spark, sf).join(e, "claim_id", "left")
    return j.groupBy("scope").agg(F.round(F.avg(F.coalesce("cited", F.lit(0))), 6).alias("cited"), F.count_distinct("source_config_id").alias("sources"))


# ---- windows, sorts, sets


@add("e01_cancelled", """SELECT update_id FROM (SELECT DISTINCT ON (update_id) * FROM claim_updates) QUALIFY row_number() OVER (PARTITION BY claim_id, scope, lower(trim(status)), source_config_id
    ORDER BY received_at DESC, update_id DESC) > 1""")  # fmt: skip
def e01(spark, sf):
    """All but the newest update of a kind: those that differ from their group's newest, which one aggregation finds. Of an update's rows the one received first counts."""
    u = once(spark, sf, "claim_updates", "update_id", "claim_id", "scope", "status", "source_config_id", "received_at", first="received_at")
    k = F.to_json(F.array(*[F.coalesce(c, F.lit("\1")) for c in ("claim_id", "scope", F.lower(F.trim("status")), "source_config_id")]))
    u = u.select("update_id", "received_at", k.alias("k"))
    top = u.groupBy("k").agg(F.max(F.struct("received_at", "update_id")).alias("t")).select(F.col("t.update_id").alias("top"))
    return u.select("update_id").join(top, F.col("update_id").eqNullSafe(F.col("top")), "left_anti")


@add("e03_latest_job", f"""SELECT source, job_id, status FROM {JOBS_SQL} QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, job_id DESC) = 1""")
def e03(spark, sf):
    g = jobs(spark, sf).groupBy("source").agg(F.max(F.struct("updated_at", "job_id", "status")).alias("t"))
    return g.select("source", "t.job_id", "t.status")


@add("f06_gravest", """SELECT conflict_id, severity, created_at FROM (SELECT DISTINCT ON (conflict_id) * FROM conflicts) WHERE status IN ('open', 'reviewing')
    ORDER BY CASE severity WHEN 'blocking' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, created_at DESC, conflict_id LIMIT 50""")  # fmt: skip
def f06(spark, sf):
    """The 50 gravest open conflicts; the number is the feature."""
    sev = F.lit(0)
    for k, v in _SEVERITY.items():
        sev = F.when(F.col("severity") == k, v).otherwise(sev)
    c = once(spark, sf, "conflicts", "conflict_id", "severity", "status", "created_at").where(F.col("status").isin("open", "reviewing"))
    return c.orderBy(F.desc(sev), F.desc("created_at"), "conflict_id").limit(50).select("conflict_id", "severity", "created_at")


_BLOCKS = r"""(SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS nth, chunk_index = 0 AS critical,
    greatest(CAST(ceil(octet_length(encode(content)) / 4.0) AS BIGINT), len(list_filter(string_split_regex(content, '\s+'), lambda x: x <> ''))) AS cost
    FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks) WHERE document_id IS NOT NULL AND content IS NOT NULL)"""


@add("f12_packed", f"""WITH RECURSIVE b AS MATERIALIZED {_BLOCKS},
    fold AS (
      SELECT document_id, chunk_id, nth, cost, CASE WHEN cost <= 600 THEN cost WHEN critical THEN 600 ELSE 0 END AS used,
             CASE WHEN cost <= 600 THEN 'kept' WHEN critical THEN 'cut' ELSE 'dropped' END AS fate,
             CASE WHEN cost <= 600 THEN cost WHEN critical THEN 600 ELSE 0 END AS spent FROM b WHERE nth = 1
      UNION ALL
      SELECT b.document_id, b.chunk_id, b.nth, b.cost, CASE WHEN b.cost <= 600 - f.spent THEN b.cost WHEN b.critical AND 600 - f.spent >= 40 THEN 600 - f.spent ELSE 0 END,
             CASE WHEN b.cost <= 600 - f.spent THEN 'kept' WHEN b.critical AND 600 - f.spent >= 40 THEN 'cut' ELSE 'dropped' END,
             f.spent + CASE WHEN b.cost <= 600 - f.spent THEN b.cost WHEN b.critical AND 600 - f.spent >= 40 THEN 600 - f.spent ELSE 0 END
      FROM fold f JOIN b ON b.document_id = f.document_id AND b.nth = f.nth + 1)
    SELECT document_id, chunk_id AS block, cost, used, fate FROM fold""")  # fmt: skip
def f12(spark, sf):
    """Each document's chunks packed into 600 tokens."""
    c = once(spark, sf, "chunks", "chunk_id", "document_id", "chunk_index", "content").where("content is not null")
    c = c.select("document_id", F.col("chunk_id").alias("block"), F.col("chunk_index").alias("priority"), packet_tokens(F.col("content")).alias("cost"), (F.col("chunk_index") == 0).alias("critical"))
    return packed(c, "document_id", 600)


@add("g01_cited_or_disputed", """SELECT claim_id FROM evidence WHERE claim_id IS NOT NULL UNION SELECT primary_claim_id FROM conflicts WHERE primary_claim_id IS NOT NULL""")
def g01(spark, sf):
    e = table(spark, sf, "evidence").select("claim_id")
    return e.union(table(spark, sf, "conflicts").select("primary_claim_id")).where("claim_id is not null").distinct()


@add("g03_scopes", " UNION ".join(f"SELECT lower(trim(scope)) AS scope FROM {t} WHERE scope IS NOT NULL" for t in _SCOPED))
def g03(spark, sf):
    return reduce(DataFrame.union, [table(spark, sf, t).select(F.lower(F.trim("scope")).alias("scope")).where("scope is not null").distinct() for t in _SCOPED]).distinct()


@add("g04_not_listed", """SELECT document_id FROM (SELECT DISTINCT ON (document_id) * FROM source_documents) d WHERE NOT EXISTS (
    SELECT 1 FROM document_snapshots s WHERE s.source_config_id = d.source_config_id AND s.scope = d.scope AND s.source_url = d.source_url)""")  # fmt: skip
def g04(spark, sf):
    """Documents that no list has."""
    key = ["source_config_id", "scope", "source_url"]
    return documents(spark, sf, *key).join(table(spark, sf, "document_snapshots").select(*key).distinct(), key, "left_anti").select("document_id")


# ---- mutations


_NEWEST = """(SELECT * FROM document_snapshots QUALIFY row_number() OVER (PARTITION BY source_config_id, scope, source_url
    ORDER BY snapshot_no DESC, delivery_no DESC, ingested_at DESC, content_checksum DESC) = 1)"""


@add("j01_upserted", f"""WITH new AS (SELECT * FROM {_NEWEST}), old AS (
      SELECT source_config_id, scope, source_url, max(content_checksum) AS content_checksum FROM source_documents GROUP BY ALL)
    SELECT source_config_id, scope, count(*) AS documents, count(DISTINCT content_checksum) AS checksums FROM (
      SELECT source_config_id, scope, source_url, content_checksum FROM new
      UNION ALL SELECT source_config_id, scope, source_url, content_checksum FROM old
      WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.source_config_id = old.source_config_id AND n.scope = old.scope AND n.source_url = old.source_url)) GROUP BY ALL""")  # fmt: skip
def j01(spark, sf):
    """The document table after all lists were written into it by natural key."""
    key = ["source_config_id", "scope", "source_url"]
    old = table(spark, sf, "source_documents").groupBy(*key).agg(F.max("content_checksum").alias("content_checksum"))
    s = table(spark, sf, "document_snapshots")
    new = s.groupBy(*key).agg(F.max_by("content_checksum", F.struct("snapshot_no", "delivery_no", "ingested_at", "content_checksum")).alias("content_checksum"))
    return upserted(old, new, key, F.lit(1)).groupBy("source_config_id", "scope").agg(F.count("*").alias("documents"), F.count_distinct("content_checksum").alias("checksums"))


@add("j07_feedback", f"""WITH v AS (SELECT claim_id, moment, d FROM (
      SELECT primary_claim_id AS claim_id, created_at AS moment, CAST(-0.25 AS DOUBLE) AS d FROM (SELECT DISTINCT ON (conflict_id) * FROM conflicts)
      UNION ALL SELECT claim_id, created_at, CAST(0.1 AS DOUBLE) FROM (SELECT DISTINCT ON (evidence_id) * FROM evidence) WHERE quote IS NOT NULL) WHERE claim_id IS NOT NULL),
    s AS (SELECT claim_id, list(d ORDER BY moment, d) AS ds, min(d) AS worst FROM v GROUP BY 1)
    SELECT c.claim_id, CASE WHEN worst < 0 THEN 'challenged' ELSE status END AS status,
           round(CASE WHEN ds IS NULL THEN confidence ELSE list_reduce(list_prepend(confidence, ds), lambda a, x: least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), a + x))) END, 4) AS confidence
    FROM {CLAIMS_SQL} c LEFT JOIN s ON s.claim_id = c.claim_id""")  # fmt: skip
def j07(spark, sf):
    """Claims after the verdicts that their conflicts (against) and quotes (for) amount to."""
    c = once(spark, sf, "conflicts", "conflict_id", "primary_claim_id", "created_at").select(F.col("primary_claim_id").alias("claim_id"), F.lit("conflict").alias("verdict"), F.col("created_at").alias("at"))
    e = once(spark, sf, "evidence", "evidence_id", "claim_id", "quote", "created_at").where("quote is not null").select("claim_id", F.lit("useful").alias("verdict"), F.col("created_at").alias("at"))
    out = with_feedback(claims(spark, sf), c.unionByName(e))
    return out.select("claim_id", "status", F.round("confidence", 4).alias("confidence"))


@add("j18_retired", f"""WITH last AS (SELECT source_config_id, max(snapshot_no) AS snapshot_no FROM document_snapshots GROUP BY 1),
    seen AS (SELECT DISTINCT source_config_id, scope, source_url FROM document_snapshots JOIN last USING (source_config_id, snapshot_no))
    SELECT CASE WHEN d.source_config_id IN (SELECT source_config_id FROM last) AND s.source_url IS NULL THEN 'deleted' ELSE d.status END AS status, count(*) AS documents
    FROM {DOCS_SQL} d LEFT JOIN seen s ON s.source_config_id = d.source_config_id AND s.scope = d.scope AND s.source_url = d.source_url GROUP BY ALL""")  # fmt: skip
def j18(spark, sf):
    """Documents after those that their source's last list lacks were retired."""
    s = table(spark, sf, "document_snapshots").select("source_config_id", "scope", "source_url", "snapshot_no")
    last = s.groupBy("source_config_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    seen = s.join(last, ["source_config_id", "snapshot_no"], "left_semi")
    key = ["source_config_id", "scope", "source_url"]
    return retired(documents(spark, sf, *key, "status"), seen, key).groupBy("status").agg(F.count("*").alias("documents"))


@add("j19_expired", f"""SELECT CASE WHEN expires_at <= TIMESTAMP '{AS_OF}' AND status NOT IN ('expired', 'deprecated') THEN 'expired' ELSE status END AS status, count(*) AS claims
    FROM {CLAIMS_SQL} GROUP BY 1""")  # fmt: skip
def j19(spark, sf):
    return expired(claims(spark, sf), at()).groupBy("status").agg(F.count("*").alias("claims"))


# ---- state


@add("k01_claimed", f"""SELECT job_id, source, attempts + 1 AS attempts FROM {JOBS_SQL} WHERE status IN ('queued', 'retry') AND attempts < max_attempts
    ORDER BY priority, updated_at, job_id LIMIT 25""")  # fmt: skip
def k01(spark, sf):
    """The next 25 jobs of the queue; the number is the feature."""
    j = jobs(spark, sf).where("status in ('queued', 'retry') and attempts < max_attempts")
    return j.orderBy("priority", "updated_at", "job_id").limit(25).select("job_id", "source", (F.col("attempts") + 1).alias("attempts"))


@add("k02_recovered", f"""SELECT CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'retry' END AS status, least(900, 30 * power(2, attempts - 1))::BIGINT AS wait_s, count(*) AS jobs
    FROM {JOBS_SQL} WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 10 MINUTE) GROUP BY ALL""")  # fmt: skip
def k02(spark, sf):
    """Jobs whose lease is over: tried again after a growing pause, or failed."""
    lost = F.coalesce(micros(at(AS_OF_EVENTS)) - micros("heartbeat_at") > 600_000_000, F.lit(True))
    j = jobs(spark, sf).where((F.col("status") == "running") & lost)
    status = F.when(F.col("attempts") >= F.col("max_attempts"), "failed").otherwise("retry").alias("status")
    wait = F.least(F.lit(900.0), F.lit(30) * F.pow(F.lit(2), F.col("attempts") - 1)).cast("bigint").alias("wait_s")
    return j.groupBy(status, wait).agg(F.count("*").alias("jobs"))


@add("k05_intake", """SELECT event_type, count(DISTINCT sha256(concat_ws('|', event_type, user_id, props))) AS jobs, count(*) AS deliveries FROM events GROUP BY ALL""")
def k05(spark, sf):
    """Deliveries and the jobs that they are, by a hash of what identifies one."""
    ident = F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), "props"), 256)
    one = table(spark, sf, "events").groupBy("event_type", ident.alias("job")).agg(F.count("*").alias("n"))
    return one.groupBy("event_type").agg(F.count("*").alias("jobs"), F.sum("n").alias("deliveries"))


@add("k07_limited", """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY ALL),
    w AS (
      SELECT user_id, min(s) AS opened_s FROM e GROUP BY 1
      UNION ALL
      SELECT user_id, opened_s FROM (SELECT w.user_id, (SELECT min(e.s) FROM e WHERE e.user_id = w.user_id AND e.s >= w.opened_s + 3600) AS opened_s FROM w) WHERE opened_s IS NOT NULL)
    SELECT w.user_id, w.opened_s, sum(e.n)::BIGINT AS events, least(sum(e.n), 5)::BIGINT AS allowed FROM w
    JOIN e ON e.user_id = w.user_id AND e.s >= w.opened_s AND e.s < w.opened_s + 3600 GROUP BY ALL""")  # fmt: skip
def k07(spark, sf):
    return limited(table(spark, sf, "events"), "user_id", "ts")


@add("k12_windows", """SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def k12(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "6 hours").alias("w"))
    g = g.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "events", "total")


@add("k12_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, nth""")  # fmt: skip
def k12_sessions(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")
