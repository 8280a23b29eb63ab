"""Queries of the general numbered problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.keys import none_if_blank
from marginalia.operators.history import attribute_history, states_at
from marginalia.operators.references import INHERITING, REPORTED, TABLES, orphan_counts, orphan_references
from marginalia.operators.snapshots import snapshot_changes
from marginalia.plans import Registry
from marginalia.sources.tables import table

registry = Registry()
add = registry.add

_P1 = """
    WITH one AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY update_id ORDER BY received_at) AS nth FROM claim_updates) WHERE nth = 1),
    eff AS (
      SELECT claim_id, coalesce(valid_from, received_at) AS eff, expires_at, received_at, update_id,
             lower(trim(status)) AS status, nullif(trim(supersedes_claim_id), '') AS sup
      FROM one WHERE expires_at IS NULL OR expires_at > coalesce(valid_from, received_at)),
    last AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, eff ORDER BY received_at DESC, update_id DESC) AS nth FROM eff) WHERE nth = 1),
    ends AS (
      SELECT *, least(expires_at, lead(eff) OVER (PARTITION BY claim_id ORDER BY eff)) AS until FROM last),
    marked AS (
      SELECT *, CASE WHEN lag(until) OVER w = eff AND lag(status) OVER w IS NOT DISTINCT FROM status
                      AND lag(sup) OVER w IS NOT DISTINCT FROM sup THEN 0 ELSE 1 END AS fresh
      FROM ends WINDOW w AS (PARTITION BY claim_id ORDER BY eff)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY claim_id ORDER BY eff) AS run FROM marked),
    versions AS (
      SELECT claim_id, min(eff) AS s, CASE WHEN bool_or(until IS NULL) THEN NULL ELSE max(until) END AS e,
             any_value(status) AS status, any_value(sup) AS sup
      FROM runs GROUP BY claim_id, run)
"""


def claim_history(spark: SparkSession, sf: str) -> DataFrame:
    return attribute_history(
        table(spark, sf, "claim_updates"),
        {"status": F.lower(F.trim("status")), "supersedes_claim_id": none_if_blank(F.trim("supersedes_claim_id"))},
    )


def _seconds(c: str):
    return F.floor(F.col(c) / 1_000_000)


@add("p1_found", _P1 + """SELECT claim_id, CAST(floor(epoch(s)) AS BIGINT) AS start_s,
    CAST(coalesce(floor(epoch(e)), 0) AS BIGINT) AS end_s, status FROM versions""")  # fmt: skip
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return claim_history(spark, sf).select(
        "claim_id", _seconds("start_us").alias("start_s"), F.coalesce(_seconds("end_us"), F.lit(0)).alias("end_s"), "status"
    )


#: Instants of the report of what held when.
QUARTERS = ["2025-01-01", "2025-04-01", "2025-07-01", "2025-10-01", "2026-01-01"]


@add("p1_held_at", _P1 + f"""SELECT q.at AS at_date, status, count(*) AS claims FROM versions,
    (SELECT unnest({QUARTERS}) AS at) q WHERE s <= CAST(q.at AS TIMESTAMP) AND (e IS NULL OR e > CAST(q.at AS TIMESTAMP))
    GROUP BY ALL""")  # fmt: skip
def p1_held_at(spark: SparkSession, sf: str) -> DataFrame:
    """How many claims had which status at the start of each quarter."""
    import datetime as dt

    at = {q: int(dt.datetime.fromisoformat(q).replace(tzinfo=dt.UTC).timestamp()) * 1_000_000 for q in QUARTERS}
    day = F.coalesce(*[F.when(F.col("at_us") == v, q) for q, v in at.items()])
    return states_at(claim_history(spark, sf), list(at.values())).groupBy(day.alias("at_date"), "status").agg(F.count("*").alias("claims"))


_P2 = r"""
    WITH top AS (SELECT source_config_id, snapshot_no, max(delivery_no) AS delivery_no FROM document_snapshots GROUP BY ALL),
    lists AS (SELECT *, lag(snapshot_no) OVER w AS before, lead(snapshot_no) OVER w AS after FROM top
              WINDOW w AS (PARTITION BY source_config_id ORDER BY snapshot_no)),
    raw AS (
      SELECT d.source_config_id, scope, snapshot_no, before, after, ingested_at,
             regexp_replace(regexp_replace(source_url, '#.*$', '', 's'), '/+$', '') AS bare,
             regexp_replace(lower(coalesce(content_checksum, '')), '^sha256:', '') AS checksum
      FROM document_snapshots d JOIN lists USING (source_config_id, snapshot_no, delivery_no)),
    cased AS (
      SELECT *, regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1) AS head FROM raw),
    docs AS (
      SELECT source_config_id, scope, lower(head) || substr(bare, length(head) + 1) AS source_url, snapshot_no, before, after,
             max({'t': ingested_at, 'c': checksum}).c AS checksum
      FROM cased GROUP BY ALL),
    changes AS (
      SELECT b.source_config_id, b.scope, b.source_url, b.snapshot_no,
             CASE WHEN a.source_url IS NULL THEN 'added' ELSE 'changed' END AS change_kind
      FROM docs b LEFT JOIN docs a ON a.source_config_id = b.source_config_id AND a.scope = b.scope AND a.source_url = b.source_url
           AND a.snapshot_no = b.before
      WHERE b.before IS NOT NULL AND (a.source_url IS NULL OR a.checksum <> b.checksum)
      UNION ALL
      SELECT a.source_config_id, a.scope, a.source_url, a.after, 'removed'
      FROM docs a LEFT JOIN docs b ON a.source_config_id = b.source_config_id AND a.scope = b.scope AND a.source_url = b.source_url
           AND b.snapshot_no = a.after
      WHERE a.after IS NOT NULL AND b.source_url IS NULL)
"""


@add("p2_found", _P2 + "SELECT source_config_id, scope, source_url, CAST(snapshot_no AS BIGINT) AS snapshot_no, change_kind FROM changes")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshot_changes(table(spark, sf, "document_snapshots"))


@add("p2_counts", _P2 + "SELECT source_config_id, CAST(snapshot_no AS BIGINT) AS snapshot_no, change_kind, count(*) AS documents FROM changes GROUP BY ALL")
def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p2_found(spark, sf).groupBy("source_config_id", "snapshot_no", "change_kind").agg(F.count("*").alias("documents"))


#: Columns that a list says of a document besides its text.
SIDE = ["title", "authority", "freshness_status"]
_SIDE = ", ".join(f"coalesce({c}, '') AS {c}" for c in SIDE)
_P2_SIDE = _P2.replace("AS checksum\n      FROM document_snapshots", f"AS checksum, {_SIDE}\n      FROM document_snapshots").replace(
    "max({'t': ingested_at, 'c': checksum}).c AS checksum", "unnest(max({'t': ingested_at, 'checksum': checksum, " + ", ".join(f"'{c}': {c}" for c in SIDE) + "}))"
).replace("FROM cased GROUP BY ALL", "FROM cased GROUP BY source_config_id, scope, lower(head) || substr(bare, length(head) + 1), snapshot_no, before, after")


@add("p2_fields", _P2_SIDE + f""", both AS (
      SELECT CASE WHEN a.checksum <> b.checksum THEN 'changed' ELSE 'touched' END AS change_kind, unnest([{", ".join(f"CASE WHEN a.{c} <> b.{c} THEN '{c}' END" for c in SIDE)}]) AS field
      FROM docs b JOIN docs a ON a.source_config_id = b.source_config_id AND a.scope IS NOT DISTINCT FROM b.scope AND a.source_url = b.source_url AND a.snapshot_no = b.before)
    SELECT change_kind, field, count(*) AS documents FROM both WHERE field IS NOT NULL GROUP BY ALL""".replace(", both AS", ", pairs AS").replace("FROM both", "FROM pairs"))  # fmt: skip
def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    """How often each side column differs between a list and the one before, of documents with another text and with the same."""
    c = snapshot_changes(table(spark, sf, "document_snapshots"), SIDE).where("fields <> ''")
    return c.select("change_kind", F.explode(F.split("fields", ",")).alias("field")).groupBy("change_kind", "field").agg(F.count("*").alias("documents"))


def _norm(c: str) -> str:
    return rf"nullif(lower(regexp_replace({c}, '^[ \t]+|[ \t]+$', '', 'g')), '')"


def _direct(t: str, key: str, field: str, parent: str, pkey: str, made: str, deletable: bool) -> str:
    gone = "bool_and(coalesce(lower(trim(status)) = 'deleted', false))" if deletable else "false"
    since = f"min({made}) FILTER (WHERE coalesce(lower(trim(status)), '') <> 'deleted')" if deletable else f"min({made})"
    return f"""
      SELECT '{t}' AS table_name, '{field}' AS field_name, c.row_id, c.ref, strftime(c.made, '%Y-%m') AS period,
             CASE WHEN p.ref IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.since > c.made THEN 'late' END AS reason
      FROM (SELECT {key} AS row_id, {_norm(field)} AS ref, min(created_at) AS made FROM {t} WHERE {_norm(field)} IS NOT NULL GROUP BY ALL) c
      LEFT JOIN (SELECT {_norm(pkey)} AS ref, {gone} AS gone, {since} AS since FROM {parent} GROUP BY 1) p ON p.ref = c.ref"""


_P4 = "WITH direct AS (SELECT * FROM (" + " UNION ALL ".join([
    _direct("evidence", "evidence_id", "claim_id", "claims", "claim_id", "created_at", False),
    _direct("evidence", "evidence_id", "document_id", "source_documents", "document_id", "ingested_at", True),
    _direct("conflicts", "conflict_id", "primary_claim_id", "claims", "claim_id", "created_at", False),
    _direct("chunks", "chunk_id", "source_config_id", "source_configs", "source_config_id", "created_at", True),
]) + ") WHERE reason IS NOT NULL) "


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references({t: table(spark, sf, t) for t in TABLES}, REPORTED + INHERITING)


def _reported(c: DataFrame) -> DataFrame:
    named = F.concat_ws(".", "table_name", "field_name")
    return c.where(named.isin([f"{k.child}.{k.field}" for k in REPORTED]))


@add("p4_found", _P4 + "SELECT table_name, field_name, row_id, period, reason FROM direct")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _reported(_orphans(spark, sf).where("kind = 'direct'")).select("table_name", "field_name", "row_id", "period", "reason")


@add("p4_counts", _P4 + """SELECT table_name, field_name, period, reason, count(*) AS "references", count(DISTINCT ref) AS keys
    FROM direct GROUP BY ALL""")  # fmt: skip
def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    direct = _orphans(spark, sf).where("kind = 'direct'")
    return orphan_counts(_reported(direct)).select("table_name", "field_name", "period", "reason", "references", "keys")


_LOST = " UNION ALL ".join([
    _direct("claims", "claim_id", "source_config_id", "source_configs", "source_config_id", "created_at", True),
    _direct("source_documents", "document_id", "source_config_id", "source_configs", "source_config_id", "created_at", True)
    .replace("min(created_at) AS made FROM source_documents", "min(ingested_at) AS made FROM source_documents"),
])


@add("p4_inherited", _P4 + f""", upper AS (SELECT * FROM ({_LOST}) WHERE reason IS NOT NULL),
    refs AS (
      SELECT 'evidence' AS table_name, 'claim_id' AS field_name, 'claims' AS parent, evidence_id AS row_id, {_norm('claim_id')} AS ref, min(created_at) AS made FROM evidence GROUP BY ALL
      UNION ALL SELECT 'evidence', 'document_id', 'source_documents', evidence_id, {_norm('document_id')}, min(created_at) FROM evidence GROUP BY ALL
      UNION ALL SELECT 'conflicts', 'primary_claim_id', 'claims', conflict_id, {_norm('primary_claim_id')}, min(created_at) FROM conflicts GROUP BY ALL)
    SELECT r.table_name, r.field_name, strftime(r.made, '%Y-%m') AS period, count(*) AS "references", count(DISTINCT r.ref) AS keys
    FROM refs r WHERE (r.parent, r.ref) IN (SELECT (table_name, {_norm('row_id')}) FROM upper)
      AND (r.table_name, r.field_name, r.row_id) NOT IN (SELECT (table_name, field_name, row_id) FROM direct) GROUP BY ALL""")  # fmt: skip
def p4_inherited(spark: SparkSession, sf: str) -> DataFrame:
    """References to rows that exist but are orphans themselves."""
    c = orphan_counts(_reported(_orphans(spark, sf).where("kind = 'inherited'")))
    return c.select("table_name", "field_name", "period", "references", "keys")
