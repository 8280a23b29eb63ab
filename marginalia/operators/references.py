"""References to records that are missing, deleted or newer than what refers to them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.keys import plain_key
from marginalia.operators.skew import hot_keys_of_each, salted_left_join
from marginalia.session import written
from marginalia.sources.tables import micros


@dataclass(frozen=True)
class Table:
    """How a table takes part: its key, when a row was made, and the status column, if rows can be deleted."""

    key: str
    made: str
    status: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    child: str
    field: str
    parent: str


#: The store's graph. The last two only pass on that a source is gone.
TABLES = {
    "evidence": Table("evidence_id", "created_at"),
    "conflicts": Table("conflict_id", "created_at"),
    "chunks": Table("chunk_id", "created_at"),
    "claims": Table("claim_id", "created_at"),
    "source_documents": Table("document_id", "ingested_at", "status"),
    "source_configs": Table("source_config_id", "created_at", "status"),
}
REPORTED = [
    ForeignKey("evidence", "claim_id", "claims"),
    ForeignKey("evidence", "document_id", "source_documents"),
    ForeignKey("conflicts", "primary_claim_id", "claims"),
    ForeignKey("chunks", "source_config_id", "source_configs"),
]
INHERITING = [ForeignKey("claims", "source_config_id", "source_configs"), ForeignKey("source_documents", "source_config_id", "source_configs")]


def _references(child: DataFrame, t: Table, fk: ForeignKey) -> DataFrame:
    """One row ``row_id, ref, made_us`` per row id: of repeated rows that refer to something, the earliest made."""
    return (
        child.select(F.col(t.key).alias("row_id"), plain_key(F.col(fk.field)).alias("ref"), micros(t.made).alias("made_us"))
        .where(F.col("ref").isNotNull())
        .groupBy("row_id")
        .agg(F.min(F.struct("made_us", "ref")).alias("r"))
        .select("row_id", "r.ref", "r.made_us")
    )


def _parents(parent: DataFrame, t: Table) -> DataFrame:
    """One row ``ref, gone, since`` per key: deleted if all its rows are, made when the first row that isn't was."""
    gone = F.coalesce(F.lower(F.trim(F.col(t.status))) == "deleted", F.lit(False)) if t.status else F.lit(False)
    return (
        parent.select(plain_key(F.col(t.key)).alias("ref"), gone.alias("gone"), micros(t.made).alias("since"))
        .where(F.col("ref").isNotNull())
        .groupBy("ref")
        .agg(F.min("gone").alias("gone"), F.min(F.when(~F.col("gone"), F.col("since"))).alias("since"))
    )


def orphan_references(tables: dict[str, DataFrame], graph: list[ForeignKey], specs: dict[str, Table] = TABLES) -> DataFrame:
    """All references that fail, and those that lead to a row which is itself orphaned.

    Columns ``table_name, field_name, row_id, ref, period, reason, kind, depth``.
    Direct references (depth 0): reason ``missing`` if no row has the key, else
    ``deleted`` if all rows with it are deleted, else ``late`` if it was made after
    the row that refers to it. Then a fixpoint: children of orphaned rows are
    orphaned themselves (kind and reason ``inherited``, depth by round) until a
    round finds no more, by semi-joins down the graph. A key is compared after
    trimming and lower-casing; null or blank is no reference. Rows repeated
    under one id are one row (the earliest made). period is YYYY-MM of the
    referring row, null with an unknown moment, of which nothing can be late.

    References to one key may be a third of a table: the rows of such keys are
    salted. Each round is written to the shared folder.
    """
    direct, edges = [], []
    # Read for hot keys, the direct round and each further one.
    every = reduce(DataFrame.unionByName, [_references(tables[fk.child], specs[fk.child], fk).withColumn("fk", F.lit(i)) for i, fk in enumerate(graph)])
    every = written(every, "references", by="fk")
    hots = hot_keys_of_each(every, "fk", "ref")
    for i, fk in enumerate(graph):
        refs, hot = every.where(F.col("fk") == i).drop("fk"), hots.get(i, [])
        met = salted_left_join(refs, _parents(tables[fk.parent], specs[fk.parent]), "ref", F.col("row_id"), hot=hot)
        reason = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("since") > F.col("made_us"), "late")
        named = met.select(
            F.lit(fk.child).alias("table_name"),
            F.lit(fk.field).alias("field_name"),
            "row_id",
            "ref",
            F.date_format(F.timestamp_add("MICROSECOND", F.col("made_us"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "yyyy-MM").alias("period"),
            reason.alias("reason"),
        )
        direct.append(named.where("reason is not null").withColumns({"kind": F.lit("direct"), "depth": F.lit(0)}))
        edges.append((fk, refs, hot))
    known = found = written(reduce(DataFrame.unionByName, direct), "orphans")
    depth = 0
    while True:
        depth += 1
        grown = []
        for fk, refs, hot in edges:
            if not any(e.child == fk.parent for e, *_ in edges):
                continue  # no row of the parent can be an orphan
            lost = found.where(F.col("table_name") == fk.parent).select(plain_key(F.col("row_id")).alias("ref")).distinct()
            held = known.where((F.col("table_name") == fk.child) & (F.col("field_name") == fk.field)).select("row_id")
            new = salted_left_join(refs, lost, "ref", F.col("row_id"), how="left_semi", hot=hot).join(held, "row_id", "left_anti")
            grown.append(
                new.select(
                    F.lit(fk.child).alias("table_name"), F.lit(fk.field).alias("field_name"), "row_id", "ref",
                    F.date_format(F.timestamp_add("MICROSECOND", F.col("made_us"), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")), "yyyy-MM").alias("period"),
                    F.lit("inherited").alias("reason"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth"),
                )
            )
        if not grown:
            return known
        found = written(reduce(DataFrame.unionByName, grown), "orphans")
        if found.isEmpty():
            return known
        known = known.unionByName(found)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Failing references per table, field, month, reason and kind."""
    return orphans.groupBy("table_name", "field_name", "period", "reason", "kind").agg(F.count("*").alias("references"), F.countDistinct("ref").alias("keys"))
