"""Joining events to the version that held when they happened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import written


def held_when(events: DataFrame, versions: DataFrame, key: str, at_us: str) -> DataFrame:
    """``events`` with the version (columns but ``key``) that held at ``at_us``; null where none did.

    ``versions`` have ``key, start_us, end_us`` (null: open) and don't overlap within a
    key. Both are laid out as one table sorted by key and time (a version before the events of its start) in ranges, so
    that a key with a third of all rows spans many. Within each part of a key the last version is carried on to the events;
    events before a part's first version get the last one of the parts before, of which there is a row each.
    No row is repeated, however long a version lasts. Column names of both sides must differ but for the key.
    """
    e_cols, v_cols = events.columns, [c for c in versions.columns if c != key]
    version = F.struct(*v_cols)
    kind = versions.select(version.alias("v")).schema["v"].dataType
    e = events.select(F.col(key).alias("_k"), F.col(at_us).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.struct(*e_cols).alias("_e"))
    v = versions.where(F.col(key).isNotNull() & F.col("start_us").isNotNull())
    v = v.select(F.col(key).alias("_k"), F.col("start_us").alias("_t"), F.lit(0).alias("_side"), version.alias("_v"), F.lit(None).cast(e.schema["_e"].dataType).alias("_e"))
    # Written once, as adaptive execution may coalesce ranges differently for each reader of an exchange.
    laid = written(e.unionByName(v).repartitionByRange("_k", "_t", "_side").withColumn("_part", F.spark_partition_id()), "held")
    upto = Window.partitionBy("_k", "_part").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = laid.withColumn("_v", F.last("_v", ignorenulls=True).over(upto)).where("_side = 1")
    ends = laid.groupBy("_k", "_part").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range that holds the key
    carried = ends.select(F.col("_k").alias("_k2"), F.col("_part").alias("_part2"), F.last("_last", ignorenulls=True).over(before).alias("_before")).where("_before IS NOT NULL")
    met = here.join(carried, (F.col("_k") == F.col("_k2")) & (F.col("_part") == F.col("_part2")), "left").withColumn("_v", F.coalesce("_v", "_before"))
    holds = F.col("_t").isNotNull() & (F.col("_v.end_us").isNull() | (F.col("_v.end_us") > F.col("_t")))
    return met.withColumn("_v", F.when(holds, F.col("_v"))).select(*[F.col(f"_e.{c}").alias(c) for c in e_cols], *[F.col(f"_v.{c}").alias(c) for c in v_cols])
