"""Percentiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import written


def nearest_ranks(df: DataFrame, key: str, value: str, percents: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles of ``value`` by ``key``: ``key`` and a column for each name of ``percents``.

    Distinct values are counted first and range-partitioned by key and value, so a hot key
    spans ranges. Sums per range tell which one holds a rank; only that range's values are
    walked. Null values are ignored; a key without others gives nulls, a null key is a key.
    """
    per = df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    # Written once, as adaptive execution may coalesce ranges differently for each reader of an exchange.
    ranges = written(per.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()), "ranks")
    known = ranges.where("value IS NOT NULL")
    by = Window.partitionBy("key")
    sums = known.groupBy("key", "part").agg(F.sum("n").alias("held"))
    sums = sums.withColumn("upto", F.sum("held").over(by.orderBy("part"))).withColumn("total", F.sum("held").over(by))
    ranks = F.array(*[F.struct(F.lit(k).alias("name"), F.greatest(F.lit(1), F.expr(f"(total * {p} + 99) div 100")).alias("rank")) for k, p in percents.items()])
    wanted = sums.select(F.col("key").alias("k"), F.col("part").alias("at"), "upto", "held", F.explode(ranks).alias("r")).select("*", "r.*").where("rank <= upto AND rank > upto - held")
    j = known.join(wanted, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("at")))
    j = j.withColumn("reached", F.col("upto") - F.col("held") + F.sum("n").over(Window.partitionBy("key", "part", "name").orderBy("value")))
    found = j.where("reached >= rank AND reached - n < rank").select("key", "name", "value")
    every = ranges.select("key", F.lit("").alias("name"), F.lit(None).cast(df.schema[value].dataType).alias("value")).distinct()
    out = found.unionByName(every).groupBy("key").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in percents])
    return out.withColumnRenamed("key", key)
