"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, key: str, most: int = 500, rows: int = 10_000) -> list:
    """The ``most`` largest keys of those with at least ``rows`` rows.

    Whatever the data, all keys with more than one in ``most`` rows are among
    them. Counted over all rows with map-side aggregation; one row per hot key comes to the driver.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    return [r.k for r in counts.orderBy(F.desc("n"), "k").limit(most).collect()]


def hot_keys_of_each(df: DataFrame, group: str, key: str, most: int = 500, rows: int = 10_000) -> dict:
    """``hot_keys`` of each of a few groups, in one job."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(group).alias("g"), F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    top = counts.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "k"))).where(F.col("nth") <= most)
    found: dict = {}
    for r in top.collect():
        found.setdefault(r.g, []).append(r.k)
    return found


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int = 32, how: str = "left", hot: list | None = None) -> DataFrame:
    """``left`` joined to ``right`` (one row a key) on ``key``, with the rows of hot keys dealt over ``salts`` tasks.

    ``spread`` is a column of ``left`` that differs within a hot key. Rows with
    a null key stay (left) and meet nothing; they are dealt out as well.
    Only the right rows of the few hot keys are repeated. ``hot``: those keys, if they are known.
    """
    hot = hot_keys(left, key) if hot is None else hot
    deal = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    is_hot = lambda c: c.isin(hot) if hot else F.lit(False)
    l = left.withColumn("_salt", F.when(F.col(key).isNull() | is_hot(F.col(key)), deal).otherwise(0))
    r = right.where(F.col(key).isNotNull()).withColumn(
        "_salt", F.explode(F.when(is_hot(F.col(key)), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return l.join(r, [key, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it would come in fewer parts: for costly work on each row of a small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
