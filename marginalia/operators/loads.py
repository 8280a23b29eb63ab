"""How many intervals are open at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def most_open(intervals: DataFrame, key: str, start_us: str, end_us: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """The most intervals of a key open at one moment, and when that was first: ``key, most, at_us``.

    An interval is open from its start until before its end; one without length,
    or with a null in any of the three columns, is never open. Of several moments
    the earliest counts. A key without open intervals has no row.

    A running sum over all of a hot key would sit in one task. So moves are
    reduced to one a moment, running sums stay within a bucket of time, and the
    sum of all earlier buckets (one row each) is added afterwards.
    """
    ok = F.col(key).isNotNull() & (F.col(end_us) > F.col(start_us))
    i = intervals.where(ok).select(F.col(key).alias("_key"), F.explode(F.array(
        F.struct(F.col(start_us).cast("bigint").alias("at_us"), F.lit(1).alias("step")),
        F.struct(F.col(end_us).cast("bigint").alias("at_us"), F.lit(-1).alias("step")),
    )).alias("m"))
    moves = i.groupBy("_key", "m.at_us").agg(F.sum("m.step").alias("step")).withColumn("_b", F.floor(F.col("at_us") / bucket_us))
    inside = Window.partitionBy("_key", "_b").orderBy("at_us")
    run = moves.withColumn("open", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # Per bucket: the highest running sum (earliest first), and what the bucket adds.
    b = run.groupBy("_key", "_b").agg(F.min(F.struct((-F.col("open")).alias("down"), "at_us")).alias("top"), F.sum("step").alias("adds"))
    before = F.coalesce(F.sum("adds").over(Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = b.select("_key", F.struct((F.col("top.down") - before).alias("down"), F.col("top.at_us").alias("at_us")).alias("t"))
    return tops.groupBy("_key").agg(F.min("t").alias("t")).select(F.col("_key").alias(key), (-F.col("t.down")).alias("most"), F.col("t.at_us").alias("at_us"))


def serial_ends(jobs: DataFrame, key: str, order: str, at_us: str, took_us: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """When each job ends if a key's jobs run one after the other as they come: ``jobs`` with ``end_us`` and ``waited_us``.

    A job starts when it has come and the one before has ended; of jobs that come together the smaller ``order`` goes first.
    ``end[i] = S[i] + max(at[j] - S[j-1] for j <= i)`` with running sums ``S``, which is taken within buckets of time first; what
    the buckets before leave over comes from a row per bucket, so no task holds all of a hot key. Rows with a null in any of the
    columns are ignored; ``order`` must be one of a kind within a key and moment.
    """
    ok = F.col(key).isNotNull() & F.col(at_us).isNotNull() & F.col(took_us).isNotNull() & F.col(order).isNotNull()
    j = jobs.where(ok).withColumn("_b", F.floor(F.col(at_us) / bucket_us))
    inside = Window.partitionBy(key, "_b").orderBy(at_us, order).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_s", F.sum(took_us).over(inside)).withColumn("_m", F.max(F.col(at_us) - F.col("_s") + F.col(took_us)).over(inside))
    b = j.groupBy(key, "_b").agg(F.sum(took_us).alias("_t"), F.max("_m").alias("_x"))
    upto = Window.partitionBy(key).orderBy("_b")
    b = b.withColumn("_c", F.sum("_t").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("_e", F.col("_c") + F.max(F.col("_x") - F.col("_c") + F.col("_t")).over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.select(key, "_b", F.lag("_e").over(upto).alias("_before"))
    end = F.col("_s") + F.greatest("_m", "_before")  # a null, before the first bucket, is passed over
    out = j.join(b, [key, "_b"]).withColumn("end_us", end)
    return out.withColumn("waited_us", F.col("end_us") - F.col(took_us) - F.col(at_us)).drop("_b", "_s", "_m", "_before")
