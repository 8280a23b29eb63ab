"""Mutations as pure functions from a table and its changes to the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of several new rows the greatest by ``order``.

    Null keys equal each other. One shuffle of both tables by the key.
    """
    both = old.withColumns({"_new": F.lit(0), "_o": F.lit(None).cast("bigint")}).unionByName(new.withColumns({"_new": F.lit(1), "_o": order.cast("bigint")}))
    cols = [F.col(c) for c in old.columns]
    best = both.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*cols), F.struct("_new", "_o")).alias("r"))
    return best.select("r.*")


def expired(claims: DataFrame, at: Column) -> DataFrame:
    """Claims whose expiry has come are set to expired, unless they are deprecated."""
    over = (F.col("expires_at") <= at) & ~F.col("status").isin("expired", "deprecated")
    return claims.withColumn("status", F.when(over, "expired").otherwise(F.col("status")))


def retired(documents: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Documents of the sources in ``seen`` that are no longer listed there are set to deleted."""
    sources = seen.select(F.col("source_config_id").alias("_s")).distinct().withColumn("_read", F.lit(True))
    listed = seen.select(*keys).distinct().withColumn("_listed", F.lit(True))
    d = documents.join(sources, F.col("source_config_id") == F.col("_s"), "left").drop("_s").join(listed, keys, "left")
    gone = F.col("_read") & F.col("_listed").isNull()
    return d.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).drop("_read", "_listed")


def with_feedback(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims after verdicts ``(claim_id, verdict, at)``, applied in order of ``at``.

    incorrect, stale and conflict set a claim to challenged and take 0.25 from its
    confidence, correct and useful add 0.1, always within 0 and 1. As the bounds
    make the order matter, each claim's verdicts are first composed: a step
    x -> min(hi, max(lo, x + d)) after another is such a step again, so that
    partial results of a claim with very many verdicts come from many tasks.
    """
    step = F.when(F.col("verdict").isin("incorrect", "stale", "conflict"), -0.25).when(F.col("verdict").isin("correct", "useful"), 0.1)
    v = verdicts.select("claim_id", "at", step.alias("d")).where("claim_id is not null and d is not null")
    ordered = lambda c, *key: F.array_sort(F.collect_list(F.struct(*key, *c)))

    def composed(rows: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        clamp = lambda x, lo, hi: F.least(hi, F.greatest(lo, x))
        return F.aggregate(rows, start, lambda a, x: F.struct(
            (a["d"] + x["d"]).alias("d"),
            clamp(a["lo"] + x["d"], x["lo"], x["hi"]).alias("lo"),
            clamp(a["hi"] + x["d"], x["lo"], x["hi"]).alias("hi"),
        ))

    part = v.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0), "worst": F.col("d")})
    for unit in ("second", "hour", "month"):  # slices of a claim's time line, each composed from the finer ones, so that none is long
        part = part.groupBy("claim_id", F.date_trunc(unit, F.col("at")).alias("at")).agg(
            composed(ordered(["d", "lo", "hi"], "at")).alias("s"), F.min("worst").alias("worst")
        ).select("claim_id", "at", "s.*", "worst")
    whole = part.groupBy("claim_id").agg(composed(ordered(["d", "lo", "hi"], "at")).alias("s"), F.min("worst").alias("worst"))
    c = claims.join(whole, "claim_id", "left")
    moved = F.least(F.col("s.hi"), F.greatest(F.col("s.lo"), F.col("confidence") + F.col("s.d")))
    return c.withColumns({
        "confidence": F.when(F.col("s").isNotNull(), moved).otherwise(F.col("confidence")),
        "status": F.when(F.col("worst") < 0, "challenged").otherwise(F.col("status")),
    }).drop("s", "worst")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
