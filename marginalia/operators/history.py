"""The full history of an entity's changing attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import written
from marginalia.sources.tables import micros


def effective_updates(
    updates: DataFrame,
    attributes: dict[str, Column],
    entity: str = "claim_id",
    update_id: str = "update_id",
    effective: str = "valid_from",
    received: str = "received_at",
    expires: str = "expires_at",
) -> DataFrame:
    """One row ``(entity, eff, exp, a0, a1, ...)`` for each moment at which an entity's attributes were set.

    Rows with one update id are one update, of which the first received counts
    (of equal receipts the smallest row). An update takes effect at
    ``effective``, or when received if that is null; it is void if it has no
    such moment or expires no later. Of several updates of an entity at one
    moment the last received counts, then the greatest id. Rows without entity
    are ignored; rows without an update id are each an update of their own, but
    equal ones count once. Times are microseconds since 1970.
    """
    u = updates.select(
        F.col(entity).alias("entity"),
        F.col(update_id).alias("uid"),
        micros(received).alias("rec"),
        F.coalesce(micros(effective), micros(received)).alias("eff"),
        micros(expires).alias("exp"),
        *[c.alias(f"a{i}") for i, c in enumerate(attributes.values())],
    ).where(F.col("entity").isNotNull())
    rest = [c for c in u.columns if c not in ("uid", "rec")]
    row = F.struct(F.coalesce("rec", F.lit(2**62)).alias("first"), "rec", *rest)
    lone = F.when(F.col("uid").isNull(), F.xxhash64("rec", *rest))
    u = u.groupBy("uid", lone.alias("lone")).agg(F.min(row).alias("r")).select("uid", "r.rec", *[f"r.{c}" for c in rest])
    u = u.where(F.col("eff").isNotNull() & (F.col("exp").isNull() | (F.col("exp") > F.col("eff"))))
    last = F.struct("rec", "uid", "exp", *rest[3:])
    return u.groupBy("entity", "eff").agg(F.max(last).alias("r")).select("entity", "eff", "r.exp", *[f"r.{c}" for c in rest[3:]])


def segmented(df: DataFrame, key: str, at: str, most: int, name: str) -> tuple[DataFrame, int]:
    """``df`` sorted by key and moment over the whole table and cut every ``most`` rows: with ``seg``, ``left`` and ``right``; and the greatest ``seg``.

    Segments are numbered in order. ``left`` marks a segment's first row and ``right`` its last
    one, or all rows of a range's last segment: only at such rows can a key go on in
    another segment. The table is written once, so that all its readers see the same segments. A moment must be one of a kind within its key.
    """
    place = F.monotonically_increasing_id()  # the number of the range, and 33 bits for the row within it
    laid = written(df.repartitionByRange(key, at).sortWithinPartitions(key, at).withColumn("_place", place), name)
    part, row = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    ends = laid.groupBy(part.alias("_part")).agg(F.max(row).alias("_row"))  # a row per range
    most_parts, most_rows = ends.agg(F.max("_part"), F.max("_row")).first()
    width = (most_rows or 0) // most + 1
    cut = laid.select(*df.columns, part.alias("_part"), row.alias("_row")).join(F.broadcast(ends.withColumnRenamed("_row", "_end")), "_part")
    seg = F.expr(f"_part * {width} + _row div {most}")
    left, right = F.col("_row") % most == 0, (F.col("_row") % most == most - 1) | F.expr(f"_row div {most} = _end div {most}")
    return cut.select(*df.columns, seg.alias("seg"), left.alias("left"), right.alias("right")), ((most_parts or 0) + 1) * width - 1


def attribute_history(updates: DataFrame, attributes: dict[str, Column], entity: str = "claim_id", max_fold: int = 256, **columns: str) -> DataFrame:
    """Each version of each entity with the period in which it held.

    Columns: ``entity`` by its own name, ``start_us``, ``end_us`` (null: it still
    holds) and the attributes. A version ends at its expiry or when the entity's
    next update takes effect. Versions that follow each other without a gap and
    agree in all attributes (a null equals a null) are one.

    The moments of all entities are sorted and cut into segments of ``max_fold``; an entity's moments
    within a segment are folded as one sorted array by a higher-order function that appends a version only upon change. Where
    an entity may go on in the next segment, its outermost versions there are folded once more together with
    those of the neighbouring segments, and so on in ever fewer and wider ones. So no array
    is longer than ``max_fold`` and no task holds an entity, however many moments it has, and small and large
    entities go the same way. Of an empty table the history is empty.
    """
    names = list(attributes)
    moments = effective_updates(updates, attributes, entity, **columns)
    att = [f"a{i}" for i in range(len(names))]
    version = "struct<s:bigint,e:bigint," + ",".join(f"{a}:{moments.schema[a].dataType.simpleString()}" for a in att) + ">"

    def folded(parts: DataFrame) -> DataFrame:
        """The versions of each entity and segment, from parts of versions (``s, e`` and attributes), of which none goes on when the next begins."""
        rows = parts.groupBy("entity", "seg").agg(
            F.array_sort(F.collect_list(F.struct("s", "e", *att))).alias("rows"), F.max("left").alias("left"), F.max("right").alias("right")
        )
        ends = F.transform(
            "rows", lambda x, i: F.struct(x["s"].alias("s"), F.least(x["e"], F.get("rows", i + 1)["s"]).alias("e"), *[x[a].alias(a) for a in att]).cast(version)
        )

        def fold(acc: Column, x: Column) -> Column:
            cur = acc["cur"]
            same = cur["e"] == x["s"]
            for a in att:
                same = same & cur[a].eqNullSafe(x[a])
            grown = F.struct(cur["s"].alias("s"), x["e"].alias("e"), *[cur[a].alias(a) for a in att]).cast(version)
            on = F.coalesce(same, F.lit(False))
            return F.struct(
                F.when(on | cur.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(cur))).cast(f"array<{version}>").alias("done"),
                F.when(on, grown).otherwise(x).cast(version).alias("cur"),
            )

        start = F.struct(F.array().cast(f"array<{version}>").alias("done"), F.lit(None).cast(version).alias("cur"))
        return rows.withColumn("versions", F.aggregate(ends, start, fold, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))).drop("rows")

    first = moments.select("entity", F.col("eff").alias("s"), F.col("exp").alias("e"), *att)
    parts, last = segmented(first, "entity", "s", max_fold, "moments")
    fan = max(2, max_fold // 2)
    done = None
    while True:
        f = folded(parts)
        if not last:  # one segment is left
            settled = f.select("entity", F.explode("versions").alias("v"))
            done = settled if done is None else done.unionByName(settled)
            break
        outer = (F.col("left") & (F.col("i") == 0)) | (F.col("right") & (F.col("i") == F.size("versions") - 1))
        settled = f.select("*", F.posexplode("versions").alias("i", "v")).where(~outer).select("entity", "v")
        done = settled if done is None else done.unionByName(settled)
        up = f.where("left OR right").select("*", F.posexplode("versions").alias("i", "v")).where(outer)
        parts = up.select("entity", F.expr(f"seg div {fan}").alias("seg"), "v.*", F.lit(True).alias("left"), F.lit(True).alias("right"))
        last //= fan
    return done.select(
        F.col("entity").alias(entity), F.col("v.s").alias("start_us"), F.col("v.e").alias("end_us"),
        *[F.col(f"v.{a}").alias(n) for a, n in zip(att, names)],
    )


def states_at(history: DataFrame, at_us: Sequence[int] | int) -> DataFrame:
    """The versions that hold at an instant (or at each of several): start inclusive, end exclusive."""
    ats = F.explode(F.array(*[F.lit(t) for t in ([at_us] if isinstance(at_us, int) else at_us)])).alias("at_us")
    h = history.select("*", ats)
    return h.where((F.col("start_us") <= F.col("at_us")) & (F.col("end_us").isNull() | (F.col("end_us") > F.col("at_us"))))
