"""What changed between full lists that are delivered periodically."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.keys import plain_address, plain_checksum


def listed(snapshots: DataFrame, side: Sequence[str] = ()) -> DataFrame:
    """The rows that count: one per source, document and snapshot, with the numbers of the source's lists before and after.

    Columns ``source_config_id, scope, url, checksum, snapshot_no, before, after``, and the ``side`` fields as texts (a null as an empty one).
    Only a snapshot's greatest delivery counts; a null delivery counts as the
    least. A document listed twice in one delivery counts as it was ingested
    last, then with the greatest checksum. Rows without source, address or
    snapshot number are ignored; a null scope is a scope of its own.
    """
    s = snapshots.select(
        "source_config_id",
        "scope",
        plain_address(F.col("source_url")).alias("url"),
        plain_checksum(F.col("content_checksum")).alias("checksum"),
        "snapshot_no",
        F.coalesce("delivery_no", F.lit(-(2**31))).alias("delivery"),
        "ingested_at",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"side_{c}") for c in side],
    ).where("source_config_id is not null and url is not null and snapshot_no is not null")
    names = [f"side_{c}" for c in side]
    # One row per source and snapshot: small beside the lists, joined as Spark finds it by its size.
    w = Window.partitionBy("source_config_id").orderBy("snapshot_no")
    lists = (
        s.groupBy("source_config_id", "snapshot_no")
        .agg(F.max("delivery").alias("delivery"))
        .withColumns({"before": F.lag("snapshot_no").over(w), "after": F.lead("snapshot_no").over(w)})
    )
    one = s.groupBy("source_config_id", "scope", "url", "snapshot_no", "delivery").agg(
        F.max(F.struct(F.coalesce(F.col("ingested_at").cast("timestamp_ntz"), F.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'")).alias("t"), "checksum", *names)).alias("r")
    )
    return one.join(lists, ["source_config_id", "snapshot_no", "delivery"]).select(
        "source_config_id", "scope", "url", "r.checksum", "snapshot_no", "before", "after", *[f"r.{c}" for c in names]
    )


def _merge(batches: Iterator[pd.DataFrame], side: Sequence[str] = ()) -> Iterator[pd.DataFrame]:
    """Merges the lists of a range. The sort has interleaved them by key, so that each
    document's row in a list stands next to its row in the list before: the two
    pointers move together, and a batch and the last document's row are all that is held."""
    held: pd.DataFrame | None = None

    def compared(b: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        """Changes seen between neighbouring rows of ``b``, whose first row was compared before unless it opens the range."""
        key = b[["source_config_id", "scope", "url"]].fillna({"scope": "\0"}).to_numpy(dtype=object)
        same = np.zeros(len(b), bool)
        same[1:] = (key[1:] == key[:-1]).all(1)
        no = b.snapshot_no.to_numpy(dtype=float)
        before, after = b.before.to_numpy(dtype=float), b.after.to_numpy(dtype=float)
        prev = np.where(same, np.roll(no, 1), np.nan)
        met = same & (prev == before)  # the row above is this document in the list before
        sums = b.checksum.to_numpy(dtype=object)
        changed = met & (sums != np.roll(sums, 1))
        other = {c: met & (v != np.roll(v, 1)) for c in side for v in [b[f"side_{c}"].to_numpy(dtype=object)]}
        touched = np.logical_or.reduce(list(other.values())) & ~changed if other else np.zeros(len(b), bool)
        added = ~met & ~np.isnan(before)
        gone = ~np.isnan(after) & ~np.append(met[1:], False)  # the row below isn't it in the list after
        if not last:
            gone[-1] = False
        fresh = ~b.seen.to_numpy(dtype=bool)
        out = []
        for mask, kind, at in ((added & fresh, "added", no), (changed & fresh, "changed", no), (touched & fresh, "touched", no), (gone, "removed", after)):
            part = b.loc[mask, ["source_config_id", "scope", "url"]].assign(snapshot_no=at[mask].astype("int64"), change_kind=kind)
            if side:
                here = (kind == "changed") | (kind == "touched")
                part["fields"] = pd.Series([",".join(c for c in side if here and other[c][i]) for i in np.flatnonzero(mask)], part.index, dtype=object)
            out.append(part)
        return pd.concat(out), b.iloc[-1:].assign(seen=True)

    for b in batches:
        if len(b):
            b = b.assign(seen=False)
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            out, held = compared(b, False)
            yield out
    if held is not None:
        yield compared(held, True)[0]


def snapshot_changes(snapshots: DataFrame, side: Sequence[str] = ()) -> DataFrame:
    """The documents added, removed and changed between each list and the same source's list before.

    Columns ``source_config_id, scope, source_url, snapshot_no, change_kind``;
    a source's first list yields nothing, a list never delivered is passed over.
    The lists are range-partitioned and sorted by (source, scope, address,
    snapshot), so a source with most of the rows spans many tasks, and each range
    is merged in one pass. Nulls and repeats: see ``listed``. Of an empty table nothing changed.

    With ``side``, names of further columns, these are compared as well: ``fields`` names those that differ (joined by commas), and a document of
    the same checksum that differs in them is ``touched``.
    """
    key, side = ["source_config_id", "scope", "url"], tuple(side)
    rows = listed(snapshots, side).repartitionByRange(*key).sortWithinPartitions(*key, "snapshot_no")
    schema = "source_config_id string, scope string, url string, snapshot_no bigint, change_kind string" + (", fields string" if side else "")
    return rows.mapInPandas(lambda batches: _merge(batches, side), schema).withColumnRenamed("url", "source_url")
