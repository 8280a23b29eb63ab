"""Greedy packing of blocks into a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import written

#: The fate of a row that only tells what a packet has left at the end of the range in which it began.
_NOTE = "note"


def _folder(budget: int, least: int, ranged: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks sorted rows with what the open packet has left.

    ``ranged``: the first packet may have begun in a range before. Then only the
    most that it can have left is known: blocks beyond that are dropped, blocks
    without cost kept, and the others, each of which lowers that most, go out without a fate.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, known, note = None, budget, True, None
        for b in batches:
            used, fates = [], []
            rows = zip(*(b.column(b.schema.names.index(n)).to_pylist() for n in ("packet", "c", "k", "used", "fate")))
            for packet, c, k, u, f in rows:
                if packet != now:
                    known = not (ranged and now is None)
                    now, left = packet, budget
                if f == _NOTE:
                    left = u
                    used.append(u)
                    fates.append(f)
                elif known:
                    fits = c <= left
                    cut = not fits and k and left >= least
                    used.append(c if fits else left if cut else 0)
                    fates.append("kept" if fits else "cut" if cut else "dropped")
                    left -= used[-1]
                elif c == 0 and budget >= 0:
                    used.append(0)
                    fates.append("kept")
                elif c <= left or k and left >= least:
                    used.append(None)
                    fates.append(None)
                    stays = min(c, least) if k else c  # what is less than this stays as it is
                    left = max(left - c if c <= left else 0, min(left, stays - 1), 0)
                else:
                    used.append(0)
                    fates.append("dropped")
            out = [*b.columns[:-2], pa.array(used, pa.int64()), pa.array(fates, pa.string())]
            done = pa.RecordBatch.from_arrays(out, names=b.schema.names)
            if b.num_rows:
                note = done.slice(b.num_rows - 1)
            yield done
        if ranged and known and note is not None:
            p = note.schema.names.index("p")
            out = [*note.columns[:-2], pa.array([left], pa.int64()), pa.array([_NOTE], pa.string())]
            out[p] = pa.nulls(1, note.column(p).type)
            yield pa.RecordBatch.from_arrays(out, names=note.schema.names)

    return fold


def packed(blocks: DataFrame, packet: str, budget: int, least: int = 40) -> DataFrame:
    """Which blocks of a packet fit: ``packet, block, cost, used, fate`` (kept, cut or dropped).

    ``blocks``: the packet's key, ``block``, ``priority`` (lower first), ``cost`` and
    ``critical``. In order of priority and block, a block is kept if its whole
    cost fits what is left; a critical one that doesn't is cut to what is left if
    that is ``least`` or more; others are dropped and cost nothing. Blocks are
    range-partitioned and sorted, and folded with one number in memory, so a packet
    may be of any size. Of a packet that goes on from a range before, the blocks that
    may still fit (``budget`` of them a range at most, if no cost is negative) are folded
    afterwards, in order, from what the packet had left. Null costs count as 0.
    """
    kind = {c: blocks.schema[c].dataType for c in (packet, "block")}
    rows = blocks.where(F.col(packet).isNotNull()).select(
        F.col(packet).alias("packet"), F.coalesce("priority", F.lit(2**31 - 1)).alias("p"), "block", F.coalesce("cost", F.lit(0)).cast("bigint").alias("c"),
        F.coalesce("critical", F.lit(False)).alias("k"), F.lit(None).cast("bigint").alias("used"), F.lit(None).cast("string").alias("fate"),
    )
    order = ["packet", "p", "block", "c", "k"]
    schema = f"packet {kind[packet].simpleString()}, p {rows.schema['p'].dataType.simpleString()}, block {kind['block'].simpleString()}, c bigint, k boolean, used bigint, fate string"
    # Written once, as adaptive execution may coalesce ranges differently for each reader of an exchange.
    ranges = written(rows.repartitionByRange("packet", "p", "block").sortWithinPartitions(*order).mapInArrow(_folder(budget, least, True), schema), "packed")
    rest = ranges.where(F.col("fate").isNull() | (F.col("fate") == _NOTE))
    rest = rest.repartition("packet").sortWithinPartitions(*order).mapInArrow(_folder(budget, least, False), schema)
    done = ranges.where(F.col("fate") != _NOTE).unionByName(rest.where(F.col("fate") != _NOTE))
    return done.select(F.col("packet").alias(packet), "block", F.col("c").alias("cost"), "used", "fate")
