"""Batches of consecutive items, each as large as its limits allow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def planned(items: DataFrame, run: str, order: list[str], sizes: dict[str, int]) -> DataFrame:
    """``items`` with ``batch`` (from 0 within a run): consecutive items until any sum of ``sizes`` would exceed its limit.

    Items of a run are taken in ``order``. An item over a limit by itself is a batch of its own. Null sizes are 0; rows without
    run are left out. Where a batch begins depends on all before it in its run, so a run is followed as a stream
    in one task: sorted, with running sums, a step per batch and nothing of it held but the open batch's sums. Runs should be what is sent at one
    time (a source's delivery), not all that a source ever sent.
    """
    names = list(sizes)
    limits = np.array([sizes[c] for c in names])
    i = items.where(F.col(run).isNotNull())
    i = i.repartition(run).sortWithinPartitions(run, *order)
    schema = i.schema

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used = None, 0, np.zeros(len(names))
        for b in batches:
            if not len(b):
                continue
            x = b[names].fillna(0).to_numpy(dtype=float)
            k = b[run].to_numpy(dtype=object)
            total = np.vstack([np.zeros(len(names)), np.cumsum(x, 0)])
            turns = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
            out = np.empty(len(b), np.int64)
            at = 0
            for stop in turns:
                if now is None or k[at] != now:
                    now, batch, used = k[at], 0, np.zeros(len(names))
                    fresh = True
                else:
                    fresh = not used.any()
                while at < stop:
                    # The first place at which a limit would be exceeded, of all limits.
                    end = min(int(np.searchsorted(total[: stop + 1, c], total[at, c] + limits[c] - used[c], side="right")) - 1 for c in range(len(names)))
                    end = min(stop, max(end, at + 1 if fresh else at))
                    out[at:end] = batch
                    used = used + total[end] - total[at]
                    at, fresh = end, False
                    if at < stop:
                        batch, used, fresh = batch + 1, np.zeros(len(names)), True
            yield b.assign(batch=out)

    return i.mapInPandas(walk, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", batch bigint")
