"""Counting events of a key in windows that open with an event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.sources.tables import micros


def limited(events: DataFrame, key: str, at: str, window_s: int = 3600, limit: int = 5) -> DataFrame:
    """Windows of a fixed length that open with a key's first event after the last one: ``key, opened_s, events, allowed``.

    Seconds are what windows are measured in. Events are first counted by key and
    second where they lie, so a key with a third of all rows becomes one row per
    second; the chain of windows is then walked in sorted order, a step per window, with one open
    window in memory. So what a key costs is bound by the seconds of its time line, not by its rows. Rows without key or time are ignored.
    """
    kind = events.schema[key].dataType.simpleString()
    per = (
        events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(F.col(key).alias("key"), F.floor(micros(at) / 1_000_000).alias("s"))
        .agg(F.count("*").alias("n"))
        .repartition("key")
        .sortWithinPartitions("key", "s")
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, count = None, 0, 0
        for b in batches:
            out = []
            k, s, n = b.key.to_numpy(), b.s.to_numpy(), b.n.to_numpy()
            turns = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
            last = turns[np.searchsorted(turns, np.arange(len(k)), side="right")]
            i = 0
            while i < len(b):
                if now is None or k[i] != now or s[i] >= opened + window_s:
                    if now is not None:
                        out.append((now, opened, count, min(count, limit)))
                    now, opened, count = k[i], int(s[i]), 0
                end = last[i]  # behind the key's rows in this batch
                stop = i + max(1, int(np.searchsorted(s[i:end], opened + window_s)))
                count += int(np.sum(n[i:stop]))
                i = stop
            yield pd.DataFrame(out, columns=["key", "opened_s", "events", "allowed"])
        if now is not None:
            yield pd.DataFrame([(now, opened, count, min(count, limit))], columns=["key", "opened_s", "events", "allowed"])

    return per.mapInPandas(walk, f"key {kind}, opened_s bigint, events bigint, allowed bigint").withColumnRenamed("key", key)
