"""Deliveries as streams: intake without repeats, windows, limits, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def without_repeats(deliveries: DataFrame, parts: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Each delivery once, by a hash (``job_id``) of what identifies it. State is dropped once ``delay`` has passed in event time.

    Null parts count as empty. Works on a batch as well, where all rows are compared.
    """
    ident = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    d = deliveries.withColumn("job_id", ident)
    if not d.isStreaming:
        return d.dropDuplicates(["job_id"])
    return d.withWatermark(at, delay).dropDuplicatesWithinWatermark(["job_id"])


def windowed_counts(events: DataFrame, at: str, key: str, length: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Events per key and window of event time: ``key, start, events``. Rows later than ``delay`` behind the newest are dropped by a stream."""
    e = events.withWatermark(at, delay) if events.isStreaming else events
    g = e.groupBy(key, F.window(at, length).alias("w")).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("start"), "events")


def limited_stream(events: DataFrame, key: str, at: str, window_s: int = 3600, limit: int = 5) -> DataFrame:
    """Whether each event of a key is within the limit of its window, which opens with the key's first event after the last window.

    Columns ``key, at_s, nth, allowed``. One small state per key: when its window opened and how
    many events it has had; events of a batch are taken in order of time, an event older than the open window counts in it.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, count = state.get if state.exists else (None, 0)
        for b in batches:
            s = np.sort(b.at_s.to_numpy())
            nth = np.empty(len(s), np.int64)
            i = 0
            while i < len(s):  # a window at a time
                if opened is None or s[i] >= opened + window_s:
                    opened, count = int(s[i]), 0
                stop = int(np.searchsorted(s, opened + window_s))
                nth[i:stop] = count + np.arange(1, stop - i + 1)
                count += stop - i
                i = stop
            yield pd.DataFrame({"key": [k[0]] * len(s), "at_s": s, "nth": nth, "allowed": nth <= limit})
        state.update((opened, count))

    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("key"), F.floor(F.unix_micros(F.col(at).cast("timestamp")) / 1_000_000).alias("at_s"))
    out = e.groupBy("key").applyInPandasWithState(step, f"key {kind}, at_s bigint, nth bigint, allowed boolean", "opened bigint, count bigint", "append", "NoTimeout")
    return out.withColumnRenamed("key", key)


def deliver(events: DataFrame, send: Callable[[int, list[str]], None], checkpoint: str, batch: int = 1000) -> StreamingQuery:
    """Sends events as lines of JSON, at least once: a batch counts as sent only when ``send`` returns.

    ``send(epoch, lines)`` runs where the rows are, for at most ``batch`` lines at a time.
    """

    def each(df: DataFrame, epoch: int) -> None:
        def push(rows: Iterator) -> None:
            lines: list[str] = []
            for r in rows:
                lines.append(r.line)
                if len(lines) >= batch:
                    send(epoch, lines)
                    lines = []
            if lines:
                send(epoch, lines)

        df.select(F.to_json(F.struct("*")).alias("line")).foreachPartition(push)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_snapshot(changes: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> StreamingQuery:
    """Folds a stream of changes into a table of which each batch writes the next version: ``path/v=<epoch>``.

    ``merge(old, batch)`` gives the next version (old is None at first). A batch that is run again writes the same version again.
    """

    def each(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        old = spark.read.parquet(f"{path}/v={epoch - 1}") if epoch else None
        merge(old, df).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
