import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from marginalia.operators.changes import upserted
from marginalia.streaming.intake import deliver, keep_snapshot, limited_stream, windowed_counts, without_repeats

SCHEMA = "id string, kind string, ts timestamp"


@pytest.fixture
def events(spark, tmp_path):
    """The same events as files that arrive one by one, and as a table."""
    base = dt.datetime(2025, 1, 1)
    rows = [(f"e{i % 40}", "ab"[i % 2], base + dt.timedelta(minutes=7 * (i % 40))) for i in range(100)]
    for n in range(5):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    return stream, spark.createDataFrame(rows, SCHEMA), tmp_path


def drained(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_repeats_are_dropped(events):
    stream, batch, tmp = events
    got = drained(without_repeats(stream(), ["id", "kind"], "ts", "2 days"), tmp, "once")
    assert got.count() == without_repeats(batch, ["id", "kind"], "ts").count() == 40


def test_windows_equal_the_batch(events):
    stream, batch, tmp = events
    got = drained(windowed_counts(stream(), "ts", "kind", "1 hour", "2 days"), tmp, "windows", "complete")
    assert sorted(got.collect()) == sorted(windowed_counts(batch, "ts", "kind", "1 hour").collect())


def test_limits_hold_over_batches(events):
    stream, batch, tmp = events
    got = drained(limited_stream(stream(), "kind", "ts", 10**6, 30), tmp, "limits")
    assert got.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("allowed").alias("a")).where("n = 50 and a = 30").count() == 2


def test_delivery_writes_every_event(events):
    stream, batch, tmp = events
    out = str(tmp / "sent")

    def send(epoch, lines):
        import os
        import uuid

        os.makedirs(out, exist_ok=True)
        with open(f"{out}/{epoch}-{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(lines) + "\n")

    deliver(stream(), send, str(tmp / "cp"), 7).awaitTermination()
    lines = [json.loads(x) for p in glob.glob(f"{out}/*") for x in open(p)]
    assert len(lines) == 100 and {x["id"] for x in lines} == {f"e{i}" for i in range(40)}


def test_snapshots_of_a_stream(events):
    stream, batch, tmp = events

    def merge(old, new):
        return new.dropDuplicates(["id"]) if old is None else upserted(old, new, ["id"], F.unix_micros("ts"))

    keep_snapshot(stream(), str(tmp / "table"), str(tmp / "cp2"), merge).awaitTermination()
    last = max(glob.glob(str(tmp / "table/v=*")), key=lambda p: int(p.rpartition("=")[2]))
    assert batch.sparkSession.read.parquet(last).count() == 40
