"""Sessions and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(app: str = "marginalia", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MARGINALIA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, benchmarks) without that setting gets a temporary
    folder of its own; anywhere else executors could not read it, so a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _fallback:
        _fallback[sc.applicationId] = tempfile.mkdtemp(prefix="spark-marginalia-")
    return _fallback[sc.applicationId]


_fallback: dict[str, str] = {}


def written(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read back.

    Cuts the lineage in a way that survives lost executors, and keeps a
    result that is used several times from being computed several times. ``by``, the last column, with few values:
    each has a folder, so that a reader of one reads no other.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Removes the tables that ``written`` left; at exit, or when their readers are done."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended
            pass


atexit.register(drop_written)

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, unless PYTHONPATH already leads them to it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.applicationId in _shipped or root in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-marginalia-"), "marginalia.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, files in os.walk(os.path.join(root, "marginalia")):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(d, f), os.path.relpath(os.path.join(d, f), root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
