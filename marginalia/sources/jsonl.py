"""Lines of JSON with comments and places to fill in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, fill: dict[str, str] | None = None) -> DataFrame:
    """The rows of files of JSON lines.

    Blank lines and those that begin with ``#`` or ``//`` are left out; ``{{name}}`` becomes the value
    that ``fill`` has for the name. A line that is no JSON is a row of nulls, so that none is lost unseen.
    """
    line = F.col("value")
    t = spark.read.text(path).where(~line.rlike(r"^\s*(#|//|$)"))
    for name, value in (fill or {}).items():
        line = F.replace(line, F.lit("{{" + name + "}}"), F.lit(value))
    return t.select(F.from_json(line, schema).alias("r")).select("r.*")


def without_lineage(metadata: Column, keys: tuple[str, ...] = ("source_config_id", "ingestion_checksum", "ingestion_status")) -> Column:
    """A map of callers' own metadata without the keys that only the store may set, in any letter case; null stays null."""
    return F.map_filter(metadata, lambda k, _: ~F.lower(F.trim(k)).isin(*keys))
