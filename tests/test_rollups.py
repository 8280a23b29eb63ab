"""Rollups, searches and mutations on empty tables and on a fixture."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.plans import rollups


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in sorted(os.listdir(small)):
        spark.read.parquet(f"{small}/{f}").limit(0).write.parquet(f"{d}/{f}")
    return str(d)


@pytest.mark.parametrize("name", list(rollups.registry.queries))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert rollups.registry.queries[name](spark, empty).collect() == []


def test_names_to_use_and_not_to_use(spark, small, tmp_path):
    texts = ["Ledger should use Kafka", "ledger must not use kafka", "Ledger uses kafka", "Portal uses Redis", "Portal should not use Kafka"]
    c = spark.read.parquet(f"{small}/claims.parquet").dropDuplicates(["claim_id"]).limit(1).drop("claim_id", "claim_text")
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate([*texts, texts[0], None, ""])], "claim_id string, claim_text string")
    c.crossJoin(rows).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/claims.parquet")
    got = [r.asDict() for r in rollups.registry.queries["i17_relation_conflicts"](spark, str(tmp_path)).collect()]
    assert got == [{"src": "ledger", "dst": "kafka", "kinds_for": 2, "mentions": 4, "severity": "high"}]
