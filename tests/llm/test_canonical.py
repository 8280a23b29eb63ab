"""Records that differ in formatting alone."""

from pyspark.sql import functions as F

from marginalia.llm.canonical import canonical_counts, canonical_groups


def groups(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "id string, text string, scope string, key string, rep int")
    return {(r.rep, r.id) for r in canonical_groups(df, "id", ["text", "scope"]).collect()}, df


def test_copies_that_differ_in_formatting(spark):
    got, df = groups(spark, [
        ("a", "Hello,  World!", "x/y", "k", 1), ("b", "hello world", "X Y", "k", 1), ("b", "hello world", "X Y", "k", 1), ("c", "hello worlds", "x y", "k", 1),
        ("d", "b: 2; a=1", "s", "k", 1), ("e", "A=1 | B=2;", "s", "k", 1), ("f", "a 1 b 2", "s", "k", 1), ("g", None, None, "k", 1), ("h", "", " ", "k", 1),
        (None, "hello world", "x y", "k", 1), ("i", "b: 1; a=2", "s", "k", 1),
    ])
    assert got == {("a", "a"), ("a", "b"), ("c", "c"), ("d", "d"), ("d", "e"), ("f", "f"), ("g", "g"), ("g", "h"), ("i", "i")}
    assert {(r.rep, r.copies) for r in canonical_counts(df, "id", ["text", "scope"]).collect()} == {("a", 2), ("c", 1), ("d", 2), ("f", 1), ("g", 2), ("i", 1)}
    assert canonical_groups(df.limit(0), "id", ["text"]).count() == 0


def test_a_hot_group_of_copies_spans_ranges(spark):
    rows = [(f"{i:05d}", "the same" if i % 3 else f"t {i}", "s", "k", 1) for i in range(6000)] + [("x" * 3, "long " * 100_000, "s", "k", 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, _ = groups(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {("00001" if i % 3 else f"{i:05d}", f"{i:05d}") for i in range(6000)} | {("xxx", "xxx")}


def test_a_hot_third_of_a_larger_table_under_adaptive_execution(spark):
    i, n = F.col("id"), 400_000
    df = spark.range(n).select(F.format_string("%07d", i).alias("id"), F.when(i % 3 == 0, "m the same").otherwise(F.concat(F.md5(i.cast("string")), F.lit(" text"))).alias("text"), F.lit("s").alias("scope"))
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    got = canonical_groups(df, "id", ["text", "scope"]).withColumn("hot", F.col("id").cast("int") % 3 == 0).persist()
    try:
        assert got.count() == n == got.select("id").distinct().count()
        assert got.where("hot").select("rep").distinct().collect() == [("0000000",)]
        assert got.where("not hot and rep <> id").count() == 0
    finally:
        got.unpersist()


def test_no_id_is_lost_whatever_the_ranges(spark):
    """Every id comes out once, even if exchanges are not reused and ranges are coalesced to odd sizes."""
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(120_000).select(F.format_string("%07d", "id").alias("id"), F.md5((F.col("id") % 30_000).cast("string")).alias("text"))
        got = canonical_groups(df, "id", ["text"])
        by = got.groupBy("rep").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        assert got.count() == 120_000 == got.select("id").distinct().count()
        assert by.count() == 30_000 == by.where("n = 4 and rep = least").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
