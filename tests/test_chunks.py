"""Chunks for storing, JSON lines, instants."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions.chunks import chunked, chunks_of
from marginalia.functions.temporal import instant
from marginalia.sources.jsonl import read_jsonl, without_lineage

TEXTS = st.lists(st.text(alphabet="ab é漢\n", max_size=80), max_size=12).map("\n\n".join)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(16, 90))
def test_chunks_are_small_whole_and_greedy(text, most):
    cs = chunks_of(text, most)
    assert all(c.strip() and len(c.encode()) <= most for c in cs)
    small = all(len(p.encode()) <= most for line in text.split("\n") for p in [line.strip()])
    if small:  # nothing was cut within a line: the lines come out once each, in order
        assert [x.strip() for c in cs for x in c.split("\n") if x.strip()] == [x.strip() for x in text.split("\n") if x.strip()]
    paragraphs = [p.strip() for p in text.split("\n\n") if p.strip()]
    if "\n\n\n" not in text and all(len(p.encode()) <= most for p in paragraphs):
        assert all(len((a + "\n\n" + b.split("\n\n")[0]).encode()) > most for a, b in zip(cs, cs[1:]))


def test_a_long_line_is_cut_with_overlap_between_characters():
    text = "é" * 5000
    cs = chunks_of(text)
    assert len(cs[0].encode()) == 1200 and sum(map(len, cs)) - 60 * (len(cs) - 1) == 5000


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "a\r\n\r\nb")], "id int, t string")
    assert {r.id: r.c for r in df.select("id", chunked(F.col("t")).alias("c")).collect()} == {1: [], 2: [], 3: [], 4: ["a\n\nb"]}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# about\n\n{"id": "{{run}}-1", "n": 2}\n// more\nbroken\n')
    got = read_jsonl(spark, str(tmp_path), "id string, n int", {"run": "r7"}).collect()
    assert sorted(map(tuple, got), key=str) == [("r7-1", 2), (None, None)]
    m = spark.range(1).select(without_lineage(F.create_map(F.lit(" Ingestion_Status"), F.lit("x"), F.lit("mine"), F.lit("y"))).alias("m"))
    assert m.first().m == {"mine": "y"}


def test_instants(spark):
    texts = ["2025-01-02T03:04:05Z", " 2025-01-02 ", "2025-02-30", "2025-13-01T00:00:00Z", "soon", "", None, "2025-01-02T03:04:05.25Z"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(instant(F.col("t")).cast("string").alias("x")).collect()]
    assert got == ["2025-01-02 03:04:05", "2025-01-02 00:00:00", None, None, None, None, None, "2025-01-02 03:04:05.25"]
