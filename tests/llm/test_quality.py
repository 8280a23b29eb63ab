import oracle
import pytest

from marginalia.llm.quality import text_statistics, text_types

PROSE = "The cache was slow this morning, and nobody knew why it was so. We have asked the team to look at it, but they had no time for that."
ROWS = [
    (1, PROSE), (2, "\n".join(f"- item number {i}" for i in range(12))), (3, "a,b,c\n" + "\n".join(f'"x{i}",{i},{i * 2}' for i in range(12))), (4, None), (5, "  \n"),
    (6, '[{"k": 1}, {"k": 2}]'), (7, "> " + PROSE.replace(". ", ".\n> ")), (8, PROSE.upper()), (9, "Home\nMenu\nPrint\nHome\nMenu\nShare\nLogin"), (10, "Please wait a\n" * 20),
    (11, "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {i * i} |" for i in range(8))), (12, "f/FqpcUfn9nHjZZhOU1km7J9uKsXGN1XgLiRWmczSdKAsjAnU24gWi7JZrCyEDl3\n" * 3), (13, PROSE + "\n\n- one\n- two"), (14, "word " * 200_000),
]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "Hello, big world.\nnot so"), (2, None), (1, "x")], "doc_id bigint, text string")
    got = {(r.doc_id, r.words): r for r in text_statistics(df).collect()}
    r = got[1, 5]
    assert (r.mean_word_length, r.punctuated_lines, r.language) == (18 / 5, 0.5, "en")
    assert r.symbol_ratio == pytest.approx(2 / 24) and r.common_words == pytest.approx(2 / 5)
    assert got[2, 0].mean_word_length == 0 and got[2, 0].language is None and len(got) == 3


def test_types_of_clear_cases_among_many(spark, small):
    corpus = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text")
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").unionByName(corpus).selectExpr("doc_id", "text", "1 AS words", "'x' AS kind")
    got = {r.doc_id: r for r in text_types(text_statistics(df)).where("doc_id < 1000").collect()}
    want = {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "junk", 6: "junk", 7: "prose", 8: "prose", 9: "junk", 10: "junk", 11: "table", 12: "junk", 13: "prose", 14: "junk"}
    assert {i: r.kind for i, r in got.items()} == want
    assert all(abs(r.p_prose + r.p_list + r.p_table + r.p_junk - 1) < 1e-9 for r in got.values())


def test_people_agree(spark, small):
    """The labels, which nothing was fitted on, hold some errors of their own."""
    sf = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/quality_labels.parquet")
    j = text_types(text_statistics(docs)).join(labels.withColumnRenamed("kind", "said"), "doc_id").select("kind", "said").collect()
    assert len(j) > 400 and sum(r.kind == r.said for r in j) / len(j) >= 0.93


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert text_types(text_statistics(df)).count() == 0
