import random
import re

import pytest

from marginalia.llm.splitting import longest_run, split_items, split_spans


def checked(text, limit, overlap):
    data = text.encode()
    spans = split_spans(data, limit, overlap)
    assert b"".join(data[s:e] for s, e, _, _ in spans) == data  # nothing is lost or doubled
    for i, (s, e, rep, _) in enumerate(spans):
        assert e - s + rep <= limit and rep <= overlap
        data[s - rep : e].decode()  # no character is cut
        assert i == 0 or s - rep >= spans[i - 1][0]
    longest = max(map(len, re.split(rb"[ \t\r\n]+", data)))
    assert longest_run(data) == longest
    assert longest > limit or not any(h for *_, h in spans)
    for a, b in zip(spans, spans[1:]):
        if not (a[3] or b[3]):  # cut at a boundary
            at = b[0]
            assert data[at : at + 1].isspace() or data[at - 1 : at].isspace() or data[:at].decode()[-1] in "。！？"
    return spans


def test_pieces_of_random_texts():
    rng = random.Random(1)
    parts = ["word ", "a", "é", "検", ". ", "\n", "\n\n", "\r\n", "\t", "。", "z", "bla bla", "   " * 90, "x" * 700]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))
        checked(text, 1200, 120)
        checked(text, 64, 8)


@pytest.mark.parametrize("text", ["x" * 1200 + "\n", "x" * 1201, "x" * 1200, " " * 5000, "x" * 1100 + " " + "y" * 1100, "é" * 5000, "hello. " * 50_000])
def test_pieces_of_odd_texts(text):
    spans = checked(text, 1200, 120)
    assert len(spans) <= 3 * len(text.encode()) // 1080 + 2


def test_strong_boundaries_are_preferred():
    text = ("one two. " * 60).strip() + "\n\n" + ("three four. " * 50).strip()
    (s, e, rep, hard), second = checked(text, 1000, 100)
    assert text[:e].endswith("\n\n") and second[2] > 0 and not hard


def test_items(spark):
    rows = [("document", "a", "word " * 400, 1), ("chunk", "b", "x" * 3000, 1), ("chunk", "c", "small", 1), ("chunk", "d", None, 1), (None, None, "word " * 400, 1), ("document", "a", "word " * 400, 1)]
    df = spark.createDataFrame(rows, "item_kind string, item_id string, content string, piece_no int")
    got = split_items(df).collect()
    assert {(r.item_id, r.longest_run > 1200) for r in got} == {("a", False), ("b", True), (None, False)}
    assert all(len(r.content.encode()) <= 1200 for r in got)
    assert split_items(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_spans(b"x", 100, 99)
