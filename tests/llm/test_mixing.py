import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm.mixing import VOCABULARY, Rates, fitted_rates, membership, mixed, reached_shares, with_tokens

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
DOCS = "doc_id bigint, text string, source string, lang string, title string, doc_type string, tokens string, rate int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, n=600):
    rng = random.Random(6)
    words = {"wiki": ["river", "castle", "history"], "code": ["return", "class", "import"], "chat": ["hello", "thanks", "bye"]}
    rows = []
    for i in range(n):
        s = rng.choices(["wiki", "code", "chat"], [0.6, 0.3, 0.1])[0]
        text = " ".join(rng.choice(words[s]) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, rng.choice([s, f" {s.upper()}"]) if i % 10 else None, "en", None, None, "t", 1))
    return spark.createDataFrame([*rows, (n, None, "wiki", None, None, None, "t", 1), (n + 1, "", "unheard of", None, None, None, "t", 1), (None, "x", "wiki", None, None, None, "t", 1)], DOCS)


def shares(spark, docs, targets):
    m, goal = membership(docs, spark.createDataFrame(targets, TARGETS))
    mix = mixed(m, goal).cache()
    return mix, {r.source: r for r in reached_shares(mix, goal).collect()}


def test_shares_are_reached(spark):
    mix, got = shares(spark, corpus(spark), [("wiki", 0.4, 3), ("code", 0.35, 4), ("chat", 0.25, 10), (None, 0.5, 1)])
    assert mix.count() == 602
    for s, want in (("wiki", 0.4), ("code", 0.35), ("chat", 0.25)):
        assert abs(got[s].actual_share - want) < 0.03
    assert max(r.copies for r in mix.collect()) <= 10


def test_shares_are_within_a_hundredth_where_they_can_be_reached(spark):
    """Sources of known sizes: those with enough text get their tokens within 1 %, the one without gets all it has, as often as it may."""
    i, n = F.col("id"), 40_000
    s = F.when(i % 10 < 5, "wiki").when(i % 10 < 8, "code").when(i % 10 < 9, "chat").otherwise("rare")
    docs = spark.range(n).select(
        i.alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("word"), (3 + i % 37).cast("int"))).alias("text"), s.alias("source"),
        F.lit("en").alias("lang"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("doc_type"),
    )
    m, goal = membership(docs, spark.createDataFrame([("wiki", 0.25, 3), ("code", 0.35, 4), ("chat", 0.1, 10), ("rare", 0.3, 2)], TARGETS))
    fitted = fitted_rates(m, goal)
    got = {r.source: r for r in reached_shares(mixed(m, goal, fitted=fitted), goal, fitted[1]).collect()}
    whole = sum(r.held_tokens for r in got.values())
    for name in ("wiki", "code", "chat"):
        assert got[name].used_tokens == pytest.approx(got[name].wanted_tokens, rel=0.01)
        assert got[name].wanted_tokens == pytest.approx(got[name].target_share * whole)
    assert got["rare"].used_tokens == 2 * got["rare"].held_tokens < got["rare"].wanted_tokens
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)


def test_many_sources_need_no_large_matrix():
    """Ten thousand posteriors of ten thousand sources are taken in small parts."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    goal = [SimpleNamespace(cap=3) for _ in range(10_000)]
    rates = Rates(goal, np.full(10_000, 0.5))
    rates.step(np.full(10_000, 0.1))
    one = np.full(10_000, 1e-4)
    seen = 0
    for at, m, r, cap in rates.loose(pd.Series([one] * 2000)):
        assert m.size <= 4_000_000 and np.allclose(r, 0.4) and (cap == 3).all()
        seen += len(r)
    assert seen == 2000 and np.allclose(rates.known, 0.4)


def test_caps_hold_and_show(spark):
    mix, got = shares(spark, corpus(spark), [("wiki", 0.3, 1), ("chat", 0.6, 2), ("code", 0.0, 0), ("absent", 0.1, 5)])
    assert got["chat"].actual_share < 0.6 and got["chat"].most_copies == 2 and got["chat"].used_tokens == pytest.approx(2 * got["chat"].held_tokens, rel=0.2)
    assert got["code"].most_copies == 0 and got["absent"].actual_share < 0.01
    assert all(r.copies <= {"wiki": 1, "chat": 2, "code": 0, None: 2}[r.source] for r in mix.collect())


def test_unknown_sources_are_told_by_their_words(spark):
    m, goal = membership(corpus(spark), spark.createDataFrame([("wiki", 0.4, 3), ("code", 0.35, 4), ("chat", 0.25, 10)], TARGETS))
    names = [g.name for g in goal]
    docs = {r.doc_id: r.text for r in corpus(spark).collect()}
    loose = [r for r in m.collect() if r["index"] is None and docs[r.doc_id]]
    right = sum(docs[r.doc_id].split()[0] in {"wiki": ["river", "castle", "history"], "code": ["return", "class", "import"], "chat": ["hello", "thanks", "bye"]}[names[max(range(3), key=r.posterior.__getitem__)]] for r in loose)
    assert len(loose) >= 50 and right / len(loose) >= 0.9


def test_tokens_and_empty_tables(spark):
    d = spark.createDataFrame([("Hello world",), (None,), ("",), ("ü" * 5000,)], "text string")
    assert [r.tokens for r in with_tokens(d).collect()][:3] == [2, 0, 0]
    docs = corpus(spark).limit(0)
    mix, got = shares(spark, docs, [("wiki", 1.0, 3)])
    assert mix.count() == 0 and got["wiki"].actual_share == 0
    mix, got = shares(spark, corpus(spark, 20), [])
    assert got == {}
