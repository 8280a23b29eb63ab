"""Recall for many queries at once against the same for each of them."""

import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.functions.text import text_score
from marginalia.operators.batch_recall import best_of_each, bm25_scores, hybrid_of_each, nearest_of_each, text_scores

WORDS = "review queue retry budget claim record team owner scope rule the a of".split()


def texts(rng, n):
    return [(f"c{i:04d}", None if i == 3 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))), "x") for i in range(n)]


def test_text_scores_equal_those_of_one_query(spark):
    rng = random.Random(8)
    df = spark.createDataFrame(texts(rng, 200), "claim_id string, claim_text string, term string")
    asked = [(1, "review queue"), (2, "the team owner"), (3, "nothing here"), (4, None), (5, ""), (6, "claim claim a")]
    got = text_scores(df, "claim_id", "claim_text", spark.createDataFrame(asked, "query_id int, query string"))
    have = {(r.query_id, r.claim_id): round(r.text_score, 9) for r in got.collect()}
    want = {}
    for i, q in asked:
        for r in df.withColumn("s", text_score(F.col("claim_text"), q or "")).where("s > 0").collect():
            want[i, r.claim_id] = round(r.s, 9)
    assert have == want
    assert text_scores(df.limit(0), "claim_id", "claim_text", spark.createDataFrame(asked, "query_id int, query string")).count() == 0


def test_nearest_equals_brute_force_in_any_number_of_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[7] = x[11] = x[5]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    q = df.where("vec_id % 50 = 5 OR vec_id > 899").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(5, 300, 50) for j in sorted(range(300), key=lambda j: (-round(max(float(u[i] @ u[j]), 0), 12), j))[:4]} | {(903, 903)}
    for block in (1000, 2):
        got = nearest_of_each(df, "vec_id", "embedding", q, 4, block=block)
        assert {(r.query_id, r.vec_id) for r in got.collect()} == want
    assert nearest_of_each(df, "vec_id", "embedding", q.limit(0), 4).count() == 0 and nearest_of_each(df.limit(0), "vec_id", "embedding", q, 4).count() == 0


def test_hybrid_and_places(spark):
    rng = random.Random(9)
    rows = [(i, t, [rng.gauss(0, 1) for _ in range(4)] if n % 5 else None, 0.5) for n, (i, t, _) in enumerate(texts(rng, 120))]
    df = spark.createDataFrame(rows, "claim_id string, claim_text string, v array<double>, confidence double")
    asked = [("q1", "review queue", [1.0, 0.0, 0.0, 0.0]), ("q2", None, [0.0, 1.0, 0.0, 0.0]), ("q3", "budget", None)]
    q = spark.createDataFrame(asked, "query_id string, query string, vector array<double>")
    got = hybrid_of_each(df, "claim_id", "claim_text", "v", q, 3, F.col("confidence")).collect()
    by = {}
    for i, text, vec in asked:
        scored = df.withColumn("s", text_score(F.col("claim_text"), text or "")).collect()
        ranks = []
        for r in scored:
            cos = max(0.0, float(np.dot(r.v, vec) / np.linalg.norm(r.v) / np.linalg.norm(vec))) if r.v and vec else 0.0
            ranks.append((r.claim_id, r.s, cos, r.s + 0.45 * cos + 0.5))
        pool = {x[0] for x in sorted((x for x in ranks if x[1] > 0), key=lambda x: (-x[1], x[0]))[:12]} | {x[0] for x in sorted((x for x in ranks if x[2] > 0), key=lambda x: (-x[2], x[0]))[:12]}
        by[i] = [x[0] for x in sorted((x for x in ranks if x[0] in pool), key=lambda x: (-round(x[3], 9), x[0]))[:3]]
    have = {}
    for r in sorted(got, key=lambda r: (-round(r.rank_score, 9), r.claim_id)):
        have.setdefault(r.query_id, []).append(r.claim_id)
    assert have == by
    s = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "c", 1), (2, "d", 0)], "query_id int, k string, s int")
    assert {(r.query_id, r.k, r.place) for r in best_of_each(s, 2, F.desc("s"), F.col("k")).collect()} == {(1, "a", 1), (1, "b", 2), (2, "d", 1)}


def test_bm25_equals_its_formula(spark):
    import math
    import re

    rng = random.Random(10)
    rows = texts(rng, 150)
    df = spark.createDataFrame(rows, "claim_id string, claim_text string, term string")
    asked = [(1, "review queue"), (2, "the team owner of the team"), (3, "nothing here"), (4, None)]
    words = {i: re.findall(r"\w+", t or "") for i, t, _ in rows}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for q, text in asked:
        for i, w in words.items():
            s = 0.0
            for t in dict.fromkeys(x for x in (text or "").split() if len(x) > 1):
                n, f = sum(t in v for v in words.values()), w.count(t)
                s += math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) if f else 0
            if s:
                want[q, i] = round(s, 9)
    q = spark.createDataFrame(asked, "query_id int, query string")
    assert {(r.query_id, r.claim_id): round(r.bm25, 9) for r in bm25_scores(df, "claim_id", "claim_text", q).collect()} == want
    assert bm25_scores(df.limit(0), "claim_id", "claim_text", q).count() == 0
