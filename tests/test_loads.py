"""The most intervals open at once, against counting at every moment."""

import random

from marginalia.operators.loads import most_open


def test_equals_counting_at_every_moment(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab") , s, s + rng.randrange(0, 60)) for s in (rng.randrange(0, 500) for _ in range(300))]
    data += [(None, 1, 9), ("a", None, 9), ("b", 1, None), ("c", 5, 5), ("d", 9, 2)]
    got = {r.k: (r.most, r.at_us) for r in most_open(spark.createDataFrame(data, "k string, s bigint, e bigint"), "k", "s", "e", bucket_us=50).collect()}
    for k in "ab":
        mine = [(s, e) for key, s, e in data if key == k and s is not None and e is not None]
        counts = [(sum(s <= t < e for s, e in mine), -t) for t in range(600)]
        most, at = max(counts)
        assert got[k] == (most, -at)
    assert set(got) == {"a", "b"}


def test_intervals_that_span_many_buckets_and_repeated_rows_count(spark):
    df = spark.createDataFrame([("x", 0, 1000, 1)] * 3 + [("x", 990, 999, 2)], "k string, s bigint, e bigint, _b int")
    assert [tuple(r) for r in most_open(df, "k", "s", "e", bucket_us=10).collect()] == [("x", 4, 990)]


def test_empty(spark):
    assert most_open(spark.createDataFrame([], "k string, s bigint, e bigint"), "k", "s", "e").collect() == []
