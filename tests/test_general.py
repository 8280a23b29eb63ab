"""Snapshots, references, copies, skewed joins and mutations on small tables with everything odd in them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.changes import retired, upserted, with_feedback
from marginalia.operators.limits import limited
from marginalia.operators.packing import packed
from marginalia.operators.policies import policy_conflicts
from marginalia.operators.ranks import nearest_ranks
from marginalia.operators.references import ForeignKey, Table, orphan_references
from marginalia.operators.skew import hot_keys, hot_keys_of_each, salted_left_join
from marginalia.operators.snapshots import snapshot_changes

LISTS = "snapshot_no int, delivery_no int, source_config_id string, source_url string, scope string, content_checksum string, ingested_at timestamp_ntz, url string, checksum int, seen int"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, dt.datetime(2025, 1, 1), "u", 1, 2) for r in rows], LISTS)
    return sorted((r.source_config_id, r.scope, r.source_url, r.snapshot_no, r.change_kind) for r in snapshot_changes(df).collect())


def test_changes_between_lists(spark):
    assert changes(spark, [
        (1, 1, "s", "HTTPS://A.b/X/", "p", "sha256:AA"), (1, 1, "s", "https://a.b/y", "p", None), (1, 1, "s", "https://a.b/gone", "p", "1"),
        (3, 1, "s", "https://a.b/old", "p", "1"), (3, 2, "s", "https://a.b/X#f", "p", "aa"), (3, 2, "s", "https://a.b/y", "p", ""),
        (3, 2, "s", "https://a.b/y", "p", ""), (3, 2, "s", "https://a.b/x", "p", "aa"), (4, 1, "s", "https://a.b/y", "p", "2"), (4, 1, "s", "https://a.b/y", "q", "2"),
        (2, 1, "t", "z", "p", "1"), (None, 1, "s", "u", "p", "1"), (1, 1, None, "u", "p", "1"), (1, 1, "s", None, "p", "1"),
    ]) == [
        ("s", "p", "https://a.b/X", 4, "removed"), ("s", "p", "https://a.b/gone", 3, "removed"), ("s", "p", "https://a.b/x", 3, "added"),
        ("s", "p", "https://a.b/x", 4, "removed"), ("s", "p", "https://a.b/y", 4, "changed"), ("s", "q", "https://a.b/y", 4, "added"),
    ]
    assert changes(spark, []) == []


def test_changes_across_batches_equal_sets(spark):
    rng = random.Random(4)
    rows = [(n, 1, f"s{s}", f"u{d}", None if d % 7 == 0 else "p", str(rng.randint(0, 2))) for n in range(1, 6) for s in range(3) for d in range(120) if rng.random() < 0.7]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = changes_set(spark, rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for s in range(3):
        lists = {n: {(r[4], r[3]): r[5] for r in rows if r[0] == n and r[2] == f"s{s}"} for n in range(1, 6)}
        for n in range(2, 6):
            a, b = lists[n - 1], lists[n]
            want |= {(f"s{s}", *k, n, "added") for k in b.keys() - a.keys()} | {(f"s{s}", *k, n, "removed") for k in a.keys() - b.keys()}
            want |= {(f"s{s}", *k, n, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert got == want


def changes_set(spark, rows):
    df = spark.createDataFrame([(*r, dt.datetime(2025, 1, 1), "u", 1, 2) for r in rows], LISTS)
    return {(r.source_config_id, r.scope, r.source_url, r.snapshot_no, r.change_kind) for r in snapshot_changes(df).collect()}


def day(n):
    return None if n is None else dt.datetime(2025, 1, n)


def test_orphans_direct_and_inherited(spark):
    kid = spark.createDataFrame(
        [("k1", " P1\t", day(5), 1), ("k2", "p9", day(5), 1), ("k3", "p2", day(5), 1), ("k4", "p3", day(1), 1), ("k5", None, day(1), 1), ("k6", " ", day(1), 1),
         ("k7", "p4", day(5), 1), ("k8", "p5", None, 1), ("k1", "p1", day(5), 1), (None, "p9", day(2), 1)], "id string, parent string, made timestamp_ntz, ref int")
    par = spark.createDataFrame(
        [("p1", None, day(1), "active"), ("p2", None, day(1), "deleted"), ("p3", None, day(3), None), ("p4", "g9", day(1), "active"), ("p5", None, day(9), "active"),
         ("p2", None, day(1), "deleted"), (None, None, day(1), "active")], "id string, grand string, made timestamp_ntz, status string")
    grand = spark.createDataFrame([("g1", day(1))], "id string, made timestamp_ntz")
    specs = {"kid": Table("id", "made"), "par": Table("id", "made", "status"), "grand": Table("id", "made")}
    graph = [ForeignKey("kid", "parent", "par"), ForeignKey("par", "grand", "grand")]
    tables = {"kid": kid, "par": par, "grand": grand}
    got = {(r.table_name, r.row_id, r.reason, r.period, r.depth) for r in orphan_references(tables, graph, specs).collect()}
    assert got == {
        ("kid", "k2", "missing", "2025-01", 0), (("kid"), None, "missing", "2025-01", 0), ("kid", "k3", "deleted", "2025-01", 0),
        ("kid", "k4", "late", "2025-01", 0), ("par", "p4", "missing", "2025-01", 0), ("kid", "k7", "inherited", "2025-01", 1),
    }
    none = {k: v.limit(0) for k, v in tables.items()}
    assert orphan_references(none, graph, specs).count() == 0


def test_orphans_of_orphans_end_in_a_fixpoint(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else "nowhere", day(2)) for i in range(6)], "id string, up string, made timestamp_ntz")
    got = orphan_references({"n": chain}, [ForeignKey("n", "up", "n")], {"n": Table("id", "made")}).collect()
    assert sorted((r.depth, r.row_id) for r in got) == [(i, f"n{i}") for i in range(6)]


def test_side_columns_are_compared_as_well(spark):
    rows = [
        (1, 1, "s", "u1", "p", "a", "x", 1), (1, 1, "s", "u2", "p", "a", "x", 1), (1, 1, "s", "u3", None, "a", None, None), (1, 1, "s", "u4", "p", "a", "x", 1),
        (2, 1, "s", "u1", "p", "b", "y", 1), (2, 1, "s", "u2", "p", "a", "y", 2), (2, 1, "s", "u3", None, "a", "", None), (2, 1, "s", "u5", "p", "a", "x", 1),
    ]
    df = spark.createDataFrame([(*r[:6], dt.datetime(2025, 1, 1), r[6], r[7]) for r in rows], "snapshot_no int, delivery_no int, source_config_id string, source_url string, scope string, content_checksum string, ingested_at timestamp_ntz, title string, seen int")
    got = {(r.source_url, r.change_kind, r.fields) for r in snapshot_changes(df, ["title", "seen"]).collect()}
    assert got == {("u1", "changed", "title"), ("u2", "touched", "title,seen"), ("u4", "removed", ""), ("u5", "added", "")}


def test_salted_join_equals_a_plain_one(spark):
    left = spark.range(60_000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("7", 2), (None, 3)], "k string, v int")
    assert hot_keys(left, "k") == ["hot"]
    assert hot_keys_of_each(left.withColumn("g", F.col("row") % 2), "g", "k", rows=1000) == {0: ["hot"], 1: ["hot"]} and hot_keys_of_each(left, "row", "k") == {}
    for how in ("left", "inner"):
        a = salted_left_join(left, right, "k", F.col("row"), how=how).groupBy("k", "v").count()
        b = left.join(right, "k", how).groupBy("k", "v").count()
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_feedback_is_applied_in_order_within_bounds(spark):
    rng = random.Random(5)
    base = dt.datetime(2025, 1, 1)
    rows = [(f"c{rng.randint(0, 5)}", rng.choice(["useful", "stale", "other", None]), base + dt.timedelta(seconds=rng.randint(0, 10**7))) for _ in range(400)] + [(None, "useful", base)]
    v = spark.createDataFrame(rows, "claim_id string, verdict string, at timestamp_ntz")
    c = spark.createDataFrame([(f"c{i}", 0.5, "verified") for i in range(8)], "claim_id string, confidence double, status string")
    want = {}
    for i in range(8):
        x, status = 0.5, "verified"
        for _, d in sorted((at, {"useful": 0.1, "stale": -0.25}[k]) for cid, k, at in rows if cid == f"c{i}" and k in ("useful", "stale")):
            x, status = min(1.0, max(0.0, x + d)), "challenged" if d < 0 or status == "challenged" else status
        want[f"c{i}"] = (round(x, 6), status)
    assert {r.claim_id: (round(r.confidence, 6), r.status) for r in with_feedback(c, v).collect()} == want


def test_upsert_and_retire(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 5), ("b", 6), ("c", 7), (None, 8)], "k string, v int")
    assert {tuple(r) for r in upserted(old, new, ["k"], F.col("v")).collect()} == {("a", 1), ("b", 6), ("c", 7), (None, 8)}
    docs = spark.createDataFrame([("s", "1", "active"), ("s", "2", "active"), ("t", "3", "active")], "source_config_id string, source_url string, status string")
    seen = docs.where("source_url = '1'").select("source_config_id", "source_url")
    assert {(r.source_url, r.status) for r in retired(docs, seen, ["source_config_id", "source_url"]).collect()} == {("1", "active"), ("2", "deleted"), ("3", "active")}


def test_packing(spark):
    b = spark.createDataFrame([("p", "x", 1, 5, False), ("p", "y", 2, 9, False), ("p", "z", 3, 4, False), ("p", "c", 4, 9, True), ("q", "n", None, None, None), (None, "o", 1, 1, True)],
                              "packet string, block string, priority int, cost int, critical boolean")
    got = {(r.block, r.used, r.fate) for r in packed(b, "packet", 10, 1).collect()}
    assert got == {("x", 5, "kept"), ("y", 0, "dropped"), ("z", 4, "kept"), ("c", 1, "cut"), ("n", 0, "kept")}


def test_packets_of_any_size_span_ranges(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([0, 3, 70, 200, 900, 2000]), rng.random() < 0.001) for i in range(110_000)] + [(f"p{i % 40:02d}", i, rng.randint(1, 300), rng.random() < 0.1) for i in range(400)]
    rows += [("slow", i, 1 if i > 30_000 else 2000, i == 59_000) for i in range(60_000)]
    want, left = set(), {}
    for p, i, c, k in sorted(rows):
        x = left.setdefault(p, 600)
        used, fate = (c, "kept") if c <= x else (x, "cut") if k and x >= 40 else (0, "dropped")
        left[p] = x - used
        want.add((p, i, c, used, fate))
    b = spark.createDataFrame(rows, "packet string, block int, cost int, critical boolean").withColumn("priority", F.lit(1))
    for coalesced in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            got = [tuple(r) for r in packed(b, "packet", 600).select("packet", "block", "cost", "used", "fate").collect()]
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(got) == len(rows) and set(got) == want


def test_policies_contradict_on_one_subject_and_purpose(spark):
    """Both kinds, as comparing all pairs finds them."""
    rng = random.Random(11)
    claims = []
    for _ in range(400):
        who, strength, no, what = rng.choice(["api", "The API", "worker", "jobs"]), rng.choice(["must", "should", "should", "needs to", "required\nto"]), rng.choice(["", "not "]), rng.choice([f"queue {i}" for i in range(40)])
        why = rng.choice(["", "sessions", "the sessions", "logs"])
        claims.append((rng.choice(["s", "t", None]), who, strength, no, what, why, f"{who} {strength} {no}use\n {what}" + (f" for {why}" if why else "") + rng.choice(["", ".", " !\n"])))
    plain = lambda x: x.lower().removeprefix("the ")
    want = {}
    for s, w, st, no, v, y, _ in claims:
        for s2, w2, st2, no2, v2, y2, _ in claims:
            if (s, plain(w), plain(y)) == (s2, plain(w2), plain(y2)):
                kind = "opposite" if no != no2 and v == v2 else "different" if not no and not no2 and v != v2 else None
                if kind:
                    k = (s, plain(w), plain(y), kind, v if kind == "opposite" else None)
                    want[k] = "high" if want.get(k) == "high" or st != "should" or st2 != "should" else "medium"
    rows = [(s, t) for s, *_, t in claims] + [("s", None), ("s", "no policy"), ("s", "x must stop"), ("u", "api must use a cache"), ("u", "api must write b for logs"), ("u", "web must not use a cache")]
    got = policy_conflicts(spark.createDataFrame(rows, "scope string, claim_text string")).collect()
    assert {(r.scope, r.subject, r.purpose, r.kind, r.value): r.severity for r in got} == want and len(got) == len(want)
    assert {k[3] for k in want} == {"opposite", "different"} and set(want.values()) == {"high", "medium"}


def test_nearest_ranks_of_a_key_that_spans_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, float(rng.randint(0, 900))])) for _ in range(9000)] + [("one", 2.0), ("none", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p0": 0, "p50": 50, "p95": 95, "p100": 100}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in got:
        v = sorted(x for k, x in rows if k == r.k and x is not None)
        assert tuple(r)[1:] == tuple(v[max(1, -(-len(v) * p // 100)) - 1] if v else None for p in (0, 50, 95, 100))
    assert {r.k for r in got} == {"hot", "b", None, "one", "none"} and len(got) == 5


def test_limits(spark):
    base = dt.datetime(2025, 1, 1)
    e = spark.createDataFrame([("a", base + dt.timedelta(seconds=s)) for s in (0, 1, 1, 9, 10, 30)] + [("b", base), (None, base), ("b", None)], "k string, ts timestamp_ntz")
    t0 = int(base.replace(tzinfo=dt.UTC).timestamp())
    assert sorted((r.k, r.opened_s - t0, r.events, r.allowed) for r in limited(e, "k", "ts", 10, 3).collect()) == [("a", 0, 4, 3), ("a", 10, 1, 1), ("a", 30, 1, 1), ("b", 0, 1, 1)]


@pytest.mark.parametrize("rows", [[], [("a", None)]])
def test_limits_without_events(spark, rows):
    assert limited(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), "k", "ts").count() == 0


def test_cancelled_updates_take_the_row_received_first(spark, tmp_path):
    """Update 1 came again later: by its first row, update 2 is the newest of its kind. An update without id, or received at no time, is one as well."""
    import duckdb

    from marginalia.plans import store

    day = lambda d: d and dt.datetime(2025, 1, d)
    rows = [(10 * k + i, f"c{k}", "p", status, "s", day(d)) for k in range(8) for i, status, d in [(1, "Verified", 1), (2, "verified", 2), (1, "verified ", 9 + k), (1, "verified", None), (3, "expired", 4)]]
    rows += [(None, "n", "p", "verified", "s", day(5)), (90, "n", "p", "verified", "s", day(4)), (91, None, "p", None, "s", day(4)), (92, None, "p", None, "s", None)]
    df = spark.createDataFrame(rows, "update_id bigint, claim_id string, scope string, status string, source_config_id string, received_at timestamp_ntz")
    df.coalesce(1).write.parquet(f"{tmp_path}/claim_updates.parquet")
    got = sorted((r.update_id for r in store.registry.queries["e01_cancelled"](spark, str(tmp_path)).collect()), key=lambda i: (i is None, i))
    assert got == [10 * k + 1 for k in range(8)] + [90, 92]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW claim_updates AS SELECT * FROM read_parquet('{tmp_path}/claim_updates.parquet/*.parquet')")
    assert sorted(r for (r,) in con.execute(store.registry.sql["e01_cancelled"]).fetchall()) == got
