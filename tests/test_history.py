import datetime as dt
import random

from pyspark.sql import functions as F

from marginalia.operators.asof import held_when
from marginalia.operators.history import attribute_history, segmented, states_at

SCHEMA = "update_id bigint, claim_id string, status string, sup string, valid_from timestamp_ntz, expires_at timestamp_ntz, received_at timestamp_ntz, entity string, eff int"
T0 = dt.datetime(2025, 1, 1)


def t(n):
    return None if n is None else T0 + dt.timedelta(seconds=n)


def brute(rows):
    """The rules, one claim at a time; times in seconds after T0."""
    first = {}
    for r in rows:
        if r[1] is not None:
            k = r[0] if r[0] is not None else ("lone", *r[1:])
            if k not in first or (r[6], str(r)) < (first[k][6], str(first[k])):
                first[k] = r
    by = {}
    for u, c, status, sup, vf, ex, rec in first.values():
        eff = rec if vf is None else vf
        if eff is None or ex is not None and ex <= eff:
            continue
        at = by.setdefault(c, {})
        if eff not in at or (rec, u if u is not None else -1) > at[eff][0]:
            at[eff] = ((rec, u if u is not None else -1), ex, status, sup)
    out = set()
    for c, at in by.items():
        effs, versions = sorted(at), []
        for i, e in enumerate(effs):
            _, ex, status, sup = at[e]
            ends = [x for x in (ex, effs[i + 1] if i + 1 < len(effs) else None) if x is not None]
            end = min(ends) if ends else None
            if versions and versions[-1][1] == e and versions[-1][2:] == [status, sup]:
                versions[-1][1] = end
            else:
                versions.append([e, end, status, sup])
        out |= {(c, *v) for v in versions}
    return out


def history(spark, rows, **kw):
    df = spark.createDataFrame([(u, c, s, p, t(v), t(e), t(r), "x", 1) for u, c, s, p, v, e, r in rows], SCHEMA)
    return attribute_history(df, {"status": F.col("status"), "supersedes_claim_id": F.col("sup")}, **kw)


def plain(h):
    base = int(T0.replace(tzinfo=dt.UTC).timestamp())
    sec = lambda us: None if us is None else us // 1_000_000 - base
    return {(r[0], sec(r[1]), sec(r[2]), r[3], r[4]) for r in h.collect()}


def some(rng, claims, per, uid=0):
    rows = []
    for c in range(claims):
        for _ in range(rng.randint(1, per)):
            uid += 1
            rec = rng.randint(0, 40 * per)
            vf = None if rng.random() < 0.1 else max(0, rec + rng.randint(-20, 20))
            ex = None if rng.random() < 0.6 else (vf or rec) + rng.randint(-3, 60)
            rows.append((uid, f"c{c}", rng.choice("ab"), rng.choice([None, "p"]), vf, ex, rec))
            if rng.random() < 0.1:
                rows.append(rows[-1] if rng.random() < 0.5 else (*rows[-1][:6], rec + 5))
    rng.shuffle(rows)
    return rows


def test_versions_equal_the_rules(spark):
    rows = some(random.Random(1), 60, 12)
    assert plain(history(spark, rows)) == brute(rows)


def test_cut_and_uncut_entities_give_the_same(spark):
    rows = some(random.Random(2), 3, 5) + some(random.Random(3), 1, 900, 10_000)
    want = brute(rows)
    for max_fold in (4, 50, 1):
        assert plain(history(spark, rows, max_fold=max_fold)) == want


def test_nulls_and_empty_tables(spark):
    rows = [
        (None, "a", "x", None, 5, None, 5), (None, "a", "x", None, 5, None, 5), (None, "a", "y", None, 9, None, 9),
        (1, None, "x", None, 1, None, 1), (2, "b", None, None, None, None, None), (3, "c", None, None, None, 7, 3),
    ]
    assert plain(history(spark, rows)) == {("a", 5, 9, "x", None), ("a", 9, None, "y", None), ("c", 3, 7, None, None)}
    assert history(spark, []).count() == 0


def test_states_and_events_meet_their_version(spark):
    h = history(spark, [(1, "a", "x", None, 0, 10, 0), (2, "a", "y", None, 20, None, 20)])
    base = int(T0.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    at = [base, base + 10_000_000, base + 20_000_000]
    assert {(r.at_us - base, r.status) for r in states_at(h, at).collect()} == {(0, "x"), (20_000_000, "y")}
    e = spark.createDataFrame([(i, "a", a) for i, a in enumerate(at)] + [(9, "z", base), (10, None, base), (11, "a", None)], "id int, claim_id string, at_us bigint")
    got = {r.id: r.status for r in held_when(e, h.drop("supersedes_claim_id"), "claim_id", "at_us").collect()}
    assert got == {0: "x", 1: None, 2: "y", 9: None, 10: None, 11: None}


def test_an_entity_of_two_thirds_of_all_moments_fills_many_small_segments(spark):
    """200,000 moments of one entity: no segment is longer than asked for, and the versions are those of a window over it."""
    i = F.col("id")
    at = F.timestamp_add("SECOND", i, F.lit(T0).cast("timestamp_ntz"))
    who = F.when(i % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("c"), i % 5000))
    u = spark.range(300_000).select(
        i.alias("update_id"), who.alias("claim_id"), (i % 1000 < 500).cast("string").alias("status"), F.lit(None).cast("string").alias("sup"),
        at.alias("valid_from"), F.when(i % 7000 == 0, at + F.expr("INTERVAL 1 SECOND")).alias("expires_at"), at.alias("received_at"),
    )
    laid, last = segmented(u.select("claim_id", "update_id"), "claim_id", "update_id", 256, "test")
    sizes = laid.groupBy("seg").count()
    assert sizes.agg(F.max("count")).first()[0] <= 256 and sizes.count() <= last + 1 <= 300_000 // 256 + 200
    h = attribute_history(u, {"status": F.col("status"), "supersedes_claim_id": F.col("sup")})
    got = sorted((r.claim_id, r.start_us, r.end_us or 0, r.status) for r in h.collect())
    u.createOrReplaceTempView("hot_updates")
    want = spark.sql("""
        WITH ends AS (SELECT *, least(expires_at, lead(valid_from) OVER w) AS until FROM hot_updates WINDOW w AS (PARTITION BY claim_id ORDER BY valid_from)),
        marked AS (SELECT *, if(lag(until) OVER w = valid_from AND lag(status) OVER w = status, 0, 1) AS fresh FROM ends WINDOW w AS (PARTITION BY claim_id ORDER BY valid_from)),
        runs AS (SELECT *, sum(fresh) OVER (PARTITION BY claim_id ORDER BY valid_from) AS run FROM marked)
        SELECT claim_id, unix_micros(CAST(min(valid_from) AS TIMESTAMP)) AS s, CAST(coalesce(unix_micros(CAST(max_by(until, valid_from) AS TIMESTAMP)), 0) AS BIGINT) AS e, any_value(status) AS status
        FROM runs GROUP BY claim_id, run""")
    assert got == sorted(map(tuple, want.collect()))


def test_events_meet_versions_across_ranges(spark):
    """A key with most events, and versions far apart from the events that they hold for."""
    rng = random.Random(4)
    versions, start = [], 0
    for k in ("hot", "b", "c"):
        start = 0
        for n in range(400 if k == "hot" else 5):
            end = start + rng.randint(1, 50)
            versions.append((k, start, None if n == 4 and k == "b" else end, f"{k}{n}"))
            start = end + rng.choice([0, 0, 7])
    events = [(i, rng.choice(["hot"] * 5 + ["b", "c", "z", None]), rng.choice([None] + [rng.randint(-5, 12_000)] * 20)) for i in range(4000)]
    want = {i: next((v for c, s, e, v in versions if c == k and t is not None and s <= t and (e is None or t < e)), None) for i, k, t in events}
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        e = spark.createDataFrame(events, "id int, claim_id string, at_us bigint")
        v = spark.createDataFrame([*versions, (None, 0, None, "none"), ("z", None, None, "never")], "claim_id string, start_us bigint, end_us bigint, status string")
        assert {r.id: r.status for r in held_when(e, v, "claim_id", "at_us").collect()} == want
        assert held_when(e.limit(0), v, "claim_id", "at_us").count() == 0 and held_when(e, v.limit(0), "claim_id", "at_us").where("status IS NULL").count() == 4000
    finally:
        for k, x in before.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)
