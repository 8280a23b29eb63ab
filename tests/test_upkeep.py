"""Mutations, names in texts, and where files come from, on small tables with everything odd in them."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions.entities import entity_names, entity_type, mentions_entity
from marginalia.operators import upkeep as U
from marginalia.sources.git import blob_address, git_identity, web_address


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_replaced(spark):
    old = spark.createDataFrame([("d1", "a", 1), ("d1", "b", 2), ("d2", "c", 3), (None, "x", 4)], "doc string, chunk string, extra int")
    new = spark.createDataFrame([("d1", "z", 9), ("d3", "n", 8), (None, "y", 7)], "doc string, chunk string, extra int")
    assert rows(U.replaced(old, new, "doc"), "doc", "chunk") == sorted([("d1", "z"), ("d2", "c"), ("d3", "n"), (None, "x")], key=str)
    assert U.replaced(old, new.limit(0), "doc").count() == 4 and U.replaced(old.limit(0), new, "doc").count() == 2


def test_forgotten(spark):
    c = spark.createDataFrame([("a", "verified", "t"), ("b", "verified", "t"), ("c", None, None), ("d", "inferred", "t")], "claim_id string, status string, tag string")
    r = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", None), (None, True), ("zz", True)], "claim_id string, permanent boolean")
    assert rows(U.forgotten(c, r)) == [("a", "deprecated", None), ("b", "deprecated", "t"), ("c", "deprecated", None), ("d", "inferred", "t")]


def test_resolved(spark):
    c = spark.createDataFrame([("a", "open", None, None), ("b", "resolved", "old", 1), ("c", "open", None, None), (None, "open", None, None)], "conflict_id string, status string, resolution string, resolved_at int")
    v = spark.createDataFrame([("a", "resolved", "n1", 5), ("a", "suppressed", "n2", 6), ("b", "open", "n3", 7), (None, "resolved", "n", 1), ("c", None, "n", 1)], "conflict_id string, to string, note string, at int")
    assert rows(U.resolved(c, v)) == sorted([("a", "suppressed", "n2", 6), ("b", "open", None, None), ("c", "open", None, None), (None, "open", None, None)], key=str)


def test_merged_summaries(spark):
    schema = "scope string, documents bigint, urls array<string>, metadata map<string,string>"
    o = spark.createDataFrame([("a", 1, ["u"], {"x": "1", "y": "1"}), (None, 2, ["v"], None), ("c", 3, [], {"k": "v"})], schema)
    n = spark.createDataFrame([("a", 5, ["w"], {"y": "2", "z": "2"}), (None, 6, None, {"q": "1"}), ("d", 7, ["n"], None)], schema)
    got = {r.scope: (r.documents, r.urls, r.metadata) for r in U.merged_summaries(o, n, ["scope"]).collect()}
    assert got == {"a": (5, ["w"], {"x": "1", "y": "2", "z": "2"}), None: (6, None, {"q": "1"}), "c": (3, [], {"k": "v"}), "d": (7, ["n"], {})}


def test_refreshed(spark):
    e = spark.createDataFrame([("e1", "u", "active"), ("e2", None, "active"), ("e3", "v", "active")], "edge string, source_url string, status string")
    s = spark.createDataFrame([("s1", "u"), ("s1", "w"), ("s2", "w"), ("s3", None)], "summary string, source_url string")
    edges, kept = U.refreshed(e, s, spark.createDataFrame([("u",), ("u",), (None,)], "source_url string"))
    assert rows(edges, "edge", "status") == [("e1", "deprecated"), ("e2", "active"), ("e3", "active")] and {r.summary for r in kept.collect()} == {"s2", "s3"}


def test_linked(spark):
    o = spark.createDataFrame([("a", "raw", None), ("b", "challenged", None), ("c", "accepted", None), ("d", "proposed", 3), ("e", "raw", None), (None, "raw", None)], "k string, status string, proposal_id int")
    p = spark.createDataFrame([("a", 9), ("a", 7), ("b", 8), ("c", 1), ("d", 1), (None, 1)], "k string, proposal_id int")
    got = {r.k: (r.status, r.proposal_id, r.refused) for r in U.linked(o, p, "k").collect()}
    assert got == {"a": ("proposed", 7, False), "b": ("proposed", 8, False), "c": ("accepted", None, True), "d": ("proposed", 3, False), "e": ("raw", None, False), None: ("raw", None, False)}


def test_marks_backoff_and_requests(spark):
    r = spark.createDataFrame([("s", 1, True, True), ("s", 2, True, False), ("s", 3, False, False), ("s", 3, False, False), ("t", 1, False, False), ("u", 1, True, True), (None, 1, True, True)], "source string, at int, ok boolean, drained boolean")
    assert rows(U.source_marks(r)) == [("s", 1, 3, 2), ("t", None, 1, 1), ("u", 1, None, 0)]
    b = spark.createDataFrame([(1, 30), (2, 60), (5, 480), (6, 900), (500, 900), (None, 30), (0, 30)], "n int, want int")
    assert b.where(U.backoff_seconds(F.col("n")) != F.col("want")).count() == 0
    j = spark.createDataFrame([(1, "failed", 3, 3), (2, "running", 1, 3), (3, "queued", 0, 3), (4, "failed", 1, 5), (5, "queued", 0, 3)], "job_id int, status string, attempts int, max_attempts int")
    q = spark.createDataFrame([(1, "retry"), (2, "cancel"), (3, "cancel"), (3, "retry"), (4, "explode"), (None, "retry")], "job_id int, action string")
    got = {x.job_id: (x.status, x.max_attempts, x.done) for x in U.job_requests(j, q).collect()}
    assert got == {1: ("queued", 4, True), 2: ("running", 3, False), 3: ("canceled", 3, True), 4: ("failed", 5, None), 5: ("queued", 3, None)}


def test_code_claims(spark):
    c = spark.createDataFrame([("a", "p", "u", "verified"), ("b", "q", "u", "verified"), ("c", "p", None, "verified"), ("d", "p", "u", "deprecated")], "claim_id string, scope string, source_url string, status string")
    d = spark.createDataFrame([("p", "u", True), ("p", "u", True), ("q", "u", False), ("p", None, True)], "scope string, source_url string, is_code boolean")
    assert {r.claim_id: r.status for r in U.retired_code_claims(c, d).collect()} == {"a": "deprecated", "b": "verified", "c": "verified", "d": "deprecated"}


TEXTS = [
    ("The Billing Service uses Redis and `ledger  api`. Ask the Payments Team.", {"billing service", "redis", "ledger api", "payments team"}),
    ("An API in Node.js talks to KAFKA; Lovely Weather, deployAPI", {"api", "node.js", "kafka"}),
    ("Order Queue Worker-Pool and The Order-Database", {"order queue worker-pool", "order-database"}),
    ("redis REDIS `Redis` ` `", {"redis"}), (None, set()), ("", set()), ("the `the` A", set()),
]


def test_names(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i int, t string")
    got = {r.i: set(r.n) for r in df.select("i", entity_names(F.col("t")).alias("n")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}
    kinds = {"payments team": "team", "billing-service": "service", "order queue": "system", "redis": "technology", "kafka topics": "technology", "x": "unknown", "event stream": "unknown"}
    df = spark.createDataFrame(list(kinds.items()), "n string, want string")
    assert df.where(entity_type(F.col("n")) != F.col("want")).count() == 0


@pytest.mark.parametrize("name, text, met", [("order-service", "the ORDER of a service", True), ("order-service", "order only", False), ("orders", "reorders", True), ("a.b", "b and a", False), ("", "x", False), ("x", None, False), (None, "x", False), ("abc", "xabcx", True)])
def test_mentions(spark, name, text, met):
    df = spark.createDataFrame([(name, text)], "n string, t string")
    assert df.select(mentions_entity(F.col("t"), F.col("n"))).first()[0] is met


def test_git(spark, tmp_path):
    sha, other = "a" * 40, "b" * 40
    g = tmp_path / ".git"
    (g / "refs" / "heads").mkdir(parents=True)
    (g / "config").write_text('[core]\n\tbare = false\n[remote "up"]\n\turl = https://x.example/a\n[remote "origin"]\n\turl = git@Git.Example.org:team/repo.git\n')
    (g / "HEAD").write_text("ref: refs/heads/main\n")
    (g / "packed-refs").write_text(f"# pack\n{other} refs/heads/main\n^{sha}\n")
    assert git_identity(str(tmp_path)) == {"web": "https://git.example.org/team/repo", "branch": "main", "commit": other}
    (g / "refs" / "heads" / "main").write_text(sha + "\n")
    assert git_identity(str(tmp_path))["commit"] == sha
    (g / "HEAD").write_text(sha)
    assert git_identity(str(tmp_path)) == {"web": "https://git.example.org/team/repo", "branch": None, "commit": sha}
    assert git_identity(str(tmp_path / "nowhere")) == {"web": None, "branch": None, "commit": None}
    for remote, want in (("https://me:pw@Host.org:8443/a/b.git/", "https://host.org/a/b"), ("ssh://git@h.org/a/b", "https://h.org/a/b"), ("/srv/repo.git", None), (None, None), ("C:\\repo", None)):
        assert web_address(remote) == want or remote.endswith(".git/") and web_address(remote).startswith("https://host.org/a/b")
    df = spark.createDataFrame([("https://h.org/a/", sha, "/docs/a b#1.md"), ("https://gitlab.h.org/a", sha, "x"), (None, sha, "x")], "w string, c string, p string")
    got = [r[0] for r in df.select(blob_address(F.col("w"), F.col("c"), F.col("p"))).collect()]
    assert got == [f"https://h.org/a/blob/{sha}/docs/a%20b%231.md", f"https://gitlab.h.org/a/-/blob/{sha}/x", None]


def test_code_edges(spark):
    from marginalia.functions.code import GO, SCRIPT, code_edges, resolved_import

    script = "import React, { useState } from 'react'\nimport './style.css'\nconst fs = require(\"fs\")\nexport default class Page {}\nexport const one = 1\nfunction helper() {}\nimport 'react'"
    go = 'package main\n\nimport "os"\nimport (\n\t"fmt"\n\tx "a/b"\n)\n\ntype Set[T any] struct{}\nfunc (s *Set) Add(v int) {}\nfunc New[T any]() {}\nfunc main() {}\n'
    df = spark.createDataFrame([(script, go), (None, None), ("", "")], "s string, g string")
    got = [({tuple(e) for e in r.a}, {tuple(e) for e in r.b}) for r in df.select(code_edges(F.col("s"), SCRIPT).alias("a"), code_edges(F.col("g"), GO).alias("b")).collect()]
    assert got[0][0] == {("imports", "react"), ("imports", "./style.css"), ("requires", "fs"), ("exports", "Page"), ("exports", "one"), ("defines", "Page"), ("defines", "helper")}
    assert got[0][1] == {("package", "main"), ("imports", "os"), ("imports", "fmt"), ("imports", "a/b"), ("types", "Set"), ("methods", "Add"), ("functions", "New"), ("functions", "main")}
    assert got[1] == got[2] == (set(), set())
    paths = {("src/a/b.ts", "./c"): "src/a/c", ("src/a/b.ts", "../c/d.js"): "src/c/d", ("b.ts", "../../x"): "x", ("src/b.ts", "lib/x.js"): "lib/x.js", ("src/b.ts", "."): "src"}
    df = spark.createDataFrame([(p, n, want) for (p, n), want in paths.items()], "p string, n string, want string")
    assert [r[0] for r in df.where(resolved_import(F.col("p"), F.col("n")) != F.col("want")).select(F.concat("p", "n")).collect()] == []


def test_planned_batches(spark):
    import random

    from marginalia.operators.planning import planned

    rng = random.Random(12)
    items = [(i, rng.choice(["a", "b"]), rng.choice([None, 1, 5, 9, 30]), 1, "x") for i in range(400)] + [(900, None, 1, 1, "x")]
    want = {}
    for run in "ab":
        batch = size = n = 0
        for i, r, s, _, _ in items:
            if r == run:
                if n and (n + 1 > 7 or size + (s or 0) > 20):
                    batch, size, n = batch + 1, 0, 0
                want[i] = batch
                size, n = size + (s or 0), n + 1
    df = spark.createDataFrame(items, "id int, run string, bytes int, n int, extra string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        assert {r.id: r.batch for r in planned(df, "run", ["id"], {"n": 7, "bytes": 20}).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert planned(df.limit(0), "run", ["id"], {"n": 7}).count() == 0


def test_serial_runs(spark):
    import random

    from marginalia.operators.loads import serial_ends

    rng = random.Random(13)
    jobs = [(i, rng.choice(["s", "t", None]), rng.choice([None] + [rng.randint(0, 3000)] * 20), rng.choice([0, 3, 40])) for i in range(300)]
    want = {}
    for key in "st":
        end = None
        for i, _, at, took in sorted((j for j in jobs if j[1] == key and j[2] is not None), key=lambda j: (j[2], j[0])):
            end = max(at, end if end is not None else at) + took
            want[i] = (end, end - took - at)
    df = spark.createDataFrame(jobs, "job_id int, source string, at bigint, took bigint")
    for bucket in (50, 1_000_000):
        assert {r.job_id: (r.end_us, r.waited_us) for r in serial_ends(df, "source", "job_id", "at", "took", bucket).collect()} == want


def test_waits_that_add_up_beyond_64_bits(spark, tmp_path):
    """140,000 jobs of one source at one moment: each waits for all before it, 1,110 s apiece, 10.9e18 microseconds in all."""
    import duckdb

    from marginalia.plans import upkeep

    n = 140_000
    e = spark.range(n).select((F.col("id") * 7 + 6).alias("event_id"), F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'").alias("ts"), F.lit(5).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    (got,) = upkeep.registry.queries["k06_serial"](spark, str(tmp_path)).collect()
    assert (got.jobs, got.longest_wait_us, got.waited_s) == (n, 1_110_000_000 * (n - 1), 1_110 * n * (n - 1) // 2)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert con.execute(upkeep.registry.sql["k06_serial"]).fetchall() == [tuple(got)]
