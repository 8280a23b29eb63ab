import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm.neighbours import Cells, Layout, _coded, _search, _unit, most_similar_vectors, similar_ids, similar_pairs, usable

SCHEMA = "kind string, id string, vector array<float>"


def vectors(spark, x, kind="k", ids=None):
    ids = ids or [f"v{i:06d}" for i in range(len(x))]
    return spark.createDataFrame([(kind, i, [float(f) for f in v]) for i, v in zip(ids, x)], SCHEMA)


def clustered(n, d=48, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(20, d))[rng.integers(0, 20, n)] + 0.9 * rng.normal(size=(n, d))).astype(np.float32)


def truth(x, k):
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, 1)[:, :k], s


def test_exact_while_all_cells_are_probed(spark):
    x = clustered(800)
    want, s = truth(x, 10)
    got = {r.id: r for r in similar_ids(vectors(spark, x), 10).groupBy("id").agg(F.collect_list(F.struct("other", "sim")).alias("n")).collect()}
    assert len(got) == 800
    for i in range(800):
        near = {int(o.other[1:]): o.sim for o in got[f"v{i:06d}"].n}
        assert set(near) == set(want[i])
        assert all(abs(s[i, j] - v) < 1e-5 for j, v in near.items())


def test_recall_with_few_probes(spark):
    x = clustered(6000, seed=1)
    want, _ = truth(x, 10)
    layout = Layout(cell_rows=60, probes=(12, 0.4, 0.75), groups=5, group_rows=900, sample=1500)
    got = similar_ids(vectors(spark, x), 10, layout=layout).groupBy("id").agg(F.collect_list("other").alias("n")).collect()
    hit = sum(len({int(o[1:]) for o in r.n} & set(want[int(r.id[1:])].tolist())) for r in got)
    assert len(got) == 6000 and hit / 60_000 >= 0.9


def searched(x, layout, k, least=-2.0):
    """What the tasks of one kind find, without Spark: the k best of each row, and how many rows each task holds."""
    rng = np.random.default_rng(5)
    cells = Cells(x[rng.choice(len(x), min(len(x), layout.sample), replace=False)], len(x), layout)
    cell, last, into = cells.met(x)
    code, fine, scale = _coded(x)
    task = cells.task(cells.group[cell[into[:, 0]]], into[:, 1])
    found = [[] for _ in x]
    sizes = []
    for t in np.unique(task):
        rows = into[task == t, 0]
        sizes.append(len(rows))
        who, sim = _search(code[rows], fine[rows], scale[rows], cell[rows], last[rows], cells, k, least)
        for r, w, v in zip(rows, who, sim):
            found[r] += [(-b, rows[a]) for a, b in zip(w, v) if a >= 0]
    return [[int(w) for _, w in sorted(f)[:k]] for f in found], sizes, cells


def test_recall_of_the_default_layout_on_a_larger_collection():
    n = 100_000
    x = _unit(clustered(n, seed=7).astype(float))
    got, sizes, _ = searched(x, Layout(), 10)
    hit = 0
    queries = np.arange(0, n, 50)  # every id that is divisible by 50, against all
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -2
    for want, q in zip(np.argpartition(-s, 10, axis=1)[:, :10], queries):
        hit += len(set(want.tolist()) & set(got[q]))
    assert hit / (10 * len(queries)) >= 0.95
    assert max(sizes) <= 100_000


def test_no_task_of_a_large_collection_holds_over_100_000_vectors():
    """Tasks as they would be for three million vectors, from every hundredth of them."""
    x = _unit(clustered(30_000, seed=8).astype(float))
    cells = Cells(x, 3_000_000, Layout())
    cell, _, into = cells.met(x)
    task = cells.task(cells.group[cell[into[:, 0]]], into[:, 1])
    assert cells.groups == 94 and np.bincount(task).max() * 100 <= 100_000


def test_each_pair_of_groups_is_one_task():
    cells = Cells(_unit(clustered(4000, seed=9).astype(float)), 4000, Layout(cell_rows=50, group_rows=400), first=7)
    g, h = np.meshgrid(np.arange(cells.groups), np.arange(cells.groups))
    t = cells.task(g.ravel(), h.ravel())
    assert cells.groups == 10 and sorted(set(t)) == list(range(7, 7 + cells.tasks)) and (cells.task(h.ravel(), g.ravel()) == t).all()


def test_a_kind_that_the_sample_missed_is_searched_whole(spark):
    x = clustered(300, 6, 11)
    many = vectors(spark, x, "a").unionByName(vectors(spark, x[:, :5], "b"))
    layout = Layout(sample=2)
    want, _ = truth(x[:, :5], 3)
    got = similar_ids(many, 3, layout=layout).where("kind = 'b'").groupBy("id").agg(F.collect_list("other").alias("n")).collect()
    assert {r.id: {int(o[1:]) for o in r.n} for r in got} == {f"v{i:06d}": set(want[i]) for i in range(300)}


def test_copies_ties_and_two_kinds(spark):
    x = np.eye(4, dtype=np.float32)
    same = vectors(spark, np.repeat(x[:1], 30, 0), "a", [f"s{i:02d}" for i in range(30)])
    rest = vectors(spark, np.vstack([x[1:], x[:1] * 3, x[:1] + 0.01]), "a", ["p", "q", "r", "t", "u"])
    other = vectors(spark, x, "b", ["s00", "z1", "z2", "z3"])
    v = same.unionByName(rest).unionByName(other).unionByName(same)
    got = {}
    for r in similar_ids(v, 3, least=0.5).collect():
        got.setdefault((r.kind, r.id), []).append(r.other)
    assert sorted(got["a", "s29"]) == ["s00", "s01", "s02"] and sorted(got["a", "s00"]) == ["s01", "s02", "s03"]
    assert sorted(got["a", "u"]) == ["s00", "s01", "s02"] and ("b", "s00") not in got and ("a", "p") not in got
    pairs = {(r.id_a, r.id_b) for r in similar_pairs(v, 3, 0.95).collect()}
    assert ("s00", "s29") in pairs and ("s00", "t") in pairs and ("s04", "s05") not in pairs


def test_hot_copies_are_collapsed(spark):
    x = np.vstack([clustered(300, 8, 3), np.repeat(clustered(1, 8, 4), 3000, 0)])
    assert most_similar_vectors(vectors(spark, x), 5).count() == 301


@pytest.mark.parametrize("v, d, ok", [([1.0], 1, True), ([], 0, False), (None, 1, False), ([0.0, 0.0], 2, False), ([1.0, None], 2, False), ([1.0, float("nan")], 2, False), ([1.0, float("inf")], 2, False), ([1.0], 2, False), ([1.0], None, False), ([1e-30, 1e30], 2, True)])
def test_usable(spark, v, d, ok):
    df = spark.createDataFrame([(v, d)], "v array<float>, d int")
    assert df.select(usable(F.col("v"), F.col("d")).alias("x")).first().x is ok


def test_nulls_and_extra_columns(spark):
    v = vectors(spark, np.eye(3) + 0.5).unionByName(spark.createDataFrame([(None, "x", [1.0] * 3), ("k", None, [1.0] * 3), ("k", "y", None)], SCHEMA))
    v = v.withColumns({"v1": F.lit("clash"), "sim": F.lit(0), "task": F.lit(None).cast("int")})
    got = similar_ids(v, 2).collect()
    assert {r.id for r in got} == {f"v{i:06d}" for i in range(3)} == {r.other for r in got} and len(got) == 6


def test_empty_and_single(spark):
    one = vectors(spark, np.ones((1, 3)))
    assert similar_ids(one).count() == 0 and similar_ids(one.limit(0)).count() == 0 and similar_pairs(one.limit(0)).count() == 0
