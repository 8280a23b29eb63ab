"""The most similar vectors of every vector, by cosine: a block matrix join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.skew import salted_left_join


@dataclass(frozen=True)
class Layout:
    """How vectors are laid out in blocks.

    ``cell_rows``: vectors a cell holds on average; a kind has no more cells than an
    eighth of the vectors that it was fitted on, beyond that they grow.
    ``probes``: ``(a, b, power)``; each vector meets the ``a + b * cells ** power`` cells
    nearest to it, as recall falls with the number of cells otherwise.
    ``group_rows``: vectors of a group of neighbouring cells on average; a task has two groups
    at most, so about twice as many vectors. ``groups``: how many groups a kind has at least (if it has as many cells), so that small
    kinds use several cores. ``sample``: about how many vectors, of all kinds
    together, the cells are fitted on; the driver holds no more than these. Half of them go to the kinds in proportion, half evenly.
    It's the only use of a sample: every vector gets a cell and neighbours. A kind that the sample missed is one cell.
    """

    cell_rows: int = 1200
    probes: tuple[float, float, float] = (4, 0.15, 0.75)
    group_rows: int = 32_000
    groups: int = 4
    sample: int = 32_000


def usable(vector: Column, dimensions: Column) -> Column:
    """Whether a vector takes part: not null, as long as its dimensions say, finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dimensions) & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow and underflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Cells:
    """Centres of cells and the group of each cell, for one kind of vectors; tasks are pairs of groups, numbered from ``first``."""

    def __init__(self, sample: np.ndarray, rows: int, layout: Layout, first: int = 0) -> None:
        n = int(max(1, min(-(-rows // layout.cell_rows), len(sample) // 8)))
        self.centres = self._fitted(sample, n)
        weight = np.bincount(self.nearest(sample), minlength=n) + 0.01
        self.groups = int(min(max(layout.groups, -(-rows // layout.group_rows)), n))
        self.group = np.empty(n, np.int32)
        self._halve(np.arange(n), weight, self.groups, 0)
        a, b, power = layout.probes
        self.probes = min(int(np.ceil(a + b * n**power)), n)
        self.first = first
        self.tasks = self.groups * (self.groups + 1) // 2

    def task(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of the task for two groups: first those of one group alone, which are the largest, so that they are dealt out evenly."""
        low, high = np.minimum(g, h), np.maximum(g, h)
        return self.first + np.where(g == h, g, self.groups + high * (high - 1) // 2 + low)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.argmax(x[a : a + 4096] @ self.centres.T, 1) for a in range(0, len(x), 4096)] or [np.empty(0, int)])

    def met(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: its cell, the cosine of the last cell that it probes, and (row, group) of the groups that its probes lie in, its own among them."""
        cell, last, seen = np.empty(len(x), np.int32), np.empty(len(x), np.float32), []
        for s in range(0, len(x), 4096):
            sims = x[s : s + 4096] @ self.centres.T
            near = np.argpartition(-sims, self.probes - 1, axis=1)[:, : self.probes]
            rows = np.arange(len(sims))
            cell[s : s + 4096] = sims.argmax(1)
            last[s : s + 4096] = sims[rows[:, None], near].min(1)
            into = np.zeros((len(sims), self.groups), bool)
            into[rows[:, None], self.group[near]] = True
            r, g = np.nonzero(into)
            seen.append(np.stack([r + s, g], 1))
        return cell, last, np.concatenate(seen)

    def _fitted(self, sample: np.ndarray, n: int) -> np.ndarray:
        rng = np.random.default_rng(0)
        self.centres = sample[rng.permutation(len(sample))[:n]].copy()
        for _ in range(6 if n > 1 else 1):
            total = np.zeros_like(self.centres)
            np.add.at(total, self.nearest(sample), sample)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            self.centres = np.where(size > 1e-6, total / np.maximum(size, 1e-6), self.centres).astype(np.float32)
        return self.centres

    def _halve(self, cells: np.ndarray, weight: np.ndarray, groups: int, first: int) -> None:
        """Gives neighbouring cells to one group, groups being about equally heavy: cuts along the widest direction."""
        if groups == 1:
            self.group[cells] = first
            return
        x = self.centres[cells] - self.centres[cells].mean(0)
        axis = np.linalg.svd(x[:: max(1, len(x) // 2000)], full_matrices=False)[2][0]
        order = cells[np.argsort(x @ axis, kind="stable")]
        left = groups // 2
        share = np.cumsum(weight[order]) / weight[order].sum()
        at = int(np.clip(np.searchsorted(share, left / groups), left, len(order) - (groups - left)))
        self._halve(order[:at], weight, left, first)
        self._halve(order[at:], weight, groups - left, first + left)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's int8 code and scale, and 16 bits for each number to tell it from its code, as exactly as a float would."""
    scale = np.maximum(np.abs(x).max(1), 1e-30).astype(np.float32) / 127
    exact = x / scale[:, None]
    code = np.rint(exact)
    return code.astype(np.int8), np.rint((exact - code) * 65534).astype(np.int16), scale.astype(np.float32)


class _Heaps:
    """The k best partners of each row seen so far, at ``least`` or more."""

    def __init__(self, rows: int, k: int, least: float) -> None:
        self.k, self.rows, self.floor = k, rows, least
        self.sim = np.full((rows, k), least, np.float32)
        self.who = np.full((rows, k), -1, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    @property
    def least(self) -> np.ndarray:
        return self.sim[:, -1]

    def push(self, row: np.ndarray, who: np.ndarray, sim: np.ndarray) -> None:
        good = sim >= self.sim[row, -1]
        self.held.append((row[good], who[good], sim[good]))
        self.count += int(good.sum())
        if self.count > 400_000:
            self.merge()

    def merge(self) -> None:
        if not self.count:
            return
        row, who, sim = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.count = [], 0
        touched = np.unique(row)
        old = self.who[touched] >= 0
        row = np.concatenate([row, np.repeat(touched, old.sum(1))])
        who, sim = np.concatenate([who, self.who[touched][old]]), np.concatenate([sim, self.sim[touched][old]])
        _, once = np.unique(row * self.rows + who, return_index=True)  # two rows that probe each other's cells meet twice
        row, who, sim = row[once], who[once], sim[once]
        order = np.lexsort((who, -sim, row))
        row, who, sim = row[order], who[order], sim[order]
        start = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        kept = place < self.k
        self.who[touched] = -1
        self.sim[touched] = self.floor
        self.sim[row[kept], place[kept]] = sim[kept]
        self.who[row[kept], place[kept]] = who[kept]


def _search(code: np.ndarray, fine: np.ndarray, scale: np.ndarray, cell: np.ndarray, last: np.ndarray, cells: Cells, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The k best of all rows for each row, as row numbers (-1: none) and cosines, at ``least`` or more.

    Tile by tile: the rows that probe a cell, against the cell; each pair counts for both its rows. The
    product of the int8 codes is the cosine but for what the codes leave out, of
    which the lengths are known; a pair survives if, with that in its favour, it could
    still be among the best of one of its rows, and is then computed in float. (The codes are held
    as floats, in which their products are exact and much faster.) Of two groups, rows meet the cells of the other group.
    """
    rough = code * scale[:, None]
    exact = rough + fine * (scale * np.float32(1 / 65534))[:, None]
    rest = np.linalg.norm(exact - rough, axis=1)
    heaps = _Heaps(len(code), k, least)
    order = np.argsort(cell, kind="stable")
    present, starts = np.unique(cell[order], return_index=True)
    stops = np.append(starts[1:], len(order))
    group = cells.group[cell]
    alone = len(np.unique(group)) == 1
    probed = np.empty((len(code), len(present)), bool)
    for s in range(0, len(code), 4096):
        if len(cells.centres) == 1:
            probed[s : s + 4096] = True
            continue
        sims = exact[s : s + 4096] @ cells.centres[present].T
        probed[s : s + 4096] = (sims >= last[s : s + 4096, None] - 1e-5) | (present[None] == cell[s : s + 4096, None])
    if not alone:
        probed &= group[:, None] != cells.group[present][None]
    for c in np.argsort(-(stops - starts), kind="stable"):
        cols, all_rows = order[starts[c] : stops[c]], np.flatnonzero(probed[:, c])
        # The cell's own rows first: they make the bars high early.
        all_rows = all_rows[np.argsort(cell[all_rows] != present[c], kind="stable")]
        for t in range(0, len(cols), 2048):
            j_of = cols[t : t + 2048]
            b, b_rest = rough[j_of], rest[j_of]
            for s in range(0, len(all_rows), 2048):
                i_of = all_rows[s : s + 2048]
                tile = rough[i_of] @ b.T
                a_rest = rest[i_of]
                a_slack = a_rest + b_rest.max() * (1 + a_rest) + 1e-5
                b_slack = b_rest + a_rest.max() * (1 + b_rest) + 1e-5
                a_bar, b_bar = heaps.least[i_of] - a_slack, heaps.least[j_of] - b_slack
                close = (tile >= a_bar[:, None]) | (tile >= b_bar[None])
                if np.count_nonzero(close) > 2 * k * sum(tile.shape):  # the tile itself gives better bars
                    a_bar, b_bar = _raised(tile, a_bar, k, 2 * a_slack), _raised(tile.T, b_bar, k, 2 * b_slack)
                    close = (tile >= a_bar[:, None]) | (tile >= b_bar[None])
                i, j = np.nonzero(close)
                if not len(i):
                    continue
                i, j = i_of[i], j_of[j]
                other = i != j
                i, j = i[other], j[other]
                sim = np.einsum("ij,ij->i", exact[i], exact[j])
                heaps.push(i, j, sim)
                heaps.push(j, i, sim)
        heaps.merge()
    return heaps.who, heaps.sim


def _raised(tile: np.ndarray, bar: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Bars raised to what a row's k best of the tile itself allow; found only for rows that need it."""
    if k < tile.shape[1]:
        loose = np.flatnonzero((tile >= bar[:, None]).sum(1) > 3 * k)
        if len(loose):
            kth = -np.partition(-tile[loose], k, axis=1)[:, k]  # k + 1 of them, as a row may meet itself
            bar = bar.copy()
            bar[loose] = np.maximum(bar[loose], kth - slack[loose])
    return bar


def _copies(vectors: DataFrame) -> DataFrame:
    """One row per id: ``kind, id, v1, v2``; two hashes stand for the vector (the smaller of several)."""
    return (
        vectors.select("kind", "id", F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2"))
        .groupBy("kind", "id")
        .agg(F.min(F.struct("v1", "v2")).alias("v"))
        .select("kind", "id", "v.v1", "v.v2")
    )


def most_similar_vectors(vectors: DataFrame, k: int = 10, layout: Layout = Layout(), least: float | None = None) -> DataFrame:
    """Distinct vectors with the k most similar distinct vectors of their kind: ``kind, v1, v2, near`` (array of ``v1, v2, sim``, best first).

    ``vectors``: ``kind`` (what is compared with each other, with vectors of one
    length), ``id``, ``vector`` (usable). Copies are collapsed before anything is compared,
    so that many of them cost no more than one. The vectors of a kind are laid
    out in cells about centres fitted on a bounded sample; neighbouring cells form groups of
    about one size. A task gets two groups, of each the vectors that probe a cell of the other: so a
    vector is sent to as many tasks as its probes lie in groups, and no task holds more than two groups.
    Each task finds the best partners of its vectors, which are then merged by vector. With ``least``, less similar ones are
    left out from the start. A vector without partners has no row. Work per vector: probes times ``cell_rows`` products. Recall is
    measured against brute force in the tests.
    """
    spark = vectors.sparkSession
    vectors = vectors.where("kind IS NOT NULL AND vector IS NOT NULL")
    hashed = vectors.select("kind", F.xxhash64("vector").alias("v1"), F.xxhash64(F.lit(1), "vector").alias("v2"), "vector")
    reps = hashed.groupBy("kind", "v1", "v2").agg(F.first("vector").alias("vector"))
    sizes = {r.kind: r.n for r in vectors.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()}
    total = sum(sizes.values())
    if not total:
        return spark.createDataFrame([], "kind string, v1 bigint, v2 bigint, near array<struct<v1:bigint,v2:bigint,sim:float>>")
    # A bounded sample, by hash: half of it to the kinds in proportion, half evenly.
    wanted = {kind: layout.sample / 2 * (1 / len(sizes) + n / total) / n for kind, n in sizes.items()}
    # A row a kind, as in the driver.
    shares = spark.createDataFrame([(kind, int(min(1.0, p) * 1_000_003) + 1) for kind, p in wanted.items()], "kind string, below int")
    sample = hashed.join(F.broadcast(shares), "kind").where(F.pmod("v1", F.lit(1_000_003)) < F.col("below"))
    sample = sample.groupBy("kind", "v1", "v2").agg(F.first("vector").alias("vector")).orderBy("kind", "v1", "v2").select("kind", "vector").toPandas()
    layouts: dict[str, Cells] = {}
    first = 0
    for kind, n in sizes.items():
        x = sample.vector[sample.kind == kind]
        x = _unit(np.stack(x.to_numpy()).astype(np.float64)) if len(x) else np.zeros((1, 1), np.float32)
        layouts[kind] = Cells(x, n, layout, first)
        first += layouts[kind].tasks
    shared = spark.sparkContext.broadcast(layouts)
    floor = -2.0 if least is None else float(np.float32(least) - np.float32(1e-5))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs the vectors of a batch by task."""
        for b in batches:
            rows = []
            for kind, part in b.groupby("kind", sort=False):
                cells = shared.value[kind]
                x = _unit(np.stack(part.vector.to_numpy()).astype(np.float64))
                if cells.centres.shape[1] != x.shape[1]:  # a kind that the sample missed
                    cell, last, into = np.zeros(len(x), np.int32), np.zeros(len(x), np.float32), np.stack([np.arange(len(x)), np.zeros(len(x), int)], 1)
                else:
                    cell, last, into = cells.met(x)
                packed = (np.stack([part.v1.to_numpy(), part.v2.to_numpy()], 1), cell, last, *_coded(x))
                task = cells.task(cells.group[cell[into[:, 0]]], into[:, 1])
                order = np.argsort(task, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(task[order])) + 1):
                    who = into[at, 0]
                    rows.append((int(task[at[0]]), kind, len(at), *(v[who].tobytes() for v in packed)))
            yield pd.DataFrame(rows, columns=["task", "kind", "n", "ids", "cell", "last", "code", "fine", "scale"])

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Searches each task of a partition, which comes sorted by task, so that one is held at a time."""
        held: list[tuple] = []

        def found() -> Iterator[pd.DataFrame]:
            kind, n = held[0][1], sum(h[2] for h in held)
            ids, cell, last, code, fine, scale = (np.frombuffer(b"".join(h[i] for h in held), t) for i, t in enumerate((np.int64, np.int32, np.float32, np.int8, np.int16, np.float32), 3))
            held.clear()
            ids = ids.reshape(n, 2)
            who, sim = _search(code.reshape(n, -1), fine.reshape(n, -1), scale, cell, last, shared.value[kind], k, floor)
            row, place = np.nonzero(who >= 0)
            for s in range(0, len(row), 100_000):
                r, p = row[s : s + 100_000], place[s : s + 100_000]
                other = ids[who[r, p]]
                yield pd.DataFrame({"kind": kind, "v1": ids[r, 0], "v2": ids[r, 1], "w1": other[:, 0], "w2": other[:, 1], "sim": sim[r, p]})

        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    yield from found()
                held.append(row)
        if held:
            yield from found()

    tiles = reps.mapInPandas(dealt, "task int, kind string, n int, ids binary, cell binary, last binary, code binary, fine binary, scale binary")
    parts = min(first, max(4 * spark.sparkContext.defaultParallelism, 6 * total // layout.group_rows))
    tiles = tiles.repartitionById(parts, F.pmod("task", F.lit(parts))).sortWithinPartitions("task")
    pairs = tiles.mapInPandas(searched, "kind string, v1 bigint, v2 bigint, w1 bigint, w2 bigint, sim float")
    near = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "w1", "w2")))  # of each task k at most
    near = pairs.groupBy("kind", "v1", "v2").agg(F.slice(near, 1, k).alias("near"))
    return near.select("kind", "v1", "v2", F.transform("near", lambda x: F.struct(x["w1"].alias("v1"), x["w2"].alias("v2"), (-x["far"]).alias("sim"))).alias("near"))


def similar_ids(vectors: DataFrame, k: int = 10, least: float | None = None, layout: Layout = Layout()) -> DataFrame:
    """For every id, the k most similar other ids of its kind: ``kind, id, other, sim``; those below ``least`` left out.

    Of equal similarity the smaller id comes first; ids of one and the same vector
    are at 1. Rows repeated under one id are one vector. An id of which no other is there has no row. Rows with a null
    kind, id or vector take no part; vectors must be ``usable``.
    """
    vectors = vectors.where("kind IS NOT NULL AND id IS NOT NULL AND vector IS NOT NULL")
    ids = _copies(vectors)
    near = most_similar_vectors(vectors, k, layout, least)
    pairs = near.select("kind", "v1", "v2", F.explode("near").alias("n")).select(
        "kind", "v1", "v2", F.col("n.v1").alias("w1"), F.col("n.v2").alias("w2"), F.col("n.sim").cast("double").alias("sim")
    )
    if least is not None:
        pairs = pairs.where(F.col("sim") >= least)
    # The k + 1 smallest ids of a vector are all that anyone can have among its k best.
    from pyspark.sql import Window

    w = Window.partitionBy("kind", "v1", "v2").orderBy("id")
    head = ids.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1).drop("nth")
    others = head.select("kind", F.col("v1").alias("w1"), F.col("v2").alias("w2"), F.col("id").alias("other"))
    copies = head.groupBy("kind", "v1", "v2").agg(F.collect_list("id").alias("same")).where(F.size("same") > 1)
    of_others = pairs.join(others, ["kind", "w1", "w2"]).select("kind", "v1", "v2", "other", "sim")
    of_copies = copies.select("kind", "v1", "v2", F.explode("same").alias("other"), F.lit(1.0).alias("sim"))
    best = of_others.unionByName(of_copies).groupBy("kind", "v1", "v2").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k + 1).alias("best")
    )
    best = best.select(F.concat_ws("\0", "kind", "v1", "v2").alias("vector"), "best")
    every = ids.select("kind", "id", F.concat_ws("\0", "kind", "v1", "v2").alias("vector"))
    met = salted_left_join(every, best, "vector", F.col("id"), how="inner")
    own = F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, k)
    return met.select("kind", "id", F.explode(own).alias("b")).select("kind", "id", F.col("b.other").alias("other"), (-F.col("b.far")).alias("sim"))


def similar_pairs(vectors: DataFrame, k: int = 10, least: float = 0.95, layout: Layout = Layout()) -> DataFrame:
    """Pairs ``kind, id_a, id_b`` (the smaller id first) at ``least`` or more, of which one is among the k most similar of the other."""
    s = similar_ids(vectors, k, least, layout)
    return s.select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
