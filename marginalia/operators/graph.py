"""Search along the edges of a graph, two steps at most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among ``nodes`` (column ``node``): two semi-joins, as an OR could not be joined by hash."""
    a = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    b = edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return a.unionByName(b).dropDuplicates(["edge_id"])


def related(nodes: DataFrame, edges: DataFrame, q: str, seeds: int = 12, near: int = 16, far: int = 20, limit: int = 5) -> DataFrame:
    """Edges about a name: those of the nodes whose name holds ``q`` (distance 1, score 1), and those of their neighbours (2, 0.65).

    Columns ``edge_id, src, type, dst, confidence, distance, score``. Each step
    is cut to its best by confidence, then id: the seeds, the near and the far edges, the result.
    """
    top = lambda e, n: e.orderBy(F.desc("confidence"), "edge_id").limit(n)
    # The seeds and the front are bounded by the cuts, so their ids become filters: one scan of the edges a step, no join.
    hit = [r.node for r in nodes.where(F.lower("name").contains(q.lower())).orderBy(F.desc("confidence"), "node").limit(seeds).select("node").collect()]
    first = top(edges.where(F.col("src").isin(hit) | F.col("dst").isin(hit)), near)
    front = sorted({n for r in first.select("src", "dst").collect() for n in r})
    second = top(edges.where(F.col("src").isin(front) | F.col("dst").isin(front)), far)
    both = first.withColumns({"distance": F.lit(1), "score": F.lit(1.0)}).unionByName(second.withColumns({"distance": F.lit(2), "score": F.lit(0.65)}))
    best = both.groupBy("edge_id", "src", "type", "dst", "confidence").agg(F.min("distance").alias("distance"), F.max("score").alias("score"))
    return best.orderBy("distance", F.desc(F.col("confidence") * F.col("score")), "edge_id").limit(limit)


def catalogue(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The warehouse tables as a graph: nations part_of regions, suppliers located_in nations, suppliers supplies parts."""
    parts = {
        "region": ("r_regionkey", F.col("r_name")),
        "nation": ("n_nationkey", F.col("n_name")),
        "supplier": ("s_suppkey", F.col("s_name")),
        "part": ("p_partkey", F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"))),
    }
    node = lambda kind, key: F.concat(F.lit(kind + "-"), F.col(key).cast("string"))
    nodes = reduce(DataFrame.unionByName, [
        t[k].select(node(k, key).alias("node"), name.alias("name"), F.lit(k).alias("type"), (F.lit(0.5) + 0.05 * F.least(F.lit(5), F.col(key) % 6)).alias("confidence"))
        for k, (key, name) in parts.items()
    ])
    supplies = t["lineitem"].groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    edge = lambda df, s, kind, d, c: df.select(s.alias("src"), F.lit(kind).alias("type"), d.alias("dst"), c.alias("confidence"))
    edges = reduce(DataFrame.unionByName, [
        edge(t["nation"], node("nation", "n_nationkey"), "part_of", node("region", "n_regionkey"), F.lit(0.9)),
        edge(t["supplier"], node("supplier", "s_suppkey"), "located_in", node("nation", "s_nationkey"), F.lit(0.8)),
        edge(supplies, node("supplier", "l_suppkey"), "supplies", node("part", "l_partkey"), F.least(F.lit(1.0), 0.5 + 0.05 * F.col("n"))),
    ])
    return nodes, edges.withColumn("edge_id", F.concat_ws(">", "src", "type", "dst"))
