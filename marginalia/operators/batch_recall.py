"""Recall for many queries at once, keyed by the query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import tokens
from marginalia.operators.recall import pool

#: Queries whose words or vectors are sent to all executors at once; more are joined by a shuffle, or taken in blocks.
BLOCK = 1024


def query_terms(queries: DataFrame, query_id: str, text: str, most: int = 16) -> DataFrame:
    """The distinct words of two letters or more of each query, the first ``most`` of them: ``query_id, term, terms`` (how many the query has)."""
    t = F.slice(F.filter(F.array_distinct(tokens(F.col(text))), lambda x: F.length(x) >= 2), 1, most)
    return queries.select(F.col(query_id).alias("query_id"), t.alias("t")).select("query_id", F.explode("t").alias("term"), F.size("t").alias("terms"))


def text_scores(texts: DataFrame, key: str, text: str, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The score of each text that meets any word of a query: ``query_id, key, text_score``, as ``functions.text.text_score`` gives for one query.

    Texts are read once for all queries: their words are counted, those that no query has are dropped, and the rest
    meet the queries by word. The words of up to ``BLOCK`` queries (16 each at most) are broadcast; more are joined by a
    shuffle. Queries and texts that are null or without words have no row. Ids of either side must be unique.
    """
    terms = query_terms(queries, query_id, query)
    few = queries.limit(BLOCK + 1).count() <= BLOCK
    words = texts.select(F.col(key).alias("key"), F.explode(tokens(F.col(text))).alias("term"))
    words = words.join(F.broadcast(terms.select("term").distinct()) if few else terms.select("term").distinct(), "term", "left_semi")
    counted = words.groupBy("key", "term").agg(F.count("*").alias("n"))
    met = counted.join(F.broadcast(terms) if few else terms, "term").groupBy("query_id", "key").agg(
        F.sum("n").alias("hits"), F.count("*").alias("found"), F.max("terms").alias("terms")
    )
    every = F.when(F.col("found") == F.col("terms"), 0.1).otherwise(0.0)
    score = F.least(F.greatest(every, F.col("hits") * F.lit(0.1) * F.lit(0.65)), F.lit(0.4))
    return met.select("query_id", F.col("key").alias(key), score.alias("text_score"))


def best_of_each(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query by ``order``, with their ``place``; cut to ``k`` before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest_of_each(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "vector", block: int = BLOCK) -> DataFrame:
    """For each query vector the ``k`` rows of greatest cosine, exactly: ``query_id, key, vector_score`` (at least 0).

    Queries are taken in blocks of about ``block``, by hash of their id. Of a block the vectors go to every
    executor, and each batch of rows is multiplied with all of them at once; a task keeps ``k`` rows a
    query. So the rows are read once a block, never compared by a join. Vectors that are null, all zero, not finite or of
    another length than the query's have no row; of equal cosine the smaller key comes first. Keys must be unique.
    """
    spark = vectors.sparkSession
    q = queries.where(F.col(query_id).isNotNull() & F.col(query).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query).alias("vector"))
    blocks = max(1, -(-q.count() // block))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, vector_score double"
    out = None
    for n in range(blocks):
        part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        by_size: dict[int, tuple[list, list]] = {}
        for r in part.collect():  # a block
            x = np.array([np.nan if v is None else v for v in r.vector], float)
            if len(x) and np.isfinite(x).all() and x.any():
                ids, xs = by_size.setdefault(len(x), ([], []))
                ids.append(r.query_id)
                xs.append(x / np.linalg.norm(x))
        sent = spark.sparkContext.broadcast({d: (ids, np.stack(xs)) for d, (ids, xs) in by_size.items()})

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for b in batches:
                size = b.vector.map(len)
                for d, (_, qs) in sent.value.items():
                    part = b[size == d]
                    if not len(part):
                        continue
                    x = np.stack(part.vector.to_numpy()).astype(float)
                    fine = np.isfinite(x).all(1) & x.any(1)
                    x, keys = x[fine], part.key.to_numpy(dtype=object)[fine]
                    sim = np.maximum(qs @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 0)
                    keys = np.broadcast_to(keys, sim.shape)
                    if d in best:
                        sim, keys = np.concatenate([best[d][0], sim], 1), np.concatenate([best[d][1], keys], 1)
                    # By key first, then stably by cosine: of equal ones the smaller key stays.
                    by_key = np.argsort(keys, axis=1, kind="stable")
                    sim, keys = np.take_along_axis(sim, by_key, 1), np.take_along_axis(keys, by_key, 1)
                    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
                    best[d] = np.take_along_axis(sim, top, 1), np.take_along_axis(keys, top, 1)
            for d, (sim, keys) in best.items():
                ids = np.repeat(np.array(sent.value[d][0], dtype=object), sim.shape[1])
                yield pd.DataFrame({"query_id": ids, "key": keys.ravel(), "vector_score": sim.ravel()})

        found = rows.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return best_of_each(out, k, F.desc("vector_score"), F.col("key")).select("query_id", F.col("key").alias(key), "vector_score")


def hybrid_of_each(claims: DataFrame, key: str, text: str, vector: str, queries: DataFrame, limit: int, base: Column) -> DataFrame:
    """Recall by text and vector together for each of many queries ``query_id, query, vector``: ``query_id, key, text_score, vector_score, rank_score``.

    Each query's best by text and best by vector form its pool; a row of the pool that one side did not bring gets that
    side's score all the same. Ranked by both and by ``base`` (of the claims), then by key.
    """
    most = pool(limit)
    by_text = text_scores(claims, key, text, queries)
    by_vector = nearest_of_each(claims, key, vector, queries, most).where("vector_score > 0")
    in_pool = best_of_each(by_text, most, F.desc("text_score"), F.col(key)).select("query_id", key).union(by_vector.select("query_id", key)).distinct()
    own = claims.select(F.col(key), F.col(vector).alias("_v"), base.alias("_base"))
    asked = queries.select("query_id", F.col("vector").alias("_q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = F.when(F.size("_v") == F.size("_q"), F.try_divide(dot("_v", "_q"), F.sqrt(dot("_v", "_v")) * F.sqrt(dot("_q", "_q"))))
    p = in_pool.join(own, key).join(asked, "query_id").join(by_text, ["query_id", key], "left")
    p = p.select("query_id", key, F.coalesce("text_score", F.lit(0.0)).alias("text_score"), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0))).alias("vector_score"), "_base")
    p = p.withColumn("rank_score", F.col("text_score") + 0.45 * F.col("vector_score") + F.col("_base")).drop("_base")
    return best_of_each(p, limit, F.desc("rank_score"), F.col(key)).drop("place")


def bm25_scores(texts: DataFrame, key: str, text: str, queries: DataFrame, query_id: str = "query_id", query: str = "query", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 of each text for each query of which it has a word: ``query_id, key, bm25``.

    Lengths and frequencies are counted over all texts: the counts of words are added up where they lie, only those of the queries'
    words are kept. A word weighs ``ln(1 + (N - n + 0.5) / (n + 0.5))``. Null texts count as empty ones. Ids of either side must be unique.
    """
    terms = query_terms(queries, query_id, query)
    few = queries.limit(BLOCK + 1).count() <= BLOCK
    asked = terms.select("term").distinct()
    sized = texts.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w"), F.size(tokens(F.col(text))).alias("size"))
    whole = sized.agg(F.count("*").alias("all_texts"), F.avg("size").alias("mean_size"))  # one row
    words = sized.select("key", "size", F.explode("w").alias("term")).join(F.broadcast(asked) if few else asked, "term", "left_semi")
    counted = words.groupBy("key", "term").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    held = counted.groupBy("term").agg(F.count("*").alias("texts"))
    weight = F.log(1 + (F.col("all_texts") - F.col("texts") + 0.5) / (F.col("texts") + 0.5))
    weighed = terms.join(held, "term").join(F.broadcast(whole)).select("query_id", "term", weight.alias("weight"), "mean_size")
    met = counted.join(F.broadcast(weighed) if few else weighed, "term")
    part = F.col("weight") * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    return met.groupBy("query_id", "key").agg(F.sum(part).alias("bm25")).withColumnRenamed("key", key)
