
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.temporal import freshness, freshness_rank
from marginalia.operators.batch_recall import best_of_each, bm25_scores, hybrid_of_each, nearest_of_each, text_scores
from marginalia.operators.recall import active_status, authority_boost, not_superseded
from marginalia.plans import Registry
from marginalia.plans.retrieval import _BOOST, _FRESH, _FRESH_RANK
from marginalia.plans.store import CLAIMS, _EFFECTIVE, at, claims, once
from marginalia.sources.tables import table

registry = Registry()
add = registry.add


def _eligible(c: DataFrame, spark, sf) -> DataFrame:
    gone = table(spark, sf, "source_configs").where(F.col("status") == "deleted").select("source_config_id")
    return not_superseded(c, at()).where(active_status(F.col("status"))).join(gone, "source_config_id", "left_anti")


def _titles(spark, sf) -> DataFrame:
    """The queries: the titles of the documents whose id is divisible by 50."""
    return table(spark, sf, "documents").where("doc_id % 50 = 0 AND title IS NOT NULL").groupBy(F.col("doc_id").alias("query_id")).agg(F.min("title").alias("query"))


_LIVE = f"""(SELECT * FROM ({_EFFECTIVE}) WHERE status IN ('verified', 'inferred')
    AND coalesce(source_config_id, '') NOT IN (SELECT source_config_id FROM source_configs WHERE status = 'deleted'))"""
#: The words of a text and of a query, and the score of one for the other, as joins over all of them.
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def _scores(texts: str, key: str, text: str, queries: str) -> str:
    return f"""terms AS (SELECT query_id, unnest(t) AS term, len(t) AS terms FROM (
        SELECT query_id, list_distinct_in_order[1:16] AS t FROM (SELECT query_id, list_transform(list_sort(list_transform(
          list_filter(range(1, len(w) + 1), lambda i: length(w[i]) >= 2 AND list_position(w, w[i]) = i), lambda i: i)), lambda i: w[i]) AS list_distinct_in_order
          FROM (SELECT query_id, {_WORDS.format('query')} AS w FROM {queries})))),
    counted AS (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest({_WORDS.format(text)}) AS term FROM {texts}) GROUP BY ALL),
    scores AS (SELECT query_id, {key}, least(greatest(CASE WHEN count(*) = max(terms) THEN 0.1 ELSE 0 END::DOUBLE, sum(n)::DOUBLE * 0.1::DOUBLE * 0.65::DOUBLE), 0.4::DOUBLE) AS text_score
      FROM counted JOIN terms USING (term) GROUP BY query_id, {key})"""


@add("h05_batch", f"""WITH asked AS (SELECT doc_id AS query_id, min(title) AS query FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL GROUP BY doc_id),
    live AS {_LIVE}, {_scores('live', 'claim_id', 'claim_text', 'asked')}
    SELECT query_id, claim_id, round(text_score, 6) AS text_score, round(rank_score, 6) AS rank_score, freshness, place FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_FRESH_RANK}, rank_score DESC, claim_id) AS place FROM (
        SELECT query_id, claim_id, text_score, text_score + confidence + {_BOOST} AS rank_score, {_FRESH} AS freshness FROM scores JOIN live USING (claim_id)))
    WHERE place <= 5""")  # fmt: skip
def h05_batch(spark, sf):
    """Recall for each document whose id is divisible by 50, by its title, against the claims of all scopes: one job, keyed by query."""
    q = _titles(spark, sf)
    c = _eligible(claims(spark, sf), spark, sf)
    s = text_scores(c, "claim_id", "claim_text", q)
    s = s.join(c.select("claim_id", "confidence", "authority", "updated_at", "expires_at"), "claim_id")
    s = s.withColumns({"rank_score": F.col("text_score") + F.col("confidence") + authority_boost(F.col("authority")), "freshness": freshness(at(), "updated_at")})
    top = best_of_each(s, 5, freshness_rank(F.col("freshness")), F.desc("rank_score"), F.col("claim_id"))
    return top.select("query_id", "claim_id", F.round("text_score", 6).alias("text_score"), F.round("rank_score", 6).alias("rank_score"), "freshness", "place")


_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@add("f03_batch", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {_USABLE}),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, greatest(0, list_cosine_similarity(q.v, e.v)) AS similarity FROM e q JOIN e ON len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, vec_id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")  # fmt: skip
def f03_batch(spark, sf):
    """The ten nearest of each vector whose id is divisible by 50, exactly, all in one scan a block of queries."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return nearest_of_each(e, "vec_id", "embedding", q, 10).select("query_id", "vec_id", F.round("vector_score", 6).alias("similarity"))


_HEX = "CAST(('0x' || right(claim_id, 6)) AS BIGINT)"


@add("h06_batch", f"""WITH vec AS (SELECT claim_id, min(embedding)::DOUBLE[] AS v FROM claims WHERE {_USABLE} AND len(embedding) = embedding_dimensions GROUP BY 1),
    live AS (SELECT l.*, v FROM {_LIVE} l LEFT JOIN vec USING (claim_id)),
    asked AS (SELECT claim_id AS query_id, claim_text AS query, v AS qv FROM live WHERE v IS NOT NULL AND {_HEX} % 50 = 0), {_scores('live', 'claim_id', 'claim_text', 'asked')},
    sims AS (SELECT query_id, claim_id, greatest(0, list_cosine_similarity(qv, v)) AS vector_score FROM asked JOIN live ON len(qv) = len(v)),
    pool AS (SELECT query_id, claim_id FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, claim_id) <= 15 UNION
             SELECT query_id, claim_id FROM sims WHERE vector_score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, claim_id) <= 15),
    ranks AS (SELECT query_id, claim_id, coalesce(text_score, 0) AS text_score, coalesce(vector_score, 0) AS vector_score, coalesce(text_score, 0) + 0.45::DOUBLE * coalesce(vector_score, 0) + (confidence + {_BOOST}) AS rank_score
             FROM pool LEFT JOIN scores USING (query_id, claim_id) LEFT JOIN sims USING (query_id, claim_id) JOIN live USING (claim_id))
    SELECT query_id, claim_id, round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score, round(rank_score, 6) AS rank_score
    FROM ranks QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rank_score, 9) DESC, claim_id) <= 5""")  # fmt: skip
def h06_batch(spark, sf):
    """Recall by text and vector for each claim whose id (its last six digits) is divisible by 50."""
    from marginalia.functions.vectors import usable_vector

    v = table(spark, sf, "claims").where(usable_vector(F.col("embedding")) & (F.size("embedding") == F.col("embedding_dimensions"))).groupBy("claim_id").agg(F.min("embedding").alias("v"))
    c = _eligible(once(spark, sf, "claims", "claim_id", *CLAIMS), spark, sf).join(v, "claim_id", "left")
    chosen = F.conv(F.right("claim_id", F.lit(6)), 16, 10).cast("bigint") % 50 == 0
    q = c.where(F.col("v").isNotNull() & chosen).select(F.col("claim_id").alias("query_id"), F.col("claim_text").alias("query"), F.col("v").alias("vector"))
    out = hybrid_of_each(c, "claim_id", "claim_text", "v", q, 5, F.col("confidence") + authority_boost(F.col("authority")))
    return out.select("query_id", "claim_id", *[F.round(s, 6).alias(s) for s in ("text_score", "vector_score", "rank_score")])


_ASKED = "asked AS (SELECT doc_id AS query_id, min(title) AS query FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL GROUP BY doc_id)"
_BM25 = """bm AS (SELECT query_id, claim_id, sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / mean_size))) AS bm25
      FROM counted JOIN (SELECT term, count(*)::DOUBLE AS df FROM counted GROUP BY 1) USING (term) JOIN terms USING (term) JOIN sizes USING (claim_id), (SELECT count(*)::DOUBLE AS nn, avg(size) AS mean_size FROM sizes) GROUP BY ALL)"""


@add("h03_bm25", f"""WITH {_ASKED}, live AS {_LIVE}, {_scores('live', 'claim_id', 'claim_text', 'asked')}, sizes AS (SELECT claim_id, coalesce(len({_WORDS.format('claim_text')}), 0)::DOUBLE AS size FROM live), {_BM25}
    SELECT query_id, claim_id, round(bm25, 6) AS bm25 FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, claim_id) <= 5""")  # fmt: skip
def h03_bm25(spark, sf):
    """The same queries as ``h05_batch``, ranked by BM25."""
    c = _eligible(claims(spark, sf), spark, sf)
    s = bm25_scores(c, "claim_id", "claim_text", _titles(spark, sf)).withColumn("r", F.round("bm25", 9))
    return best_of_each(s, 5, F.desc("r"), F.col("claim_id")).select("query_id", "claim_id", F.round("bm25", 6).alias("bm25"))


@add("h03_agreement", f"""WITH {_ASKED}, live AS {_LIVE}, {_scores('live', 'claim_id', 'claim_text', 'asked')}, sizes AS (SELECT claim_id, coalesce(len({_WORDS.format('claim_text')}), 0)::DOUBLE AS size FROM live), {_BM25},
    r AS (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC) AS a, rank() OVER (PARTITION BY query_id ORDER BY round(text_score, 9) DESC) AS b FROM bm JOIN scores USING (query_id, claim_id))
    SELECT query_id, count(*) AS texts, round(corr(a, b), 6) AS correlation FROM r GROUP BY 1 HAVING count(DISTINCT a) > 1 AND count(DISTINCT b) > 1""")  # fmt: skip
def h03_agreement(spark, sf):
    """How far the store's own rank of texts agrees with BM25, by query: the correlation of ranks. Ranks of a query come from counts of its scores, of which there are few."""
    c = _eligible(claims(spark, sf), spark, sf)
    q = _titles(spark, sf)
    s = bm25_scores(c, "claim_id", "claim_text", q).join(text_scores(c, "claim_id", "claim_text", q), ["query_id", "claim_id"])
    s = s.select("query_id", F.round("bm25", 9).alias("a"), F.round("text_score", 9).alias("b")).groupBy("query_id", "a", "b").agg(F.count("*").alias("n"))

    def ranks(col: str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc(col)).rowsBetween(Window.unboundedPreceding, -1)
        return s.groupBy("query_id", col).agg(F.sum("n").alias("m")).select("query_id", col, (F.coalesce(F.sum("m").over(w), F.lit(0)) + 1).alias(f"rank_{col}"))

    r = s.join(ranks("a"), ["query_id", "a"]).join(ranks("b"), ["query_id", "b"])
    x, y, n = F.col("rank_a"), F.col("rank_b"), F.col("n")
    g = r.groupBy("query_id").agg(
        F.sum("n").alias("texts"), *[F.sum((e * n).cast("double")).alias(k) for k, e in {"x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}.items()], F.count_distinct("a").alias("as"), F.count_distinct("b").alias("bs")
    ).where("`as` > 1 AND bs > 1")
    c = F.expr("(texts * xy - x * y) / (sqrt(texts * xx - x * x) * sqrt(texts * yy - y * y))")
    return g.select("query_id", "texts", F.round(c, 6).alias("correlation"))
