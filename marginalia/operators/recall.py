"""Recall of claims and chunks by text, by vector and by both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.temporal import freshness, freshness_rank, policy_seconds, schedule_seconds, valid_at
from marginalia.functions.text import text_score
from marginalia.functions.vectors import cosine_to
from marginalia.sources.tables import micros

# What an authority adds to a rank.
AUTHORITY = {"official-doc": 0.25, "adr": 0.2, "team-convention": 0.15, "jira-resolved": 0.1}


def authority_boost(c: Column) -> Column:
    out = F.lit(0.0)
    for k, v in AUTHORITY.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def pool(limit: int) -> int:
    """How many candidates each branch of a recall brings."""
    return max(3 * limit, 12)


def active_status(status: Column, unverified: bool = False) -> Column:
    return ~status.isin("deprecated", "expired") if unverified else status.isin("verified", "inferred")


def not_superseded(claims: DataFrame, at: Column, unverified: bool = False) -> DataFrame:
    """Claims that hold at an instant and have no superseder of their scope that holds and counts as well."""
    live = claims.where(valid_at(at))
    by = live.where(active_status(F.col("status"), unverified)).select(F.col("supersedes_claim_id").alias("_old"), F.col("scope").alias("_scope"), F.col("claim_id").alias("_new")).where("_old is not null")
    cond = (F.col("claim_id") == F.col("_old")) & (F.col("scope") == F.col("_scope")) & (F.col("claim_id") != F.col("_new"))
    return live.join(by, cond, "left_anti")


def refresh_due(at: Column, since: Column) -> Column:
    """Whether a source with ``freshness_policy`` and ``schedule_cron``, last read at ``since``, should have been read again."""
    age = (micros(at) - micros(since)) / 1_000_000
    return (F.col("status") == "active") & F.coalesce(
        (age > policy_seconds(F.col("freshness_policy"))) | (age > schedule_seconds(F.col("schedule_cron"))), F.lit(False)
    )


def eligible(claims: DataFrame, sources: DataFrame, at: Column, scope: str, unverified: bool = False) -> DataFrame:
    """Claims of a scope that may be recalled; those of deleted sources may not."""
    gone = sources.where(F.col("status") == "deleted").select("source_config_id")
    c = claims.where(F.col("scope") == scope)
    return not_superseded(c, at, unverified).where(active_status(F.col("status"), unverified)).join(gone, "source_config_id", "left_anti")


def ranked(df: DataFrame, at: Column, limit: int) -> DataFrame:
    """Freshest first, then by rank, then the last updated, then by id; one top-k, without a full sort."""
    d = df.withColumn("freshness", freshness(at, "updated_at"))
    return d.orderBy(freshness_rank(F.col("freshness")), F.desc("rank_score"), F.desc("updated_at"), "claim_id").limit(limit)


def recall_text(claims: DataFrame, sources: DataFrame, q: str, scope: str, at: Column, limit: int = 5, unverified: bool = False) -> DataFrame:
    """Claims that meet any word of a query: ``claim_id, text_score, rank_score, freshness``."""
    c = eligible(claims, sources, at, scope, unverified).withColumn("text_score", text_score(F.col("claim_text"), q)).where("text_score > 0")
    c = c.withColumn("rank_score", F.col("text_score") + F.col("confidence") + authority_boost(F.col("authority")))
    return ranked(c, at, limit).select("claim_id", "text_score", "rank_score", "freshness")


def recall_hybrid(claims: DataFrame, sources: DataFrame, q: str, vector: list[float], scope: str, at: Column, limit: int = 5) -> DataFrame:
    """The best by text and the best by vector together, ranked by both: ``claim_id, text_score, vector_score, rank_score, freshness``."""
    c = eligible(claims, sources, at, scope).withColumns({
        "text_score": text_score(F.col("claim_text"), q),
        "vector_score": F.coalesce(cosine_to(F.col("embedding"), vector), F.lit(0.0)),
    })
    c = c.select("claim_id", "text_score", "vector_score", "confidence", "authority", "updated_at", "expires_at")
    by_text = c.where("text_score > 0").orderBy(F.desc("text_score"), "claim_id").limit(pool(limit))
    by_vector = c.where("vector_score > 0").orderBy(F.desc("vector_score"), "claim_id").limit(pool(limit))
    both = by_text.union(by_vector).dropDuplicates(["claim_id"])
    both = both.withColumn("rank_score", F.col("text_score") + 0.45 * F.col("vector_score") + F.col("confidence") + authority_boost(F.col("authority")))
    return ranked(both, at, limit).select("claim_id", "text_score", "vector_score", "rank_score", "freshness")


def recall_chunks(chunks: DataFrame, documents: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """The chunks that meet a query best, with their documents: ``chunk_id, document_id, title, text_score``. Chunks may bring their score instead of their content."""
    c = chunks if "text_score" in chunks.columns else chunks.withColumn("text_score", text_score(F.col("content"), q))
    c = c.where("text_score > 0")
    live = documents.where("status <> 'deleted'").select("document_id", "title", "ingested_at")
    d = c.select("chunk_id", "document_id", "chunk_index", "text_score").join(live, "document_id")
    return d.orderBy(F.desc("text_score"), F.desc("ingested_at"), "chunk_index", "chunk_id").limit(limit).select("chunk_id", "document_id", "title", "text_score")


def recall_chunks_hybrid(chunks: DataFrame, documents: DataFrame, q: str, vector: list[float], limit: int = 5) -> DataFrame:
    """Chunks of live documents, the best by text and the best by vector together: ``chunk_id, document_id, text_score, vector_score, rank_score``.

    Both branches are cut to their pools before they meet the documents' order; a
    chunk without a usable vector has the vector score 0.
    """
    c = chunks.withColumns({"text_score": text_score(F.col("content"), q), "vector_score": F.coalesce(cosine_to(F.col("embedding"), vector), F.lit(0.0))})
    c = c.where("text_score > 0 or vector_score > 0").select("chunk_id", "document_id", "chunk_index", "text_score", "vector_score")
    c = c.join(documents.where("status <> 'deleted'").select("document_id", "ingested_at"), "document_id")
    best = lambda s: c.where(F.col(s) > 0).orderBy(F.desc(s), "chunk_id").limit(pool(limit))
    both = best("text_score").union(best("vector_score")).dropDuplicates(["chunk_id"])
    both = both.withColumn("rank_score", F.col("text_score") + 0.45 * F.col("vector_score"))
    top = both.orderBy(F.desc("rank_score"), F.desc("ingested_at"), "chunk_index", "chunk_id").limit(limit)
    return top.select("chunk_id", "document_id", "text_score", "vector_score", "rank_score")


def best_of(results: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """Of one row in several queries' results, the fresher, then the higher ranked."""
    w = Window.partitionBy(key).orderBy(freshness_rank(F.col("freshness")), F.desc("rank_score"), query)
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
