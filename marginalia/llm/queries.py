"""Queries of the problems on texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.canonical import canonical_counts, canonical_groups
from marginalia.llm.leak import MIN_WORDS, leaked_passages, without_leaks
from marginalia.llm.mixing import fitted_rates, membership, mixed, reached_shares
from marginalia.llm.neighbours import similar_ids, similar_pairs, usable
from marginalia.llm.quality import COMMON, text_statistics, text_types
from marginalia.llm.splitting import split_items
from marginalia.operators.skew import spread
from marginalia.plans import Registry
from marginalia.sources.tables import table

registry = Registry()
add = registry.add


def _items(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "source_documents").select("document_id", "content")).select(F.lit("document").alias("item_kind"), F.col("document_id").alias("item_id"), "content")
    return docs.unionByName(table(spark, sf, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "content"))


_BIG = """(SELECT 'document' AS item_kind, document_id AS item_id, content FROM source_documents
    UNION ALL SELECT 'chunk', chunk_id, content FROM chunks) WHERE octet_length(encode(content)) > 1200"""


@add("p3_found", f"""SELECT DISTINCT item_kind, item_id, CAST(list_max(list_transform(string_split_regex(content, '[ \\t\\r\\n]+'),
    lambda x: octet_length(encode(x)))) > 1200 AS BIGINT) AS unbroken FROM {_BIG}""")  # fmt: skip
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    run = F.max(F.col("longest_run"))
    return split_items(_items(spark, sf)).groupBy("item_kind", "item_id").agg((run > 1200).cast("bigint").alias("unbroken"))


@add("p3_pieces")
def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of all oversized items; repeated rows once, told by two hashes of their content."""
    i = _items(spark, sf).where(F.octet_length("content") > 1200)
    i = i.groupBy("item_kind", "item_id", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b")).agg(F.first("content").alias("content"))
    return split_items(i.select("item_kind", "item_id", "content"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name, kind, key in (("chunks", "chunk", "chunk_id"), ("claims", "claim", "claim_id")):
        v = table(spark, sf, name).where(usable(F.col("embedding"), F.col("embedding_dimensions")) & F.col(key).isNotNull())
        model = F.concat_ws("|", F.lit(kind), F.col("embedding_dimensions").cast("string"), F.coalesce("embedding_model", F.lit("")))
        v = v.select(model.alias("kind"), F.col(key).alias("id"), F.col("embedding").alias("vector"))
        out = v if out is None else out.unionByName(v)
    return out


def _collection() -> F.Column:
    return F.substring_index("kind", "|", 1).alias("collection")


_SIMILAR = """
    WITH v AS (
      SELECT DISTINCT ON (c, id) * FROM (
        SELECT 'chunk' AS c, chunk_id AS id, coalesce(embedding_model, '') AS m, embedding, embedding_dimensions AS d FROM chunks
        UNION ALL SELECT 'claim', claim_id, coalesce(embedding_model, ''), embedding, embedding_dimensions FROM claims)
      WHERE len(embedding) = d AND d > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (
      SELECT a.c, a.id, b.id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
      FROM v a JOIN v b ON a.c = b.c AND a.m = b.m AND a.d = b.d AND a.id <> b.id),
    near AS (SELECT *, row_number() OVER (PARTITION BY c, id ORDER BY sim DESC, other) AS nth FROM s WHERE sim >= 0.95)
"""


@add("p5_found", _SIMILAR + "SELECT DISTINCT c AS collection, least(id, other) AS id_a, greatest(id, other) AS id_b FROM near WHERE nth <= 10")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_pairs(_vectors(spark, sf), 10, 0.95).select(_collection(), "id_a", "id_b")


@add("p5_similar")
def p5_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar of every usable vector."""
    return similar_ids(_vectors(spark, sf), 10).select(_collection(), "id", "other", F.round("sim", 5).alias("similarity"))


_P6 = r"""
    WITH parts AS (
      SELECT claim_id, claim_text, scope,
             list_filter(string_split_regex(coalesce(claim_text, ''), '[;|\r\n]'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ps,
             list_filter(string_split_regex(coalesce(scope, ''), '[;|\r\n]'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ss
      FROM claims WHERE claim_id IS NOT NULL),
    canon AS (
      SELECT DISTINCT claim_id,
        CASE WHEN len(ps) >= 2 AND len(list_filter(ps, lambda x: NOT regexp_matches(x, '^\s*[^\s=:;|][^=:;|]*[=:][^;|]*$'))) = 0
             THEN ';' || array_to_string(list_sort(list_transform(ps, lambda x: array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ' '))), ';')
             ELSE array_to_string(regexp_extract_all(lower(coalesce(claim_text, '')), '[\p{L}\p{N}]+'), ' ') END AS t,
        CASE WHEN len(ss) >= 2 AND len(list_filter(ss, lambda x: NOT regexp_matches(x, '^\s*[^\s=:;|][^=:;|]*[=:][^;|]*$'))) = 0
             THEN ';' || array_to_string(list_sort(list_transform(ss, lambda x: array_to_string(regexp_extract_all(lower(x), '[\p{L}\p{N}]+'), ' '))), ';')
             ELSE array_to_string(regexp_extract_all(lower(coalesce(scope, '')), '[\p{L}\p{N}]+'), ' ') END AS s
      FROM parts),
    reps AS (SELECT *, min(claim_id) OVER (PARTITION BY t, s) AS rep FROM canon)
"""


@add("p6_found", _P6 + "SELECT DISTINCT rep AS claim_id, claim_id AS copy_claim_id FROM reps WHERE rep <> claim_id")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    g = canonical_groups(table(spark, sf, "claims"), "claim_id", ["claim_text", "scope"])
    return g.where("rep <> id").select(F.col("rep").alias("claim_id"), F.col("id").alias("copy_claim_id"))


@add("p6_counts", _P6 + "SELECT rep AS claim_id, count(DISTINCT claim_id) AS copies FROM reps GROUP BY rep")
def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct record with the number of claim ids it stands for."""
    return canonical_counts(table(spark, sf, "claims"), "claim_id", ["claim_text", "scope"]).withColumnRenamed("rep", "claim_id")


_LEAK = r"""
    WITH grams AS (
      SELECT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (
        SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items))),
    texts AS (
      SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)))
"""


def _leaks(f, spark: SparkSession, sf: str) -> DataFrame:
    return f(spread(table(spark, sf, "documents").select("doc_id", "text")), table(spark, sf, "eval_items"))


@add("p7_found", _LEAK + "SELECT DISTINCT doc_id, item_id FROM texts JOIN grams USING (g)")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(leaked_passages, spark, sf).where(F.col("longest") >= MIN_WORDS).select("doc_id", "item_id")


@add("p7_items", _LEAK + "SELECT item_id, count(DISTINCT doc_id) AS documents FROM texts JOIN grams USING (g) GROUP BY item_id")
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return _leaks(leaked_passages, spark, sf).where(F.col("longest") >= MIN_WORDS).groupBy("item_id").agg(F.count("*").alias("documents"))


@add("p7_cleaned")
def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the leaked spans cut out."""
    return _leaks(without_leaks, spark, sf)


@add("p8_shares")
def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    members, goal = membership(spread(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))
    fitted = fitted_rates(members, goal)
    return reached_shares(mixed(members, goal, fitted=fitted), goal, fitted[1])


@add("p8_mix")
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    members, goal = membership(spread(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))
    return mixed(members, goal).drop("posterior")


@add("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    t = text_types(text_statistics(spread(table(spark, sf, "documents").where("doc_id is not null").select("doc_id", "text"))))
    return t.where("kind <> 'prose'").select("doc_id", "kind").dropDuplicates(["doc_id"])


_SHARES = ", ".join(
    "len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in ws.split()) + "], x)))" for ws in COMMON.values()
)


@add("p9_statistics", rf"""
    SELECT doc_id, CAST(len(w) AS INT) AS words,
      round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w)::DOUBLE ELSE 0 END, 6) AS mean_word_length,
      round(CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[\p{{L}}\p{{N}}\p{{M}}\s\x0b\x{{85}}]+', '', 'g')) / length(t)::DOUBLE ELSE 0 END, 6) AS symbol_ratio,
      round(CASE WHEN len(w) > 0 THEN greatest({_SHARES}) / len(w)::DOUBLE ELSE 0 END, 6) AS common_words
    FROM (SELECT doc_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w
          FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents))""")  # fmt: skip
def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    s = text_statistics(table(spark, sf, "documents"))
    return s.select("doc_id", "words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "common_words")])
