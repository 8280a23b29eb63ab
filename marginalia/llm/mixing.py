"""Mixing sources to target shares of the total size in tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.keys import words
from marginalia.session import written

#: Where the public tokenizers' files lie; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts are cut before byte pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled rows that the classifier is fitted on, at most; all else covers all rows.
MAX_LABELLED = 20_000
#: Sources that targets may name, at most.
MAX_SOURCES = 10_000


def source_name(c: Column) -> Column:
    """A source's name without blanks around it, in lower case, with hyphens."""
    n = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "_", "-")
    return F.when(n != "", n)


def with_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without the text but with its size in ``tokens`` of a public tokenizer; a null text has none.

    The vocabulary is read here and broadcast, so executors need no file.
    """
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    built: list = []

    @F.pandas_udf("long")
    def size(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if not built:
            built.append(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={}))
        for texts in it:
            yield pd.Series([len(built[0].encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn("tokens", size(F.col(text))).drop(text)


def with_posteriors(labelled: DataFrame, rows: DataFrame, names: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``rows`` with the probability of each source of ``names`` (``posterior``) in place of ``features``.

    A multinomial regression on hashed words and side columns (``features``,
    an array of strings), fitted on a bounded sample of the labelled rows by hash of id.
    With fewer than two sources among them all are as likely.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    tf = HashingTF(inputCol="features", outputCol="_tf", numFeatures=2048, binary=True)
    n = labelled.count()
    part = min(1.0, max_labelled / max(n, 1))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(part * 1_000_003) + 1)
    sample = written(sample.select(F.col("index").cast("double").alias("label"), "features"), "labelled")
    if sample.select("label").distinct().limit(2).count() < 2:
        return rows.drop("features").withColumn("posterior", F.array(*[F.lit(1 / len(names)) for _ in names]).cast("array<double>"))
    model = LogisticRegression(featuresCol="_tf", labelCol="label", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", maxIter=15, regParam=0.05, family="multinomial").fit(tf.transform(sample))
    pad = F.array(*[F.lit(0.0) for _ in range(max(0, len(names) - model.numClasses))]).cast("array<double>")
    return model.transform(tf.transform(rows)).withColumn("posterior", F.concat(vector_to_array("_p"), pad)).drop("features", "_tf", "_p", "_r", "_y")


def membership(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, list]:
    """Each document with its tokens and what it belongs to: its recorded source (``index``) or, without a usable one, the classifier's ``posterior``.

    Also the targets in order: rows ``name, share, cap``. Target rows with a null
    name are ignored; of repeated names the greatest share counts; null shares and caps are 0.
    """
    goal = (
        targets.select(source_name(F.col("source")).alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap"))
        .where(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.max(F.struct("share", "cap")).alias("t"))
        .select("name", "t.share", "t.cap")
        .orderBy("name")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    spark = docs.sparkSession
    index = spark.createDataFrame([(g.name, i) for i, g in enumerate(goal)], "name string, index int")
    side = F.array_compact(F.array(F.concat(F.lit("lang="), F.lower("lang")), F.concat(F.lit("type="), "doc_type")))
    features = F.concat(F.array_distinct(words(F.concat_ws(" ", "title", "text"))), side)
    d = docs.where(F.col("doc_id").isNotNull()).select("doc_id", source_name(F.col("source")).alias("name"), "text", features.alias("features"))
    d = d.join(F.broadcast(index), "name", "left")
    labelled = d.where("index is not null")
    known = with_tokens(labelled.select("doc_id", "index", "text"), "text", vocabulary).select("doc_id", "tokens", "index", F.lit(None).cast("array<double>").alias("posterior"))
    loose = with_tokens(d.where("index is null").select("doc_id", "text", "features"), "text", vocabulary)
    loose = with_posteriors(labelled.select("doc_id", "index", "features"), loose, [g.name for g in goal], max_labelled)
    members = known.unionByName(loose.select("doc_id", "tokens", F.lit(None).cast("int").alias("index"), "posterior"))
    return written(members, "members"), goal


class Rates:
    """How often documents are used: those of a recorded source all alike, the others by their posteriors.

    A document's rate starts at the weighted start of its sources and follows the steps, always within
    0 and its cap. Where a source is recorded that is a number per source; posteriors are taken a few
    hundred at a time, so that no matrix is large.
    """

    def __init__(self, goal: list, start: np.ndarray) -> None:
        self.cap = np.array([float(g.cap) for g in goal])
        self.start, self.steps = start, np.zeros((0, len(goal)))
        self.known = np.clip(start, 0, self.cap)

    def step(self, move: np.ndarray) -> None:
        self.steps = np.vstack([self.steps, move])
        self.known = np.clip(self.known - move, 0, self.cap)

    def loose(self, posterior: pd.Series) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """By slices of rows: the posteriors, the rates, and the caps (of the sources, weighted, in whole numbers)."""
        at = max(1, min(512, 4_000_000 // max(1, len(self.cap))))
        for a in range(0, len(posterior), at):
            m = np.stack(posterior.iloc[a : a + at].to_numpy()).astype(float)
            cap = np.floor(m @ self.cap + 1e-9)
            r = np.clip(m @ self.start, 0, cap)
            for move in (m @ self.steps.T).T:
                r = np.clip(r - move, 0, cap)
            yield slice(a, a + at), m, r, cap


def fitted_rates(members: DataFrame, goal: list, total_tokens: float | None = None, rounds: int = 50, tolerance: float = 1e-5) -> tuple[Rates, np.ndarray]:
    """Projected-gradient least squares for the documents' rates; also the targets in tokens.

    Each round sums the expected tokens of each source over all documents and moves
    the rates against the difference from the targets, scaled by what each source holds, within 0 and the
    cap. Documents of a recorded source are summed once, as all of a source have one rate; the others are summed in
    each round, by a vector per partition. Rounds end when the sums no longer move.
    """
    s = len(goal)
    share = np.array([max(0.0, g.share) for g in goal])
    share = share / share.sum() if share.sum() > 0 else share
    sure = np.zeros(s)
    for r in members.where("index is not null").groupBy("index").agg(F.sum("tokens").alias("t")).collect():  # a row a source
        sure[r["index"]] = r.t
    others = members.where("index is null").select("tokens", "posterior")

    def sums(rates: Rates) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, s))
            for b in batches:
                for at, m, r, _ in rates.loose(b.posterior):
                    tok = b.tokens.iloc[at].to_numpy(dtype=float)
                    total += np.stack([tok @ m, (tok * r) @ m])
            yield pd.DataFrame({"s": np.arange(s), "held": total[0], "used": total[1]})

        got = others.mapInPandas(run, "s int, held double, used double").groupBy("s").agg(F.sum("held").alias("held"), F.sum("used").alias("used")).toPandas().sort_values("s")
        if not len(got):
            return np.zeros(s), np.zeros(s)
        return got.held.to_numpy(), got.used.to_numpy()

    held = sure + sums(Rates(goal, np.zeros(s)))[0]
    want = share * (held.sum() if total_tokens is None else total_tokens)
    scaled = lambda x: np.divide(x, held, out=np.zeros(s), where=held > 0)
    rates = Rates(goal, scaled(want))
    before = None
    for _ in range(rounds):
        used = sure * rates.known + sums(rates)[1]
        still = before is not None and np.abs(used - before).max(initial=0) <= tolerance * max(want.sum(), 1)
        if still or np.abs(used - want).max(initial=0) <= tolerance * max(want.sum(), 1):
            break
        before = used
        rates.step(scaled(used - want))
    return rates, want


def mixed(members: DataFrame, goal: list, total_tokens: float | None = None, fitted: tuple[Rates, np.ndarray] | None = None) -> DataFrame:
    """Each document with its fitted ``rate`` and how many ``copies`` of it the mix has: ``doc_id, source, tokens, rate, copies``.

    ``copies`` is the rate's whole part, plus one for a share of documents as
    large as the rest, chosen by hash of the id; never more than the cap. ``source`` is null
    where only the classifier's belief is known.
    """
    rates, _ = fitted or fitted_rates(members, goal, total_tokens)
    names = np.array([g.name for g in goal], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            known = b["index"].notna().to_numpy()
            at = b["index"].to_numpy(dtype=float)[known].astype(int)
            r, cap = np.zeros(len(b)), np.zeros(len(b))
            source = np.full(len(b), None, dtype=object)
            r[known], cap[known], source[known] = rates.known[at], rates.cap[at], names[at]
            others = np.flatnonzero(~known)
            for part, _, x, most in rates.loose(b.posterior[~known]):
                r[others[part]], cap[others[part]] = x, most
            draw = b.draw.to_numpy(dtype=float)
            copies = np.minimum(np.floor(r) + (draw < r - np.floor(r)), cap)
            yield pd.DataFrame({"doc_id": b.doc_id, "source": source, "tokens": b.tokens, "rate": r, "copies": copies.astype("int32"), "posterior": b.posterior})

    draw = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(1 << 30)
    kind = members.schema["doc_id"].dataType.simpleString()
    return members.withColumn("draw", draw).mapInPandas(run, f"doc_id {kind}, source string, tokens bigint, rate double, copies int, posterior array<double>")


def reached_shares(mix: DataFrame, goal: list, wanted: np.ndarray | None = None) -> DataFrame:
    """Per source: ``target_share``, ``actual_share`` of the mix's tokens, the tokens held, wanted and used, the documents used, and the most copies of one.

    A document without a usable source counts for each source by its posterior; posteriors are summed to a vector per partition.
    Sources that can't reach their target even with all repeats show it by fewer tokens used than wanted.
    """
    spark, s = mix.sparkSession, len(goal)
    place = {g.name: i for i, g in enumerate(goal)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, s))
        for b in batches:
            tok, copies = b.tokens.to_numpy(dtype=float), b.copies.to_numpy(dtype=float)
            known = b.source.notna().to_numpy()
            at = b.source[known].map(place).to_numpy(dtype=int)
            total[0] += np.bincount(at, tok[known], s)
            total[1] += np.bincount(at, (tok * copies)[known], s)
            total[2] += np.bincount(at, copies[known] > 0, s)
            np.maximum.at(total[3], at, copies[known])
            others = np.flatnonzero(~known)
            for a in range(0, len(others), 512):
                rows = others[a : a + 512]
                m = np.stack(b.posterior.iloc[rows].to_numpy()).astype(float)
                total[:2] += np.stack([tok[rows] @ m, (tok * copies)[rows] @ m])
        yield pd.DataFrame({"i": np.arange(s), "held": total[0], "used": total[1], "documents": total[2], "most": total[3]})

    parts = mix.select("source", "tokens", "copies", "posterior").mapInPandas(run, "i int, held double, used double, documents double, most double")
    by = parts.groupBy("i").agg(
        F.sum("held").alias("held_tokens"), F.sum("used").alias("used_tokens"), F.sum("documents").cast("bigint").alias("documents"), F.max("most").cast("int").alias("most_copies")
    )
    wanted = np.zeros(s) if wanted is None else wanted
    goals = spark.createDataFrame([(i, g.name, float(g.share), int(g.cap), float(w)) for i, (g, w) in enumerate(zip(goal, wanted))], "i int, source string, target_share double, max_repeats int, wanted_tokens double")
    total = by.agg(F.sum("used_tokens").alias("all_tokens"))  # one row
    none = {"held_tokens": 0.0, "used_tokens": 0.0, "documents": 0, "most_copies": 0}
    share = F.coalesce(F.try_divide("used_tokens", "all_tokens"), F.lit(0.0)).alias("actual_share")
    return goals.join(by, "i", "left").crossJoin(F.broadcast(total)).select("source", "target_share", "max_repeats", share, "wanted_tokens", *none).fillna(none)
