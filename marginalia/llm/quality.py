"""Statistics of texts, and from them whether a text is prose, a list, a table or junk."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import written

KINDS = ["prose", "list", "table", "junk"]

# Common words by language, which are the words of its grammar: articles and pronouns, prepositions, conjunctions,
# auxiliary verbs, and adverbs that go with them.
COMMON = {
    "en": "the a an this that these those each every either neither some any no all both such what which whose "
    "i you he she it we they me him her us them my your his its our their who whom itself themselves "
    "of in to for on with at by from as into about than through after over between out against during without before under around among "
    "within along across behind beyond up down off above near since until upon per "
    "and or but nor so yet if because while although though unless whether when where why how "
    "be am is are was were been being have has had having do does did will would shall should can could may might must "
    "not only also very too there here then now just more most other",
    "fr": "le la les l un une des du de d au aux ce cet cette ces mon ton son ma ta sa mes tes ses notre votre leur nos vos leurs "
    "je j tu il elle on nous vous ils elles me m te t se s lui y en qui que qu quoi dont où "
    "à dans par pour sur sous avec sans entre vers chez depuis pendant avant après contre et ou mais donc ni car si comme quand lorsque puisque parce "
    "est sont était étaient être été suis sommes êtes a ai as avons avez ont avait avaient avoir eu peut doit "
    "ne n pas plus très aussi bien tout tous toute toutes même autre autres",
    "de": "der die das den dem des ein eine einen einem einer eines kein keine keinen keiner "
    "ich du er sie es wir ihr mich mir dich dir ihn ihm uns euch ihnen sich mein sein unser dieser diese dieses diesem diesen jeder jede jedes was wer welche "
    "in im an am auf aus bei beim mit nach seit von vom zu zum zur für durch gegen ohne um über unter vor hinter neben zwischen bis während wegen "
    "und oder aber denn weil dass wenn ob als obwohl damit sondern wie wo wann warum "
    "ist sind war waren bin bist gewesen hat haben hatte hatten habe werden wird wurde wurden worden kann können muss müssen soll sollen will wollen darf "
    "nicht nur auch noch schon sehr so da dann hier alle mehr",
    "es": "el la los las lo un una unos unas este esta estos estas ese esa esos esas aquel aquella esto eso "
    "yo tú él ella nosotros ellos ellas usted ustedes me te se nos le les mi mis tu tus su sus nuestro nuestra qué quién cuál que "
    "de del a al en con por para sin sobre entre hasta desde hacia según tras bajo ante contra durante "
    "y e o u ni pero sino si porque como cuando donde aunque mientras "
    "es son era eran fue fueron ser sido está están estaba estar ha han había haber hay he "
    "no ya muy más menos también tan todo toda todos todas otro otra",
    "id": "yang ini itu tersebut saya aku kami kita anda kamu dia ia mereka nya apa siapa mana bagaimana mengapa kapan "
    "di ke dari untuk dengan pada dalam oleh kepada terhadap tentang antara sejak hingga sampai sebelum setelah "
    "dan atau tetapi tapi namun serta maupun karena sebab jika kalau bila ketika saat agar supaya bahwa sebagai seperti maka lalu kemudian "
    "adalah ialah merupakan ada tidak bukan belum sudah telah sedang akan masih pernah dapat bisa harus boleh "
    "juga saja hanya lebih sangat para setiap semua suatu sebuah seorang lagi pun",
}

#: Lines of lists, of tables and of machine output. Fixed patterns of this operator.
LIST_LINE = r"^\s*(?:[-*+•‣·–]\s+|\d{1,3}[.)]\s+|\d{1,3}(?:\.\d{1,3})+\.?\s+|\[[ xX✓]?\]\s+|[-*+]\s+\[|[a-zA-Z][.)]\s+|[ivx]{1,4}[.)]\s+)\S"
# Each alternative stands beside a string without which it can't match, looked for first, as it is cheaper.
TABLE_LINE = [
    ("|", r"^\s*\|.*\|\s*$|^\s*\S+(?: +\| +\S+){2,}"),
    ("\t", r"^[^\t]*\S\t+\S"),
    (",", r"^(?:[^,\s]|\S[^,]*)(?:,(?:[^\s,][^,]*)?){2,}$"),
    (";", r"^[^;]*(?:;[^\s;][^;]*){2,}$"),
    ("   ", r"\S {4,}\S|\S {3,}\S+[^\n]* {3,}\S"),
    ("---", r"^\s*[-+|=: ]{5,}$"),
]
MACHINE_LINE = [
    ("", r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d|[A-Za-z0-9+/=]{40,}\s*$|(?:0x)?[0-9a-fA-F]{24,}\s*$|[\"'}\])]+[,;]?\s*$|at [\w.$]+\()"),
    ("=", r"(?:^|\s)[A-Za-z_][\w.]*=\S+\s(?:.*\s)?[A-Za-z_][\w.]*=\S"),  # two or more of name=value
    ("\"", r"^\s*(?:\"[^\"]*\"\s*:\s|[\[{].*[\"'\]}:]\s*,?\s*$)"),
    ("'", r"^\s*[\[{].*[\"'\]}:]\s*,?\s*$"),
    (":", r"^\s*[\[{].*[\]}:]\s*,?\s*$"),
    ("<", r"^\s*<[^>]+>"),
]
MOJIBAKE = r"Ã.|â€.?|Â|ï¿½|�|[\x00-\x08\x0e-\x1f\x80-\x9f]"
CONTROL = r"[\x00-\x08\x0e-\x1f]"
#: A full stop behind a word or what closes behind one, and before a blank, what closes, or the end.
SENTENCE_END = r"[.!?…](?<=[\p{L}\p{N}\"'»”’)\]][.!?…])(?=[\s\"'»”’)\]]|$)|[。！？]"
ENDS = r"[.!?…:。！？]['\"»”’)\]*_]*\s*$"


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each row's text, all computed by built-in functions in one pass over the rows, without a shuffle.

    ``words``, ``mean_word_length``, ``symbol_ratio`` (characters that are no
    letter, digit or space), ``punctuated_lines`` (share of the non-blank lines that
    end a sentence), ``language`` (of the five known ones that with the most common
    words in the text, whatever a column says; null if there are none) and
    ``common_words`` (share of words that are common in it), then the features behind the
    types. A null or blank text has 0 everywhere. Repeated rows stay.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_replace(raw, r"\r\n?", "\n").alias("t"))
    base = base.select(
        "doc_id", "t",
        F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"),
        F.filter(F.transform(F.split("t", "\n"), lambda l: F.regexp_replace(l, r"^(?:\s*>)+ ?", "")), lambda l: l.rlike(r"\S")).alias("ls"),
    )

    def any_of(l: Column, patterns: list[tuple[str, str]]) -> Column:
        return reduce(Column.__or__, [l.contains(m) & l.rlike(p) if m else l.rlike(p) for m, p in patterns])

    def marks(l: Column) -> Column:
        """What is looked for in a line, each once; what it makes the line is settled from these."""
        n = F.size(F.split(F.trim(l), r"\s+"))
        return F.struct(
            F.length(l).alias("c"), n.alias("n"), any_of(l, MACHINE_LINE).alias("m"), any_of(l, TABLE_LINE).alias("t"), l.rlike(LIST_LINE).alias("l"),
            (F.length(F.regexp_replace(l, r"[\p{L}\p{N}\p{M}\s|,.;:\"'()\-]+", "")) * 4 >= F.length(l)).alias("odd"),
            l.rlike(ENDS).alias("e"), l.rlike(r"[.!?]\s*$").alias("stop"),
        )

    def line(x: Column) -> Column:
        table = ~x["odd"] & x["t"] & ~(x["stop"] & (x["n"] >= 10))  # a long sentence with commas is no row of cells
        kind = F.when(x["m"], "m").when(table, "t").when(x["l"] & (x["n"] <= 14), "l").when(x["n"] <= 3, "s").otherwise("p")
        return F.struct(x["c"], x["n"], kind.alias("k"), x["e"])

    x = base.select("doc_id", "t", "w", "ls", F.transform(F.transform("ls", marks), line).alias("q"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars = lambda k: F.aggregate(F.filter("q", lambda s: s["k"] == k), F.lit(0), lambda a, s: a + s["c"])
    count = lambda k: F.size(F.filter("q", lambda s: s["k"] == k))

    def among(common: list[str]) -> Column:
        return F.size(F.filter("w", lambda v: v.isin(common)))

    common = [among(ws.split()) for ws in COMMON.values()]
    x = x.select(
        "doc_id",
        F.size("w").alias("words"),
        F.aggregate("w", F.lit(0), lambda a, v: a + F.length(v)).alias("letters"),
        F.length("t").alias("size"),
        F.length(F.regexp_replace("t", r"[\p{L}\p{N}\p{M}\s]+", "")).alias("symbols"),
        F.size("ls").alias("lines"),
        F.size(F.array_distinct("ls")).alias("lines_apart"),
        F.size(F.array_distinct("w")).alias("words_apart"),
        F.size(F.filter("q", lambda s: s["e"])).alias("ends"),
        F.aggregate("q", F.lit(0), lambda a, s: a + s["c"]).alias("line_chars"),
        F.aggregate("q", F.lit(0), lambda a, s: a + s["n"]).alias("line_words"),
        *[chars(k).alias(f"c_{k}") for k in "mtlsp"],
        *[count(k).alias(f"n_{k}") for k in "mtls"],
        F.when((F.octet_length("t") > F.length("t")) | F.col("t").rlike(CONTROL), F.regexp_count("t", F.lit(MOJIBAKE))).otherwise(0).alias("mojibake"),
        F.regexp_count("t", F.lit(SENTENCE_END)).alias("sentences"),
        F.length(F.regexp_replace(F.regexp_replace("t", r"[\x00-\u0dff]+", ""), r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]+", "")).alias("ideographs"),
        F.array(*[F.struct(c.alias("n"), F.lit(k).alias("k")) for c, k in zip(common, COMMON)]).alias("langs"),
    )
    best = F.array_max("langs")
    x = x.withColumn("best", best)
    return x.select(
        "doc_id",
        "words",
        share(F.col("letters"), F.col("words")).alias("mean_word_length"),
        share(F.col("symbols"), F.col("size")).alias("symbol_ratio"),
        share(F.col("ends"), F.col("lines")).alias("punctuated_lines"),
        F.when(F.col("best.n") > 0, F.col("best.k")).alias("language"),
        share(F.col("best.n"), F.col("words")).alias("common_words"),
        "lines",
        share(F.col("lines_apart"), F.col("lines")).alias("lines_apart"),
        share(F.col("words_apart"), F.col("words")).alias("words_apart"),
        share(F.col("line_words"), F.col("lines")).alias("words_a_line"),
        *[share(F.col(f"c_{k}"), F.col("line_chars")).alias(f"chars_{n}") for k, n in zip("mtlsp", ["machine", "table", "list", "short", "prose"])],
        *[share(F.col(f"n_{k}"), F.col("lines")).alias(f"lines_{n}") for k, n in zip("mtls", ["machine", "table", "list", "short"])],
        share(F.col("mojibake"), F.col("words")).alias("mojibake"),
        share(F.col("sentences"), F.col("words")).alias("sentences"),
        share(F.col("ideographs"), F.col("letters")).alias("ideographs"),
    )


def labelling_functions() -> dict[str, tuple[str, Column]]:
    """Thresholds on the statistics, each a noisy vote for one type of text."""
    c = F.col
    told = (c("common_words") >= 0.18) | (c("ideographs") >= 0.3)
    filler = ((c("lines") >= 5) & (c("lines_apart") <= 0.4)) | ((c("words") >= 40) & (c("words_apart") <= 0.15) & (c("ideographs") < 0.3))
    return {
        "common words": ("prose", told & ~filler),
        "prose lines": ("prose", (c("chars_prose") >= 0.5) & told & ~filler),
        "sentences": ("prose", (c("sentences") >= 0.02) & (c("common_words") >= 0.1) & (c("chars_table") < 0.5) & (c("chars_list") < 0.5)),
        "long lines": ("prose", (c("words_a_line") >= 9) & told & (c("chars_machine") < 0.5)),
        "list text": ("list", (c("chars_list") >= 0.5) & ~filler),
        "list lines": ("list", (c("lines") >= 3) & (c("lines_list") >= 0.6) & ~filler),
        "bare entries": ("list", (c("lines") >= 4) & (c("words_a_line") <= 7) & (c("chars_list") >= 0.45) & (c("common_words") < 0.3)),
        "table text": ("table", (c("chars_table") >= 0.5) & ~filler),
        "table lines": ("table", (c("lines") >= 3) & (c("lines_table") >= 0.6) & ~filler),
        "cells": ("table", (c("chars_table") >= 0.45) & (c("common_words") < 0.25) & ~filler),
        "no words": ("junk", c("words") <= 2),
        "symbols": ("junk", (c("symbol_ratio") >= 0.2) & (c("chars_table") < 0.5) & (c("chars_list") < 0.5)),
        "filler": ("junk", filler),
        "damage": ("junk", c("mojibake") >= 0.1),
        "machine text": ("junk", c("chars_machine") >= 0.5),
        "long words": ("junk", (c("mean_word_length") >= 14) & (c("ideographs") < 0.3)),
        "no sentences": ("junk", (c("words") >= 8) & (c("common_words") < 0.08) & (c("ideographs") < 0.3) & (c("chars_list") < 0.4) & (c("chars_table") < 0.4)),
        "furniture": ("junk", (c("lines") >= 4) & (c("chars_short") >= 0.6) & (c("common_words") < 0.35)),
    }


class VoteModel:
    """How often each labelling function fires on each type, and how common the types are, learnt without labels."""

    def __init__(self, kinds: list[str], own: list[int]) -> None:
        self.kinds, self.own = kinds, own
        self.prior = np.full(len(kinds), 1 / len(kinds))
        self.fires = np.array([[0.8 if k == o else 0.03 for k in range(len(kinds))] for o in own])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[None] + votes @ np.log(self.fires) + (1 - votes) @ np.log(1 - self.fires)
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> VoteModel:
        """Expectation-maximization on how the functions agree; ``votes``: distinct patterns of 0 and 1, ``count`` texts each."""
        for _ in range(rounds):
            p = self.posterior(votes) * count[:, None]
            size = p.sum(0)
            prior = (size + 1) / (size.sum() + len(self.kinds))
            # A few texts' worth of the starting belief keeps a type that is absent from being taken over by another.
            start = np.array([[0.8 if k == o else 0.03 for k in range(len(self.kinds))] for o in self.own])
            fires = (votes.T @ p + 5 * start) / (size[None] + 5)
            fires = np.clip(fires, 1e-3, 1 - 1e-3)
            done = np.abs(fires - self.fires).max() < 1e-6
            self.prior, self.fires = prior, fires
            if done:
                break
        return self


def text_types(stats: DataFrame) -> DataFrame:
    """``stats`` with ``kind`` and its posterior ``p_<kind>`` for each type.

    Every labelling function fires or abstains. All texts are counted by the
    pattern of their votes (at most two to the number of functions, here 2^18, and
    far fewer in practice); expectation-maximization over the counts learns how far each
    function can be trusted; each pattern's posterior is joined back. Of an empty table nothing comes out.
    """
    fs = labelling_functions()
    spark = stats.sparkSession
    pattern = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, (_, c) in enumerate(fs.values())), F.lit(0))
    voted = written(stats.withColumn("_votes", pattern.cast("int")), "votes")  # the statistics are computed once
    seen = voted.groupBy("_votes").agg(F.count("*").alias("n")).toPandas().sort_values("_votes")
    bits = (seen["_votes"].to_numpy()[:, None] >> np.arange(len(fs))[None] & 1).astype(float)
    model = VoteModel(KINDS, [KINDS.index(k) for k, _ in fs.values()]).fit(bits, seen["n"].to_numpy(dtype=float))
    post = model.posterior(bits) if len(seen) else np.zeros((0, len(KINDS)))
    table = spark.createDataFrame(
        [(int(v), KINDS[int(p.argmax())], *map(float, p)) for v, p in zip(seen["_votes"], post)],
        "_votes int, kind string, " + ", ".join(f"p_{k} double" for k in KINDS),
    )
    return voted.join(F.broadcast(table), "_votes").drop("_votes")
