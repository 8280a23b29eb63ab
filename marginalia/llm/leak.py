"""Passages of evaluation items in training texts."""

from __future__ import annotations

import pickle
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import written

#: Consecutive words in common that make a leak.
MIN_WORDS = 13
#: Share of an item's words that make a leak, if they are consecutive, even if they are fewer; and the words an item must have at least.
COVERAGE, SHORTEST = 1.0, 5
#: Bytes of items in one automaton, about, and bytes of automata that one pass over the texts holds in each worker.
SHARD_BYTES, PASS_BYTES = 1 << 20, 256 << 20

_WORD = regex.compile(r"[\p{L}\p{N}]+")


class Automaton:
    """Generalised suffix automaton over the words of items: every run of words of any item, with the items that hold it.

    States are rows of flat arrays. Nearly all have one way on, which stands in
    two of them (``token``, ``to``); the others' further ways are in one dictionary. The items of a state are those that end
    in its subtree of links: a slice (``low``, ``high``) of ``ends``. ``pairs`` are the pairs of
    consecutive words of all items, by which texts are looked through before they are walked.
    """

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS, coverage: float = COVERAGE, shortest: int = SHORTEST) -> None:
        self.vocabulary: dict[str, int] = {}
        self.token, self.to, self.more = array("i", [-1]), array("i", [0]), {}
        self.others: dict[int, list[int]] = {}  # of states with several ways on, the further tokens
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.sizes: dict[int, int] = {}
        self.enough: dict[int, int] = {}
        own: list[tuple[int, int]] = []
        pairs: list[np.ndarray] = []
        for ident, text in items:
            toks = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in _WORD.findall((text or "").lower())]
            if len(toks) < max(1, shortest):
                continue
            self.sizes[ident] = max(len(toks), self.sizes.get(ident, 0))
            self.enough[ident] = min(min_words, max(1, int(np.ceil(coverage * len(toks) - 1e-9))), self.enough.get(ident, min_words))
            pairs.append(_pairs(np.array(toks)))
            last = 0
            for t in toks:
                last = self._extend(last, t)
                own.append((last, ident))
        self.floor = min(self.enough.values(), default=min_words)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        del self.others
        self._settle(own)

    def _way(self, state: int, t: int) -> int:
        if self.token[state] == t:
            return self.to[state]
        return self.more.get(state << 32 | t, -1)

    def _lead(self, state: int, t: int, to: int) -> None:
        if self.token[state] in (-1, t):
            self.token[state], self.to[state] = t, to
        else:
            if state << 32 | t not in self.more:
                self.others.setdefault(state, []).append(t)
            self.more[state << 32 | t] = to

    def _new(self, length: int, link: int) -> int:
        for a, v in ((self.length, length), (self.link, link), (self.token, -1), (self.to, 0)):
            a.append(v)
        return len(self.length) - 1

    def _split(self, p: int, t: int, q: int) -> int:
        """The state for the run of ``p`` and ``t``, taken out of the longer ``q``."""
        c = self._new(self.length[p] + 1, self.link[q])
        self.token[c], self.to[c] = self.token[q], self.to[q]
        for u in self.others.get(q, ()):
            self._lead(c, u, self.more[q << 32 | u])
        self.link[q] = c
        while p >= 0 and self._way(p, t) == q:
            self._lead(p, t, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, t: int) -> int:
        q = self._way(last, t)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, t, q)
        cur, p = self._new(self.length[last] + 1, 0), last
        while p >= 0 and self._way(p, t) < 0:
            self._lead(p, t, cur)
            p = self.link[p]
        if p >= 0:
            q = self._way(p, t)
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, t, q)
        return cur

    def _settle(self, own: list[tuple[int, int]]) -> None:
        """Lays the ends of items out in the order of a walk down the links, so that a state's subtree is a slice."""
        n = len(self.length)
        link = np.frombuffer(self.link, np.int32)
        held = np.bincount([s for s, _ in own], minlength=n) if own else np.zeros(n, int)
        below = held.copy()
        down = np.argsort(np.frombuffer(self.length, np.int32), kind="stable")
        for v in down[:0:-1].tolist():  # a link leads to a shorter run
            below[link[v]] += below[v]
        low = np.zeros(n, np.int64)
        free = held.copy()  # of each state, where the next subtree below it begins
        for v in down[1:].tolist():
            up = link[v]
            low[v] = low[up] + free[up]
            free[up] += below[v]
        ends = np.empty(len(own), object)
        at = low.copy()
        for s, ident in own:
            ends[at[s]] = ident
            at[s] += 1
        self.low, self.high = array("i", low.astype(np.int32).tobytes()), array("i", (low + below).astype(np.int32).tobytes())
        self.ends = ends.tolist()

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def stretches(self, toks: np.ndarray) -> list[tuple[int, int]]:
        """Where a text's consecutive words are pairs of the items long enough: only there can a match be."""
        if self.floor < 2:
            return [(0, len(toks))]
        if len(toks) < self.floor or not len(self.pairs):
            return []
        key = _pairs(toks)
        place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = np.concatenate([[False], (self.pairs[place] == key) & (toks[1:] >= 0) & (toks[:-1] >= 0), [False]])
        turn = np.flatnonzero(known[1:] != known[:-1])
        return [(int(a), int(b) + 1) for a, b in zip(turn[::2], turn[1::2]) if b + 1 - a >= self.floor]

    def matches(self, words: list[str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """The longest match of each item, if it is long enough, and the runs of words (end exclusive) that are such matches."""
        best: dict[int, int] = {}
        runs: list[tuple[int, int]] = []
        all_toks = self.ids(words)
        for a, b in self.stretches(all_toks):
            toks = all_toks[a:b].tolist()
            state = matched = 0
            for i, t in enumerate(toks, a):
                to = self._way(state, t)
                while state and to < 0:
                    state = self.link[state]
                    matched = self.length[state]
                    to = self._way(state, t)
                if to < 0:
                    continue
                state, matched = to, matched + 1
                if matched >= self.floor and self._ends_here(state, matched, toks, i + 1 - a):
                    size = self._note(state, matched, best)
                    if size:
                        if runs and runs[-1][1] >= i + 1 - size:
                            runs[-1] = (min(runs[-1][0], i + 1 - size), i + 1)
                        else:
                            runs.append((i + 1 - size, i + 1))
        return best, runs

    def _ends_here(self, state: int, matched: int, toks: list[int], nth: int) -> bool:
        """Whether some run that ends here isn't part of one that ends at the next word in the same places of the items."""
        if nth == len(toks):
            return True
        t = toks[nth]
        up = state
        while self.length[self.link[up]] >= self.floor:  # the least run of all that count
            up = self.link[up]
        for v in (state, up):
            w = self._way(v, t)
            if w < 0 or self.high[w] - self.low[w] != self.high[v] - self.low[v]:
                return True
        return False

    def _note(self, state: int, matched: int, best: dict[int, int]) -> int:
        """Notes the items that share a run that ends here; the longest such run that is enough for one of them."""
        v, size, most = state, matched, 0
        while size >= self.floor:
            for item in set(self.ends[self.low[v] : self.high[v]]):
                if size >= self.enough[item]:
                    most = max(most, size)
                    if best.get(item, 0) < size:
                        best[item] = size
            v = self.link[v]
            if v <= 0:
                break
            size = self.length[v]
        return most

    def packed(self) -> bytes:
        return pickle.dumps(self, protocol=5)


def _pairs(toks: np.ndarray) -> np.ndarray:
    return toks[:-1].astype(np.int64) << 32 | toks[1:].astype(np.int64) & 0xFFFFFFFF


def _automata(items: DataFrame, id_col: str, text_col: str, min_words: int, coverage: float, shortest: int, shard_bytes: int, pass_bytes: int) -> Iterator[list[tuple[str, Broadcast]]]:
    """Automata over shards of the items, built where the items are, in lots of at most ``pass_bytes`` (or of one)."""
    spark = items.sparkSession
    it = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct()
    shards = int(-(-(it.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // shard_bytes) or 1)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(i, t) for b in batches for i, t in zip(b.i, b.t)]
        if rows:
            a = Automaton(rows, min_words, coverage, shortest).packed()
            yield pd.DataFrame({"size": [len(a)], "packed": [a]})

    dealt = it.repartitionById(shards, F.pmod(F.xxhash64("i"), F.lit(shards)).cast("int"))
    built = written(dealt.mapInPandas(build, "size bigint, packed binary").withColumn("nth", F.spark_partition_id()), "automata")
    lot, size = [], 0
    for r in built.select("nth", "size").orderBy("nth").collect():  # numbers only
        if lot and size + r["size"] > pass_bytes:
            yield [_sent(spark, built, n) for n in lot]
            lot, size = [], 0
        lot.append(r["nth"])
        size += r["size"]
    yield [_sent(spark, built, n) for n in lot]


def _sent(spark, built: DataFrame, nth: int) -> tuple[str, Broadcast]:
    """One automaton to all executors, under a name of its own; the driver holds it packed."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(built.where(F.col("nth") == nth).first()["packed"]))


_open: dict[str, Automaton] = {}


def _opened(sent: list[tuple[str, Broadcast]]) -> list[Automaton]:
    """The automata of this pass, unpacked once a worker; those of passes before are let go."""
    for k in _open.keys() - dict(sent).keys():
        del _open[k]
    for k, b in sent:
        if k not in _open:
            _open[k] = pickle.loads(b.value)
    return [_open[k] for k, _ in sent]


def leaked_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    coverage: float = COVERAGE,
    shortest: int = SHORTEST,
    shard_bytes: int = SHARD_BYTES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Each document and item that have at least ``min_words`` consecutive words in common, or ``coverage`` of the item's words.

    Columns ``doc_id, item_id, longest`` (words of the longest common run) and
    ``coverage`` (its share of the item's words). Items of fewer than ``shortest`` words are left out, as they stand
    anywhere; those of fewer than ``min_words`` are found by their coverage (1: whole). Each text is streamed once
    through a suffix automaton of the items, which follows the longest match at
    every word. Automata are built in tasks, of about ``shard_bytes`` of items each; a pass over the
    texts takes as many as fit into ``pass_bytes``. Null texts hold nothing, rows
    with a null id are left out; rows repeated under one id count as one document, with the longest run of any.
    """
    ids = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}"
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for sent in _automata(items, item_id, item_text, min_words, coverage, shortest, shard_bytes, pass_bytes):

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            autos = _opened(sent)
            for b in batches:
                rows = []
                for i, t in zip(b.doc_id, b.text):
                    words = _WORD.findall(t.lower())
                    for a in autos:
                        rows += [(i, item, n, n / a.sizes[item]) for item, n in a.matches(words)[0].items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "longest", "coverage"])

        part = d.mapInPandas(run, f"{ids}, longest int, coverage double")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))


def _spans(text: str, words: list[str]) -> list[tuple[int, int]]:
    """The places of a text's words; ``words`` are those of the lower-cased text."""
    at = [m.span() for m in _WORD.finditer(text)]
    if len(at) != len(words):  # lower-casing made words of its own; then the lower-cased text's places hold
        at = [m.span() for m in _WORD.finditer(text.lower())]
    return at


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    coverage: float = COVERAGE,
    shortest: int = SHORTEST,
    max_removed: float = 0.5,
    shard_bytes: int = SHARD_BYTES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The texts that hold passages of items, with those spans cut out: ``doc_id, text, removed_chars, dropped``.

    ``dropped`` is true where the passages were more than ``max_removed`` of the
    text's characters; such a document should go as a whole. Documents without leaks yield nothing, those with a null
    id or text neither. Items of more than one pass are cut out of what the pass before left.
    """
    of = docs.schema[doc_id].dataType.simpleString()
    d = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<int>").alias("gone"))
    for sent in _automata(items, item_id, item_text, min_words, coverage, shortest, shard_bytes, pass_bytes):

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            autos = _opened(sent)
            for b in batches:
                gone = []
                for t, before in zip(b.text, b.gone):
                    words = _WORD.findall(t.lower())
                    runs = [r for a in autos for r in a.matches(words)[1]]
                    at = _spans(t, words) if runs else []
                    gone.append([*before, *(x for s, e in runs for x in (at[s][0], at[e - 1][1]))])
                yield pd.DataFrame({"doc_id": b.doc_id, "text": b.text, "gone": gone})

        d = d.mapInPandas(run, f"doc_id {of}, text string, gone array<int>")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, gone in zip(b.doc_id, b.text, b.gone):
                kept, upto, n = [], 0, 0
                for s, e in sorted(zip(gone[::2], gone[1::2])):
                    if e > upto:
                        s = max(s, upto)
                        kept.append(t[upto:s])
                        n, upto = n + e - s, e
                rows.append((i, "".join([*kept, t[upto:]]), n, n > max_removed * len(t)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed_chars", "dropped"])

    return d.where(F.size("gone") > 0).mapInPandas(cut, f"doc_id {of}, text string, removed_chars int, dropped boolean")
