"""Records that differ in formatting alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.keys import words
from marginalia.session import written

#: What separates the fields of a record of name=value or name: value fields, and what a field looks like.
BREAK = r"[;|\r\n]"
FIELD = r"^\s*[^\s=:;|][^=:;|]*[=:][^;|]*$"


def canonical_text(c: Column) -> Column:
    """The words of a text in order; of a text of two or more fields, the fields in sorted order.

    Two texts are equal by it if only white space, letter case, punctuation or
    the order of fields tells them apart. Null has no words, like an empty text.
    """
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), BREAK), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    fields = (F.size(parts) >= 2) & F.forall(parts, lambda x: x.rlike(FIELD))
    line = lambda x: F.array_join(words(x), " ")
    sorted_fields = F.array_sort(F.transform(parts, line))
    return F.when(fields, F.concat(F.lit(";"), F.array_join(sorted_fields, ";"))).otherwise(line(c))


#: Rows of ``_runs``: settled; of the range's first run, which may have begun in a range before; a note of its last run.
_SETTLED, _FIRST, _NOTE = 0, 1, 2


def _digest(key: str) -> bytes:
    return hashlib.sha256(key.encode("utf-8", "surrogatepass")).digest()


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walks a sorted range, comparing neighbouring full keys; each distinct (key, id) goes out with the first id of its run here.

    That is the run's true first id unless the run began in a range before, which
    only the range's first run can have done: its rows carry the digest of the
    key, and so does a note of the range's last run and its first id.
    """
    first = key = rep = last = None
    for b in batches:
        if not len(b):
            continue
        k, i = b.key.to_numpy(dtype=object), b.id.to_numpy(dtype=object)
        if first is None:
            first = k[0]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        new[0] = key is None or k[0] != key
        fresh = new.copy()
        fresh[1:] |= i[1:] != i[:-1]
        fresh[0] |= i[0] != last
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        reps = np.array([*i[starts], rep], dtype=object)[run]  # run -1, going on from the batch before, is the last entry
        kind = np.where(k == first, _FIRST, _SETTLED)
        key, rep, last = k[-1], reps[-1], i[-1]
        out = pd.DataFrame({"kind": kind, "rep": reps, "id": i})[fresh]
        out["digest"] = np.where(out.kind == _FIRST, _digest(first), None)
        yield out
    if key is not None:
        yield pd.DataFrame({"kind": [_NOTE], "rep": [rep], "id": [rep], "digest": [_digest(key)]})


def canonical_groups(df: DataFrame, id_col: str, texts: list[str]) -> DataFrame:
    """Each distinct id with the smallest id of the ids whose canonical texts are all the same: ``rep, id``.

    The canonical records are range-partitioned by the full key and id and sorted,
    so that equal records are neighbours even where a third of all rows are
    copies and fill several ranges; one scan compares neighbouring full keys. Only a
    range's first run can have begun before it: its true first id comes from the
    notes, of which there is one per range, few enough to broadcast. The scan is written once, as adaptive execution may
    coalesce ranges differently for each reader of an exchange. Rows
    without id are ignored; repeated rows count once. A null text equals an empty
    one. Extra columns don't matter. An id whose rows differ stands in each of its groups.
    """
    key = F.to_json(F.array(*[canonical_text(F.col(t)) for t in texts]))
    of = df.schema[id_col].dataType.simpleString()
    runs = written(
        df.where(F.col(id_col).isNotNull())
        .select(key.alias("key"), F.col(id_col).alias("id"))
        .repartitionByRange("key", "id")
        .sortWithinPartitions("key", "id")
        .mapInPandas(_runs, f"kind int, rep {of}, id {of}, digest binary"),
        "runs",
    )
    notes = runs.where(F.col("kind") == _NOTE).groupBy("digest").agg(F.min("rep").alias("true_rep"))
    first = runs.where(F.col("kind") == _FIRST).join(F.broadcast(notes), "digest", "left")
    return runs.where(F.col("kind") == _SETTLED).select("rep", "id").unionByName(
        first.select(F.least("rep", "true_rep").alias("rep"), "id").distinct()
    )


def canonical_counts(df: DataFrame, id_col: str, texts: list[str]) -> DataFrame:
    """One row per distinct record: ``rep``, the id that stands for it, and ``copies``, the number of ids it stands for."""
    return canonical_groups(df, id_col, texts).groupBy("rep").agg(F.count_distinct("id").alias("copies"))
