"""Products of vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine with a given vector, at least 0; null where lengths differ or a vector is all zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    sim = F.try_divide(dot(vector, q), F.sqrt(dot(vector, vector)) * F.lit(size))
    return F.when(F.size(vector) == len(query), F.greatest(F.lit(0.0), sim))


def usable_vector(vector: Column) -> Column:
    """Whether a vector can be compared: not null, not empty, all numbers finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))
