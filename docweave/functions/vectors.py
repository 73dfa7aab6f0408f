"""Column functions over vectors and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def freshness(when: Column, now: Column, days: float) -> Column:
    """1 for the future, 0 without a date, else falling with age."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(when)) / 86400.0
    return F.when(when.isNull(), 0.0).when(age < 0, 1.0).otherwise(F.exp(-age / days))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
