"""Vector expressions over ``ARRAY<FLOAT>``, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length; zero vectors stay zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    """Logistic function, 0 and 1 beyond 60."""
    return F.when(x < -60, F.lit(0.0)).when(x > 60, F.lit(1.0)).otherwise(1.0 / (1.0 + F.exp(-x)))
