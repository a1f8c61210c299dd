"""Vectors in array columns, as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    """The vector in double precision; single-precision sums differ between engines."""
    return as_column(v).cast("array<double>")


def is_usable(v: Column | str, dimension: int) -> Column:
    """Exactly ``dimension`` values, none null or NaN, not all zero; false for a null vector."""
    v = as_column(v)
    return F.coalesce((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def is_finite(v: Column | str, dimension: int) -> Column:
    """Exactly ``dimension`` values, each a finite number; zeros may be all there is. False for a null vector."""
    v = as_column(v)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & ~odd, F.lit(False))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance; neither side is normalised."""
    return F.sqrt(squared_distance(a, b))


def normalised(v: Column | str) -> Column:
    """The vector divided by its length; null for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(doubles(v), lambda x: x / length))


def vector_mean(v: Column | str) -> Column:
    """Mean vector of a group, as an aggregate with partial sums on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(v))))


def linear_score(v: Column | str, weights: list[float], bias: float = 0.0) -> Column:
    """Probability of the positive class under a fixed logistic model."""
    return 1 / (1 + F.exp(-(dot(v, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias)))))
