"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; arrays of different lengths have none (null)."""
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(vector), lambda x: x * x)))


def normalise(vector: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    length = norm(vector)
    return F.transform(doubles(vector), lambda x: F.when(length > 0, x / length).otherwise(x))


def truncate(vector: Column, dimensions: int) -> Column:
    """The first `dimensions` components at unit length."""
    return normalise(F.slice(vector, 1, dimensions))


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def has_dimensions(vector: Column, dimensions: int) -> Column:
    return F.size(vector) == dimensions
