"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); null if a vector is null or all zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_normalize(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    size = F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x)
    return F.when(size == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / F.sqrt(size)))
