"""Vector columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    x, y = a.cast("array<double>"), b.cast("array<double>")
    return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null or has length 0."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
