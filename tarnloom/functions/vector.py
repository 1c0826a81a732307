"""Cosine distance between arrays of floats, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; null for vectors of different lengths and for a vector without direction."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)


def literal(vector: list[float]) -> Column:
    """A query vector as part of the plan: no join is needed to compare with it."""
    return F.array(*(F.lit(float(x)) for x in vector))
