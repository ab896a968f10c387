"""Arithmetic on ARRAY columns of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in vector))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null for unlike lengths, 0 if either is a zero vector."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def euclidean(a: Column, b: Column) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(
        same, F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))
    )


def _clamped(c: Column) -> Column:
    return F.transform(c, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def add(a: Column, b: Column) -> Column:
    return _clamped(F.zip_with(doubles(a), doubles(b), lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return _clamped(F.zip_with(doubles(a), doubles(b), lambda x, y: x - y))


def toward(a: Column, b: Column, share: float) -> Column:
    return _clamped(F.zip_with(doubles(a), doubles(b), lambda x, y: x + (y - x) * share))


def content_id(vector: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.array_join(vector.cast("array<string>"), ","), model), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def confidence(scores: Column) -> Column:
    """How clearly the best of descending ``scores`` stands out from the last."""
    top, last = F.get(scores, F.lit(0)), F.element_at(scores, -1)
    return (
        F.when(F.size(scores) < 2, 0.5)
        .when(top <= 0, 0.0)
        .otherwise(F.least(F.lit(0.99), 0.5 + 0.9 * (top - last) / top))
    )
