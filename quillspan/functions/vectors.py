"""Similarity of embedding vectors and the decisions drawn from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, NO_MATCH, AMBIGUOUS, UNAVAILABLE = "MATCH", "NO_MATCH", "AMBIGUOUS", "UNAVAILABLE"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, clamp: bool = True) -> Column:
    """Cosine of two vectors; null if one is null, of other length, or of no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    raw = F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) + raw * 0 if clamp else raw


def decision(score: Column, high: float, low: float) -> Column:
    """At least ``high`` is a match, at most ``low`` none, between them open, null unavailable."""
    return (
        F.when(score.isNull(), UNAVAILABLE)
        .when(score >= high, MATCH)
        .when(score <= low, NO_MATCH)
        .otherwise(AMBIGUOUS)
    )


def rank_of(verdict: Column) -> Column:
    return (
        F.when(verdict == MATCH, 0).when(verdict == AMBIGUOUS, 1).when(verdict == NO_MATCH, 2)
        .when(verdict == UNAVAILABLE, 3).otherwise(99)
    )
