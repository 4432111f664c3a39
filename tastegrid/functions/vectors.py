"""Arithmetic on array<double> vectors as higher-order column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; an expression captured by a lambda
    would be evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(a: Column) -> Column:
    """Scale to length 1; a zero vector stays zero."""
    def scaled(x: Column) -> Column:
        return let(norm(x), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x))

    return let(a, scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, null when either has length 0 or is missing."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def centered(a: Column) -> Column:
    """Subtract the vector's own mean, so that cosine of the result is Pearson."""
    return let(a, lambda x: let(
        total(x) / F.size(x), lambda m: F.transform(x, lambda v: v - m)
    ))


def positive_mask(a: Column) -> Column:
    """1.0 where the coordinate is positive, else 0.0."""
    return F.transform(a, lambda v: F.when(v > 0, 1.0).otherwise(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def log_loss(logit: Column, label: Column) -> Column:
    """Logistic loss of a raw score without overflow for large |score|."""
    return F.log1p(F.exp(-F.abs(logit))) + F.greatest(logit, F.lit(0.0)) - label * logit
