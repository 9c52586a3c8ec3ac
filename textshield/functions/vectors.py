"""Vector arithmetic on array columns. Sums run in DOUBLE from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textshield.fixed_values import DEFAULT_METRIC, METRICS


def metric_name(metric: str | None) -> str:
    """The metric asked for; an unknown or missing name means the default."""
    name = (metric or DEFAULT_METRIC).lower()
    return name if name in METRICS else DEFAULT_METRIC


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: _double(x) * _double(x))))


def distance(a: Column, b: Column, metric: str | None = DEFAULT_METRIC) -> Column:
    """Distance of two vectors: squared ``l2``, ``ip`` as 1 - dot, ``cosine`` as 1 - cosine."""
    name = metric_name(metric)
    if name == "ip":
        return 1.0 - dot(a, b)
    if name == "cosine":
        length = norm(a) * norm(b)
        return 1.0 - F.when(length > 0, dot(a, b) / length).otherwise(0.0)
    return _total(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(a: Column) -> Column:
    """Unit-length copy of a vector; the zero vector stays zero."""
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda length: F.transform(a, lambda x: _double(x) / length))


def softmax(logits: Column) -> Column:
    """Probabilities of class logits."""
    weights = let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(_double(x) - _double(top))))
    return let(weights, lambda w: let(_total(w), lambda total: F.transform(w, lambda x: x / total)))


def rounded(values: Column, digits: int = 6) -> Column:
    return F.transform(values, lambda x: F.round(_double(x), digits) + 0.0)
