"""Vector functions over ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparquill.functions.text import let


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    return let(
        l2_norm(v),
        lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))),
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(l2_norm(a) * l2_norm(b), F.lit(0.0))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(
        F.zip_with(
            a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
        )
    )


def distance(a: Column, b: Column, metric: str = "l2sq") -> Column:
    """Smaller is nearer for every metric; ``ip`` is one minus the inner product."""
    if metric == "l2sq":
        return l2_squared(a, b)
    if metric == "l2":
        return F.sqrt(l2_squared(a, b))
    if metric == "cosine":
        return F.lit(1.0) - cosine_similarity(a, b)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def nan_count(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.isnan(x)))


def inf_count(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.abs(x) == float("inf")))
