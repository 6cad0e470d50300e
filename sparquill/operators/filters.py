"""Metadata filters written as nested dictionaries, compiled to a ``Column``.

``{"year_range": "2007-2026", "chunk_id": {"$gt": 10}}`` means both conditions hold.
Plain column predicates reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _field(name: str, wanted: Any) -> Column:
    column = F.col(name)
    if isinstance(wanted, dict):
        unknown = set(wanted) - set(_COMPARE)
        if unknown:
            raise ValueError(f"unknown filter operator {sorted(unknown)} on {name!r}")
        return _all([_COMPARE[op](column, value) for op, value in wanted.items()])
    if isinstance(wanted, (list, tuple, set)):
        raise ValueError(f"{name!r}: lists are not metadata values; use $in")
    return column == wanted


def where_to_column(where: dict[str, Any] | None) -> Column | None:
    """The filter as a column, or None when there is nothing to filter on."""
    if not where:
        return None
    parts = []
    for key, wanted in where.items():
        if key == "$and":
            parts.append(_all([where_to_column(w) for w in wanted]))
        elif key == "$or":
            parts.append(reduce(lambda a, b: a | b, [where_to_column(w) for w in wanted]))
        elif key.startswith("$"):
            raise ValueError(f"unknown filter operator {key!r}")
        else:
            parts.append(_field(key, wanted))
    return _all(parts)
