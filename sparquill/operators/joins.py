"""Joins that look at the size of a side before they choose a strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.session import checkpointed

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20


def join_small(rows: DataFrame, side: DataFrame, key: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Inner join with a side that is expected, but not known, to be small.

    The side is written to the checkpoint folder, so it is computed once, and counted
    and measured there.  Up to ``max_rows`` rows and ``MAX_BROADCAST_BYTES`` it is broadcast, so that a frequent key of ``rows``
    stays spread over all tasks; beyond that Spark shuffles both sides, where adaptive
    execution splits a partition that is too large.
    """
    stored = checkpointed(side)
    size = F.sum(F.octet_length(F.to_json(F.struct(*stored.columns))))
    n, n_bytes = stored.agg(F.count(F.lit(1)), size).first()
    few = n <= max_rows and (n_bytes or 0) <= MAX_BROADCAST_BYTES
    return rows.join(F.broadcast(stored) if few else stored, key)
