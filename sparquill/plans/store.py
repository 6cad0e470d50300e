"""Building and checking a stored collection."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators import encoding as E
from sparquill.operators.filters import where_to_column
from sparquill.operators.knn import knn
from sparquill.sources.collections import Collections


def build(
    store: Collections,
    name: str,
    chunks: DataFrame,
    encoder: E.Encoder | None = None,
    model_name: str = "feature-hashing",
    partition_by: str | None = None,
) -> None:
    """Encode chunk rows and store them under ids in (source, chunk) order.

    Chunks whose encoding failed are counted and listed by ``Collections.errors``.
    """
    rows = E.encode_chunks(chunks, encoder=encoder).withColumnRenamed("text", "document")
    store.create(name, model_name, partition_by=partition_by)
    store.add(name, rows, "source_file", "chunk_id", "year_range")


def validation_suite(
    collection: DataFrame, queries: DataFrame, where: dict[str, Any], ids: DataFrame, expected: int, n_results: int = 3
) -> DataFrame:
    """``(check_name, n, passed)``: nearest neighbours, filter, lookup by id and count."""
    count = F.count(F.lit(1)).alias("n")
    n_queries = queries.count()
    nearest = knn(queries, collection, n_results).agg(count)
    filtered = collection.where(where_to_column(where)).agg(count)
    wanted = ids.select("id").distinct()
    looked_up = collection.select("id").join(wanted, "id", "left_semi").agg(count)
    total = collection.agg(count)
    checks = [
        ("semantic", nearest, F.col("n") == n_results * n_queries),
        ("filtered", filtered, F.col("n") > 0),
        ("by_id", looked_up, F.col("n") == wanted.count()),
        ("count", total, F.col("n") == expected),
    ]
    rows = [df.select(F.lit(name).alias("check_name"), "n", passed.alias("passed")) for name, df, passed in checks]
    return reduce(DataFrame.unionByName, rows)
