"""Analytics over collection metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.functions.text import round_half_even


def _known(column: str):
    return F.coalesce(F.col(column), F.lit("unknown"))


def year_distribution(rows: DataFrame) -> DataFrame:
    """``(year_range, n_chunks, percent)``; a missing year counts as ``unknown``."""
    counts = rows.groupBy(_known("year_range").alias("year_range")).agg(F.count(F.lit(1)).alias("n_chunks"))
    total = counts.agg(F.sum("n_chunks")).scalar()
    shares = counts.withColumn("percent", F.col("n_chunks") / total * 100)
    return shares.withColumn("percent", round_half_even(F.col("percent"), 1))


def unique_sources(rows: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count(_known("source_file")).alias("n_sources"))


def first_sources(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct sources in name order."""
    return rows.select(_known("source_file").alias("source_file")).distinct().orderBy("source_file").limit(n)


def distinct_years(rows: DataFrame) -> DataFrame:
    return rows.select(_known("year_range").alias("year_range")).distinct().orderBy("year_range")


def chunks_per_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_chunks"))


def count_check(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """``(n_chunks, n_expected, matches)``: a stored collection against what was put in."""
    n_expected = expected.agg(F.count(F.lit(1))).scalar()
    counted = rows.agg(F.count(F.lit(1)).alias("n_chunks")).withColumn("n_expected", n_expected)
    return counted.withColumn("matches", F.col("n_chunks") == F.col("n_expected"))


def align(vectors: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Pair vectors with their metadata by key; an error if a row on either side has no partner."""
    counts = alignment_report(vectors, metadata, key).first()
    if not counts["matches"]:
        raise ValueError(f"{counts['n_vectors']} vectors and {counts['n_metadata']} metadata rows, {counts['n_aligned']} aligned")
    return vectors.join(metadata, key, "inner")


def alignment_report(vectors: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """One row of counts; ``matches`` only if every row on either side found its partner."""
    sides = vectors.select(key, F.lit(1).alias("_v")).join(metadata.select(key, F.lit(1).alias("_m")), key, "full_outer")
    return sides.agg(
        F.count("_v").alias("n_vectors"),
        F.count("_m").alias("n_metadata"),
        F.count_if(F.col("_v").isNotNull() & F.col("_m").isNotNull()).alias("n_aligned"),
    ).withColumn(
        "matches", (F.col("n_vectors") == F.col("n_aligned")) & (F.col("n_metadata") == F.col("n_aligned"))
    )
