"""What several of the operators share: ASCII text rules, tables, distributed running sums."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The six ASCII blanks; every operator that cuts or compares text goes by them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

ROWS_PER_BUCKET = 20_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage and, where SQL can say the same, its SQL."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast built-in where no other letter can occur."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def shuffle_key(*parts: Column, seed: str = "0") -> Column:
    """16 hexadecimal digits that put rows into a reproducible random order."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), *texts)), 1, 16)


def numbered_copies(rows: DataFrame, name: str = "_copy") -> DataFrame:
    """``rows`` with a number from 0 among equal rows: the same result whatever the partitions, as equal rows can be exchanged.

    Equal rows are counted first, with partial counts in the tasks that hold them, and dealt out again in runs.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    run = F.lit(ROWS_PER_BUCKET)
    runs = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / run))).alias("_run"))
    last = F.least(F.col("_n"), (F.col("_run") + 1) * run) - 1
    return runs.select(*rows.columns, F.explode(F.sequence(F.col("_run") * run, last)).alias(name))


def running_sum(df: DataFrame, group: str, key: str, value: str, name: str, n_rows: int) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one in its group, by order of ``key``.

    ``key`` is evenly spread hexadecimal text (``shuffle_key``).  Its first digits cut each
    group into buckets of about ``ROWS_PER_BUCKET`` rows, so that a group which holds most
    of the table is still summed by many tasks: bucket totals are added up first, and each
    bucket then counts on from its own start.  ``group`` must not be null.
    """
    digits = max(2, math.ceil(math.log(max(n_rows, 1) / ROWS_PER_BUCKET, 16)))
    cut = df.withColumn("_rs_bucket", F.substring(key, 1, digits))
    before = W.partitionBy(group).orderBy("_rs_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = cut.groupBy(group, "_rs_bucket").agg(F.sum(value).alias("_rs_sum"))
    starts = starts.select(group, "_rs_bucket", F.coalesce(F.sum("_rs_sum").over(before), F.lit(0)).alias("_rs_start"))
    inside = W.partitionBy(group, "_rs_bucket").orderBy(key, "_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = cut.withColumn("_rs_upto", F.sum(value).over(inside))
    return (
        summed.join(starts, [group, "_rs_bucket"])
        .withColumn(name, (F.col("_rs_start") + F.col("_rs_upto") - F.col(value)).cast("long"))
        .drop("_rs_bucket", "_rs_start", "_rs_upto")
    )
