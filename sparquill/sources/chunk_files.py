"""Chunk files: JSON for exchange, Parquet for everything else."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparquill.schemas import CHUNK

_BLOCK = ("file", "start")


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, start, place, piece)``: the text between closing braces, however long the lines; files are split into
    ``start`` byte ranges as usual and ``place`` keeps the order within one."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("piece"),
    )


def _with_running(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all earlier rows of the file, as sums within the byte ranges plus
    what the ranges before hold (one row each)."""
    earlier = (W.unboundedPreceding, -1)
    within = W.partitionBy(*_BLOCK).orderBy("place").rowsBetween(*earlier)
    rows = rows.withColumn("_amount", amount)
    ranges = rows.groupBy(*_BLOCK).agg(F.sum("_amount").alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(W.partitionBy("file").orderBy("start").rowsBetween(*earlier)), F.lit(0))
    rows = rows.withColumn(name, F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    joined = rows.join(ranges.select(*_BLOCK, offset.alias("_offset")), [*_BLOCK])
    return joined.withColumn(name, F.col(name) + F.col("_offset")).drop("_amount", "_offset")


def read_json_arrays(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """The objects of JSON array files, each file read by as many tasks as it has byte ranges.

    A range may begin anywhere, also inside a string.  The numbers of quotes before a piece say whether it begins in a
    string, and with that known the braces outside strings say at which depth it ends; an object is whole
    where the depth is back at zero.  Objects may be nested; text that is no object is an error.
    """
    bare = F.regexp_replace("piece", r"\\.", "")  # an escaped quote is no quote
    rows = _with_running(_pieces(spark, path), F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))), "quotes")
    opened = F.when(F.col("quotes") % 2 == 1, F.concat(F.lit('"'), bare)).otherwise(bare)
    outside = F.regexp_replace(opened, r'"[^"]*("|$)', "")
    in_string = (F.length(opened) - F.length(F.replace(opened, F.lit('"'), F.lit("")))) % 2 == 1  # so its brace is text
    braces = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    rows = rows.withColumn("_step", braces - F.when(in_string, 0).otherwise(1)).withColumn("_string", in_string)
    rows = _with_running(rows, F.col("_step"), "depth")
    ends = ~F.col("_string") & (F.col("depth") + F.col("_step") <= 0)
    rows = _with_running(rows.select(*_BLOCK, "place", "piece", "depth", ends.cast("int").alias("_end")), F.col("_end"), "record")
    parts = F.array_sort(F.collect_list(F.struct("start", "place", "piece")))  # the pieces of one object
    whole = rows.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "}").alias("text"))
    text = F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", "")
    objects = whole.select("file", text.alias("text")).where(F.regexp_replace("text", r"\s+$", "") != "]")
    checked = F.when(F.col("text").startswith("{"), F.concat("text", F.lit("}"))).otherwise(
        F.raise_error(F.concat(F.lit("no JSON array of objects: "), F.col("file")))
    )
    return objects.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_chunks(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Chunks from JSON array files, from JSON lines, or from both; an empty input or an array without its end is an error.

    A file is an array if its first character is a bracket.  ``lines`` overrides that.
    """
    reader = spark.read.schema(CHUNK).option("mode", "FAILFAST")
    if lines:
        chunks = reader.json(path)
    else:
        at = F.struct("start", "place")
        kinds = _pieces(spark, path).groupBy("file").agg(
            F.regexp_like(F.min_by("piece", at), F.lit(r"^[\x{FEFF}\s]*\[")).alias("array"),
            F.regexp_like(F.max_by("piece", at), F.lit(r"\]\s*$")).alias("closed"),
        )
        found = [(r["file"], r["array"] or lines is False, r["closed"]) for r in kinds.toLocalIterator()]  # a row per file
        arrays, others = [f for f, array, _ in found if array], [f for f, array, _ in found if not array]
        cut_off = [f for f, array, closed in found if array and not closed]
        if cut_off:
            raise ValueError(f"no end of the array in {cut_off[0]} and {len(cut_off) - 1} more")
        if arrays and others:
            chunks = reader.json(others).unionByName(read_json_arrays(spark, arrays, CHUNK))
        else:
            chunks = read_json_arrays(spark, path, CHUNK) if arrays else reader.json(path)
    if chunks.isEmpty():
        raise ValueError(f"no chunks in {path}")
    return chunks


def write_chunks(chunks: DataFrame, path: str, format: str = "json") -> None:
    """All tasks write at once: a folder of JSON lines or Parquet files."""
    chunks.write.mode("overwrite").format(format).save(path)


def write_run_metadata(statistics: DataFrame, path: str, configuration: dict[str, Any]) -> None:
    """One JSON record: when, with what settings, and the run's statistics row."""
    settings = F.struct(*[F.lit(v).alias(k) for k, v in configuration.items()])
    record = statistics.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("processing_date"),
        F.struct(*statistics.columns).alias("statistics"),
        settings.alias("configuration"),
    )
    record.coalesce(1).write.mode("overwrite").json(path)
