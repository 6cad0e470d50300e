"""Chunks to checked, stored vectors."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sparquill.operators import encoding as E
from sparquill.operators.indexing import dense_index
from sparquill.session import stored_for_now
from sparquill.sources.chunk_files import write_run_metadata


def embed(
    chunks: DataFrame,
    path: str,
    encoder: E.Encoder | None = None,
    dimension: int = E.DIMENSION,
    batch_size: int = E.BATCH_SIZE,
    model_name: str = "feature-hashing",
) -> tuple[bool, Row]:
    """Encode, validate and save; returns whether the check passed, and its report.

    The model runs once: vectors are written under ``path/unchecked`` and only get to
    ``path/vectors`` when the check passes.  Rows that failed to encode make the vector
    count differ from the metadata count, which fails the check.  ``path/run`` has the report with model, dimension,
    time and throughput.  Earlier vectors stay until the new ones are in place.
    """
    spark = chunks.sparkSession
    unchecked, final = f"{path.rstrip('/')}/unchecked", f"{path.rstrip('/')}/vectors"
    began = time.monotonic()
    with stored_for_now(E.encode_chunks(chunks, encoder=encoder, batch_size=batch_size)) as encoded:
        seconds = round(time.monotonic() - began, 2)
        indexed = dense_index(encoded, "source_file", "chunk_id", "year_range", name="embedding_index")
        indexed.write.mode("overwrite").parquet(unchecked)

    stored = spark.read.parquet(unchecked)
    vectors = stored.where(F.col("embedding").isNotNull())
    n_chunks = stored.count()
    checked = E.validation_report(vectors, n_chunks, dimension)
    report = checked.first()
    rate = round(n_chunks / seconds, 2) if seconds else 0.0
    configuration = {
        "model": model_name, "dimension": dimension, "batch_size": batch_size, "n_chunks": n_chunks, "seconds": seconds, "chunks_per_second": rate,
    }
    write_run_metadata(spark.createDataFrame([report], checked.schema), f"{path.rstrip('/')}/run", configuration)
    if report["passed"]:
        jvm = spark._jvm.org.apache.hadoop.fs
        source, target = jvm.Path(unchecked), jvm.Path(final)
        fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
        old = jvm.Path(f"{final}-old")
        fs.delete(old, True)
        if fs.exists(target):
            fs.rename(target, old)
        fs.rename(source, target)
        fs.delete(old, True)
    return bool(report["passed"]), report


def profile(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """``(cluster, n_chunks, n_years)`` of a k-means clustering."""
    return summarise_clusters(E.cluster_profile(vectors, k, seed))


def summarise_clusters(pairs: DataFrame) -> DataFrame:
    """``(cluster, n_chunks, n_years)`` of one row per cluster and year."""
    return pairs.groupBy("cluster").agg(F.sum("n_chunks").alias("n_chunks"), F.count(F.lit(1)).alias("n_years"))
