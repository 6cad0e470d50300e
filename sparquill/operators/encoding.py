"""Turning text into vectors, and checking the vectors.

An encoder is a factory: called once per Python worker task, it loads its model and
returns ``encode(texts) -> float array of shape (n, dim)``.  The default needs no model and
no Python: it is the expression ``hashed_words``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions import vectors as V
from sparquill.functions.text import round_half_even
from sparquill.operators.clustering import kmeans

Encode = Callable[[list[str]], np.ndarray]
Encoder = Callable[[], Encode]

DIMENSION = 384
BATCH_SIZE = 32


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_words(text: Column, dimension: int = DIMENSION) -> Column:
    """Word counts hashed into ``dimension`` buckets, scaled to unit length; all zeros without words.

    The buckets of a text's words are sorted together with one entry of every bucket, so that each bucket ends
    somewhere and its count is the distance from the end before it.
    """

    def bucket(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(F.lower(word)), 1, 8), 16, 10).cast("long") % dimension).cast("int")

    def ends(buckets: Column) -> Column:
        return F.array_compact(F.transform(buckets, lambda b, i: F.when(F.get(buckets, i + 1).eqNullSafe(b), None).otherwise(i)))

    def counts(ends: Column) -> Column:
        return F.transform(ends, lambda e, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(-1)) - 1).cast("double"))

    def scaled(counts: Column) -> Column:
        squares = F.aggregate(counts, F.lit(0.0), lambda total, n: total + n * n)
        norm = F.when(squares > 0, F.sqrt(squares)).otherwise(1.0)
        return _let(norm, lambda norm: F.transform(counts, lambda n: (n / norm).cast("float")))

    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))  # letters and digits of every script
    every = F.sequence(F.lit(0), F.lit(dimension - 1))
    buckets = F.sort_array(F.concat(F.transform(words, bucket), every))
    return _let(buckets, lambda b: _let(ends(b), lambda e: _let(counts(e), scaled)))


def hashing_encoder(dimension: int = DIMENSION) -> Encoder:
    """``hashed_words`` as an encoder, for callers that wrap or replace encoders."""

    def load() -> Encode:
        @lru_cache(maxsize=1 << 18)
        def bucket(word: str) -> int:
            return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dimension

        word = re.compile(r"[^\W_]+")  # letters and digits of every script

        def encode(texts: list[str]) -> np.ndarray:
            counts = np.zeros((len(texts), dimension))
            for row, text in enumerate(texts):
                found = [bucket(w.lower()) for w in word.findall(text)]
                counts[row] = np.bincount(found, minlength=dimension)
            norms = np.linalg.norm(counts, axis=1, keepdims=True)
            return counts / np.where(norms > 0, norms, 1.0)

        return encode

    return load


def model_encoder(model_name: str, device: str | None = None) -> Encoder:
    """A sentence-transformers model, where that library is installed on the workers."""

    def load() -> Encode:
        from sentence_transformers import SentenceTransformer  # optional

        model = SentenceTransformer(model_name, device=device)
        return lambda texts: model.encode(
            texts, batch_size=len(texts), convert_to_numpy=True, normalize_embeddings=True, show_progress_bar=False
        )

    return load


def _as_list_array(rows: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if r is None else len(r) for r in rows]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = [r for r in rows if r is not None]
    values = pa.array(np.concatenate(flat).astype(np.float32) if flat else np.zeros(0, np.float32))
    missing = pa.array([r is None for r in rows])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=missing if any(r is None for r in rows) else None)


def encode(text: Column, encoder: Encoder | None = None, batch_size: int = BATCH_SIZE) -> Column:
    """``struct<embedding array<float>, error string>`` for a text column.

    A batch that fails leaves its rows with no embedding and the reason in ``error``;
    the other batches go on.  Without ``encoder`` the vector is an expression and cannot fail.
    """
    if encoder is None:
        return F.struct(hashed_words(text).alias("embedding"), F.lit(None).cast("string").alias("error"))

    @F.arrow_udf("struct<embedding:array<float>,error:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode_batch = encoder()
        for batch in batches:
            vectors: list[np.ndarray | None] = []
            errors: list[str | None] = []
            texts = batch.to_pylist()
            for start in range(0, len(texts), batch_size):
                part = texts[start : start + batch_size]
                try:
                    vectors.extend(encode_batch(part))
                    errors.extend([None] * len(part))
                except Exception as failure:  # a bad batch must not fail the job
                    vectors.extend([None] * len(part))
                    errors.extend([str(failure)] * len(part))
            yield pa.StructArray.from_arrays(
                [_as_list_array(vectors), pa.array(errors, pa.string())], names=["embedding", "error"]
            )

    # keeps the optimiser from moving or repeating the model call
    return run.asNondeterministic()(text)


def encode_chunks(
    chunks: DataFrame, text: str = "text", encoder: Encoder | None = None, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """Add ``embedding`` and ``encode_error``; rows without text are dropped first."""
    encoded = chunks.where(F.col(text).isNotNull()).withColumn("_e", encode(F.col(text), encoder, batch_size))
    return encoded.select(
        *chunks.columns, F.col("_e.embedding").alias("embedding"), F.col("_e.error").alias("encode_error")
    )


def validation_report(vectors: DataFrame, metadata_count: int | Column, dimension: int = DIMENSION) -> DataFrame:
    """One row: dimension, NaN, Inf and norm statistics, and whether the vectors pass.

    Norms far from one are reported but do not fail the check.
    """
    v = F.col("embedding")
    expected = F.lit(metadata_count) if isinstance(metadata_count, int) else metadata_count
    per_row = vectors.select(
        (F.size(v) != dimension).cast("int").alias("wrong"),
        V.nan_count(v).alias("nans"),
        V.inf_count(v).alias("infs"),
        V.l2_norm(v).alias("norm"),
    )
    totals = per_row.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.coalesce(F.sum("wrong"), F.lit(0)).alias("n_wrong_dimension"),
        F.coalesce(F.sum("nans"), F.lit(0)).alias("n_nan"),
        F.coalesce(F.sum("infs"), F.lit(0)).alias("n_inf"),
        round_half_even(F.avg("norm"), 6).alias("mean_norm"),
        round_half_even(F.stddev_pop("norm"), 6).alias("std_norm"),
    )
    return totals.select(
        "*",
        (F.abs(F.col("mean_norm") - 1.0) < 0.01).alias("is_normalised"),
        (F.col("n_vectors") == expected).alias("count_matches"),
        (
            (F.col("n_wrong_dimension") == 0)
            & (F.col("n_nan") == 0)
            & (F.col("n_inf") == 0)
            & (F.col("n_vectors") == expected)
        ).alias("passed"),
    )


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second; zero when no time has passed."""
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))


def cluster_profile(vectors: DataFrame, k: int = 10, seed: int = 42, rounds: int = 20) -> DataFrame:
    """k-means over ``embedding``: ``(cluster, year_range, n_chunks)`` with one row per pair; unusable vectors have no cluster."""
    found = kmeans(vectors.select("year_range", "embedding"), k, seed, rounds).where(F.col("cluster").isNotNull())
    return found.groupBy("cluster", "year_range").agg(F.count(F.lit(1)).alias("n_chunks"))
