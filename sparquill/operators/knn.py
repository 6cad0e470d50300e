"""Exact nearest neighbours of a set of query vectors.

Two plans give the same answer:

* *broadcast*: the query vectors are few enough (checked, not assumed) to send to every
  task.  The collection is scanned in place, never shuffled; each task keeps only its
  best ``k`` per query, and those few rows are merged.
* *rounds*: more queries than that.  They are stored once in blocks of bounded size, and
  each block in turn is broadcast to a scan like the one above, whose ``k`` rows per query
  are stored before the next.  The collection is read once a round and never moved.  A task
  gathers its vectors into small balls (centre and radius) and passes over the balls that the
  triangle inequality shows to be farther from a query than its ``k`` best so far.

Distances are rounded to the reported four decimals first and ties go to the lower id,
so that equal copies rank the same in every plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from sparquill.operators.filters import where_to_column
from sparquill.session import shared_folder, written

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_RESULTS = 1 << 19
BLOCK_QUERIES = 65536
BALL_ROWS = 64  # vectors in a ball at most
GATHERED_BYTES = 64 << 20  # vectors a task gathers before it makes balls of them
PIECE_ROWS = 1024  # rows of the collection that a task compares at once
TILE_CELLS = 1 << 20  # distances held in memory at once inside a task
DECIMALS = 4


# -- inside a task ------------------------------------------------------------


def _by_length(ids: Any, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length; those with NaN, infinite or null components are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    first, end = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    offsets -= first  # a slice shares the values of the whole
    values = column.values.slice(first, end - first).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for length in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == length)
        matrix = values[offsets[places][:, None] + np.arange(length)]
        finite = np.isfinite(matrix).all(axis=1)
        if finite.any():
            yield int(length), places[finite], matrix[finite]


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype("U") if values.dtype == object else values


def _distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    product = queries @ vectors.T
    if metric == "ip":
        return 1.0 - product
    query_sq = np.einsum("ij,ij->i", queries, queries)[:, None]
    vector_sq = np.einsum("ij,ij->i", vectors, vectors)[None, :]
    if metric == "cosine":
        norms = np.sqrt(query_sq) * np.sqrt(vector_sq)
        return 1.0 - product / np.where(norms > 0, norms, np.inf)
    squared = np.maximum(query_sq + vector_sq - 2.0 * product, 0.0)
    return np.sqrt(squared) if metric == "l2" else squared


def _balls(points: np.ndarray) -> list[np.ndarray]:
    """Places of the points of each ball: cut across the line to a far point, until they are small.

    The cut is the widest gap along the line that leaves an eighth on both sides, which keeps clusters whole.
    """
    found, open_ = [], [np.arange(len(points))]
    while open_:
        places = open_.pop()
        part = points[places]
        away = part - part[0]
        along = away @ away[np.argmax(np.einsum("ij,ij->i", away, away))]
        if len(places) <= BALL_ROWS or not along.max() > along.min():
            found.append(places)
            continue
        order, eighth = np.argsort(along), len(places) // 8
        cut = eighth + 1 + int(np.argmax(np.diff(along[order[eighth : len(places) - eighth]])))
        open_ += [places[order[:cut]], places[order[cut:]]]
    return found


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 0, norms, 1.0)


class _Best:
    """Running best ``k`` (distance, id) per query, over any number of batches.

    ``cells`` counts the distances that a full comparison takes, ``computed`` those that were needed.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.distance = np.full((len(queries), k), np.inf)
        self.filled = np.zeros(len(queries), dtype=np.int64)
        self.ids: np.ndarray | None = None
        self.cells = self.computed = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.cells += len(ids) * len(self.queries)
        self._compare(ids, vectors, np.arange(len(self.queries)))

    def add_by_balls(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """``add``, without the balls that are too far away to matter."""
        self.cells += len(ids) * len(self.queries)
        if not len(ids) or not len(self.queries):
            return
        angles = self.metric == "cosine"
        points = _unit(vectors) if angles else vectors
        balls = _balls(points)
        centres = np.stack([points[b].mean(axis=0) for b in balls])
        radii = np.array([np.linalg.norm(points[b] - c, axis=1).max() for b, c in zip(balls, centres)])
        step = max(1, TILE_CELLS // len(balls))
        for start in range(0, len(self.queries), step):
            rows = np.arange(start, min(start + step, len(self.queries)))
            asked = _unit(self.queries[rows]) if angles else self.queries[rows]
            least = self._least(asked, centres, radii)
            nearest = np.argmin(_distances(asked, centres, self.metric), axis=1)
            for n, ball in enumerate(balls):  # each query's nearest ball first: it sets how far to look
                self._compare(ids[ball], vectors[ball], rows[nearest == n])
            for n, ball in enumerate(balls):
                open_ = (least[:, n] <= self.distance[rows, -1]) & (nearest != n)
                self._compare(ids[ball], vectors[ball], rows[open_])

    def _least(self, asked: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
        """A bound under the rounded distance of each query to all points of each ball."""
        asked_sq = np.einsum("ij,ij->i", asked, asked)[:, None]
        product = asked @ centres.T
        centre_sq = np.einsum("ij,ij->i", centres, centres)[None, :]
        scale = asked_sq + centre_sq + radii**2
        rounding = 10.0**-DECIMALS
        if self.metric == "ip":
            return 1.0 - product - np.sqrt(asked_sq) * radii - rounding - 1e-10 * scale
        gap = np.maximum(np.sqrt(np.maximum(asked_sq + centre_sq - 2.0 * product, 0.0)) - radii, 0.0)
        if self.metric == "l2":
            return gap - rounding - 1e-6 * np.sqrt(scale)
        return gap**2 / (2.0 if self.metric == "cosine" else 1.0) - rounding - 1e-10 * scale

    def _compare(self, ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray) -> None:
        if not len(ids) or not len(asked):
            return
        self.computed += len(ids) * len(asked)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        if self.ids is None:
            self.ids = np.zeros(self.distance.shape, dtype=ids.dtype)
        elif self.ids.dtype != ids.dtype:  # longer strings
            self.ids = self.ids.astype(np.promote_types(self.ids.dtype, ids.dtype))
        keep = min(self.k, len(ids))
        step = max(1, TILE_CELLS // len(ids))
        for start in range(0, len(asked), step):
            rows = asked[start : start + step]
            tile = np.round(_distances(self.queries[rows], vectors, self.metric), DECIMALS) + 0.0
            tile = np.fmin(tile, np.finfo(np.float64).max)  # overflow is a very large distance
            better = tile.min(axis=1) <= self.distance[rows, -1]
            rows, tile = rows[better], tile[better]
            if not len(rows):
                continue
            picked = np.argpartition(tile, keep - 1, axis=1)[:, :keep]
            worst_kept = np.take_along_axis(tile, picked, axis=1).max(axis=1)
            # only where more rows tie at the cut than fit do ids decide which are kept
            for r in np.flatnonzero((tile <= worst_kept[:, None]).sum(axis=1) > keep):
                near = np.flatnonzero(tile[r] <= worst_kept[r])  # ascending ids, ties included
                picked[r] = near[np.argsort(tile[r, near], kind="stable")[:keep]]
            distance = np.concatenate([self.distance[rows], np.take_along_axis(tile, picked, axis=1)], axis=1)
            found = np.concatenate([self.ids[rows], ids[picked]], axis=1)
            best = np.lexsort((found, distance), axis=1)[:, : self.k]
            self.distance[rows] = np.take_along_axis(distance, best, axis=1)
            self.ids[rows] = np.take_along_axis(found, best, axis=1)
            self.filled[rows] = np.minimum(self.filled[rows] + keep, self.k)

    def rows(self, query_ids: list[Any], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.ids is None:
            return
        step = max(1, 65536 // self.k)
        for start in range(0, len(query_ids), step):
            part = query_ids[start : start + step]
            held = np.arange(self.k) < self.filled[start : start + len(part), None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, n in zip(part, held.sum(axis=1)) for _ in range(n)], schema.field(0).type),
                    pa.array(self.ids[start : start + len(part)][held].tolist(), schema.field(1).type),
                    pa.array(self.distance[start : start + len(part)][held]),
                ],
                schema=schema,
            )


# -- plans --------------------------------------------------------------------


def _output(queries: DataFrame, collection: DataFrame) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", collection.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    return schema, to_arrow_schema(schema)


def _query_blocks(query_rows: pa.Table) -> dict[int, tuple[list, np.ndarray]]:
    """Length -> (query ids, matrix)."""
    ids = query_rows["query_id"].to_pylist()
    found = _by_length(ids, query_rows["embedding"]) if query_rows.num_rows else ()
    return {length: ([ids[p] for p in places], matrix) for length, places, matrix in found}


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows in larger pieces."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller pieces, so that memory goes neither by Spark's batches nor by the size of a partition."""
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(start, PIECE_ROWS)


def _by_broadcast(
    query_rows: pa.Table, queries: DataFrame, collection: DataFrame, k: int, metric: str, balls: bool = False
) -> DataFrame:
    schema, arrow_schema = _output(queries, collection)
    shared = collection.sparkSession.sparkContext.broadcast(_query_blocks(query_rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {length: _Best(matrix, k, metric) for length, (_, matrix) in shared.value.items()}
        for batch in _gathered(batches) if balls else _pieces(batches):
            ids = _ids(batch.column(0))
            for length, places, matrix in _by_length(ids, batch.column(1)):
                if length in best:
                    (best[length].add_by_balls if balls else best[length].add)(ids[places], matrix)
        for length, (query_ids, _) in shared.value.items():
            yield from best[length].rows(query_ids, arrow_schema)

    return collection.select("id", "embedding").mapInArrow(scan, schema)


def _ranked(nearest: DataFrame, k: int) -> DataFrame:
    """Each task sent at most ``k`` rows per query; the filter on rank lets Spark cut before it shuffles."""
    order = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    ranked = nearest.withColumn("rank", order).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "distance")


def _by_rounds(queries: DataFrame, collection: DataFrame, k: int, metric: str, block_queries: int) -> DataFrame:
    """Ranked rows, stored round by round."""
    spark = collection.sparkSession
    queries = written(queries)  # encoded once
    size, longest = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    block = max(1, min(block_queries, MAX_BROADCAST_BYTES // (4 * max(longest or 1, 1))))
    rounds = -(-size // block) or 1
    folder = shared_folder(spark)
    number = F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int")
    queries.withColumn("round", number).repartition(rounds, "round").write.partitionBy("round").parquet(f"{folder}/asked")
    layout = T.StructType([*queries.schema.fields, T.StructField("round", T.IntegerType())])
    asked = spark.read.schema(layout).parquet(f"{folder}/asked")
    for n in range(rounds):
        part = asked.where(F.col("round") == n).drop("round").toArrow()
        found = _ranked(_by_broadcast(part, queries, collection, k, metric, balls=True), k)
        found.write.mode("overwrite").parquet(f"{folder}/found/round={n}")
    return spark.read.schema(found.schema).parquet(f"{folder}/found").drop("round")


def knn(
    queries: DataFrame,
    collection: DataFrame,
    k: int,
    where: dict[str, Any] | None = None,
    metric: str = "l2sq",
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
    block_queries: int = BLOCK_QUERIES,
    columns: tuple[str, ...] = (),
    look_up: Callable[..., DataFrame] | None = None,
) -> DataFrame:
    """``(query_id, rank, id, distance, *columns)``: the ``k`` nearest ids per query, rank from 1.

    ``queries`` has ``query_id, embedding``; ``collection`` has ``id, embedding`` and
    metadata.  ``where`` filters the collection before any distance is computed.
    Vectors with NaN, infinite or null components take no part on either side, and vectors are only
    compared with those of their length (``unusable_vectors`` counts what that leaves out).
    ``columns`` of the collection are looked up for the ranked ids only, so the scan
    that computes distances reads nothing but ids, vectors and filtered fields.  ``look_up(found, columns, small=…)`` does that
    for a collection that knows where its ids are stored (``Collections.look_up_in``); else the collection is scanned for them.
    """
    condition = where_to_column(where)
    allowed = collection if condition is None else collection.where(condition)
    # missing vectors are left out inside the tasks: Spark would push a filter below the encoding and encode every text twice
    searched, wanted = allowed, queries.select("query_id", "embedding")

    head = wanted.limit(max_broadcast_queries + 1).toArrow()
    few = head.num_rows <= max_broadcast_queries and head.nbytes <= MAX_BROADCAST_BYTES
    if few:
        top = _ranked(_by_broadcast(head, wanted, searched, k, metric), k)
    else:
        top = _by_rounds(wanted, searched, k, metric, block_queries)
    if not columns:
        return top
    # k rows per query, with the number of queries checked above
    small = few and head.num_rows * k <= MAX_BROADCAST_RESULTS
    if look_up is not None:
        return look_up(top, columns, small=small).select("query_id", "rank", "id", "distance", *columns)
    details = allowed.select("id", *columns)
    return details.join(F.broadcast(top) if small else top, "id").select(
        "query_id", "rank", "id", "distance", *columns
    )


def unusable_vectors(rows: DataFrame, dimension: int) -> DataFrame:
    """One row: n_rows, n_missing, n_wrong_dimension, n_not_finite; a search leaves all but the first out."""
    v = F.col("embedding")
    wrong = v.isNotNull() & (F.size(v) != dimension)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v.isNull()).alias("n_missing"),
        F.count_if(wrong).alias("n_wrong_dimension"),
        F.count_if(v.isNotNull() & ~wrong & ~finite).alias("n_not_finite"),
    )


def inner_product_top_k(queries: DataFrame, collection: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, id, score)`` by descending inner product."""
    nearest = knn(queries, collection, k, metric="ip")
    score = F.lit(1.0) - F.col("distance")
    return nearest.select("query_id", "rank", "id", F.bround(score, DECIMALS).alias("score"))


def similar_items(items: DataFrame, collection: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` stored items most like each given item, which itself is left out."""
    queries = items.select(F.col("id").alias("query_id"), "embedding")
    nearest = inner_product_top_k(queries, collection, k + 1).where(F.col("id") != F.col("query_id"))
    again = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return nearest.withColumn("rank", again).where(F.col("rank") <= k)

