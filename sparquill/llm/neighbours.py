"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors are normalised, so the nearest by cosine is the nearest by distance.  A vector is indexed by few numbers: its coordinates along
the ``LEADING`` directions of its tree's vectors, and ``PROJECTED`` Gaussian projections of what these leave over.  Squared distance
along the leading directions is part of the true one.  For the rest, squared projected distance divided by the true one follows
a chi-square law, so divided by a high quantile of it, it is below the true one with the chance ``SURE``.  With the projections
scaled by that quantile, the squared distance of two indexed points is such a bound as a whole.

Each task builds kd-trees over the points of its rows.  For a query it verifies the nearest leaf on the original vectors, then takes
the points of all leaves that may hold a nearer row in order of their distance, until the next point is farther than the fifth
best row verified so far: a row closer than that would lie beyond with a chance below ``1 - SURE``.

All rows are indexed, in parts of bounded bytes.  A part and the queries meet in one sorted stream: first the part's vectors, whose
tree is built once, then the query vectors, which pass one after the other.  Neither side goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.llm.common import query, table

K = 5
LEADING = 8  # directions
PROJECTED = 24  # dimensions, even
SURE = 0.98
LEAF = 64  # rows
TREE_BYTES = 64 << 20  # vectors under one tree
SAMPLE = 2048  # vectors of a tree that its leading directions are fitted to
FIRST = 128  # rows verified in one step at first; each further step takes twice as many
LEAST_PART = 1024  # rows; smaller parts are not made only to keep all cores busy


def chi_square_quantile(p: float, m: int) -> float:
    """The value that a chi-square variable with an even number ``m`` of degrees stays under with chance ``p``."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


class ProjectionTree:
    """A kd-tree over the indexed points of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, limit: float):
        dimension = vectors.shape[1]
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        sample = vectors[:: max(1, len(vectors) // SAMPLE)][:SAMPLE] / norms[:: max(1, len(vectors) // SAMPLE)][:SAMPLE, None]
        self._leading = np.linalg.svd(sample, full_matrices=False)[2][:LEADING].T
        self._directions = np.random.default_rng(dimension).normal(size=(dimension, PROJECTED)) / math.sqrt(limit)
        points = self.project(vectors, norms)
        order, sizes = [], []
        stack = [np.arange(len(ids))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                order.append(rows)
                sizes.append(len(rows))
                continue
            axis = int(np.ptp(points[rows], axis=0).argmax())
            half = len(rows) // 2
            rows = rows[np.argpartition(points[rows, axis], half)]
            stack += [rows[half:], rows[:half]]
        # the rows of a leaf stand together
        order = np.concatenate(order)
        self.ids, self.vectors, self.norms, self.points = ids[order], vectors[order], norms[order], points[order]
        self.squares = (self.points * self.points).sum(axis=1)
        self.begins = np.cumsum(sizes) - sizes
        self.leaf_of = np.repeat(np.arange(len(sizes)), sizes)
        self.low = np.minimum.reduceat(self.points, self.begins)
        self.high = np.maximum.reduceat(self.points, self.begins)
        self.repeats = len(np.unique(ids)) < len(ids)
        self.verified = 0  # rows whose original vectors were looked at

    def project(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        unit = vectors / norms[:, None]
        along = unit @ self._leading
        return np.concatenate((along, (unit - along @ self._leading.T) @ self._directions), axis=1)

    def search(self, own: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best ``k`` ids found, each by its best row, ties by id; rows with the id ``own`` are left out."""
        norm = np.sqrt((vector * vector).sum())
        point = self.project(vector[None, :], np.array([norm]))[0]
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        boxes = (gap * gap).sum(axis=1)
        ids, scores = np.empty(0, dtype=self.ids.dtype), np.empty(0)

        def verify(rows: np.ndarray) -> None:
            nonlocal ids, scores
            self.verified += len(rows)
            if len(ids) == k:  # a fast product first, as most rows cannot come in; near ties are looked at below
                rows = rows[(self.vectors[rows] @ vector) >= (scores[-1] - 1e-9) * norm * self.norms[rows]]
            rows = rows[self.ids[rows] != own]
            if not len(rows):
                return
            found = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * norm)
            ids, scores = np.concatenate((ids, self.ids[rows])), np.concatenate((scores, found))
            best = np.lexsort((ids, -scores))
            if self.repeats:  # before the cut, or the rows of one id could fill all places
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
            ids, scores = ids[best[:k]], scores[best[:k]]

        def reach() -> float:
            """No row beyond this squared distance can be among the best."""
            return 2 - 2 * scores[-1] + 1e-9 if len(ids) == k else math.inf

        first = int(np.argmin(boxes))
        begin = int(self.begins[first])
        end = int(self.begins[first + 1]) if first + 1 < len(self.begins) else len(self.ids)
        verify(np.arange(begin, end))
        open_leaves = boxes <= reach()
        if open_leaves.mean() > 0.5:  # most of the tree: no need to copy its points
            near = self.squares - 2 * (self.points @ point) + point @ point
            rows = np.flatnonzero(near <= reach())
            near = near[rows]
        else:
            rows = np.flatnonzero(open_leaves[self.leaf_of])
            near = self.squares[rows] - 2 * (self.points[rows] @ point) + point @ point
            rows, near = rows[near <= reach()], near[near <= reach()]
        other = (rows < begin) | (rows >= end)
        rows, near = rows[other], near[other]
        if len(rows) > 2 * FIRST:  # the nearest points at once, as what they leave open is much less to sort
            chosen = np.argpartition(near, FIRST)
            verify(rows[chosen[:FIRST]])
            rest = chosen[FIRST:][near[chosen[FIRST:]] <= reach()]
            rows, near = rows[rest], near[rest]
        nearest_first = np.argsort(near)
        rows, near = rows[nearest_first], near[nearest_first]
        at, step = 0, FIRST
        while at < len(rows) and near[at] <= reach():
            to = min(at + step, int(np.searchsorted(near, reach(), side="right")))
            verify(rows[at:to])
            at, step = to, min(2 * step, 4096)
        return ids, scores


def _searcher(k: int, limit: float):
    """Task function over rows (length, part, kind, vec_id, v), sorted: of each part the vectors (kind 0), then the queries (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            asked, found = [], []
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                length, number, kind = keys[begin].tolist()
                if (length, number) != part:
                    part, held, tree = (length, number), [], None
                ids = batch.column(3).slice(begin, end - begin).to_numpy()
                vectors = batch.column(4).slice(begin, end - begin).flatten().to_numpy().reshape(len(ids), length)
                if kind == 0:
                    held.append((ids, vectors))
                    continue
                if tree is None and held:
                    tree = ProjectionTree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), limit)
                    held = []
                if tree is not None:
                    asked.append(ids)
                    found += [tree.search(own, q, k) for own, q in zip(ids.tolist(), vectors)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.concatenate(asked), [len(f[0]) for f in found])),
                        pa.array(np.concatenate([f[0] for f in found])),
                        pa.array(np.concatenate([f[1] for f in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` rows found for each row that ``is_query`` chooses.

    ``score`` is the cosine in double precision, ties go to the smaller id.  Rows with a null id, and vectors that
    are null, empty, zero or hold null or non-finite components take no part.  Vectors are compared with those of
    the same length.  A query is not its own neighbour, nor is a row that repeats its id.  Rows that repeat an id count once, by
    the nearest of them.
    """
    usable = vectors.filter(_usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    rows = usable.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    ).withColumn("length", F.size("v"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    fit = F.greatest(F.lit(1), F.floor(F.lit(TREE_BYTES) / (8 * F.col("length"))))  # rows of a full part
    parts = F.greatest(F.ceil(F.col("n") / fit), F.least(F.lit(cores), F.floor(F.col("n") / LEAST_PART)), F.lit(1)).cast("int")
    lengths = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).select("length", parts.alias("parts"))  # one row, if the table is in order
    n_parts = lengths.agg(F.sum("parts")).first()[0] or 1
    sized = rows.join(lengths, "length")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    indexed = sized.select("length", part.alias("part"), F.lit(0).alias("kind"), "vec_id", "v")
    # of the rows that repeat an id, one asks: the least vector
    asked = sized.filter("is_query").groupBy("length", "parts", "vec_id").agg(F.min("v").alias("v"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asked = asked.select("length", every.alias("part"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = indexed.unionByName(asked).repartitionByRange(int(n_parts), "length", "part").sortWithinPartitions("length", "part", "kind")
    best = dealt.mapInArrow(_searcher(k, chi_square_quantile(SURE, PROJECTED)), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # an id may repeat under several trees
    distinct = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
