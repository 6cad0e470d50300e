"""k-means that gives the same clusters however the rows are laid out.

Components are scaled to whole numbers, and all sums and distances are sums of whole numbers, which do not depend on their order.
Seeds are the distinct vectors with the least hashes, ties go to the lower cluster, and a new centre is the rounded quotient of two whole
numbers.  A round is one map over the vectors, in which each task adds up its rows for each cluster; only ``k`` centres go
through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 16
LARGEST = float(1 << 20)  # a component beyond it is no whole number of bounded size any more


def _whole(vector) -> F.Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE + 0.5).cast("bigint"))


def _usable(vector, dimension: int) -> F.Column:
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) == dimension) & F.coalesce(good, F.lit(False))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dimension)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equally near ones the first.  Whole numbers below 2**53, so that the products are exact."""
    distance = (rows * rows).sum(axis=1)[:, None] - 2 * (rows @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return distance.argmin(axis=1)


def kmeans(vectors: DataFrame, k: int = 10, seed: int = 42, rounds: int = 20, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with an int column ``cluster`` (0 to k - 1).

    The dimension is that of most vectors (the larger of equally frequent ones); vectors that are null, of another length or hold null, non-finite or
    huge components have no cluster.  Rounds end when no centre moves.  With fewer distinct vectors than ``k`` there are fewer clusters.
    A cluster without rows keeps its centre.
    """
    v = F.col(vector_col)
    sizes = vectors.where(v.isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    dimension = int(most["size"])
    whole = vectors.select(F.when(_usable(v, dimension), _whole(v)).alias("_whole")).where(F.col("_whole").isNotNull())
    text = F.array_join(F.transform("_whole", lambda x: x.cast("string")), ",")
    hashed = whole.select(F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")).alias("h"), "_whole")
    seeds = hashed.groupBy("h").agg(F.min("_whole").alias("_whole")).orderBy("h").limit(k)  # at most k vectors
    centres = np.array([r["_whole"] for r in seeds.collect()], dtype=np.float64).reshape(-1, dimension)
    for _ in range(rounds):
        moved = _moved(whole, centres, dimension)
        if np.array_equal(moved, centres):
            break
        centres = moved

    @F.arrow_udf("int")
    def assign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.zeros(len(batch), dtype=np.int32)
            known = batch.is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                found[known] = _nearest(_matrix(batch.filter(batch.is_valid()), dimension), centres)
            yield pa.array(found, pa.int32(), mask=~known)

    if not len(centres):
        return vectors.withColumn("cluster", F.lit(None).cast("int"))
    return vectors.withColumn("cluster", assign(F.when(_usable(v, dimension), _whole(v))))


def _moved(whole: DataFrame, centres: np.ndarray, dimension: int) -> np.ndarray:
    """The centres after one round."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centres.shape, dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0), dimension)
                cluster = _nearest(rows, centres)
                np.add.at(sums, cluster, rows.astype(np.int64))
                counts += np.bincount(cluster, minlength=len(centres))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    partial = whole.mapInArrow(add_up, "cluster long, n long, sums array<long>")
    counted = partial.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    totals = counted.groupBy("cluster", "place").agg(F.sum("part").alias("total"), F.sum("n").alias("n"))
    moved = centres.copy()
    for r in totals.collect():  # k times dimension rows
        moved[r["cluster"], r["place"]] = (2 * r["total"] + r["n"]) // (2 * r["n"])
    return moved
