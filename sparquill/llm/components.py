"""Connected components: by union-find in a task where the edges are few, else by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.session import checkpointed

EDGES_PER_TASK = 1 << 17  # some 40 MB of Python at most


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges of this task."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = top(parent.setdefault(a, a)), top(parent.setdefault(b, b))
            parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(top, part), pa.int64())], names=["node", "component"])


def _both_ways(a: str, b: str, c: str, d: str) -> Column:
    """Two rows (u, v) from one: no union, which would read the edges twice and deal them out again."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ((a, b), (c, d))]))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it sees."""
    both = edges.select(_both_ways("a", "b", "b", "a"))
    smallest = both.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.filter("v > u").join(smallest, "u")
    return joined.select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(smallest, "u").select(_both_ways("u", "m", "v", "m"))
    return linked.filter("u != v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), whole numbers; component is the smallest node reachable.

    Up to ``EDGES_PER_TASK`` edges are joined by one task: star steps would take thousands of tasks with hardly an edge in each.
    For more, each step is an aggregate and a join over the edges; rounds grow with the logarithm of the longest
    path.  Nothing but the number of edges and a checksum comes to the driver.
    """
    edges = checkpointed(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b"))
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] <= EDGES_PER_TASK:
            return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
        if now == state:
            break
        state = now
        edges = checkpointed(_small_star(_large_star(edges)))
    return edges.select(_both_ways("a", "b", "b", "b")).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
