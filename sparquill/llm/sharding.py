"""Shards of near equal size by best-fit-decreasing packing of indivisible groups.

Groups (copies of one text) are weighed by a plain aggregate.  The few that hold more
than a 1024th of all bytes or rows, a number bounded by that rule, are packed first.
The many small ones are hashed into parts of bounded size; every part packs its own
groups, largest first, into its share of what the large ones left free.  Packing puts a
group where the least room remains after it (a successor search in a balanced tree of
residual capacities) and, where it fits nowhere, into the emptiest bin.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import filled, numbered_copies, query, running_sum, shuffle_key, table
from sparquill.session import checkpointed

LARGE = 1024  # groups above this fraction of the bytes or rows are packed one by one
GROUPS_PER_PART = 50_000


class ResidualTree:
    """A balanced search tree (treap) of (residual capacity, bin)."""

    def __init__(self, seed: int = 1):
        self._root = None  # [key, priority, left, right]
        self._state = seed

    def _priority(self) -> int:
        self._state = (self._state * 6364136223846793005 + 1442695040888963407) % 2**64
        return self._state >> 16

    def insert(self, key: tuple) -> None:
        priority = self._priority()
        path, node = [], self._root
        while node is not None and node[1] >= priority:
            path.append(node)
            node = node[2] if key < node[0] else node[3]
        less, more = self._split(node, key)
        new = [key, priority, less, more]
        if not path:
            self._root = new
        else:
            path[-1][2 if key < path[-1][0] else 3] = new

    @staticmethod
    def _split(node, key):
        """The parts of a subtree below and above ``key``."""
        less_top, more_top = [None, 0, None, None], [None, 0, None, None]
        less, more = less_top, more_top
        while node is not None:
            if node[0] < key:
                less[3], less, node = node, node, node[3]
            else:
                more[2], more, node = node, node, node[2]
        less[3] = more[2] = None
        return less_top[3], more_top[2]

    def remove(self, key: tuple) -> None:
        parent, side, node = None, 0, self._root
        while node[0] != key:
            parent, side = node, (2 if key < node[0] else 3)
            node = node[side]
        merged = self._merge(node[2], node[3])
        if parent is None:
            self._root = merged
        else:
            parent[side] = merged

    @staticmethod
    def _merge(a, b):
        top = [None, 0, None, None]
        at, side = top, 2
        while a is not None and b is not None:
            if a[1] >= b[1]:
                at[side], at, side, a = a, a, 3, a[3]
            else:
                at[side], at, side, b = b, b, 2, b[2]
        at[side] = a if a is not None else b
        return top[2]

    def successor(self, key: tuple) -> tuple | None:
        """The smallest key that is at least ``key``."""
        found, node = None, self._root
        while node is not None:
            if node[0] >= key:
                found, node = node[0], node[2]
            else:
                node = node[3]
        return found

    def largest(self) -> tuple | None:
        node = self._root
        while node is not None and node[3] is not None:
            node = node[3]
        return node[0] if node is not None else None


def best_fit(sizes: Iterable[int], residuals: Iterable[int] = (), capacity: int | None = None) -> tuple[list[int], list[int]]:
    """The bin of each size, taken in the given order, and the bins' residuals afterwards.

    Open bins have ``residuals``.  A size that fits none opens a new bin of ``capacity``; without
    a capacity it goes to the bin with the largest residual, which may become negative.
    """
    left = list(residuals)
    tree = ResidualTree()
    for number, room in enumerate(left):
        tree.insert((room, number))
    bins = []
    for size in sizes:
        spot = tree.successor((size, -1))
        if spot is None and capacity is not None:
            spot = (max(capacity, size), len(left))
            left.append(spot[0])
        else:
            spot = spot or tree.largest()
            tree.remove(spot)
        left[spot[1]] = spot[0] - size
        tree.insert((left[spot[1]], spot[1]))
        bins.append(spot[1])
    return bins, left


def pack_groups(groups: DataFrame, n_shards: int) -> tuple[DataFrame, list]:
    """The shard of each row of ``groups`` (digest, bytes, n), largest groups first.

    Returns the small groups' shards (digest, shard) as a DataFrame and the large groups as a list of
    (digest, pieces, shards): a group above one shard's fair size can't stay whole and is cut into the fewest
    pieces that fit, the others are one piece.
    """
    spark = groups.sparkSession
    total, rows, n_groups = groups.agg(F.sum("bytes"), F.sum("n"), F.count(F.lit(1))).first()
    if not n_groups:
        return groups.select("digest", F.lit(0).alias("shard")).limit(0), []
    fair = max(1, -(-total // n_shards))
    big = (F.col("bytes") * LARGE >= total) | (F.col("n") * LARGE >= rows)  # at most 2 * LARGE groups
    large = groups.filter(big).orderBy(F.desc("bytes"), "digest").collect()
    pieces = [(r["bytes"] // k, r["digest"], k) for r in large for k in [min(-(-r["bytes"] // fair), r["n"])] for _ in range(k)]
    pieces.sort(key=lambda p: (-p[0], bytes(p[1])))
    placed, residuals = best_fit([p[0] for p in pieces], [fair] * n_shards)
    shards: dict[bytes, list[int]] = {}
    for (_, digest, _), shard in zip(pieces, placed):
        shards.setdefault(bytes(digest), []).append(shard)
    found = [(bytearray(digest), len(s), s) for digest, s in shards.items()]

    room = np.maximum(np.array(residuals, dtype=float), 0)
    share = room / room.sum() if room.sum() else np.full(n_shards, 1 / n_shards)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bytes", "digest"], ascending=[False, True], kind="stable")
        sizes = [int(x) for x in part["bytes"]]
        bins, _ = best_fit(sizes, [int(x) for x in np.ceil(share * sum(sizes))])
        return pd.DataFrame({"digest": part["digest"].to_numpy(), "shard": np.array(bins, dtype=np.int32)})

    parts = max(1, -(-n_groups // GROUPS_PER_PART))
    if parts == 1:  # few groups: still not all in one task where there are thousands
        parts = max(1, min(spark.sparkContext.defaultParallelism, n_groups // 2000))
    small = (
        groups.filter(~big)
        .select("digest", "bytes", F.pmod(F.xxhash64("digest"), F.lit(parts)).alias("part"))
        .groupBy("part")
        .applyInPandas(pack, "digest binary, shard int")
    )
    return small, found


def shard_documents(
    docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot, split_group.

    Rows of equal text share a shard unless together they exceed a shard's fair size
    (``split_group``).  Null texts count as empty.  Slots run from 0 within a shard, in a reproducible random
    order.  The result does not depend on how the rows are partitioned.  Ids may be null or repeat.  Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    text = filled(text_col)
    measured = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
    )
    rows = checkpointed(numbered_copies(measured).withColumn("_row", F.xxhash64("doc_id", "digest", "_copy")).drop("_copy"))
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    small, large = pack_groups(groups, n_shards)
    big = spark.createDataFrame(large, "digest binary, pieces int, shards array<int>")
    piece = F.pmod(F.xxhash64("doc_id", "_row"), F.col("pieces")).cast("int")
    hot = rows.join(F.broadcast(big), "digest").withColumn("shard", F.get("shards", piece))
    hot = hot.withColumn("split_group", F.col("pieces") > 1).drop("pieces", "shards")
    cold = rows.join(F.broadcast(big.select("digest")), "digest", "left_anti").join(small, "digest")
    placed = hot.unionByName(cold.withColumn("split_group", F.lit(False)))
    placed = placed.withColumn("_key", shuffle_key(F.col("doc_id"), F.col("_row"))).withColumn("_one", F.lit(1))
    numbered = running_sum(placed, "shard", "_key", "_one", "slot", rows.count() // n_shards)
    return numbered.select("doc_id", "size", "text_crc32", "shard", "slot", "split_group")


@query("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_documents(table(spark, sf_dir, "documents"), 16)
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
