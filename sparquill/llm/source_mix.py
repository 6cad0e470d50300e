"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots.  Slot ``i`` takes the
point ``frac(i * golden ratio)``, which the cumulative target weights map to a source, so that every stretch of
the mix has nearly the right proportions.  A source too small for that gets slots of its own, evenly spread over the same sequence.
The words up to a source's target are cut evenly into as many blocks as it has slots, so every source gives exactly its target
in whole words, whatever its share.  The k-th slot of a source takes the k-th
block of its documents, which stand in a reproducible random order; after the last document the order starts again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.llm.common import filled, query, running_sum, shuffle_key, table, word_count
from sparquill.session import checkpointed

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
# A block is this part of the smallest target, but the points give no more than about MAX_SLOTS slots.  Sources with a target of
# fewer blocks than this have so many slots (or one for each word) of their own.
BLOCKS_PER_SOURCE = 256
MAX_SLOTS = 1 << 20
GOLDEN = 0.6180339887498949  # fractional part of the golden ratio


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = MAX_REPEATS) -> DataFrame:
    """Add source_no, weight and target to one row per source (source, source_size).

    Sources by code point, null last, get ``weights`` in turn.  Together they take ``share`` of all words in
    proportion to the weights; none takes more than ``repeats`` times its size, and what
    it can't take goes to the others by weight.  That is one level ``x`` with target = min(cap, x * weight): with
    the sources in order of cap / weight, the level that follows from filling the first ones is right as soon as
    it fills no further one.  One row per source is the whole input.
    """
    place = W.orderBy(F.col("source").isNull(), "source")
    numbered = sizes.withColumn("source_no", F.row_number().over(place) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("source_no") % len(weights) + 1)
    rows = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(repeats))
    rows = rows.withColumn("limit", F.col("cap") / F.col("weight"))
    order = W.orderBy("limit", "source_no")
    rows = (
        rows.withColumn("all_words", F.sum("source_size").over(W.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.col("all_words") - F.col("full")) / F.col("open"))
        .withColumn("rank", F.row_number().over(order))
    )
    level = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("rank", "level"))).over(W.partitionBy())
    target = F.least(F.col("cap").cast("double"), level.getField("level") * F.col("weight"))
    return rows.withColumn("target", target).select("source", "source_no", "weight", "source_size", "target")


def schedule(spark: SparkSession, bounds: list[float], words: list[int], block: int, n_slots: int) -> DataFrame:
    """The slots (slot, source_no, rank, n_blocks, n_words) for the cumulative shares ``bounds`` of the sources.

    ``rank`` counts the ``n_blocks`` slots of a source, which together have exactly its ``words``.  The points draw the slots of
    sources with at least ``BLOCKS_PER_SOURCE`` blocks; a smaller one has its own, which may lie beside one of another source.
    """
    small = [(s, n, min(n, BLOCKS_PER_SOURCE)) for s, n in enumerate(words) if 0 < n < BLOCKS_PER_SOURCE * block]
    sizes = spark.createDataFrame(list(enumerate(words)), "source_no int, words long")
    point = F.col("slot") * F.lit(GOLDEN) - F.floor(F.col("slot") * F.lit(GOLDEN))
    cuts = np.array(bounds[:-1], dtype=np.float64)  # one number for each source, searched by halving

    @F.arrow_udf("int")
    def source_at(points: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, points.to_numpy(), side="right"), pa.int32())

    drawn = (
        spark.range(n_slots)
        .select((F.col("id") + 1).alias("slot"))
        .withColumn("point", point)
        .withColumn("source_no", source_at("point"))
        .join(F.broadcast(sizes.filter(F.col("words") >= BLOCKS_PER_SOURCE * block)), "source_no")
        .select("slot", "source_no", "words")
    )
    # the first of a small source's slots differs by source, lest all of them meet in the same ones
    phase = (F.col("source_no") + 1) * F.lit(GOLDEN)
    place = (F.col("j") + phase - F.floor(phase)) * n_slots / F.col("n")
    own = (
        spark.createDataFrame(small, "source_no int, words long, n int")
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select((F.floor(place) + 1).alias("slot"), "source_no", "words")
    )
    turn = W.partitionBy("source_no")
    return (
        drawn.unionByName(own)
        .withColumn("rank", (F.row_number().over(turn.orderBy("slot")) - 1).cast("long"))
        .withColumn("n_blocks", F.count(F.lit(1)).over(turn))
        .withColumn("n_words", block_start(F.col("rank") + 1) - block_start(F.col("rank")))
        .filter("n_words > 0")
        .select("slot", "source_no", "rank", "n_blocks", "n_words")
    )


def block_start(rank: Column) -> Column:
    """floor(rank * words / n_blocks), without a product that could leave 64 bits."""
    whole = F.expr("words div n_blocks")
    return rank * whole + F.floor(rank * (F.col("words") - whole * F.col("n_blocks")) / F.col("n_blocks")).cast("long")


def block_of(word: Column) -> Column:
    """The block that holds a word, counted from 0: the largest rank whose start is not behind it."""
    many = (word + 1).cast("decimal(19,0)") * F.col("n_blocks").cast("decimal(19,0)") - 1
    return F.call_function("div", many, F.col("words").cast("decimal(19,0)")).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The measured rows and the pieces of the mix.

    Rows: doc_id, source, size, text_hash, source_size, target, _row.  Pieces: _row, slot, pass (0, 1), first_word, n_words: words of
    the row that stand in that slot, each pass going once through a source.  Size is the
    number of words, 0 for null and empty texts, which enter no slot.  Ids may be null or repeat; every row counts by itself.
    Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(filled(text_col)).alias("text_hash"),
        )
        .withColumn("_key", shuffle_key(F.col("doc_id")))
        .withColumn("_row", F.monotonically_increasing_id())
    )
    goals = checkpointed(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    # one number per source; the corpus itself stays where it is
    plan = goals.orderBy("source_no").select("source_size", "target").collect()
    measured = rows.join(
        goals.select(F.col("source").alias("_source"), "source_no", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")

    total = sum(r["target"] for r in plan)
    smallest = min((r["target"] for r in plan if r["target"] > 0), default=1)
    block = max(1, int(smallest // BLOCKS_PER_SOURCE), int(total // MAX_SLOTS))
    bounds, done = [], 0.0
    for r in plan:
        done += r["target"]
        bounds.append(done / total if total else 1.0)
    words = [int(r["target"]) for r in plan]
    slots = checkpointed(schedule(spark, bounds or [1.0], words or [0], block, int(total // block) + 1))
    counts = slots.groupBy("source_no").agg(F.first("n_blocks").alias("n_blocks"), F.sum("n_words").alias("words"))

    placed = running_sum(measured.filter("size > 0"), "source_no", "_key", "size", "_start", max(rows.count(), 1))
    passes = (
        placed.join(F.broadcast(counts), "source_no")
        .select(
            "_row", "source_no", "size", "words", "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))).alias("pass"),
            (F.col("_start") + F.col("pass") * F.col("source_size")).alias("start"),
        )
        .filter("start < words")
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("words")))
    )
    blocks = passes.select("*", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("end") - 1))).alias("rank"))
    low = F.greatest(F.col("start"), block_start(F.col("rank")))
    high = F.least(F.col("end"), block_start(F.col("rank") + 1))
    pieces = (
        blocks.withColumn("first_word", low - F.col("start"))
        .withColumn("n_words", high - low)
        .filter("n_words > 0")
        .join(slots.select("source_no", "rank", "slot"), ["source_no", "rank"])
        .select("_row", "slot", "pass", "first_word", "n_words")
    )
    return measured, pieces


def taken_words(docs: DataFrame, **columns: str) -> DataFrame:
    """One row per input row: doc_id, source, size, text_hash, source_size, target, taken, pass_words.

    ``pass_words`` has the words taken in each pass; ``taken`` is their sum.
    """
    measured, pieces = mix(docs, **columns)
    per_pass = [F.sum(F.when(F.col("pass") == p, F.col("n_words")).otherwise(0)) for p in range(MAX_REPEATS)]
    taken = pieces.groupBy("_row").agg(F.sum("n_words").alias("taken"), F.array(*per_pass).alias("pass_words"))
    nothing = F.array_repeat(F.lit(0).cast("long"), MAX_REPEATS)
    return measured.join(taken, "_row", "left").select(
        "doc_id", "source", "size", "text_hash", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pass_words", nothing).alias("pass_words"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Whole rows of ``docs``, once for each pass of the schedule that takes at least half of their words.

    Rows that repeat id, source and text share one decision.  Documents without words are in no pass.
    """
    decided = taken_words(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    decided = decided.groupBy("doc_id", "source", "size", "text_hash").agg(F.max("pass_words").alias("pass_words"))
    passes = F.filter("pass_words", lambda n: (n > 0) & (n * 2 >= F.col("size")))
    decided = decided.select("doc_id", "text_hash", "source", F.size(passes).alias("copies")).filter("copies > 0")
    # the row as one value, so that its columns may have any names
    carried = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"),
        F.xxhash64(filled(text_col)).alias("own_hash"), F.col(source_col).alias("own_source"),
    )
    same = (
        F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")) & F.col("own_source").eqNullSafe(F.col("source"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return carried.join(decided, same).select("row", copies).select("row.*")


@query("op8_source_mix")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = taken_words(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
