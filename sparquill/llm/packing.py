"""Packing documents into sequences of fixed length, without conflicts inside a sequence.

Texts longer than a sequence are cut into pieces.  Pieces enter bins by best fit, largest first.  Bins
stand in order of the room they have left and carry one bitmap of sources and one of duplicate clusters: the
search starts at the tightest bin with room enough and goes on to the next until a bin holds neither the piece's source nor its
cluster; where none does, a new bin opens.

Pieces are hashed into parts of bounded size and each part is packed by one task, so a source or a cluster of copies that makes up a
third of the corpus is spread over all parts.  A source too frequent to stand in
each bin only once gets several bits (lanes), as many as an average full bin holds of it, and each piece takes one of them by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import filled, numbered_copies, query, table, word_count, BLANK, WORD
from sparquill.session import checkpointed

CAPACITY = 2048  # words of a sequence
PIECES_PER_PART = 8192
_BIN_BITS = 24  # bin number within a part; parts hold far fewer pieces


def _bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Word and bit of each code in a bitmap of all codes; -1 has no bit."""
    words = int(codes.max(initial=-1)) // 64 + 1
    bit = np.where(codes >= 0, np.uint64(1) << (codes % 64).astype(np.uint64), np.uint64(0))
    return np.maximum(codes, 0) // 64, bit, max(words, 1)


def conflict_best_fit(
    sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the given order.

    ``sources`` and ``clusters`` are small codes; -1 conflicts with nothing.  Pieces are no larger than ``capacity``.
    """
    n = len(sizes)
    source_word, source_bit, source_words = _bits(sources)
    cluster_word, cluster_bit, cluster_words = _bits(clusters)
    in_source = np.zeros((64, source_words), dtype=np.uint64)
    in_cluster = np.zeros((64, cluster_words), dtype=np.uint64)
    room = np.empty(n, dtype=np.int64)  # ascending
    bin_at = np.empty(n, dtype=np.int64)
    open_bins = made = 0
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i in range(n):
        size = sizes[i]
        at, spot, step = int(np.searchsorted(room[:open_bins], size)), -1, 16
        while at < open_bins:
            these = bin_at[at : min(at + step, open_bins)]
            clash = (in_source[these, source_word[i]] & source_bit[i]) | (in_cluster[these, cluster_word[i]] & cluster_bit[i])
            free = clash == 0
            first = int(free.argmax())
            if free[first]:
                spot = at + first
                break
            at, step = at + step, 256
        if spot < 0:
            number, left = made, capacity
            made += 1
            if made > len(in_source):
                in_source = np.concatenate((in_source, np.zeros_like(in_source)))
                in_cluster = np.concatenate((in_cluster, np.zeros_like(in_cluster)))
            spot = open_bins
            open_bins += 1
        else:
            number, left = int(bin_at[spot]), int(room[spot])
        bins[i], offsets[i] = number, capacity - left
        in_source[number, source_word[i]] |= source_bit[i]
        in_cluster[number, cluster_word[i]] |= cluster_bit[i]
        left -= size
        to = int(np.searchsorted(room[:spot], left, side="right"))
        room[to + 1 : spot + 1] = room[to:spot].copy()
        bin_at[to + 1 : spot + 1] = bin_at[to:spot].copy()
        room[to], bin_at[to] = left, number
    return bins, offsets


def _codes(values: pd.Series) -> np.ndarray:
    return pd.factorize(values)[0]


def pack(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per piece: doc_id, source, cluster, piece, n_pieces, first_word, n_words, bin, bin_offset.

    ``cluster`` is the MD5 of the text without ASCII blanks: a bin holds no two pieces of one cluster, and of a source
    no more than its lanes.  A document without words (null, empty or blank text) is one piece of 0 words
    with a null bin.  Null sources are a source of their own.  Ids may be null or repeat; each row is packed by itself.
    The result does not depend on how the rows are partitioned.
    Other columns are neither read nor returned.
    """
    measured = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.md5(F.regexp_replace(filled(text_col), BLANK + "+", "")).alias("cluster"),
        F.md5(filled(text_col)).alias("text_md5"),
        word_count(F.col(text_col)).alias("size"),
    )
    number = F.xxhash64("doc_id", "source", "text_md5", "_copy")
    rows = checkpointed(numbered_copies(measured).withColumn("_row", number).drop("_copy"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(capacity))).cast("int")
    pieces = (
        rows.withColumn("n_pieces", n_pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("first_word", F.col("piece").cast("long") * capacity)
        .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("first_word")))
    )
    filled_pieces = pieces.filter("n_words > 0")
    per_source = filled_pieces.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    totals = per_source.agg(F.sum("n"), F.sum("words")).first()
    n, words = totals[0] or 0, totals[1] or 0
    # of an average full bin of capacity / (words / n) pieces, this source's share
    lanes = per_source.select(
        F.col("source").alias("_source"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(max(words, 1)) * capacity)).cast("int").alias("lanes"),
    )
    parts = max(1, -(-n // PIECES_PER_PART))
    where = F.xxhash64("_row", "piece")
    dealt = (
        filled_pieces.join(lanes, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("lane", F.pmod(F.xxhash64(F.lit("lane"), "_row", "piece"), F.col("lanes")))
        .select("doc_id", "source", "cluster", "text_md5", "piece", "n_pieces", "first_word", "n_words", "_row", "lane", F.pmod(where, F.lit(parts)).alias("part"))
    )

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "_row", "piece"], ascending=[False, True, True], kind="stable")
        source = _codes(part["source"].map(lambda s: "" if s is None else f"={s}") + ":" + part["lane"].astype(str))
        alone = ~part["cluster"].duplicated(keep=False).to_numpy()
        cluster = _codes(part["cluster"].where(~alone))  # only clusters that could meet need a bit
        bins, offsets = conflict_best_fit(part["n_words"].to_numpy(), source, cluster, capacity)
        part = part.assign(bin=(part["part"].to_numpy() << _BIN_BITS) + bins, bin_offset=offsets)
        return part[[f.split()[0] for f in schema.split(", ")]]

    schema = "doc_id long, source string, cluster string, text_md5 string, piece int, n_pieces int, first_word long, n_words long, bin long, bin_offset long"
    placed = dealt.groupBy("part").applyInPandas(place, schema)
    nowhere = pieces.filter("n_words <= 0").withColumn("n_words", F.lit(0).cast("long"))
    nowhere = nowhere.withColumn("bin", F.lit(None).cast("long")).withColumn("bin_offset", F.lit(None).cast("long"))
    return placed.unionByName(nowhere.select(*placed.columns))


def packed_texts(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``text``, the piece with its blanks, to placed pieces of the same ``docs``."""
    texts = docs.select(F.col(id_col).alias("_id"), filled(text_col).alias("_text"))
    texts = texts.withColumn("_md5", F.md5("_text")).dropDuplicates(["_id", "_md5"])
    words = F.regexp_extract_all("_text", F.lit(f"{BLANK}*{WORD}"), F.lit(0))
    piece = F.array_join(F.slice(words, F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), "")
    joined = placed.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")))
    return joined.withColumn("text", F.when(F.col("n_pieces") == 1, F.col("_text")).otherwise(piece)).select(*placed.columns, "text")


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("text_md5")
