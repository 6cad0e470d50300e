"""Exact deduplication with frequent digests removed on the map side.

Texts are equal when their SHA-256 after deleting ASCII blanks is equal.  A Misra-Gries
type summary (Spark's frequent-items sketch) over the digests names the few that may be
frequent; their groups are aggregated exactly, and the winners, whose number is bounded
by the size of the summary, are broadcast.  Rows of those groups get their verdict where
they lie.  All other digests are rare by construction, so one ordinary shuffle brings
each group together.  Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.llm.common import BLANK, filled, query, table
from sparquill.session import checkpointed

TRACKED = 4096  # entries of a summary: power of two, 16 bytes each
FREQUENT = 1024  # digests handed to the broadcast at most
MERGERS = 64  # summaries meet in so many tasks before the last one


def frequent_items(rows: DataFrame, item: Column, tracked: int = TRACKED, frequent: int = FREQUENT) -> DataFrame:
    """At most ``frequent`` values of ``item``, among them every one above its share of the rows.

    One summary per task, merged in two steps, so that no task reads one from every other.
    """
    return (
        rows.select(item.alias("item"), (F.spark_partition_id() % MERGERS).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(item, {tracked})").alias("summary"))
        .groupBy(F.col("part") < 0)  # one group, but none where a task has no summary
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {tracked}), {frequent})").alias("top"))
        .select(F.explode("top").alias("top"))
        .select(F.col("top.item").alias("item"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, heavy.

    Of equal texts the row with the most code points stays, then the one with the smallest
    id; a null id ranks last, and of fully equal rows exactly one stays.  A null text counts
    as empty; empty and blank texts are equal to each other.  ``heavy`` tells the rows
    that were decided by the broadcast.  Other columns are neither read nor returned.
    """
    text = filled(text_col)
    digests = checkpointed(  # some 80 bytes a row; every later step reads these and no text
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.length(text).alias("n_code_points"),
            F.unhex(F.sha2(F.regexp_replace(text, BLANK + "+", ""), 256)).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    rank = F.struct(-F.col("n_code_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    digests = digests.select("doc_id", "row", "digest", rank.alias("rank"))

    short = F.xxhash64("digest")
    candidates = frequent_items(digests, short)
    winners = checkpointed(
        digests.join(F.broadcast(candidates), short == F.col("item"), "left_semi")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("rank").alias("best"))
        .filter("group_size > 1")
    )
    heavy = digests.join(F.broadcast(winners), "digest").withColumn("heavy", F.lit(True))

    same = W.partitionBy("digest")
    rare = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("best", F.min("rank").over(same))
        .withColumn("heavy", F.lit(False))
    )
    return heavy.unionByName(rare).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "heavy",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; ids must be unique and not null."""
    stay = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(id_col))
    return docs.join(stay, id_col, "left_semi").select(*docs.columns)


@query(
    "op1_exact_dedup",
    r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("heavy")
