"""Removal of lines that many documents share.

Lines are exploded with their position, normalised and hashed; distinct documents are
counted per hash; a line that enough documents hold goes everywhere but in one of them;
the rest is put together again by position.

Texts move once, to meet the positions that their document loses.  Everything before that
moves 16 byte hashes and positions.  A line that a third of all documents hold
is counted by (hash, document) first, so no task counts it alone; the join that marks its
occurrences is a plain equi-join whose large partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import BLANKS, ascii_lower, filled, query, table
from sparquill.session import checkpointed

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
_KEY_SALT = "line"


def _lines(text: Column) -> Column:
    return F.split(filled(text), "\n", -1)


def _without(lines: Column, positions: Column) -> Column:
    """The elements outside the sorted ``positions`` (from 0), as the slices between them."""
    ends = F.concat(positions, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(-1)), positions)
    slices = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(slices)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """All rows and columns of ``docs`` under new names: struct ``row``, n_lines, n_dropped, kept_text.

    A line's key is the line without the ASCII blanks at both ends and with A-Z lower-cased.
    Keys of at least ``min_length`` code points in at least ``min_documents`` documents lose
    all lines, except in the largest id that holds them, which keeps every one.  A document is an id: rows
    that repeat an id count once, and rows without id count as one document, below all others.
    Null and empty texts are one empty line.  The input row comes back whole in ``row``, so
    columns of any name are safe.
    """
    source = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64(filled(text_col)).alias("text_hash"),  # tells rows with the same id apart
    )
    text = F.col("row").getField(text_col)
    key = ascii_lower(F.btrim(F.col("line"), F.lit(BLANKS)))
    found = (
        source.select("doc_id", "text_hash", F.posexplode(_lines(text)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_length)
        # 128 bits: two lines of a corpus do not meet by chance
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(_KEY_SALT), "key").alias("h2"))
    )
    shared = checkpointed(  # a stored side: adaptive execution may broadcast it or split what it meets
        found.groupBy("h1", "h2")
        .agg(
            (F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))).alias("n"),
            F.max("doc_id").alias("holder"),
        )
        .filter(F.col("n") >= min_documents)
        .select("h1", "h2", "holder")
    )
    lost = (
        found.join(shared, ["h1", "h2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("lost"))
        .withColumnsRenamed({"doc_id": "lost_id", "text_hash": "lost_hash"})
    )
    joined = source.join(
        lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left"
    )
    kept = F.array_join(_without(_lines(text), F.col("lost")), "\n")
    return joined.select(
        "row",
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), filled(text)).otherwise(kept).alias("kept_text"),
    )


@query(
    "op2_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(cut) + 1)) AS pos, unnest(cut) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS cut FROM documents)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, pos, line, holder IS NOT NULL AND holder <> doc_id AS lost
  FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup(docs)
    return kept.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
