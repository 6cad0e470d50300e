"""The corpus pipeline: toxicity, line dedup, near-duplicate removal, source mix, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows its predecessor kept.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparquill.llm.line_dedup import line_dedup  # noqa: E402
from sparquill.llm.near_dedup import drop_near_copies  # noqa: E402
from sparquill.llm.packing import pack, packed_texts  # noqa: E402
from sparquill.llm.source_mix import mixed_documents  # noqa: E402
from sparquill.llm.toxicity import fit, score  # noqa: E402
from sparquill.session import ensure_checkpoint_dir  # noqa: E402


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows outside the held-out fifth."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(model, F.col("text")).alias("score"))
    return scored.filter("score < 0.5").select("row.*")


def remove_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least three documents hold stay in one of them; n_chars follows, where the table has it."""
    kept = line_dedup(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    untouched = F.col("n_dropped") == 0  # null texts stay null
    return kept.select(
        *[F.when(untouched, F.col("row").getField(c)).otherwise(changed[c]).alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns]
    )


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once or twice, or not at all, so that the sources come near their target weights."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence (bin), their place in it and their text."""
    placed = pack(docs)
    return packed_texts(docs, placed).drop("text_md5")


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_shared_lines),
    ("MinHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# A trained classifier and best-fit packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet in the shared folder and read again.

    A result is deleted once its successor is written; the input of the last stage stays, as the returned rows come from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        before = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{k - 1}")
        before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)
