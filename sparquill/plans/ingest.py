"""Documents to chunks, with per-document outcomes and run statistics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.operators.chunking import chunk_documents, fold_plain, fold_sections
from sparquill.schemas import CHUNK_COLUMNS
from sparquill.sources.chunk_files import write_run_metadata


def outcomes(
    documents: DataFrame,
    chunk_size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
    sections: bool = True,
) -> DataFrame:
    """One row per ``(path, text)`` document: pages, chunks, and whether it succeeded.

    A document without a single chunk counts as failed.  The count is taken inside the
    row, so no chunk is shuffled to find out.
    """
    fold = fold_sections if sections else fold_plain
    long_enough = F.length(T.strip(F.coalesce(F.col("text"), F.lit("")))) >= vocab.MIN_DOCUMENT_CHARS
    n_chunks = F.when(long_enough, F.size(fold(F.col("text"), chunk_size, overlap))).otherwise(0)
    counted = documents.select(
        "path",
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(T.PAGE_MARKER)).alias("n_pages"),
        n_chunks.alias("n_chunks"),
    )
    return counted.withColumn("succeeded", F.col("n_chunks") > 0)


def statistics(per_document: DataFrame) -> DataFrame:
    """One row of run statistics."""
    ocr = [F.coalesce(F.sum("ocr_used"), F.lit(0)).alias("ocr_used")] if "ocr_used" in per_document.columns else []
    totals = per_document.agg(
        *ocr,
        F.count(F.lit(1)).alias("total_pdfs"),
        F.count_if("succeeded").alias("successful"),
        F.count_if(~F.col("succeeded")).alias("failed"),
        F.coalesce(F.sum("n_pages"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("total_chunks"),
    )
    average = F.col("total_chunks") / F.greatest(F.col("successful"), F.lit(1))
    return totals.withColumn("chunks_per_pdf", T.round_half_even(average, 1))


def ingest(
    extracted: DataFrame,
    chunk_size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
    sections: bool = True,
    strict_years: bool = False,
    tokenizer: Callable | None = None,
) -> DataFrame:
    """Extracted files ``(path, pages, …)`` to chunk rows."""
    documents = extracted.select(
        T.mark_pages(F.col("pages")).alias("text"),
        T.file_name(F.col("path")).alias("source_file"),
        T.extract_year_range(F.col("path"), strict_years).alias("year_range"),
    )
    return chunk_documents(documents, chunk_size, overlap, sections, tokenizer=tokenizer)


def process(
    extracted: DataFrame,
    chunk_size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
    sections: bool = True,
    strict_years: bool = False,
) -> DataFrame:
    """One row per extracted file with all that a run needs, from one fold over its text.

    ``path, source_file, year_range, n_pages, ocr_used, error, chunks, n_chunks, succeeded``.  ``n_pages`` are the file's own
    pages, blank and unreadable ones included.  Store this once (``write_run`` does) and derive chunks, statistics and errors from it.
    """
    fold = fold_sections if sections else fold_plain
    marked = extracted.withColumn("_text", F.coalesce(T.mark_pages(F.col("pages")), F.lit("")))
    folded = fold(F.col("_text"), chunk_size, overlap)
    long_enough = F.length(T.strip(F.col("_text"))) >= vocab.MIN_DOCUMENT_CHARS
    files = marked.select(
        "path",
        T.file_name(F.col("path")).alias("source_file"),
        T.extract_year_range(F.col("path"), strict_years).alias("year_range"),
        "n_pages",
        "ocr_used",
        "error",
        F.when(long_enough, folded).otherwise(F.slice(folded, 1, 0)).alias("chunks"),
    )
    return files.withColumn("n_chunks", F.size("chunks")).withColumn("succeeded", F.col("n_chunks") > 0)


def chunks_of(files: DataFrame) -> DataFrame:
    """Chunk rows of processed files."""
    rows = files.select("source_file", "year_range", F.posexplode("chunks").alias("chunk_id", "chunk"))
    inside = ("text", "page_number", "token_count", "section")
    return rows.select(*[F.col(f"chunk.{c}") if c in inside else F.col(c) for c in CHUNK_COLUMNS])


def errors_of(files: DataFrame) -> DataFrame:
    """``(file, error)`` of the files that could not be read."""
    return files.where(F.col("error").isNotNull()).select(F.col("path").alias("file"), "error")


def write_run(files: DataFrame, path: str, configuration: dict[str, Any]) -> DataFrame:
    """Store processed files once below ``path``, then ``chunks``, ``errors`` and the run record from what was stored."""
    root = path.rstrip("/")
    files.write.mode("overwrite").parquet(f"{root}/files")
    stored = files.sparkSession.read.schema(files.schema).parquet(f"{root}/files")
    chunks_of(stored).write.mode("overwrite").json(f"{root}/chunks")
    errors_of(stored).write.mode("overwrite").json(f"{root}/errors")
    write_run_metadata(statistics(stored), f"{root}/run", configuration)
    return stored
