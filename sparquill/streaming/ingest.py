"""Incremental ingest: new files become new rows of a stored collection.

This is where the "checkpoint every N files" habit of a long run ends up in Spark: the
stream remembers which files are done, takes N at a time, and replays a batch that was
interrupted.  Chunking is per document, so nothing is carried between batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.operators import encoding as E
from sparquill.plans.ingest import ingest
from sparquill.sources.collections import Collections
from sparquill.sources.documents import PageReader, extract, pypdf_reader

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ingest(
    spark: SparkSession,
    root: str,
    store: Collections,
    name: str,
    checkpoint: str,
    reader: Callable[[], PageReader] = pypdf_reader,
    encoder: E.Encoder | None = None,
    files_per_batch: int = 50,
    chunk_size: int = vocab.CHUNK_SIZE,
    overlap: int = vocab.CHUNK_OVERLAP,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream; by default it takes all files present now and stops."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
        .where(T.is_pdf_path(F.col("path")))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # a stream has an id of its own, kept with its progress: another one never has the same keys
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        chunks = ingest(extract(batch, reader), chunk_size, overlap)
        rows = E.encode_chunks(chunks, encoder=encoder).withColumnRenamed("text", "document")
        store.add(name, rows, "source_file", "chunk_id", "year_range", key=f"{stream}-{batch_id}")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
