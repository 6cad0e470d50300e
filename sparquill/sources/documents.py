"""Finding and reading document files."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparquill import vocab
from sparquill.functions import text as T

# A reader turns file content into one callable per page, so that a page that cannot be
# read does not take the other pages with it.  Both are built once per worker task.
PageReader = Callable[[bytes], list[Callable[[], str]]]
Ocr = Callable[[bytes, int], str | None]

HELD_BYTES = 4 << 20  # text that a task holds as Python objects before it hands the rows on

_EXTRACTED = "struct<pages:array<struct<number:int,body:string>>,n_pages:int,ocr_used:int,error:string>"


def find_files(spark: SparkSession, root: str, case_sensitive: bool = False) -> DataFrame:
    """All PDF files below ``root``.  Contents are only read if ``content`` is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(T.is_pdf_path(F.col("path"), case_sensitive))


def pypdf_reader() -> PageReader:
    from pypdf import PdfReader  # optional

    return lambda content: [page.extract_text for page in PdfReader(io.BytesIO(content)).pages]


def tesseract_ocr() -> Ocr:
    import pytesseract  # optional
    from pdf2image import convert_from_bytes  # optional

    def recognise(content: bytes, page: int) -> str | None:
        images = convert_from_bytes(content, first_page=page, last_page=page, dpi=vocab.OCR_DPI)
        return pytesseract.image_to_string(images[0]) if images else None

    return recognise


def _read_file(content: bytes, read: PageReader, recognise: Ocr | None) -> dict:
    pages, ocr_used = [], 0
    sheets = read(content)
    for number, sheet in enumerate(sheets, 1):
        try:
            body = sheet()
            if recognise is not None and len((body or "").strip()) < vocab.OCR_MIN_CHARS:
                try:
                    better = recognise(content, number)
                except Exception:
                    better = None
                if better:
                    body, ocr_used = better, ocr_used + 1
        except Exception:  # skip the page, keep the file
            continue
        if body:
            pages.append({"number": number, "body": body})
    return {"pages": pages, "n_pages": len(sheets), "ocr_used": ocr_used, "error": None}


def _read_batches(batches: Iterator[pa.Array], read: PageReader, recognise: Ocr | None) -> Iterator[pa.Array]:
    """A row per file, in the same order, handed on whenever ``HELD_BYTES`` of text are read: the objects of the pages take many
    times the memory of their text."""
    kind = pa.struct(
        [
            ("pages", pa.list_(pa.struct([("number", pa.int32()), ("body", pa.string())]))),
            ("n_pages", pa.int32()),
            ("ocr_used", pa.int32()),
            ("error", pa.string()),
        ]
    )
    for batch in batches:
        rows, held = [], 0
        for file in batch:
            try:
                rows.append(_read_file(file.as_py(), read, recognise))
                held += sum(len(page["body"]) for page in rows[-1]["pages"])
            except Exception as failure:
                rows.append({"pages": None, "n_pages": 0, "ocr_used": 0, "error": str(failure)})
            if held >= HELD_BYTES:
                yield pa.array(rows, kind)
                rows, held = [], 0
        if rows:
            yield pa.array(rows, kind)


def extract_pages(
    content: Column, reader: Callable[[], PageReader] = pypdf_reader, ocr: Callable[[], Ocr] | None = None
) -> Column:
    """``struct<pages,n_pages,ocr_used,error>`` of a file; one that cannot be read has ``error``."""

    @F.arrow_udf(_EXTRACTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _read_batches(batches, reader(), ocr() if ocr else None)

    return run.asNondeterministic()(content)


def extract(
    files: DataFrame, reader: Callable[[], PageReader] = pypdf_reader, ocr: Callable[[], Ocr] | None = None
) -> DataFrame:
    """``(path, pages, n_pages, ocr_used, error)``, one row per file."""
    return files.select("path", extract_pages(F.col("content"), reader, ocr).alias("x")).select("path", "x.*")


# -- corpus audit ---------------------------------------------------------------


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def audit(files: DataFrame) -> DataFrame:
    """``(folder, n_files, size_mb)``."""
    return files.groupBy(folder_of(F.col("path")).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.bround(F.sum("length") / 1048576, 2).alias("size_mb")
    )


def sample_names(files: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` file names of each folder."""
    named = files.select(folder_of(F.col("path")).alias("folder"), T.file_name(F.col("path")).alias("name"))
    order = F.row_number().over(W.partitionBy("folder").orderBy("name"))
    return named.withColumn("pos", order).where(F.col("pos") <= n)


def validity(files: DataFrame) -> DataFrame:
    """``(path, is_valid)``: whether the content starts like a PDF file."""
    return files.select("path", (F.substring("content", 1, 4) == F.lit(bytearray(b"%PDF"))).alias("is_valid"))
