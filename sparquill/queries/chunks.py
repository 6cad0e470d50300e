"""Registered queries: from marked text to chunks and ingest statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.operators import metadata as M
from sparquill.operators.chunking import chunk_documents
from sparquill.plans import ingest as I
from sparquill.queries.inputs import PAPERS_SQL, PATHS_SQL, YEAR_SQL, papers, paper_path, spread, table, with_ctes
from sparquill.queries.registry import literal, query
from sparquill.session import ensure_checkpoint_dir
from sparquill.sources import chunk_files
from sparquill.sources import documents as D
from sparquill.sources.collections import total_size

_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_IS_TABLE = r"(contains(line, '|') OR (regexp_matches(line, '\S\s{3,}\S') AND length(" + _STRIP.format("line") + ") > 10))"


def _section_sql(column: str) -> str:
    cases = "\n".join(
        f"    WHEN regexp_full_match({_STRIP.format(column)}, {literal('(?i)' + pattern)}) THEN {literal(name)}"
        for name, pattern in vocab.SECTION_PATTERNS
    )
    return f"CASE\n{cases} END"


# one row per page, in order
PAGES_SQL = r"""
page_rows AS (
  SELECT doc_id, unnest(range(1, len(numbers) + 1)) AS page_pos,
         unnest(numbers)::INT AS page, unnest(bodies[2:]) AS body
  FROM (SELECT doc_id, regexp_extract_all(text, '\[PAGE ([0-9]+)\]', 1) AS numbers,
               regexp_split_to_array(text, '\[PAGE [0-9]+\]') AS bodies FROM marked))
"""

BLOCKS_SQL = f"""
line_rows AS (
  SELECT doc_id, page_pos, page, unnest(range(1, len(split_lines) + 1)) AS line_pos, unnest(split_lines) AS line
  FROM (SELECT *, string_split(body, chr(10)) AS split_lines FROM page_rows)),
flagged AS (SELECT *, {_IS_TABLE} AS is_table FROM line_rows),
islands AS (
  SELECT *, sum(CASE WHEN is_table AND was_table THEN 0 ELSE 1 END)
              OVER (PARTITION BY doc_id, page_pos ORDER BY line_pos) AS block_pos
  FROM (SELECT *, coalesce(lag(is_table) OVER (PARTITION BY doc_id, page_pos ORDER BY line_pos), false) AS was_table
        FROM flagged)),
blocks AS (
  SELECT doc_id, page_pos, page, block_pos, CASE WHEN bool_or(is_table) THEN 'table' ELSE 'text' END AS type,
         string_agg(line, chr(10) ORDER BY line_pos) AS content
  FROM islands GROUP BY doc_id, page_pos, page, block_pos)
"""


def _pieces(content: str) -> str:
    return rf"string_split(regexp_replace({content}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


STEPS_SQL = f"""
pieces AS (
  SELECT doc_id, page_pos, page, block_pos, 1 AS kind, 1 AS piece_pos, {_STRIP.format("content")} AS piece
  FROM blocks WHERE type = 'table'
  UNION ALL
  SELECT doc_id, page_pos, page, block_pos, 2, unnest(range(1, len(cut) + 1)), unnest(cut)
  FROM (SELECT *, {_pieces(_STRIP.format("content"))} AS cut FROM blocks WHERE type = 'text')),
steps AS (
  SELECT doc_id, page, kind, piece, length(piece) // 4 AS n,
         CASE WHEN kind = 2 THEN {_section_sql("piece")} END AS hit,
         row_number() OVER (PARTITION BY doc_id ORDER BY page_pos, block_pos, piece_pos) AS pos
  FROM (SELECT doc_id, page_pos, page, block_pos, kind, piece_pos, {_STRIP.format("piece")} AS piece FROM pieces)
  WHERE piece <> '')
"""


def _fold_sql(size: int, overlap: int) -> str:
    full = f"(f.cur <> '' AND f.tok + s.n > {size})"
    reset = "(s.kind = 1 OR s.hit IS NOT NULL)"
    carried = _STRIP.format(f"right(f.cur, {4 * overlap}) || ' ' || s.piece")
    return f"""
fold AS (
  SELECT doc_id, 0::BIGINT AS pos, '' AS cur, 0::BIGINT AS tok, '' AS section, 1 AS page,
         NULL::VARCHAR AS out_text, 0::BIGINT AS out_tok, '' AS out_section,
         NULL::VARCHAR AS table_text, 0::BIGINT AS table_tok
  FROM (SELECT DISTINCT doc_id FROM steps)
  UNION ALL
  SELECT s.doc_id, s.pos,
    CASE WHEN {reset} THEN '' WHEN {full} THEN {carried}
         WHEN f.cur = '' THEN s.piece ELSE f.cur || ' ' || s.piece END,
    CASE WHEN {reset} THEN 0 WHEN {full} THEN length({carried}) // 4 ELSE f.tok + s.n END,
    coalesce(s.hit, f.section), s.page,
    CASE WHEN f.cur <> '' AND ({reset} OR {full}) THEN f.cur END, f.tok, f.section,
    CASE WHEN s.kind = 1 THEN s.piece END, s.n
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1),
emitted AS (
  SELECT doc_id, pos, 0 AS sub, out_text AS text, page, out_tok AS tok, out_section AS section
  FROM fold WHERE out_text IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, 1, table_text, page, table_tok, out_section FROM fold WHERE table_text IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, 2, cur, page, tok, section
  FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last_pos FROM fold) WHERE pos = last_pos AND cur <> ''),
chunks AS (
  SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1)::INT AS chunk_id,
         page AS page_number, tok::INT AS token_count, section
  FROM emitted)
"""


_SHORT = f"length({_STRIP.format('text')}) >= {vocab.MIN_DOCUMENT_CHARS}"
PLAIN_MARKED_SQL = "marked AS (SELECT doc_id, '[PAGE 1]' || chr(10) || text AS text FROM documents)"
PAPER_MARKED_SQL = f"marked AS (SELECT doc_id, text FROM papers WHERE {_SHORT})"

CHUNKS_SQL = (PAPERS_SQL, PAPER_MARKED_SQL, PAGES_SQL, BLOCKS_SQL, STEPS_SQL, _fold_sql(vocab.CHUNK_SIZE, vocab.CHUNK_OVERLAP))


def paper_chunks(spark, sf_dir, keep=("doc_id",)):
    return chunk_documents(papers(spark, sf_dir), keep=keep)


# -- text pieces ----------------------------------------------------------------


@query(
    "sentence_split",
    f"""
    SELECT doc_id, pos::INT AS pos, sentence FROM (
      SELECT doc_id, unnest(range(0, len(kept))) AS pos, unnest(kept) AS sentence FROM (
        SELECT doc_id, list_filter(list_transform({_pieces("text")}, lambda s: {_STRIP.format("s")}), lambda s: s <> '') AS kept
        FROM documents))
    """,
)
def sentence_split(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("token_count", "SELECT doc_id, (length(text) // 4)::INT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query("overlap_tail", f"SELECT doc_id, right(text, {4 * vocab.CHUNK_OVERLAP}) AS tail FROM documents")
def overlap_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.overlap_tail(F.col("text"), vocab.CHUNK_OVERLAP).alias("tail")
    )


@query(
    "section_detect",
    with_ctes(
        PAPERS_SQL,
        "line_rows AS (SELECT doc_id, unnest(range(0, len(cut))) AS pos, unnest(cut) AS line"
        " FROM (SELECT doc_id, string_split(text, chr(10)) AS cut FROM papers))",
        select=f"SELECT doc_id, pos::INT AS pos, section FROM (SELECT *, {_section_sql('line')} AS section FROM line_rows)"
        " WHERE section IS NOT NULL",
    ),
)
def section_detect(spark, sf_dir):
    lines = papers(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.detect_section(F.col("line")).alias("section")).where(
        F.col("section").isNotNull()
    )


@query(
    "table_row_detect",
    with_ctes(
        PAPERS_SQL,
        "line_rows AS (SELECT doc_id, unnest(range(0, len(cut))) AS pos, unnest(cut) AS line"
        " FROM (SELECT doc_id, string_split(text, chr(10)) AS cut FROM papers))",
        select=f"SELECT doc_id, pos::INT AS pos, {_IS_TABLE} AS is_table FROM line_rows",
    ),
)
def table_row_detect(spark, sf_dir):
    lines = papers(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.is_table_row(F.col("line")).alias("is_table"))


def _page_rows(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", F.explode(T.pages(F.col("text"))).alias("page"))


@query(
    "page_split",
    with_ctes(
        PAPERS_SQL,
        "marked AS (SELECT doc_id, text FROM papers)",
        PAGES_SQL,
        select="SELECT doc_id, page AS page_number, body FROM page_rows",
    ),
)
def page_split(spark, sf_dir):
    return _page_rows(spark, sf_dir).select("doc_id", F.col("page.number").alias("page_number"), F.col("page.body").alias("body"))


@query(
    "table_blocks",
    with_ctes(
        PAPERS_SQL,
        "marked AS (SELECT doc_id, text FROM papers)",
        PAGES_SQL,
        BLOCKS_SQL,
        select="SELECT doc_id, page AS page_number, (block_pos - 1)::INT AS pos, type, content FROM blocks",
    ),
)
def table_blocks(spark, sf_dir):
    blocks = _page_rows(spark, sf_dir).select(
        "doc_id",
        F.col("page.number").alias("page_number"),
        F.posexplode(T.table_blocks(T.lines(F.col("page.body")))).alias("pos", "block"),
    )
    return blocks.select("doc_id", "page_number", "pos", "block.type", "block.content")


@query(
    "ocr_trigger",
    with_ctes(
        PAPERS_SQL,
        "marked AS (SELECT doc_id, text FROM papers)",
        PAGES_SQL,
        select=f"SELECT doc_id, page AS page_number, length({_STRIP.format('body')}) < {vocab.OCR_MIN_CHARS} AS needs_ocr FROM page_rows",
    ),
)
def ocr_trigger(spark, sf_dir):
    return _page_rows(spark, sf_dir).select(
        "doc_id", F.col("page.number").alias("page_number"), T.needs_ocr(F.col("page.body")).alias("needs_ocr")
    )


# -- chunks -----------------------------------------------------------------------


@query(
    "chunk_fold",
    with_ctes(
        PLAIN_MARKED_SQL,
        PAGES_SQL,
        BLOCKS_SQL,
        STEPS_SQL,
        _fold_sql(vocab.CHUNK_SIZE, vocab.CHUNK_OVERLAP),
        select="SELECT doc_id, chunk_id, page_number, token_count, section, text FROM chunks",
        recursive=True,
    ),
)
def chunk_fold(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.concat(F.lit("[PAGE 1]\n"), "text").alias("text"),
        F.col("source").alias("source_file"),
        F.lit("unknown").alias("year_range"),
    )
    return chunk_documents(docs, keep=("doc_id",)).drop("source_file", "year_range")


@query(
    "chunk_fold_sections",
    with_ctes(
        *CHUNKS_SQL,
        select="SELECT doc_id, source_file, year_range, chunk_id, page_number, token_count, section, c.text"
        " FROM chunks c JOIN (SELECT doc_id, source_file, year_range FROM papers) USING (doc_id)",
        recursive=True,
    ),
)
def chunk_fold_sections(spark, sf_dir):
    return paper_chunks(spark, sf_dir)


@query(
    "chunk_fold_small",
    with_ctes(
        *CHUNKS_SQL[:-1],
        _fold_sql(48, 12),
        select="SELECT doc_id, chunk_id, page_number, token_count, section, text FROM chunks",
        recursive=True,
    ),
)
def chunk_fold_small(spark, sf_dir):
    """A size far below most paragraphs: overflow, carried tails and oversized sentences."""
    return chunk_documents(papers(spark, sf_dir), 48, 12, keep=("doc_id",)).drop("source_file", "year_range")


def _fold_v1_sql(size: int, overlap: int) -> str:
    full = f"(f.cur <> '' AND f.tok + s.n > {size})"
    carried = f"right(f.cur, {4 * overlap}) || ' ' || s.piece"
    return f"""
cut AS (
  SELECT doc_id, page_pos, page, unnest(range(1, len(c) + 1)) AS piece_pos, unnest(c) AS piece
  FROM (SELECT *, {_pieces("body")} AS c FROM page_rows)),
steps AS (
  SELECT doc_id, page, piece, length(piece) // 4 AS n,
         row_number() OVER (PARTITION BY doc_id ORDER BY page_pos, piece_pos) AS pos
  FROM (SELECT doc_id, page_pos, page, piece_pos, {_STRIP.format("piece")} AS piece FROM cut) WHERE piece <> ''),
fold AS (
  SELECT doc_id, 0::BIGINT AS pos, '' AS cur, 0::BIGINT AS tok, 1 AS page,
         NULL::VARCHAR AS out_text, 0::BIGINT AS out_tok, 1 AS out_page
  FROM (SELECT DISTINCT doc_id FROM steps)
  UNION ALL
  SELECT s.doc_id, s.pos,
    CASE WHEN {full} THEN {carried} WHEN f.cur = '' THEN s.piece ELSE f.cur || ' ' || s.piece END,
    CASE WHEN {full} THEN length({carried}) // 4 ELSE f.tok + s.n END,
    s.page, CASE WHEN {full} THEN f.cur END, f.tok, f.page
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1),
emitted AS (
  SELECT doc_id, pos, 0 AS sub, out_text AS text, out_page AS page, out_tok AS tok FROM fold WHERE out_text IS NOT NULL
  UNION ALL
  SELECT doc_id, pos, 1, cur, page, tok
  FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last_pos FROM fold) WHERE pos = last_pos AND cur <> '')
"""


@query(
    "chunk_fold_v1",
    with_ctes(
        PAPERS_SQL,
        PAPER_MARKED_SQL,
        PAGES_SQL,
        _fold_v1_sql(vocab.CHUNK_SIZE, vocab.V1_CHUNK_OVERLAP),
        select=f"""
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) - 1)::INT AS chunk_id,
               page AS page_number, tok::INT AS token_count, {_STRIP.format("text")} AS text
        FROM emitted""",
        recursive=True,
    ),
)
def chunk_fold_v1(spark, sf_dir):
    chunks = chunk_documents(papers(spark, sf_dir), overlap=vocab.V1_CHUNK_OVERLAP, sections=False, keep=("doc_id",))
    return chunks.select("doc_id", "chunk_id", "page_number", "token_count", "text")


# -- corpus statistics --------------------------------------------------------------


@query(
    "chunks_per_source",
    with_ctes(
        *CHUNKS_SQL,
        select="SELECT source_file, count(*) AS n_chunks FROM chunks JOIN papers USING (doc_id) GROUP BY source_file",
        recursive=True,
    ),
)
def chunks_per_source(spark, sf_dir):
    return M.chunks_per_source(paper_chunks(spark, sf_dir))


@query(
    "ingest_outcomes",
    with_ctes(
        *CHUNKS_SQL,
        select="""
        SELECT p.path, count(c.chunk_id)::INT AS n_chunks, count(c.chunk_id) > 0 AS succeeded
        FROM papers p LEFT JOIN chunks c USING (doc_id) GROUP BY p.path""",
        recursive=True,
    ),
)
def ingest_outcomes(spark, sf_dir):
    return I.outcomes(papers(spark, sf_dir)).select("path", "n_chunks", "succeeded")


@query(
    "ingest_stats",
    with_ctes(
        *CHUNKS_SQL,
        """per_doc AS (
          SELECT doc_id, count(c.chunk_id) AS n FROM papers p LEFT JOIN chunks c USING (doc_id) GROUP BY doc_id)""",
        "page_total AS (SELECT count(*) AS n_pages FROM (SELECT unnest(regexp_extract_all(text, '\\[PAGE [0-9]+\\]')) FROM papers))",
        select="""
        SELECT count(*) AS total_pdfs, count_if(n > 0)::BIGINT AS successful, count_if(n = 0)::BIGINT AS failed,
               any_value(n_pages) AS total_pages, sum(n)::BIGINT AS total_chunks,
               round_even(sum(n) / greatest(count_if(n > 0), 1), 1)::DOUBLE AS chunks_per_pdf
        FROM per_doc, page_total""",
        recursive=True,
    ),
)
def ingest_stats(spark, sf_dir):
    return I.statistics(I.outcomes(papers(spark, sf_dir)))


# -- file names ----------------------------------------------------------------------


@query("year_range_extract", with_ctes(PATHS_SQL, select=f"SELECT doc_id, path, {YEAR_SQL} AS year_range FROM paths"))
def year_range_extract(spark, sf_dir):
    path = paper_path(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), T.extract_year_range(path).alias("year_range")
    )


@query(
    "filename_to_doi",
    with_ctes(
        PATHS_SQL,
        select=r"SELECT doc_id, regexp_replace(replace(source_file, '.pdf', ''), '^(10\.[^_]*)_', '\1/') AS doi FROM paths",
    ),
)
def filename_to_doi(spark, sf_dir):
    name = T.file_name(paper_path(F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", T.filename_to_doi(name).alias("doi"))


@query("pdf_discovery", with_ctes(PATHS_SQL, select="SELECT path FROM paths WHERE lower(path) LIKE '%.pdf'"))
def pdf_discovery(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(paper_path(F.col("doc_id")).alias("path"))
    return paths.where(T.is_pdf_path(F.col("path")))


@query("pdf_discovery_v1", with_ctes(PATHS_SQL, select="SELECT path FROM paths WHERE path LIKE '%.pdf'"))
def pdf_discovery_v1(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(paper_path(F.col("doc_id")).alias("path"))
    return paths.where(T.is_pdf_path(F.col("path"), case_sensitive=True))


@query(
    "source_contains",
    with_ctes(
        *CHUNKS_SQL,
        select="SELECT source_file, chunk_id FROM chunks JOIN papers USING (doc_id) WHERE contains(source_file, '_x1')",
        recursive=True,
    ),
)
def source_contains(spark, sf_dir):
    hit = F.contains(F.col("source_file"), F.lit("_x1"))
    return paper_chunks(spark, sf_dir).where(hit).select("source_file", "chunk_id")


@query(
    "chunks_of_period",
    with_ctes(
        *CHUNKS_SQL,
        select="SELECT doc_id, chunk_id, year_range FROM chunks JOIN papers USING (doc_id) WHERE year_range = '2007-2026'",
        recursive=True,
    ),
)
def chunks_of_period(spark, sf_dir):
    return paper_chunks(spark, sf_dir).where(F.col("year_range") == "2007-2026").select("doc_id", "chunk_id", "year_range")


# -- files ---------------------------------------------------------------------------


def _files(spark, sf_dir):
    """Documents as files: every third one is a PDF by its first bytes."""
    doc_id = F.col("doc_id")
    head = F.when(doc_id % 3 == 0, "%PDF-1.4 ").otherwise("")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        paper_path(doc_id).alias("path"),
        F.col("n_chars").alias("length"),
        F.encode(F.concat(head, "text"), "UTF-8").alias("content"),
    )


_FOLDER_SQL = "regexp_replace(path, '/[^/]*$', '')"


@query(
    "corpus_audit",
    with_ctes(
        PATHS_SQL,
        select=f"""
        SELECT {_FOLDER_SQL} AS folder, count(*) AS n_files, round_even(sum(n_chars)::DOUBLE / 1048576, 2) AS size_mb
        FROM paths GROUP BY 1""",
    ),
)
def corpus_audit(spark, sf_dir):
    return D.audit(_files(spark, sf_dir))


@query(
    "corpus_sample_names",
    with_ctes(
        PATHS_SQL,
        select=f"""
        SELECT folder, name, pos FROM (
          SELECT {_FOLDER_SQL} AS folder, source_file AS name,
                 row_number() OVER (PARTITION BY {_FOLDER_SQL} ORDER BY source_file)::INT AS pos FROM paths)
        WHERE pos <= 10""",
    ),
)
def corpus_sample_names(spark, sf_dir):
    return D.sample_names(_files(spark, sf_dir))


@query(
    "pdf_validity",
    with_ctes(PATHS_SQL, select="SELECT path, doc_id % 3 = 0 OR starts_with(text, '%PDF') AS is_valid FROM paths"),
)
def pdf_validity(spark, sf_dir):
    return D.validity(_files(spark, sf_dir))


@query(
    "database_size",
    with_ctes(PATHS_SQL, select="SELECT count(*) AS n_files, round_even(sum(n_chars)::DOUBLE / 1048576, 2) AS size_mb FROM paths"),
)
def database_size(spark, sf_dir):
    return total_size(_files(spark, sf_dir))


def _line_reader():
    """One page per line.  A line with a pipe cannot be read; a file of nine characters or less neither."""

    def page(line):
        if "|" in line:
            raise ValueError("unreadable page")
        return line

    def read(content):
        text = content.decode()
        if len(text) < 10:
            raise ValueError("not a document")
        return [lambda line=line: page(line) for line in text.split("\n")]

    return read


def _shouting_ocr():
    return lambda content, number: f"OCR TEXT OF PAGE {number}"


_READ_PAGES_SQL = """read_pages AS (
          SELECT doc_id, unnest(range(1, len(cut) + 1)) AS n, unnest(cut) AS line
          FROM (SELECT doc_id, string_split(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.4 ' ELSE '' END || text, chr(10)) AS cut,
                       length(CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.4 ' ELSE '' END || text) AS n_chars FROM documents)
          WHERE n_chars >= 10),
        kept AS (
          SELECT doc_id, n, length(trim(line)) < 50 AS by_ocr,
                 CASE WHEN length(trim(line)) < 50 THEN 'OCR TEXT OF PAGE ' || n ELSE line END AS body
          FROM read_pages WHERE NOT contains(line, '|'))"""


@query(
    "extract_pages",
    with_ctes(
        _READ_PAGES_SQL,
        select="""
        SELECT d.doc_id, coalesce(p.n_pages, 0)::INT AS n_pages, coalesce(k.ocr_used, 0)::INT AS ocr_used,
               CASE WHEN p.n_pages IS NULL THEN 'not a document' END AS error, coalesce(k.marked, '') AS marked
        FROM documents d
        LEFT JOIN (SELECT doc_id, count(*) AS n_pages FROM read_pages GROUP BY doc_id) p USING (doc_id)
        LEFT JOIN (SELECT doc_id, count_if(by_ocr) AS ocr_used,
                          string_agg('[PAGE ' || n || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY n) AS marked
                   FROM kept GROUP BY doc_id) k USING (doc_id)""",
    ),
)
def extract_pages(spark, sf_dir):
    """Text extraction with a failing page, a failing file and pages that need OCR."""
    found = spread(_files(spark, sf_dir)).select("doc_id", D.extract_pages(F.col("content"), _line_reader, _shouting_ocr).alias("x"))
    return found.select(
        "doc_id", "x.n_pages", "x.ocr_used", "x.error", F.coalesce(T.mark_pages(F.col("x.pages")), F.lit("")).alias("marked")
    )


# one row per file: its own pages, and the marked text of those that could be read
_READ_FILES_SQL = """
read_files AS (
  SELECT d.doc_id, coalesce(p.n_pages, 0)::INT AS n_pages, p.n_pages IS NULL AS unreadable, coalesce(k.ocr_used, 0) AS ocr_used
  FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n_pages FROM read_pages GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, count_if(by_ocr) AS ocr_used FROM kept GROUP BY doc_id) k USING (doc_id)),
marked AS (
  SELECT doc_id, string_agg('[PAGE ' || n || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY n) AS text
  FROM kept GROUP BY doc_id)
"""


def _processed(spark, sf_dir):
    files = spread(_files(spark, sf_dir))
    found = files.select("path", D.extract_pages(F.col("content"), _line_reader, _shouting_ocr).alias("x"))
    return I.process(found.select("path", "x.*"))


@query(
    "ingest_run",
    with_ctes(
        _READ_PAGES_SQL,
        _READ_FILES_SQL,
        PAGES_SQL,
        BLOCKS_SQL,
        STEPS_SQL,
        _fold_sql(vocab.CHUNK_SIZE, vocab.CHUNK_OVERLAP),
        select="""
        SELECT *, round_even(total_chunks / greatest(successful, 1), 1) AS chunks_per_pdf FROM (
          SELECT sum(ocr_used)::BIGINT AS ocr_used, count(*) AS total_pdfs, count_if(n > 0)::BIGINT AS successful, count_if(n = 0)::BIGINT AS failed,
                 sum(n_pages)::BIGINT AS total_pages, sum(n)::BIGINT AS total_chunks
          FROM (SELECT f.*, coalesce(c.n, 0) AS n FROM read_files f
                LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id)))""",
        recursive=True,
    ),
)
def ingest_run(spark, sf_dir):
    """Statistics of a run with blank pages, unreadable pages and unreadable files, from one fold."""
    return I.statistics(_processed(spark, sf_dir))


@query(
    "ingest_errors",
    with_ctes(PATHS_SQL, _READ_PAGES_SQL, select="""
        SELECT path AS file, 'not a document' AS error FROM paths WHERE doc_id NOT IN (SELECT doc_id FROM read_pages)"""),
)
def ingest_errors(spark, sf_dir):
    return I.errors_of(_processed(spark, sf_dir))


@query(
    "chunk_file_roundtrip",
    """
    SELECT text, 'd' || doc_id AS source_file, lang AS year_range, (doc_id % 1000)::INT AS chunk_id, 1 AS page_number,
           n_chars::INT AS token_count, source AS section FROM documents
    """,
)
def chunk_file_roundtrip(spark, sf_dir):
    """All documents as chunk records, written with the defaults and read with the defaults."""
    d = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").select(
        "text", F.concat(F.lit("d"), d.cast("string")).alias("source_file"), F.col("lang").alias("year_range"),
        (d % 1000).cast("int").alias("chunk_id"), F.lit(1).alias("page_number"),
        F.col("n_chars").cast("int").alias("token_count"), F.col("source").alias("section"),
    )
    path = f"{ensure_checkpoint_dir(spark)}/chunk-files-{uuid.uuid4()}"
    chunk_files.write_chunks(spread(chunks), path)
    return chunk_files.read_chunks(spark, path)
