"""Inputs of the registered queries: domain-shaped relations derived from the given tables.

Each has a Spark form and an SQL form (a list of common table expressions).  All of them
map whole tables row by row; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.operators.encoding import encode_chunks
from sparquill.queries.registry import literal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a small input whose file has too few row groups to split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_ctes(*parts: str, select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(p.strip() for p in parts) + "\n" + select.strip()


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _pick_sql(index: str, values: list[str]) -> str:
    return "[" + ", ".join(literal(v) for v in values) + f"][({index} + 1)::INT]"


# -- papers: documents with a path, and text laid out in pages -----------------

_FOLDERS = ["1961-2006", "2007-2026", "misc", "0011-1832/1961-2006", "loose"]
_LAYOUT = [
    "Abstract\n",
    "1. Introduction\n",
    "Materials and Methods\n",
    "Trait   Mean   SD\nYield | 2.5 | 0.3\n\nHeight   1.25   0.4\n",
    "Results and Discussion\n",
    "Summary\n",
    "References\n",
    "Background notes\n",
]
_LINES_PER_PAGE = 3
_LAYOUT_EVERY = 24  # one of the layout pieces before eight lines out of 24


def paper_name(doc_id: Column) -> Column:
    n = doc_id.cast("string")
    return (
        F.when(doc_id % 5 == 0, F.concat(F.lit("report_"), (1950 + doc_id % 77).cast("string"), F.lit("_no"), n, F.lit(".pdf")))
        .when(doc_id % 5 == 1, F.concat(F.lit("notes"), n, F.lit(".PDF")))
        .otherwise(F.concat(F.lit("10."), (1000 + doc_id % 9000).cast("string"), F.lit("_x"), n, F.lit("_v1.pdf")))
    )


def paper_path(doc_id: Column) -> Column:
    return F.concat(F.lit("/corpus/"), _pick(doc_id % len(_FOLDERS), _FOLDERS), F.lit("/"), paper_name(doc_id))


_NAME_SQL = """CASE doc_id % 5
        WHEN 0 THEN 'report_' || (1950 + doc_id % 77) || '_no' || doc_id || '.pdf'
        WHEN 1 THEN 'notes' || doc_id || '.PDF'
        ELSE '10.' || (1000 + doc_id % 9000) || '_x' || doc_id || '_v1.pdf' END"""

PATHS_SQL = f"""
paths AS (
  SELECT doc_id, text, n_chars, {_NAME_SQL} AS source_file,
         '/corpus/' || {_pick_sql(f"doc_id % {len(_FOLDERS)}", _FOLDERS)} || '/' || {_NAME_SQL} AS path
  FROM documents)
"""

YEAR_SQL = r"""coalesce(
    nullif(regexp_extract(path, '([0-9]{4}-[0-9]{4})', 1), ''),
    nullif(regexp_extract(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1'),
                          '((19|20)[0-9]{2})', 1), ''),
    'unknown')"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, source_file, year_range, text``: one marked-up text per document."""
    documents = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")

    def lay_out(line: Column, i: Column) -> Column:
        page = F.when(
            i % _LINES_PER_PAGE == 0,
            F.concat(F.lit("[PAGE "), F.floor(i / _LINES_PER_PAGE + 1).cast("string"), F.lit("]\n")),
        ).otherwise("")
        slot = (doc_id + i * 3) % _LAYOUT_EVERY
        piece = F.when(slot < len(_LAYOUT), _pick(slot % len(_LAYOUT), _LAYOUT)).otherwise("")
        return F.concat(page, piece, line)

    path = paper_path(doc_id)
    return spread(documents).select(
        "doc_id",
        path.alias("path"),
        T.file_name(path).alias("source_file"),
        T.extract_year_range(path).alias("year_range"),
        F.array_join(F.transform(T.lines(F.col("text")), lay_out), "\n").alias("text"),
    )


PAPERS_SQL = f"""
{PATHS_SQL.strip()},
papers AS (
  SELECT doc_id, path, source_file, {YEAR_SQL} AS year_range,
    array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
      (CASE WHEN (i - 1) % {_LINES_PER_PAGE} = 0
            THEN '[PAGE ' || ((i - 1) // {_LINES_PER_PAGE} + 1) || ']' || chr(10) ELSE '' END)
      || (CASE WHEN (doc_id + (i - 1) * 3) % {_LAYOUT_EVERY} < {len(_LAYOUT)}
            THEN {_pick_sql(f"((doc_id + (i - 1) * 3) % {len(_LAYOUT)})", _LAYOUT)} ELSE '' END)
      || line), chr(10)) AS text
  FROM paths)
"""

# -- shelf: documents as an encoded collection; asked: questions about them ----

_SECTIONS = ["abstract", "introduction", "methods", "results", "discussion", "conclusion", "references", ""]
_OPENINGS = [
    "How does drought affect bean rust?",
    "Is tepary bean resistance to white mold stable?",
    "Do we trust indeterminate lines for yield and quality under irrigation?",
    "Which QTL and GWAS loci matter for BCMV?",
    "Tolerance and resistance:",
    "",
    "What fungicide and herbicide are used?",
]

DIMENSION = 384


def shelf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc_id.alias("id"),
        F.col("text").alias("document"),
        F.concat(F.lit("10.1007_"), F.col("source"), F.lit(".pdf")).alias("source_file"),
        _pick(doc_id % 3, ["1961-2006", "2007-2026", "2007-2026"]).alias("year_range"),
        (doc_id % 7 + 1).cast("int").alias("page_number"),
        (doc_id % 40).cast("int").alias("chunk_id"),
        _pick(doc_id % len(_SECTIONS), _SECTIONS).alias("section"),
    )


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, document, source_file, year_range, page_number, chunk_id, section, embedding``."""
    return encode_chunks(spread(shelf_rows(spark, sf_dir)), text="document")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, question`` from the benchmark passages, with some greetings and blanks."""
    item = F.col("item_id")
    opened = F.concat_ws(" ", _pick(item % len(_OPENINGS), _OPENINGS), "text")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("query_id"),
        F.when(item % 20 == 7, "Hello! ").when(item % 20 == 11, "  ").otherwise(opened).alias("question"),
    )


SHELF_SQL = f"""
shelf AS (
  SELECT doc_id AS id, text AS document, '10.1007_' || source || '.pdf' AS source_file,
         {_pick_sql("doc_id % 3", ["1961-2006", "2007-2026", "2007-2026"])} AS year_range,
         (doc_id % 7 + 1)::INT AS page_number, (doc_id % 40)::INT AS chunk_id,
         {_pick_sql(f"doc_id % {len(_SECTIONS)}", _SECTIONS)} AS section
  FROM documents)
"""

ASKED_SQL = f"""
asked AS (
  SELECT item_id AS query_id, CASE item_id % 20 WHEN 7 THEN 'Hello! ' WHEN 11 THEN '  '
         ELSE {_pick_sql(f"item_id % {len(_OPENINGS)}", _OPENINGS)} || ' ' || text END AS question
  FROM benchmark)
"""


def encode_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs ``<name>``: ``(key, bucket, w)``, the non-zero components of unit vectors."""
    return f"""
{name}_counts AS (
  SELECT {key}, (('0x' || substr(md5(lower(word)), 1, 8))::BIGINT % {DIMENSION})::INT AS bucket, count(*) AS n
  FROM (SELECT {key}, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+')) AS word FROM {source})
  GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket,
         (n / sqrt(sum(n * n) OVER (PARTITION BY {key})::DOUBLE))::FLOAT::DOUBLE AS w
  FROM {name}_counts)
"""


# -- vectors: the embeddings table as a collection, probes: query vectors ------

_PROBES = [("near", 1, 0, 0), ("pair", 1, 1, 0), ("triple", 1, 1, 1), ("far", -1, -1, -1)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, embedding, year_range, source_file, page_number, chunk_id, label``."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"),
        "embedding",
        F.when(F.col("label") < 5, "1961-2006").otherwise("2007-2026").alias("year_range"),
        F.concat(F.lit("10.2135_src"), (v % 13).cast("string"), F.lit(".pdf")).alias("source_file"),
        (v % 11).cast("int").alias("page_number"),
        (v % 50).cast("int").alias("chunk_id"),
        "label",
    )


VECTORS_SQL = """
vectors AS (
  SELECT vec_id AS id, embedding, CASE WHEN label < 5 THEN '1961-2006' ELSE '2007-2026' END AS year_range,
         '10.2135_src' || (vec_id % 13) || '.pdf' AS source_file, (vec_id % 11)::INT AS page_number,
         (vec_id % 50)::INT AS chunk_id, label
  FROM embeddings)
"""


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, embedding``: four blends of three exemplars of every label."""
    rows = table(spark, sf_dir, "embeddings")
    first = F.get(F.col("embedding"), 0)
    picked = rows.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("a"),
        F.max_by("embedding", "vec_id").alias("b"),
        F.min_by("embedding", first).alias("c"),
    )
    weights = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"))
        for name, x, y, z in _PROBES
    ])
    blended = picked.select("label", "a", "b", "c", F.explode(weights).alias("p"))
    pair = F.zip_with("a", "b", lambda x, y: x.cast("double") * F.col("p.x") + y.cast("double") * F.col("p.y"))
    return blended.select(
        F.concat(F.col("p.name"), F.lit("-"), F.col("label").cast("string")).alias("query_id"),
        F.zip_with(pair, "c", lambda xy, z: xy + z.cast("double") * F.col("p.z")).alias("embedding"),
    )


PROBES_SQL = f"""
picked AS (
  SELECT label, arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b,
         arg_min(embedding, embedding[1]) AS c
  FROM embeddings GROUP BY label),
probes AS (
  SELECT p.name || '-' || label AS query_id,
         list_transform(a, lambda v, i: v::DOUBLE * p.x + b[i]::DOUBLE * p.y + c[i]::DOUBLE * p.z) AS embedding
  FROM picked, (VALUES {", ".join(f"({literal(n)}, {x}, {y}, {z})" for n, x, y, z in _PROBES)}) AS p(name, x, y, z))
"""


def knn_sql(k: int, where: str = "true", queries: str = "probes", collection: str = "vectors") -> str:
    """CTE ``nearest``: ``(query_id, rank, id, distance)`` by squared Euclidean distance."""
    return f"""
distances AS (
  SELECT q.query_id, v.id,
         round_even(list_sum(list_transform(v.embedding, lambda x, i:
           (x::DOUBLE - q.embedding[i]) * (x::DOUBLE - q.embedding[i]))), 4) AS distance
  FROM {queries} q, {collection} v WHERE {where}),
nearest AS (
  SELECT query_id, rank, id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM distances)
  WHERE rank <= {k})
"""


# -- the retrieval chain in SQL -------------------------------------------------


def chain_sql(expanded: str = "expanded", where: str = "true", n: int = 20) -> str:
    """CTE ``nearest`` of encoded questions over the encoded shelf."""
    return f"""
{encode_sql("q", expanded, "query_id", "expanded").strip()},
{encode_sql("d", "shelf", "id", "document").strip()},
q_norm AS (SELECT query_id, sum(w * w) AS sq FROM q GROUP BY query_id),
d_norm AS (SELECT id, sum(w * w) AS sq FROM d GROUP BY id),
products AS (
  SELECT query_id, id, sum(q.w * d.w) AS dot FROM q JOIN d USING (bucket) GROUP BY query_id, id),
nearest AS (
  SELECT query_id, rank, id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM (
      SELECT a.query_id, s.id,
             round_even(greatest(coalesce(qn.sq, 0) + coalesce(dn.sq, 0) - 2 * coalesce(p.dot, 0), 0), 4) AS distance
      FROM {expanded} a CROSS JOIN shelf s
      LEFT JOIN q_norm qn ON qn.query_id = a.query_id
      LEFT JOIN d_norm dn ON dn.id = s.id
      LEFT JOIN products p ON p.query_id = a.query_id AND p.id = s.id
      WHERE {where}))
  WHERE rank <= {n})
"""
