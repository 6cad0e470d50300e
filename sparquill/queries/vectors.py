"""Registered queries: vector functions, nearest neighbours and collection metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparquill.functions import vectors as V
from sparquill.functions.text import preview, round_half_even
from sparquill.operators import encoding as E
from sparquill.operators import metadata as M
from sparquill.operators.indexing import dense_index
from sparquill.operators.joins import join_small
from sparquill.operators.knn import inner_product_top_k, knn, similar_items, unusable_vectors
from sparquill.queries.inputs import (
    ASKED_SQL, DIMENSION, PATHS_SQL, PROBES_SQL, SHELF_SQL, VECTORS_SQL, YEAR_SQL, asked, encode_sql, knn_sql,
    chain_sql, paper_path, probes, shelf, shelf_rows, spread, table, vectors, with_ctes,
)
from sparquill.plans.embedding import summarise_clusters
from sparquill.queries.registry import query
from sparquill.functions import text as T
from sparquill.session import ensure_checkpoint_dir, written
from sparquill.sources.collections import Collections, append_rows, number_rows

_NEAREST = "SELECT query_id, rank, id, distance FROM nearest"


def _knn_query(name: str, k: int, where: dict | None, where_sql: str) -> None:
    @query(name, with_ctes(VECTORS_SQL, PROBES_SQL, knn_sql(k, where_sql), select=_NEAREST))
    def run(spark, sf_dir):
        return knn(probes(spark, sf_dir), vectors(spark, sf_dir), k, where)


_knn_query("knn_topk", 20, None, "true")
_knn_query("knn_filtered", 20, {"year_range": "2007-2026"}, "v.year_range = '2007-2026'")
_knn_query("knn_source_filter", 5, {"source_file": "10.2135_src4.pdf"}, "v.source_file = '10.2135_src4.pdf'")
_knn_query("knn_page_filter", 5, {"page_number": 5}, "v.page_number = 5")
_knn_query(
    "knn_multi_where", 5, {"year_range": "2007-2026", "page_number": 5}, "v.year_range = '2007-2026' AND v.page_number = 5"
)
_knn_query("knn_range_where", 20, {"chunk_id": {"$gt": 10}}, "v.chunk_id > 10")
_knn_query(
    "knn_nested_where",
    20,
    {"$or": [{"page_number": {"$in": [1, 2]}}, {"$and": [{"chunk_id": {"$gte": 30}}, {"year_range": {"$ne": "1961-2006"}}]}]},
    "(v.page_number IN (1, 2) OR (v.chunk_id >= 30 AND v.year_range <> '1961-2006'))",
)


def _spoiled(rows):
    """The collection with bad vectors laid in by key."""
    v, key = F.col("embedding"), F.col("id") % 17
    first = lambda x: F.concat(F.array(F.lit(x).cast("float")), F.slice(v, 2, 1000))
    bad = (
        F.when(key == 3, first(float("nan"))).when(key == 5, first(float("inf"))).when(key == 8, F.slice(v, 1, 63))
        .when(key != 11, v)
    )
    return rows.withColumn("embedding", bad)


@query("knn_bad_vectors", with_ctes(VECTORS_SQL, PROBES_SQL, knn_sql(20, "v.id % 17 NOT IN (3, 5, 8, 11)"), select=_NEAREST))
def knn_bad_vectors(spark, sf_dir):
    return knn(probes(spark, sf_dir), _spoiled(vectors(spark, sf_dir)), 20)


@query("knn_bad_vectors_blocks", with_ctes(VECTORS_SQL, PROBES_SQL, knn_sql(20, "v.id % 17 NOT IN (3, 5, 8, 11)"), select=_NEAREST))
def knn_bad_vectors_blocks(spark, sf_dir):
    return knn(probes(spark, sf_dir), _spoiled(vectors(spark, sf_dir)), 20, max_broadcast_queries=0, block_queries=64)


@query(
    "unusable_vectors",
    """
    SELECT count(*) AS n_rows, count(*) FILTER (vec_id % 17 = 11) AS n_missing,
           count(*) FILTER (vec_id % 17 = 8) AS n_wrong_dimension, count(*) FILTER (vec_id % 17 IN (3, 5)) AS n_not_finite
    FROM embeddings
    """,
)
def unusable_vectors_of_embeddings(spark, sf_dir):
    return unusable_vectors(_spoiled(vectors(spark, sf_dir)), 64)


@query(
    "knn_multi_query",
    with_ctes(
        SHELF_SQL,
        ASKED_SQL,
        "expanded AS (SELECT query_id, question AS expanded FROM asked)",
        chain_sql(n=3),
        select=_NEAREST,
    ),
)
def knn_multi_query(spark, sf_dir):
    questions = E.encode_chunks(asked(spark, sf_dir).withColumnRenamed("question", "text"))
    return knn(questions, shelf(spark, sf_dir), 3)


@query(
    "metric_distances",
    with_ctes(
        "exemplar AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)",
        "terms AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(e)::DOUBLE AS y FROM embeddings JOIN exemplar USING (label))",
        "sums AS (SELECT vec_id, sum((x - y) * (x - y)) AS sq, sum(x * y) AS dot, sum(x * x) AS xx, sum(y * y) AS yy FROM terms GROUP BY vec_id)",
        select="""
        SELECT vec_id, round_even(sq, 4) AS l2sq, round_even(sqrt(sq), 4) AS l2,
               round_even(1 - dot / (sqrt(xx) * sqrt(yy)), 4) + 0.0 AS cosine, round_even(1 - dot, 4) + 0.0 AS ip FROM sums""",
    ),
)
def metric_distances(spark, sf_dir):
    rows = _with_exemplar(spark, sf_dir)
    return rows.select(
        "vec_id",
        *[
            round_half_even(V.distance(F.col("embedding"), F.col("e"), m), 4).alias(m)
            for m in ("l2sq", "l2", "cosine", "ip")
        ],
    )


def _with_exemplar(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    exemplar = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return join_small(rows, exemplar, "label")


@query(
    "cosine_pairs",
    with_ctes(
        "exemplar AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label)",
        "terms AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(e)::DOUBLE AS y FROM embeddings JOIN exemplar USING (label))",
        select="""
        SELECT vec_id, round_even(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS similarity
        FROM terms GROUP BY vec_id""",
    ),
)
def cosine_pairs(spark, sf_dir):
    rows = _with_exemplar(spark, sf_dir)
    return rows.select("vec_id", round_half_even(V.cosine_similarity(F.col("embedding"), F.col("e")), 6).alias("similarity"))


@query(
    "l2_norms",
    "SELECT vec_id, round_even(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
)
def l2_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", round_half_even(V.l2_norm(F.col("embedding")), 6).alias("norm"))


@query(
    "normalise",
    """
    WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 3)) AS v FROM embeddings),
    normed AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM scaled)
    SELECT vec_id, unnest(range(0, len(v)))::INT AS pos, round_even(unnest(v) / norm, 6) AS component FROM normed
    """,
)
def normalise(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v")
    )
    unit = scaled.select("vec_id", F.posexplode(V.normalise(F.col("v"))).alias("pos", "x"))
    return unit.select("vec_id", "pos", round_half_even(F.col("x"), 6).alias("component"))


@query(
    "flat_ip_topk",
    with_ctes(
        VECTORS_SQL,
        PROBES_SQL,
        """scores AS (
          SELECT q.query_id, v.id, round_even(list_sum(list_transform(v.embedding, lambda x, i: x::DOUBLE * q.embedding[i])), 4) + 0.0 AS score
          FROM probes q, vectors v)""",
        select="""
        SELECT query_id, rank, id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scores) WHERE rank <= 5""",
    ),
)
def flat_ip_topk(spark, sf_dir):
    return inner_product_top_k(probes(spark, sf_dir), vectors(spark, sf_dir), 5)


@query(
    "similar_items_excl_self",
    with_ctes(
        VECTORS_SQL,
        "items AS (SELECT arg_min(id, id) AS query_id, arg_min(embedding, id) AS embedding FROM vectors GROUP BY label)",
        """scores AS (
          SELECT q.query_id, v.id, round_even(list_sum(list_transform(v.embedding, lambda x, i: x::DOUBLE * q.embedding[i]::DOUBLE)), 4) + 0.0 AS score
          FROM items q, vectors v WHERE v.id <> q.query_id)""",
        select="""
        SELECT query_id, rank, id, score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scores) WHERE rank <= 10""",
    ),
)
def similar_items_excl_self(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    items = rows.groupBy("label").agg(F.min("id").alias("id"), F.min_by("embedding", "id").alias("embedding"))
    return similar_items(items, rows, 10)


@query(
    "embedding_validation",
    """
    WITH per_row AS (
      SELECT len(embedding) <> 64 AS wrong, len(list_filter(embedding, lambda x: isnan(x))) AS nans,
             len(list_filter(embedding, lambda x: isinf(x))) AS infs,
             sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings),
    totals AS (
      SELECT count(*) AS n_vectors, count_if(wrong)::BIGINT AS n_wrong_dimension, sum(nans)::BIGINT AS n_nan, sum(infs)::BIGINT AS n_inf,
             round_even(avg(norm), 6) AS mean_norm, round_even(stddev_pop(norm), 6) AS std_norm FROM per_row)
    SELECT *, abs(mean_norm - 1) < 0.01 AS is_normalised, n_vectors = (SELECT count(*) FROM embeddings) AS count_matches,
           n_wrong_dimension = 0 AND n_nan = 0 AND n_inf = 0 AND n_vectors = (SELECT count(*) FROM embeddings) AS passed FROM totals
    """,
)
def embedding_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return E.validation_report(rows, rows.count(), 64)


@query(
    "embedding_index",
    with_ctes(
        SHELF_SQL,
        encode_sql("d", "shelf", "id", "document"),
        select="""
        SELECT s.id AS doc_id, row_number() OVER (ORDER BY s.id) - 1 AS embedding_index, count(d.id) AS n_components
        FROM shelf s LEFT JOIN d USING (id) WHERE s.document IS NOT NULL GROUP BY s.id""",
    ),
)
def embedding_index(spark, sf_dir):
    """All documents encoded and stored, then numbered where there is a vector; with the number of its components that are not zero."""
    encoded = written(E.encode_chunks(shelf_rows(spark, sf_dir), text="document"))
    good = encoded.where(F.col("encode_error").isNull() & F.col("embedding").isNotNull())
    n = F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_components")
    return dense_index(good.select(F.col("id").alias("doc_id"), n), "doc_id", name="embedding_index")


@query(
    "hash_encode",
    with_ctes(
        SHELF_SQL,
        encode_sql("d", "shelf", "id", "document"),
        select="SELECT id, bucket, round_even(w, 5) AS component FROM d",
    ),
)
def hash_encode(spark, sf_dir):
    parts = shelf(spark, sf_dir).select("id", F.posexplode("embedding").alias("bucket", "w")).where(F.col("w") != 0)
    return parts.select("id", "bucket", round_half_even(F.col("w"), 5).alias("component"))


@query(
    "cluster_summary",
    """
    SELECT label AS cluster, count(*) AS n_chunks, count(DISTINCT label < 5) AS n_years FROM embeddings GROUP BY label
    """,
)
def cluster_summary(spark, sf_dir):
    """Size and years of clusters that are given, by the summary that a k-means profile ends with."""
    pairs = vectors(spark, sf_dir).groupBy(F.col("label").alias("cluster"), "year_range").agg(F.count(F.lit(1)).alias("n_chunks"))
    return summarise_clusters(pairs)


_ROUNDS = 4


def _kmeans_sql() -> str:
    """The rounds of k-means one after the other: distances, nearest centre, new centres."""
    parts = [
        """whole AS (
          SELECT vec_id, year_range, list_transform(embedding, lambda x: floor(x::DOUBLE * 65536 + 0.5)::BIGINT) AS w
          FROM (SELECT *, id AS vec_id FROM vectors)),
        cells AS (SELECT vec_id, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM whole),
        seeds AS (SELECT w, row_number() OVER (ORDER BY h) - 1 AS cluster
          FROM (SELECT md5('42:' || array_to_string(w, ',')) AS h, min(w) AS w FROM whole GROUP BY h) ORDER BY h LIMIT 10),
        c0 AS (SELECT cluster, unnest(w) AS x, generate_subscripts(w, 1) AS place FROM seeds)"""
    ]
    for n in range(_ROUNDS + 1):
        parts.append(
            f"""d{n} AS (SELECT vec_id, cluster, sum((cells.x - c.x) * (cells.x - c.x)) AS d
          FROM cells JOIN c{n} c USING (place) GROUP BY vec_id, cluster),
        a{n} AS (SELECT vec_id, cluster FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)"""
        )
        if n < _ROUNDS:
            up, down = "(2 * sum(x)::BIGINT + count(*))", "(2 * count(*))"
            parts.append(
                f"""c{n + 1} AS (SELECT c.cluster, c.place, coalesce(t.x, c.x) AS x FROM c{n} c LEFT JOIN (
            SELECT cluster, place, (({up} - (({up} % {down}) + {down}) % {down}) // {down})::BIGINT AS x
            FROM cells JOIN a{n} USING (vec_id) GROUP BY cluster, place) t USING (cluster, place))"""
            )
    return with_ctes(
        VECTORS_SQL,
        *parts,
        select=f"""SELECT cluster::INT AS cluster, year_range, count(*) AS n_chunks
        FROM a{_ROUNDS} JOIN whole USING (vec_id) GROUP BY ALL""",
    )


@query("kmeans_profile", _kmeans_sql())
def kmeans_profile(spark, sf_dir):
    """Four rounds, so that SQL can go through the same ones."""
    return E.cluster_profile(vectors(spark, sf_dir), rounds=_ROUNDS)


# -- the collection --------------------------------------------------------------


@query(
    "align_vectors_metadata",
    """
    SELECT count(e.vec_id) AS n_vectors, count(d.doc_id) AS n_metadata,
           count_if(e.vec_id IS NOT NULL AND d.doc_id IS NOT NULL)::BIGINT AS n_aligned,
           count(e.vec_id) = count_if(e.vec_id IS NOT NULL AND d.doc_id IS NOT NULL)
             AND count(d.doc_id) = count_if(e.vec_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matches
    FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id
    """,
)
def align_vectors_metadata(spark, sf_dir):
    return M.alignment_report(
        table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")),
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")),
        "id",
    )


def _stored_shelf(spark, sf_dir):
    """A collection of all documents, inserted in one go under ids in (source, chunk, document) order."""
    store = Collections(spark, f"{ensure_checkpoint_dir(spark)}/collections-{uuid.uuid4()}")
    store.create("shelf", "none", partition_by="year_range")
    rows = shelf_rows(spark, sf_dir).withColumnRenamed("id", "shelf_id")
    store.add("shelf", rows, "source_file", "chunk_id", "shelf_id")
    return store


@query(
    "stored_collection",
    """
    SELECT 'chunk_' || (row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1) AS id, doc_id, text AS document, lang AS year_range
    FROM documents
    """,
)
def stored_collection(spark, sf_dir):
    """All documents in two inserts, both of them run again under their keys, one before and one after a compaction."""
    store = Collections(spark, f"{ensure_checkpoint_dir(spark)}/collections-{uuid.uuid4()}")
    store.create("papers", "none", partition_by="year_range")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"), F.col("lang").alias("year_range"))
    for half in (0, 1, 1):
        store.add("papers", rows.where(F.col("doc_id") % 2 == half), "doc_id", key=f"half-{half}")
    store.compact("papers")
    store.add("papers", rows.where(F.col("doc_id") % 2 == 0), "doc_id", key="half-0")
    return store.open("papers").select("id", "doc_id", "document", "year_range")


@query(
    "get_by_id",
    with_ctes(
        SHELF_SQL,
        select="""
        SELECT id, document, source_file, year_range, page_number FROM shelf WHERE id IN (SELECT doc_id FROM labels)""",
    ),
)
def get_by_id(spark, sf_dir):
    """A stored collection, asked for a table of ids."""
    store = _stored_shelf(spark, sf_dir)
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("shelf_id"))
    ids = store.open("shelf").select("id", "shelf_id").join(wanted, "shelf_id", "left_semi")
    found = store.get("shelf", ids=ids.select("id"))
    return found.select(F.col("shelf_id").alias("id"), "document", "source_file", "year_range", "page_number")


@query(
    "get_where",
    with_ctes(
        SHELF_SQL,
        select="SELECT id, substr(document, 1, 100) AS preview FROM shelf WHERE year_range = '2007-2026' AND page_number = 5",
    ),
)
def get_where(spark, sf_dir):
    found = _stored_shelf(spark, sf_dir).get("shelf", where={"year_range": "2007-2026", "page_number": 5})
    return found.select(F.col("shelf_id").alias("id"), preview(F.col("document")).alias("preview"))


@query(
    "collection_count",
    """
    SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM labels) AS n_expected,
           (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS matches
    """,
)
def collection_count(spark, sf_dir):
    return M.count_check(shelf_rows(spark, sf_dir), table(spark, sf_dir, "labels"))


@query(
    "append_collection",
    """
    SELECT 'chunk_' || (row_number() OVER (ORDER BY part, a, b) - 1) AS id, part, a, b FROM (
      SELECT 0 AS part, doc_id AS a, 0::BIGINT AS b FROM documents
      UNION ALL SELECT 1, conv_id, turn FROM conversations)
    """,
)
def append_collection(spark, sf_dir):
    stored = number_rows(
        table(spark, sf_dir, "documents").select(F.lit(0).alias("part"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b")),
        "a", "b",
    )
    added = table(spark, sf_dir, "conversations").select(
        F.lit(1).alias("part"), F.col("conv_id").alias("a"), F.col("turn").alias("b")
    )
    return append_rows(stored, added, "a", "b")


@query(
    "validation_suite",
    with_ctes(
        SHELF_SQL,
        ASKED_SQL,
        "expanded AS (SELECT query_id, question AS expanded FROM asked)",
        chain_sql(n=3),
        select="""
        SELECT 'semantic' AS check_name, count(*) AS n, count(*) = 3 * (SELECT count(*) FROM asked) AS passed FROM nearest
        UNION ALL SELECT 'filtered', count(*), count(*) > 0 FROM shelf WHERE year_range = '2007-2026'
        UNION ALL SELECT 'by_id', count(*), count(*) = (SELECT count(*) FROM labels) FROM shelf WHERE id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'count', count(*), count(*) = (SELECT count(*) FROM documents) FROM shelf""",
    ),
)
def validation_suite(spark, sf_dir):
    from sparquill.plans.store import validation_suite as run

    questions = asked(spark, sf_dir)
    return run(
        shelf(spark, sf_dir),
        E.encode_chunks(questions.withColumnRenamed("question", "text")),
        {"year_range": "2007-2026"},
        table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")),
        table(spark, sf_dir, "documents").count(),
    )


# -- metadata analytics --------------------------------------------------------------


def _catalogued(spark, sf_dir):
    """Paths of all documents, with the year missing where the path has none."""
    path = paper_path(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        T.file_name(path).alias("source_file"), F.nullif(T.extract_year_range(path), F.lit("unknown")).alias("year_range")
    )


_CATALOGUED_SQL = f"catalogued AS (SELECT source_file, {YEAR_SQL} AS year_range FROM paths)"


@query(
    "year_distribution",
    with_ctes(
        PATHS_SQL,
        _CATALOGUED_SQL,
        select="""
        SELECT year_range, count(*) AS n_chunks, round_even(count(*)::DOUBLE / (SELECT count(*) FROM catalogued) * 100, 1) AS percent
        FROM catalogued GROUP BY year_range""",
    ),
)
def year_distribution(spark, sf_dir):
    return M.year_distribution(_catalogued(spark, sf_dir))


@query("unique_sources", with_ctes(SHELF_SQL, select="SELECT count(DISTINCT source_file) AS n_sources FROM shelf"))
def unique_sources(spark, sf_dir):
    return M.unique_sources(shelf_rows(spark, sf_dir))


@query("sample_sources", with_ctes(SHELF_SQL, select="SELECT DISTINCT source_file FROM shelf ORDER BY 1 LIMIT 5"))
def sample_sources(spark, sf_dir):
    return M.first_sources(shelf_rows(spark, sf_dir))


@query("distinct_years", with_ctes(PATHS_SQL, _CATALOGUED_SQL, select="SELECT DISTINCT year_range FROM catalogued"))
def distinct_years(spark, sf_dir):
    return M.distinct_years(_catalogued(spark, sf_dir))
