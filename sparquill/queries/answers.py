"""Registered queries: from questions to ranked evidence, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.operators import evaluation as V
from sparquill.operators import prompting as P
from sparquill.operators import retrieval as R
from sparquill.operators.encoding import encode_chunks
from sparquill.operators.knn import knn
from sparquill.plans import answering as A
from sparquill.plans import evaluating as E
from sparquill.queries.chunks import CHUNKS_SQL, paper_chunks
from sparquill.queries.inputs import (
    ASKED_SQL, PROBES_SQL, SHELF_SQL, VECTORS_SQL, asked, chain_sql, knn_sql, probes, shelf, spread, table, vectors, with_ctes,
)
from sparquill.queries.registry import literal, query
from sparquill.queries.texts import KEYWORDS_SQL
from sparquill.session import written

# -- SQL of the stages ------------------------------------------------------------

_DICTIONARY_SQL = "dictionary AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {literal(term)}, [{', '.join(literal(a) for a in aliases[: vocab.MAX_ALIASES_PER_TERM])}])"
    for i, (term, aliases) in enumerate(vocab.SYNONYMS)
) + ") AS t(ord, term, aliases))"

EXPANDED_SQL = f"""
{_DICTIONARY_SQL},
added AS (
  SELECT query_id, string_agg(alias, ' ' ORDER BY n) AS aliases FROM (
    SELECT query_id, alias, row_number() OVER (PARTITION BY query_id ORDER BY ord, pos) AS n FROM (
      SELECT query_id, question, ord, unnest(range(1, len(aliases) + 1)) AS pos, unnest(aliases) AS alias
      FROM asked JOIN dictionary ON contains(lower(question), term))
    WHERE NOT list_contains(regexp_split_to_array(lower(question), '\\s+'), lower(alias)))
  WHERE n <= {vocab.MAX_ADDED_ALIASES} GROUP BY query_id),
expanded AS (
  SELECT query_id, question || coalesce(' ' || aliases, '') AS expanded FROM asked LEFT JOIN added USING (query_id))
"""

CANDIDATES_SQL = r"""
found AS (
  SELECT n.query_id, n.rank, s.document AS text, s.source_file AS source,
         regexp_replace(replace(s.source_file, '.pdf', ''), '^(10\.[^_]*)_', '\1/') AS doi,
         s.year_range, s.page_number AS page, s.section, n.distance
  FROM nearest n JOIN shelf s USING (id)),
candidates AS (
  SELECT * EXCLUDE (copy) FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, source, page ORDER BY distance, rank) AS copy FROM found)
  WHERE copy = 1)
"""

_WORDS = "list_distinct(list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w)))"

RANKED_SQL = f"""
pairs AS (
  SELECT c.*, {_WORDS.format("question")} AS asked_words, {_WORDS.format("text")} AS text_words
  FROM candidates c JOIN asked USING (query_id)),
ranked AS (
  SELECT * EXCLUDE (rank, asked_words, text_words, new_rank), new_rank AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, distance, rank)::INT AS new_rank FROM (
      SELECT *, coalesce(len(list_intersect(asked_words, text_words)) / nullif(len(asked_words), 0)::DOUBLE, 0.0) AS rerank_score
      FROM pairs))
  WHERE new_rank <= {vocab.TOP_K})
"""


def _label_sql(best: str, relevant: str) -> str:
    return f"""CASE WHEN {best} <= {vocab.DISTANCE_SUPPORTED} AND {relevant} >= 3 THEN 'SUPPORTED'
         WHEN {best} <= {vocab.DISTANCE_PARTIAL} AND {relevant} >= 2 THEN 'PARTIALLY_SUPPORTED'
         WHEN {best} <= {vocab.DISTANCE_INFERRED} THEN 'INFERRED' ELSE 'UNSUPPORTED' END"""


JUDGED_SQL = f"""
judged AS (
  SELECT a.query_id, a.question, best, {_label_sql("best", "relevant")} AS confidence
  FROM asked a LEFT JOIN (
    SELECT query_id, arg_min(distance, rank) AS best, count_if(distance <= {vocab.DISTANCE_INFERRED}) AS relevant
    FROM ranked GROUP BY query_id) USING (query_id))
"""

_TAG_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(section), {literal(k)}) THEN {literal(t)}" for k, t in vocab.SECTION_TAGS
) + " END"

CONTEXT_SQL = f"""
context AS (
  SELECT a.query_id, coalesce(c.body, '') AS context FROM asked a LEFT JOIN (
    SELECT query_id, string_agg(
      '[' || rank || '] ' || concat_ws(' | ', 'doi:' || doi, 'p.' || page, {_TAG_SQL},
        CASE WHEN distance > {vocab.DISTANCE_INFERRED} THEN {literal(vocab.WEAK_EVIDENCE)} END)
      || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS body
    FROM ranked GROUP BY query_id) c USING (query_id))
"""

REFERENCES_SQL = f"""
refs AS (
  SELECT a.query_id, coalesce({literal(vocab.REFERENCE_HEADING)} || chr(10) || r.entries, '') AS refs
  FROM asked a LEFT JOIN (
    SELECT query_id, string_agg('• doi:' || doi || CASE WHEN distance > {vocab.DISTANCE_INFERRED}
             THEN {literal(vocab.WEAK_REFERENCE)} ELSE '' END, chr(10) ORDER BY rank) AS entries
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doi ORDER BY rank) AS nth FROM ranked) WHERE nth = 1
    GROUP BY query_id) r USING (query_id))
"""

_ROUTE_SQL = f"""CASE WHEN trim(question) = '' THEN 'blank'
  WHEN rtrim(lower(trim(question)), '!?. ') IN ({", ".join(literal(g) for g in vocab.GREETINGS)}) THEN 'greeting'
  WHEN best IS NULL OR best > {vocab.DISTANCE_NO_MATCH} THEN 'out_of_scope' ELSE 'answer' END"""

ANSWERS_SQL = f"""
routed AS (SELECT *, {_ROUTE_SQL} AS route FROM judged),
lead_rows AS (
  SELECT query_id, doi, page,
         trim(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1], ' ' || chr(10)) AS said
  FROM ranked WHERE rank = 1),
answers AS (
  SELECT r.query_id, r.question, r.confidence, r.route,
         CASE r.route WHEN 'blank' THEN '' WHEN 'greeting' THEN {literal(vocab.WELCOME_MESSAGE)}
           WHEN 'out_of_scope' THEN {literal(vocab.OUT_OF_SCOPE_MESSAGE)}
           ELSE said || ' (doi:' || doi || ', p.' || page || ')' END AS answer,
         CASE WHEN r.route = 'answer' THEN refs ELSE '' END AS refs
  FROM routed r LEFT JOIN lead_rows l USING (query_id) LEFT JOIN refs USING (query_id))
"""

_TO_NEAREST = (SHELF_SQL, ASKED_SQL, EXPANDED_SQL, chain_sql(n=vocab.N_CANDIDATES))
_TO_CANDIDATES = (*_TO_NEAREST, CANDIDATES_SQL)
_TO_RANKED = (*_TO_CANDIDATES, RANKED_SQL)
_TO_JUDGED = (*_TO_RANKED, JUDGED_SQL)
_TO_ANSWERS = (*_TO_JUDGED, REFERENCES_SQL, ANSWERS_SQL)


def retrieved(spark, sf_dir, where=None):
    return A.retrieve(asked(spark, sf_dir), shelf(spark, sf_dir), where=where)


# -- expansion and candidates -------------------------------------------------------


@query("query_expansion", with_ctes(ASKED_SQL, EXPANDED_SQL, select="SELECT query_id, expanded FROM expanded"))
def query_expansion(spark, sf_dir):
    return R.expand_queries(asked(spark, sf_dir)).select("query_id", "expanded")


@query(
    "query_expansion_documents",
    with_ctes(
        "asked AS (SELECT doc_id AS query_id, text || ' trust in tepary bean yield' AS question FROM documents)",
        EXPANDED_SQL,
        select="SELECT query_id, expanded FROM expanded",
    ),
)
def query_expansion_documents(spark, sf_dir):
    asked_of = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" trust in tepary bean yield")).alias("question")
    )
    return R.expand_queries(asked_of).select("query_id", "expanded")


@query(
    "dedup_source_page",
    with_ctes(
        VECTORS_SQL,
        PROBES_SQL,
        knn_sql(60),
        """found AS (SELECT n.query_id, n.rank, v.source_file AS source, v.page_number % 3 AS page, n.distance FROM nearest n JOIN vectors v USING (id))""",
        select="""
        SELECT query_id, source, page, rank, distance FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, source, page ORDER BY distance, rank) AS copy FROM found)
        WHERE copy = 1""",
    ),
)
def dedup_source_page(spark, sf_dir):
    nearest = knn(probes(spark, sf_dir), vectors(spark, sf_dir), 60, columns=("source_file", "page_number"))
    found = nearest.select(
        "query_id", F.col("source_file").alias("source"), (F.col("page_number") % 3).alias("page"), "rank", "distance"
    )
    return R.deduplicate(found)


@query(
    "dedup_corpus",
    """
    SELECT source, lang, doc_id, distance FROM (
      SELECT source, lang, doc_id, n_chars / 1000.0::DOUBLE AS distance,
             row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS copy FROM documents)
    WHERE copy = 1
    """,
)
def dedup_corpus(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "source", "lang", "doc_id", (F.col("n_chars") / F.lit(1000.0)).alias("distance"), F.col("doc_id").alias("rank")
    )
    return R.deduplicate(rows, "source", "lang").drop("rank")


@query(
    "retrieve_candidates",
    with_ctes(*_TO_CANDIDATES, select="SELECT query_id, rank, source, doi, year_range, page, section, distance, text FROM candidates"),
)
def retrieve_candidates(spark, sf_dir):
    found = A.candidates(asked(spark, sf_dir), shelf(spark, sf_dir))
    return found.drop("rerank_score")


@query(
    "rerank_lexical",
    with_ctes(*_TO_RANKED, select="SELECT query_id, rank, source, page, distance, rerank_score FROM ranked"),
)
def rerank_lexical(spark, sf_dir):
    questions = asked(spark, sf_dir)
    found = A.candidates(questions, shelf(spark, sf_dir)).join(questions, "query_id")
    return R.rerank(found).select("query_id", "rank", "source", "page", "distance", "rerank_score")


@query(
    "rank_by_distance",
    with_ctes(
        *_TO_CANDIDATES,
        select=f"""
        SELECT query_id, rank, source, page, distance FROM (
          SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, rank)::INT AS rank, source, page, distance FROM candidates)
        WHERE rank <= {vocab.TOP_K}""",
    ),
)
def rank_by_distance(spark, sf_dir):
    """The fallback order, when no pair scorer can be used."""
    questions = asked(spark, sf_dir)
    found = A.candidates(questions, shelf(spark, sf_dir)).join(questions, "query_id")
    return R.rerank(found, scorer=None).select("query_id", "rank", "source", "page", "distance")


@query(
    "retrieve",
    with_ctes(
        *_TO_JUDGED,
        select="""
        SELECT query_id, confidence, rank, source, doi, year_range, page, section, distance, rerank_score
        FROM ranked JOIN judged USING (query_id)""",
    ),
)
def retrieve(spark, sf_dir):
    return retrieved(spark, sf_dir).select("query_id", "confidence", F.inline("sources")).drop("text")


@query(
    "retrieve_period",
    with_ctes(
        SHELF_SQL,
        ASKED_SQL,
        EXPANDED_SQL,
        chain_sql(where="s.year_range = '1961-2006'", n=vocab.N_CANDIDATES),
        CANDIDATES_SQL,
        RANKED_SQL,
        JUDGED_SQL,
        select="SELECT query_id, confidence, rank, source, page, distance FROM ranked JOIN judged USING (query_id)",
    ),
)
def retrieve_period(spark, sf_dir):
    rows = retrieved(spark, sf_dir, {"year_range": "1961-2006"}).select("query_id", "confidence", F.inline("sources"))
    return rows.select("query_id", "confidence", "rank", "source", "page", "distance")


@query(
    "retrieve_chunks",
    with_ctes(
        *CHUNKS_SQL,
        """shelf AS (
          SELECT doc_id * 100000 + chunk_id AS id, c.text AS document, source_file, year_range, page_number, section
          FROM chunks c JOIN (SELECT doc_id, source_file, year_range FROM papers) USING (doc_id))""",
        ASKED_SQL,
        EXPANDED_SQL,
        chain_sql(n=vocab.N_CANDIDATES),
        CANDIDATES_SQL,
        RANKED_SQL,
        JUDGED_SQL,
        select="SELECT query_id, confidence, rank, source, year_range, page, section, distance, text FROM ranked JOIN judged USING (query_id)",
        recursive=True,
    ),
)
def retrieve_chunks(spark, sf_dir):
    """The whole way: papers to chunks, chunks to vectors, questions to evidence."""
    chunks = paper_chunks(spark, sf_dir).withColumnRenamed("text", "document")
    chunks = chunks.withColumn("id", F.col("doc_id") * 100000 + F.col("chunk_id"))
    # read twice, for the ranking and for the ranked texts: fold and encode once
    collection = written(encode_chunks(chunks, text="document"))
    found = A.retrieve(asked(spark, sf_dir), collection).select("query_id", "confidence", F.inline("sources"))
    return found.select("query_id", "confidence", "rank", "source", "year_range", "page", "section", "distance", "text")


# -- judging -------------------------------------------------------------------------


@query("confidence_label", with_ctes(*_TO_JUDGED, select="SELECT query_id, confidence FROM judged"))
def confidence_label(spark, sf_dir):
    return retrieved(spark, sf_dir).select("query_id", "confidence")


# every vector on three pages, so that all four labels occur
_PAGED_SQL = """
paged AS (
  SELECT id * 3 + p - 1 AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 - 0.01 * (p - 1))) AS embedding
  FROM vectors, (VALUES (1), (2), (3)) AS t(p))
"""


@query(
    "confidence_label_vectors",
    with_ctes(
        VECTORS_SQL,
        PROBES_SQL,
        """unit AS (SELECT query_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS embedding FROM probes)""",
        _PAGED_SQL,
        knn_sql(10, queries="unit", collection="paged"),
        select=f"""
        SELECT query_id, {_label_sql("best", "relevant")} AS confidence FROM (
          SELECT query_id, arg_min(distance, rank) AS best, count_if(distance <= {vocab.DISTANCE_INFERRED}) AS relevant
          FROM nearest GROUP BY query_id)""",
    ),
)
def confidence_label_vectors(spark, sf_dir):
    from sparquill.functions.vectors import normalise

    rows = vectors(spark, sf_dir).select("id", "embedding", F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])).alias("p"))
    paged = rows.select(
        (F.col("id") * 3 + F.col("p") - 1).alias("id"),
        F.transform("embedding", lambda x: x.cast("double") * (1 - F.lit(0.01) * (F.col("p") - 1))).alias("embedding"),
    )
    unit = probes(spark, sf_dir).select("query_id", normalise(F.col("embedding")).alias("embedding"))
    nearest = knn(unit, paged, 10)
    sources = F.sort_array(F.collect_list(F.struct("rank", "distance")))
    return nearest.groupBy("query_id").agg(sources.alias("sources")).select(
        "query_id", R.confidence_label(F.col("sources")).alias("confidence")
    )


@query(
    "out_of_scope_gate",
    with_ctes(*_TO_JUDGED, select=f"SELECT query_id, best IS NULL OR best > {vocab.DISTANCE_NO_MATCH} AS out_of_scope FROM judged"),
)
def out_of_scope_gate(spark, sf_dir):
    return retrieved(spark, sf_dir).select("query_id", R.is_out_of_scope(F.col("sources")).alias("out_of_scope"))


# -- prompts -------------------------------------------------------------------------


@query("build_context", with_ctes(*_TO_RANKED, CONTEXT_SQL, select="SELECT query_id, context FROM context"))
def build_context(spark, sf_dir):
    return retrieved(spark, sf_dir).select("query_id", P.build_context(F.col("sources")).alias("context"))


_NOTE_SQL = "CASE WHEN confidence IN ('INFERRED', 'UNSUPPORTED') THEN {0} ELSE '' END"


@query(
    "build_messages",
    with_ctes(
        *_TO_JUDGED,
        CONTEXT_SQL,
        select=f"""
        SELECT query_id, 0 AS pos, 'system' AS role, {literal(vocab.SYSTEM_PROMPT)} AS content FROM asked
        UNION ALL
        SELECT query_id, 1, 'user', 'RETRIEVED SOURCES:' || chr(10) || chr(10) || context || chr(10)
          || {_NOTE_SQL.format("chr(10) || chr(10) || " + literal(vocab.GAP_NOTE))} || chr(10) || 'QUESTION: ' || question
        FROM judged JOIN context USING (query_id)""",
    ),
)
def build_messages(spark, sf_dir):
    messages = P.build_messages(F.col("question"), F.col("sources"), F.col("confidence"))
    return retrieved(spark, sf_dir).select("query_id", F.posexplode(messages).alias("pos", "m")).select(
        "query_id", "pos", "m.role", "m.content"
    )


@query(
    "build_prompt",
    with_ctes(
        *_TO_JUDGED,
        CONTEXT_SQL,
        select=f"""
        SELECT query_id, {literal("<|begin_of_text|><|start_header_id|>system<|end_header_id|>" + chr(10) + vocab.SYSTEM_PROMPT)}
          || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || 'RETRIEVED SOURCES:' || chr(10) || chr(10)
          || context || chr(10) || {_NOTE_SQL.format("chr(10) || " + literal(vocab.GAP_NOTE) + " || chr(10)")}
          || 'QUESTION: ' || question || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) AS prompt
        FROM judged JOIN context USING (query_id)""",
    ),
)
def build_prompt(spark, sf_dir):
    prompt = P.build_prompt(F.col("question"), F.col("sources"), F.col("confidence"))
    return retrieved(spark, sf_dir).select("query_id", prompt.alias("prompt"))


@query("format_references", with_ctes(*_TO_RANKED, REFERENCES_SQL, select="SELECT query_id, refs FROM refs"))
def format_references(spark, sf_dir):
    return retrieved(spark, sf_dir).select("query_id", P.format_references(F.col("sources")).alias("refs"))


# -- answers -------------------------------------------------------------------------


@query("question_route", with_ctes(*_TO_JUDGED, select=f"SELECT query_id, {_ROUTE_SQL} AS route FROM judged"))
def question_route(spark, sf_dir):
    route = R.question_route(F.col("question"), F.col("sources"))
    return retrieved(spark, sf_dir).select("query_id", route.alias("route"))


@query(
    "answer_questions",
    with_ctes(*_TO_ANSWERS, select="SELECT query_id, question, confidence, route, answer, refs FROM answers"),
)
def answer_questions(spark, sf_dir):
    return A.answer(retrieved(spark, sf_dir), routed=True).select(
        "query_id", "question", "confidence", "route", "answer", F.col("references").alias("refs")
    )


@query(
    "batch_summary",
    with_ctes(
        *_TO_JUDGED,
        select="SELECT count(*) AS total_questions, count(*) AS successful, "
        + ", ".join(f"count_if(confidence = {literal(c)})::BIGINT AS {c.lower()}" for c in vocab.CONFIDENCE_LABELS)
        + " FROM judged",
    ),
)
def batch_summary(spark, sf_dir):
    return A.batch_summary(A.answer(retrieved(spark, sf_dir)))


@query(
    "answer_labels",
    with_ctes(
        *_TO_JUDGED,
        "labels_all AS (SELECT unnest([" + ", ".join(literal(c) for c in vocab.CONFIDENCE_LABELS) + "]) AS confidence)",
        select="SELECT l.confidence, count(j.query_id) AS n_answers FROM labels_all l LEFT JOIN judged j USING (confidence) GROUP BY l.confidence",
    ),
)
def answer_labels(spark, sf_dir):
    return V.confidence_distribution(A.answer(retrieved(spark, sf_dir)))


# -- the fixed question sets, over the whole collection ---------------------------------

_DEFAULT_ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {literal(q)})" for i, q in enumerate(vocab.DEFAULT_QUESTIONS)
) + ") AS t(query_id, question))"

_ITEMS_SQL = "items AS (SELECT * FROM (VALUES " + ", ".join(
    f"({literal(i)}, {literal(c)}, {literal(q)}, [{', '.join(literal(r) for r in rubric)}])"
    for i, c, q, rubric in vocab.BENCHMARK
) + ") AS t(query_id, category, question, rubric)),\nasked AS (SELECT query_id, question FROM items)"

_PLAIN_ANSWERS_SQL = ANSWERS_SQL.replace(f"SELECT *, {_ROUTE_SQL} AS route", "SELECT *, 'answer' AS route")

_ITEM_SCORES_SQL = f"""
scores AS (
  SELECT query_id, category, confidence, answer,
         round_even(len(list_filter(rubric, lambda r: len(list_filter({KEYWORDS_SQL.format("r")}, lambda k: contains(lower(answer), k))) > 0))
                    / len(rubric)::DOUBLE, 2) AS rubric_coverage,
         regexp_matches(lower(answer), 'doi:\\s*10\\.\\d{{4,}}') AS has_doi_citation,
         regexp_matches(lower(answer), '\\[(supported|partially_supported|inferred|unsupported)\\]') AS has_confidence_label
  FROM items JOIN answers USING (query_id))
"""


def _chain_from(asked_sql: str, *more: str, select: str) -> str:
    return with_ctes(
        SHELF_SQL, asked_sql, EXPANDED_SQL, chain_sql(n=vocab.N_CANDIDATES), CANDIDATES_SQL, RANKED_SQL, JUDGED_SQL,
        REFERENCES_SQL, _PLAIN_ANSWERS_SQL, *more, select=select,
    )


def benchmark_scores_rows(spark, sf_dir):
    return E.evaluate(spark, shelf(spark, sf_dir))


@query(
    "default_questions",
    _chain_from(_DEFAULT_ASKED_SQL, select="SELECT query_id, question, confidence, answer, refs FROM answers"),
)
def default_questions(spark, sf_dir):
    found = A.retrieve(A.default_questions(spark), shelf(spark, sf_dir))
    return A.answer(found).select("query_id", "question", "confidence", "answer", F.col("references").alias("refs"))


@query(
    "benchmark_scores",
    _chain_from(
        _ITEMS_SQL,
        _ITEM_SCORES_SQL,
        select="SELECT query_id, category, confidence, answer, rubric_coverage, has_doi_citation, has_confidence_label FROM scores",
    ),
)
def benchmark_scores(spark, sf_dir):
    return benchmark_scores_rows(spark, sf_dir).select(
        "query_id", "category", "confidence", "answer", "rubric_coverage", "has_doi_citation", "has_confidence_label"
    )


@query(
    "benchmark_by_category",
    _chain_from(
        _ITEMS_SQL,
        _ITEM_SCORES_SQL,
        select="""
        SELECT category, round_even(sum(round(rubric_coverage * 100)::BIGINT) / count(*)::DOUBLE / 100, 3) AS avg_rubric_coverage
        FROM scores GROUP BY category""",
    ),
)
def benchmark_by_category(spark, sf_dir):
    return V.by_category(benchmark_scores_rows(spark, sf_dir))


@query(
    "benchmark_overall",
    _chain_from(
        _ITEMS_SQL,
        _ITEM_SCORES_SQL,
        select="""
        SELECT (SELECT count(*) FROM items) AS total_questions, count(*) AS successful,
               round_even(sum(round(rubric_coverage * 100)::BIGINT) / count(*)::DOUBLE / 100, 3) AS avg_rubric_coverage,
               round_even(count_if(has_doi_citation) / count(*)::DOUBLE, 3) AS doi_citation_rate,
               round_even(count_if(has_confidence_label) / count(*)::DOUBLE, 3) AS confidence_label_rate
        FROM scores""",
    ),
)
def benchmark_overall(spark, sf_dir):
    return V.overall(benchmark_scores_rows(spark, sf_dir))


@query(
    "eval_rollup",
    _chain_from(
        _ITEMS_SQL,
        _ITEM_SCORES_SQL,
        select="""
        SELECT category, grouping(category)::INT AS level, count(*) AS successful,
               round_even(sum(round(rubric_coverage * 100)::BIGINT) / count(*)::DOUBLE / 100, 3) AS avg_rubric_coverage,
               round_even(count_if(has_doi_citation) / count(*)::DOUBLE, 3) AS doi_citation_rate,
               round_even(count_if(has_confidence_label) / count(*)::DOUBLE, 3) AS confidence_label_rate
        FROM scores GROUP BY ROLLUP (category)""",
    ),
)
def eval_rollup(spark, sf_dir):
    return V.rollup(benchmark_scores_rows(spark, sf_dir))
