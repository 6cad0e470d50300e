"""Registered queries: scalar text functions and answer scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.operators import encoding as E
from sparquill.operators import evaluation as V
from sparquill.operators.joins import join_small
from sparquill.queries.inputs import _pick, _pick_sql, spread, table, with_ctes
from sparquill.queries.registry import literal, query


@query(
    "section_tag",
    with_ctes(
        "titled AS (SELECT doc_id, split_part(text, chr(10), 1) || ' ' || "
        + _pick_sql("doc_id % 6", ["Tables", "RESULTS", "Background", "Figure 2", "materials", ""])
        + " AS title FROM documents)",
        select="SELECT doc_id, CASE "
        + " ".join(f"WHEN contains(lower(title), {literal(k)}) THEN {literal(t)}" for k, t in vocab.SECTION_TAGS)
        + " ELSE '' END AS tag FROM titled",
    ),
)
def section_tag(spark, sf_dir):
    title = F.concat_ws(
        " ",
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)),
        _pick(F.col("doc_id") % 6, ["Tables", "RESULTS", "Background", "Figure 2", "materials", ""]),
    )
    return table(spark, sf_dir, "documents").select("doc_id", T.section_tag(title).alias("tag"))


@query("text_preview", "SELECT conv_id, turn, substr(text, 1, 100) AS preview FROM conversations")
def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.preview(F.col("text")).alias("preview"))


_SAYINGS = ["  Hello!! ", "hi", "Good Morning.", "What's up?", "hello there", "hey bean", ""]


@query(
    "greeting_gate",
    f"""
    WITH said AS (
      SELECT conv_id, turn, CASE WHEN turn = 0 THEN {_pick_sql(f"conv_id % {len(_SAYINGS)}", _SAYINGS)} ELSE text END AS line
      FROM conversations)
    SELECT conv_id, turn, rtrim(lower(trim(line, ' ' || chr(10))), '!?. ') IN ({", ".join(literal(g) for g in vocab.GREETINGS)}) AS is_greeting
    FROM said
    """,
)
def greeting_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    line = F.when(F.col("turn") == 0, _pick(F.col("conv_id") % len(_SAYINGS), _SAYINGS)).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", T.is_greeting(line).alias("is_greeting"))


_FAULTS = ["HTTP 401", "Unauthorized access", "429 too many", "Rate Limit hit", "HTTP 503", "service Unavailable", "timed out"]


@query(
    "error_classify",
    f"""
    WITH faults AS (SELECT event_id, {_pick_sql(f"event_id % {len(_FAULTS)}", _FAULTS)} || ' ' || event_type AS err FROM events)
    SELECT event_id, CASE
      {" ".join(f"WHEN contains(err, {literal(c)}) OR contains(lower(err), {literal(p)}) THEN {literal(m)}" for c, p, m in vocab.MODEL_ERRORS)}
      ELSE {literal(vocab.MODEL_ERROR_OTHER)} || err END AS message FROM faults
    """,
)
def error_classify(spark, sf_dir):
    err = F.concat_ws(" ", _pick(F.col("event_id") % len(_FAULTS), _FAULTS), "event_type")
    return table(spark, sf_dir, "events").select("event_id", T.model_error_message(err).alias("message"))


KEYWORDS_SQL = (
    r"list_filter(list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{3,}}')), lambda w: w NOT IN ("
    + ", ".join(literal(w) for w in vocab.RUBRIC_STOP_WORDS)
    + "))"
)


@query(
    "rubric_keywords",
    f"SELECT item_id, unnest({KEYWORDS_SQL.format('text')}) AS keyword FROM benchmark",
)
def rubric_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.rubric_keywords(F.col("text"))).alias("keyword"))


# answers: every document, some with a citation or a label at the end
_ENDINGS = [" (doi:10.1234/abc, p.4)", " [Supported]", " doi: 10.99", " [PARTIALLY_SUPPORTED] DOI: 10.55555/x", "", " [unsure]"]
_CATEGORIES = ["direct_lookup", "cross_section", "inference", "critique", "multi_part"]
_ANSWERED_SQL = f"""
answered AS (
  SELECT doc_id, text || {_pick_sql(f"doc_id % {len(_ENDINGS)}", _ENDINGS)} AS answer,
         {_pick_sql(f"doc_id % {len(_CATEGORIES)}", _CATEGORIES)} AS category,
         {_pick_sql(f"doc_id % 4", vocab.CONFIDENCE_LABELS)} AS confidence,
         CASE WHEN n_chars < 400 THEN 'no answer' END AS error,
         doc_id % (SELECT count(*) FROM benchmark) AS item_id
  FROM documents)
"""
_RUBRIC_SQL = r"""
rubrics AS (
  SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                                             lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '') AS rubric
  FROM benchmark)
"""
_SCORED_SQL = f"""
item_words AS (
  SELECT item_id, len(rubric) AS n_items, list_transform(rubric, lambda r: {KEYWORDS_SQL.format("r")}) AS words FROM rubrics),
scored AS (
  SELECT doc_id, category, confidence, error,
         coalesce(round_even(len(list_filter(words, lambda ks: len(list_filter(ks, lambda k: contains(lower(answer), k))) > 0))
                  / nullif(n_items, 0)::DOUBLE, 2), 0.0) AS rubric_coverage,
         regexp_matches(lower(answer), 'doi:\\s*10\\.\\d{{4,}}') AS has_doi_citation,
         regexp_matches(lower(answer), '\\[(supported|partially_supported|inferred|unsupported)\\]') AS has_confidence_label
  FROM answered JOIN item_words USING (item_id))
"""


def answered(spark, sf_dir):
    doc_id = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat("text", _pick(doc_id % len(_ENDINGS), _ENDINGS)).alias("answer"),
        _pick(doc_id % len(_CATEGORIES), _CATEGORIES).alias("category"),
        _pick(doc_id % 4, vocab.CONFIDENCE_LABELS).alias("confidence"),
        F.when(F.col("n_chars") < 400, "no answer").alias("error"),
    )


def scored(spark, sf_dir):
    """Every document scored against the rubric of one benchmark item."""
    rubrics = table(spark, sf_dir, "benchmark").select(
        "item_id", T.rubric_word_lists(T.sentences(F.col("text"))).alias("word_lists")
    )
    rows = spread(answered(spark, sf_dir)).withColumn("item_id", F.col("doc_id") % rubrics.count())
    rows = join_small(rows, rubrics, "item_id")
    score = V.score_answer(F.col("answer"), F.col("word_lists"), F.col("confidence"))
    return rows.withColumn("s", score).select(
        "doc_id", "category", "confidence", "error", "s.rubric_coverage", "s.has_doi_citation", "s.has_confidence_label"
    )


_SCORE_PARTS = (_ANSWERED_SQL, _RUBRIC_SQL, _SCORED_SQL)


@query("doi_citation", with_ctes(_ANSWERED_SQL, select="SELECT doc_id, regexp_matches(lower(answer), 'doi:\\s*10\\.\\d{4,}') AS cited FROM answered"))
def doi_citation(spark, sf_dir):
    return answered(spark, sf_dir).select("doc_id", T.has_doi_citation(F.col("answer")).alias("cited"))


@query(
    "confidence_label_present",
    with_ctes(_ANSWERED_SQL, select="SELECT doc_id, regexp_matches(lower(answer), '\\[(supported|partially_supported|inferred|unsupported)\\]') AS labelled FROM answered"),
)
def confidence_label_present(spark, sf_dir):
    return answered(spark, sf_dir).select("doc_id", T.has_confidence_label(F.col("answer")).alias("labelled"))


@query(
    "rubric_score",
    with_ctes(*_SCORE_PARTS, select="SELECT doc_id, rubric_coverage, has_doi_citation, has_confidence_label FROM scored"),
)
def rubric_score(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "rubric_coverage", "has_doi_citation", "has_confidence_label")


@query(
    "eval_by_category",
    with_ctes(
        *_SCORE_PARTS,
        select="""
        SELECT category, round_even(sum(round(rubric_coverage * 100)::BIGINT) / count(*)::DOUBLE / 100, 3) AS avg_rubric_coverage
        FROM scored WHERE error IS NULL GROUP BY category""",
    ),
)
def eval_by_category(spark, sf_dir):
    return V.by_category(scored(spark, sf_dir))


@query(
    "eval_overall",
    with_ctes(
        *_SCORE_PARTS,
        select="""
        SELECT (SELECT count(*) FROM scored) AS total_questions, count(*) AS successful,
               round_even(sum(round(rubric_coverage * 100)::BIGINT) / count(*)::DOUBLE / 100, 3) AS avg_rubric_coverage,
               round_even(count_if(has_doi_citation) / count(*)::DOUBLE, 3) AS doi_citation_rate,
               round_even(count_if(has_confidence_label) / count(*)::DOUBLE, 3) AS confidence_label_rate
        FROM scored WHERE error IS NULL""",
    ),
)
def eval_overall(spark, sf_dir):
    return V.overall(scored(spark, sf_dir))


@query(
    "eval_categories_only",
    with_ctes(
        _ANSWERED_SQL,
        select="SELECT category, count(*) AS n_questions FROM answered WHERE category IN ('direct_lookup', 'inference') GROUP BY category",
    ),
)
def eval_categories_only(spark, sf_dir):
    chosen = V.only_categories(answered(spark, sf_dir), ["direct_lookup", "inference"])
    return chosen.groupBy("category").agg(F.count(F.lit(1)).alias("n_questions"))


@query(
    "eval_outcomes",
    with_ctes(_ANSWERED_SQL, select="SELECT error IS NULL AS succeeded, count(*) AS n_answers FROM answered GROUP BY 1"),
)
def eval_outcomes(spark, sf_dir):
    return answered(spark, sf_dir).groupBy(V.succeeded().alias("succeeded")).agg(F.count(F.lit(1)).alias("n_answers"))


@query(
    "confidence_distribution",
    with_ctes(
        _ANSWERED_SQL,
        # SUPPORTED is relabelled, so that one label has no answer: its count must still appear, as zero
        "labels_all AS (SELECT unnest([" + ", ".join(literal(c) for c in vocab.CONFIDENCE_LABELS) + "]) AS confidence)",
        select="""
        SELECT l.confidence, count(a.doc_id) AS n_answers
        FROM labels_all l LEFT JOIN (
          SELECT doc_id, CASE confidence WHEN 'SUPPORTED' THEN 'INFERRED' ELSE confidence END AS confidence FROM answered) a
        USING (confidence) GROUP BY l.confidence""",
    ),
)
def confidence_distribution(spark, sf_dir):
    label = F.col("confidence")
    relabelled = F.when(label == "SUPPORTED", "INFERRED").otherwise(label)
    return V.confidence_distribution(answered(spark, sf_dir).withColumn("confidence", relabelled))


@query(
    "round_half_even",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity::BIGINT / 16.0)::DOUBLE AS x,
           round_even((l_quantity::BIGINT / 16.0)::DOUBLE, 2)::DOUBLE AS r2, round_even((l_quantity::BIGINT / 16.0)::DOUBLE, 3)::DOUBLE AS r3
    FROM lineitem
    """,
)
def round_half_even(spark, sf_dir):
    x = F.col("l_quantity").cast("long") / F.lit(16.0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", x.alias("x"),
        T.round_half_even(x, 2).alias("r2"), T.round_half_even(x, 3).alias("r3"),
    )


@query(
    "encode_throughput",
    """
    SELECT user_id, CASE WHEN sum(second(ts)::BIGINT % 7) > 0 THEN count(*) / sum(second(ts)::BIGINT % 7)::DOUBLE ELSE 0.0 END AS per_second
    FROM events GROUP BY user_id
    """,
)
def encode_throughput(spark, sf_dir):
    seconds = F.sum(F.second("ts") % 7)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        E.throughput(F.count(F.lit(1)), seconds).alias("per_second")
    )

