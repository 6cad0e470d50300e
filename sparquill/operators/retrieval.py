"""From a question to ranked evidence: expand, retrieve, deduplicate, rerank, label."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparquill import vocab
from sparquill.functions import text as T

PairScorer = Callable[[Column, Column], Column]

SOURCE = (
    "struct<rank:int,text:string,source:string,doi:string,year_range:string,page:int,section:string,"
    "distance:double,rerank_score:double>"
)


# -- query expansion ----------------------------------------------------------


_MARK = "\\u0001"


def expand_queries(
    questions: DataFrame,
    question: str = "question",
    output: str = "expanded",
    synonyms: list[tuple[str, list[str]]] | None = None,
) -> DataFrame:
    """Append up to six aliases of the dictionary terms found inside each question.

    Terms match as substrings, in dictionary order, two aliases each.  An alias that is
    itself a word of the question is not added.  The dictionary is fixed and short, so
    it becomes one generated expression: no join, no lambda, and nothing is shuffled.
    """

    def quoted(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    cases = []
    for term, aliases in synonyms or vocab.SYNONYMS:
        for alias in aliases[: vocab.MAX_ALIASES_PER_TERM]:
            condition = f"contains(_lower, {quoted(term)})"
            if len(alias.split()) == 1:  # an alias of several words is never one word of the question
                condition += f" AND NOT array_contains(_asked, {quoted(alias.lower())})"
            cases.append(f"CASE WHEN {condition} THEN {quoted(alias)} END")

    lowered = questions.withColumn("_lower", F.lower(question))
    asked = lowered.withColumn("_asked", F.split("_lower", rf"(?U){T.WS}+", -1))
    found = asked.withColumn("_found", F.expr(f"concat_ws('{_MARK}', {', '.join(cases)})"))
    first = F.slice(F.split("_found", "\x01"), 1, vocab.MAX_ADDED_ALIASES)
    expanded = F.when(F.col("_found") == "", F.col(question)).otherwise(
        F.concat(question, F.lit(" "), F.array_join(first, " "))
    )
    return found.withColumn(output, expanded).drop("_lower", "_asked", "_found")


# -- candidates ---------------------------------------------------------------


def normalise_candidates(nearest: DataFrame) -> DataFrame:
    """kNN rows with metadata to the retrieved-chunk shape, defaults filled in."""
    source = F.coalesce(F.col("source_file"), F.lit("unknown"))
    return nearest.select(
        "query_id",
        "rank",
        F.col("document").alias("text"),
        source.alias("source"),
        T.filename_to_doi(source).alias("doi"),
        F.coalesce(F.col("year_range"), F.lit("unknown")).alias("year_range"),
        F.col("page_number").cast("int").alias("page"),
        F.coalesce(F.col("section"), F.lit("")).alias("section"),
        T.round_half_even(F.col("distance"), 4).alias("distance"),
        F.lit(None).cast("double").alias("rerank_score"),
    )


def deduplicate(candidates: DataFrame, *keys: str) -> DataFrame:
    """Keep the nearest row per key, the first one on ties.

    Written as an aggregate, not a window: copies are already merged before the
    shuffle, so a page with very many copies costs no more than any other.
    """
    keys = keys or ("query_id", "source", "page")
    others = [c for c in candidates.columns if c not in keys]
    best = F.min_by(F.struct(*others), F.struct("distance", "rank")).alias("_best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*candidates.columns)


# -- rerank -------------------------------------------------------------------


def lexical_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that occur in the text."""
    asked = F.array_distinct(T.words(question))
    return T.let(
        asked,
        lambda q: F.coalesce(F.size(F.array_intersect(q, T.words(text))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)),
    )


def cross_encoder_score(model_name: str) -> PairScorer:
    """Scores from a cross-encoder; NULL for every pair where the model cannot be used."""

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        try:
            from sentence_transformers import CrossEncoder  # optional

            model = CrossEncoder(model_name, max_length=512)
        except Exception:
            model = None
        for questions, texts in batches:
            if model is None:
                yield pa.nulls(len(questions), pa.float64())
            else:
                pairs = list(zip(questions.to_pylist(), texts.to_pylist()))
                try:
                    scores = pa.array([float(s) for s in model.predict(pairs)], pa.float64())
                except Exception:  # its questions keep their order by distance, see ``rerank``
                    scores = pa.nulls(len(questions), pa.float64())
                yield scores

    return score.asNondeterministic()


def rerank(candidates: DataFrame, scorer: PairScorer | None = lexical_score, top_k: int = vocab.TOP_K) -> DataFrame:
    """Best ``top_k`` per question by pair score; without scores, by distance.

    ``candidates`` carry the original ``question``, which is what the scorer sees.  A question of which a pair could not
    be scored has no scores at all: scores of some rows and distances of others cannot be compared.
    """
    if scorer is not None:
        failed = F.count_if(F.col("rerank_score").isNull()).over(W.partitionBy("query_id"))
        candidates = candidates.withColumn("rerank_score", scorer(F.col("question"), F.col("text")))
        candidates = candidates.withColumn("rerank_score", F.when(failed == 0, F.col("rerank_score")))
    order = W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "distance", "rank")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def collect_sources(ranked: DataFrame) -> DataFrame:
    """``(query_id, sources)``: the ranked rows of each question, at most ``top_k`` of them."""
    fields = [f.split(":")[0] for f in SOURCE[len("struct<") : -1].split(",")]
    return ranked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields).cast(SOURCE))).alias("sources")
    )


# -- judging the evidence (expressions over the ``sources`` array) ------------


def confidence_label(sources: Column) -> Column:
    """Label from the distance of the first source and the number of relevant ones."""
    best = F.get(sources, 0)["distance"]
    relevant = F.size(F.filter(sources, lambda s: s["distance"] <= vocab.DISTANCE_INFERRED))
    return (
        F.when((best <= vocab.DISTANCE_SUPPORTED) & (relevant >= 3), "SUPPORTED")
        .when((best <= vocab.DISTANCE_PARTIAL) & (relevant >= 2), "PARTIALLY_SUPPORTED")
        .when(best <= vocab.DISTANCE_INFERRED, "INFERRED")
        .otherwise("UNSUPPORTED")
    )


def is_out_of_scope(sources: Column) -> Column:
    best = F.get(sources, 0)["distance"]
    return best.isNull() | (best > vocab.DISTANCE_NO_MATCH)


def question_route(question: Column, sources: Column) -> Column:
    return (
        F.when(T.strip(question) == "", "blank")
        .when(T.is_greeting(question), "greeting")
        .when(is_out_of_scope(sources), "out_of_scope")
        .otherwise("answer")
    )
