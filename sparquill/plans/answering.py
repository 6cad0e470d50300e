"""Batch question answering: every question of a DataFrame at once."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.operators import prompting as P
from sparquill.operators import retrieval as R
from sparquill.operators.encoding import Encoder, encode_chunks
from sparquill.operators.knn import knn
from sparquill.sources.chunk_files import write_run_metadata

METADATA = ("document", "source_file", "year_range", "page_number", "section")


def default_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(vocab.DEFAULT_QUESTIONS)), "query_id int, question string")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of strings, numbered in list order."""
    texts = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("q"))
    return texts.select(F.posexplode("q").alias("query_id", "question"))


def candidates(
    questions: DataFrame,
    collection: DataFrame,
    n_candidates: int = vocab.N_CANDIDATES,
    where: dict[str, Any] | None = None,
    encoder: Encoder | None = None,
    **knn_options: Any,
) -> DataFrame:
    """Expanded, retrieved and deduplicated chunks per question."""
    expanded = R.expand_queries(questions).select("query_id", F.col("expanded").alias("text"))
    queries = encode_chunks(expanded, encoder=encoder)
    nearest = knn(queries, collection, n_candidates, where, columns=METADATA, **knn_options)
    return R.deduplicate(R.normalise_candidates(nearest))


def retrieve(
    questions: DataFrame,
    collection: DataFrame,
    top_k: int = vocab.TOP_K,
    n_candidates: int = vocab.N_CANDIDATES,
    where: dict[str, Any] | None = None,
    encoder: Encoder | None = None,
    scorer: R.PairScorer | None = R.lexical_score,
    routed: bool = False,
    **knn_options: Any,
) -> DataFrame:
    """``(query_id, question, sources, confidence)``, one row per question.

    ``routed`` leaves blank questions and greetings out of the search: their reply is fixed.

    ``questions`` has ``query_id, question``.  The rank inside ``sources`` starts at 1.
    """
    question = F.col("question")
    searched = questions.where((T.strip(question) != "") & ~T.is_greeting(question)) if routed else questions
    found = candidates(searched, collection, n_candidates, where, encoder, **knn_options)
    ranked = R.rerank(found.join(questions.select("query_id", "question"), "query_id"), scorer, top_k)
    per_question = questions.join(R.collect_sources(ranked), "query_id", "left")
    empty = F.array().cast(f"array<{R.SOURCE}>")
    return per_question.withColumn("sources", F.coalesce("sources", empty)).withColumn(
        "confidence", R.confidence_label(F.col("sources"))
    )


def answer(
    retrieved: DataFrame,
    generator: P.Generator = P.extractive_generator,
    model: str = "extractive",
    year_filter: str | None = None,
    n_candidates: int = vocab.N_CANDIDATES,
    top_k: int = vocab.TOP_K,
    routed: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Answer records.  A failed generation becomes answer text, never a failed job.

    ``tasks`` spreads the calls of the generator: questions are small rows, which adaptive execution
    otherwise gathers in few tasks.

    ``routed`` adds the front-end behaviour: blank questions, greetings and questions
    out of scope get their fixed reply, and the generator is not called for them.
    """
    question, sources, confidence = F.col("question"), F.col("sources"), F.col("confidence")
    route = R.question_route(question, sources) if routed else F.lit("answer")
    prepared = retrieved.withColumn("route", route).withColumn(
        "prompt", F.when(F.col("route") == "answer", P.build_prompt(question, sources, confidence))
    )
    if tasks is not None:
        prepared = prepared.repartition(tasks, "query_id")
    generated = prepared.withColumn(
        "_g", generator(F.col("prompt"), P.build_messages(question, sources, confidence), sources)
    )
    error = F.col("_g.error")
    failure = (
        F.concat(F.lit("⚠️ "), T.model_error_message(error))
        if routed
        else F.concat(
            F.lit("[LLM ERROR] "), error, F.lit(". Retrieval succeeded with confidence="), confidence, F.lit(".")
        )
    )
    text = (
        F.when(F.col("route") == "blank", "")
        .when(F.col("route") == "greeting", vocab.WELCOME_MESSAGE)
        .when(F.col("route") == "out_of_scope", vocab.OUT_OF_SCOPE_MESSAGE)
        .when(error.isNotNull(), failure)
        .otherwise(F.col("_g.answer"))
    )
    listed = F.when((F.col("route") == "answer") & error.isNull(), P.format_references(sources)).otherwise("")
    return generated.select(
        "query_id",
        "question",
        "route",
        text.alias("answer"),
        "confidence",
        F.transform(
            sources,
            lambda s: F.struct(
                s["doi"].alias("doi"),
                s["page"].alias("page"),
                s["year_range"].alias("year_range"),
                s["section"].alias("section"),
                s["distance"].alias("distance"),
                s["rerank_score"].alias("rerank_score"),
            ),
        ).alias("sources"),
        listed.alias("references"),
        F.lit(model).alias("model"),
        F.lit(year_filter).cast("string").alias("year_filter"),
        F.lit(n_candidates).alias("n_candidates"),
        F.lit(top_k).alias("top_k"),
        error.alias("error"),
    )


def batch_summary(answers: DataFrame) -> DataFrame:
    """One row: how many questions, how many answered, and the label counts.

    A failed generation leaves answer text and counts as answered; only a question without retrieval does not.
    """
    ok = F.col("sources").isNotNull()
    return answers.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(ok).alias("successful"),
        *[
            F.count_if(F.col("confidence") == label).alias(label.lower())
            for label in vocab.CONFIDENCE_LABELS
        ],
    )


def write_answers(answers: DataFrame, path: str, configuration: dict[str, Any] | None = None) -> None:
    """``results``, ``summary`` and ``run`` as JSON below ``path``; the summary reads the results.

    ``run`` has the summary, the seconds that answering took, and the settings given in ``configuration``.
    """
    root = path.rstrip("/")
    began = time.monotonic()
    answers.write.mode("overwrite").json(f"{root}/results")
    seconds = round(time.monotonic() - began, 2)
    stored = answers.sparkSession.read.schema(answers.schema).json(f"{root}/results")
    summary = batch_summary(stored)
    summary.write.mode("overwrite").json(f"{root}/summary")
    write_run_metadata(summary, f"{root}/run", {**(configuration or {}), "seconds": seconds})
