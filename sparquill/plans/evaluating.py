"""The question benchmark: answer, score, summarise, report."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T
from sparquill.operators import evaluation as V
from sparquill.operators import prompting as P
from sparquill.plans import answering as A
from sparquill.sources.chunk_files import write_run_metadata


def benchmark(spark: SparkSession, categories: list[str] | None = None) -> DataFrame:
    """``(query_id, category, question, rubric)``."""
    schema = "query_id string, category string, question string, rubric array<string>"
    return V.only_categories(spark.createDataFrame(vocab.BENCHMARK, schema), categories)


def score(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One scored row per benchmark item; an item without an answer is an error."""
    joined = items.join(answers.drop("question"), "query_id", "left").withColumn(
        "error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("no answer")))
    )
    scores = V.score_answer(F.col("answer"), T.rubric_word_lists(F.col("rubric")), F.col("confidence"))
    return joined.withColumn("scores", scores).select("*", "scores.*").drop("scores")


def evaluate(
    spark: SparkSession,
    collection: DataFrame,
    generator: P.Generator = P.extractive_generator,
    categories: list[str] | None = None,
    top_k: int = vocab.TOP_K,
    n_candidates: int = vocab.N_CANDIDATES,
    **options: Any,
) -> DataFrame:
    items = benchmark(spark, categories)
    retrieved = A.retrieve(items.select("query_id", "question"), collection, top_k, n_candidates, **options)
    return score(items, A.answer(retrieved, generator, n_candidates=n_candidates, top_k=top_k))


def write_report(scored: DataFrame, path: str, configuration: dict[str, Any] | None = None) -> None:
    """``results``, ``summary``, ``by_category``, ``confidence`` and ``run`` as JSON below ``path``.

    The results are written first and summed up from there, so that questions are only
    answered once.  ``run`` has the summary, the seconds that took, and the settings given in ``configuration``.
    """
    spark, root = scored.sparkSession, path.rstrip("/")
    began = time.monotonic()
    scored.write.mode("overwrite").json(f"{root}/results")
    seconds = round(time.monotonic() - began, 2)
    results = spark.read.schema(scored.schema).json(f"{root}/results")
    V.overall(results).write.mode("overwrite").json(f"{root}/summary")
    write_run_metadata(V.overall(results), f"{root}/run", {**(configuration or {}), "seconds": seconds})
    V.by_category(results).write.mode("overwrite").json(f"{root}/by_category")
    V.confidence_distribution(results.where(V.succeeded())).write.mode("overwrite").json(f"{root}/confidence")
