"""Scoring answers against rubrics and summing the scores up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill import vocab
from sparquill.functions import text as T


def score_answer(answer: Column, word_lists: Column, confidence: Column) -> Column:
    """Scores of one answer; ``word_lists`` are the rubric's keywords, item by item."""
    return F.struct(
        T.covered_share(answer, word_lists).alias("rubric_coverage"),
        T.has_doi_citation(answer).alias("has_doi_citation"),
        T.has_confidence_label(answer).alias("has_confidence_label"),
        confidence.alias("retrieval_confidence"),
    )


def succeeded() -> Column:
    return F.col("error").isNull()


def _mean_coverage() -> Column:
    # coverages have two decimals: add them up as whole hundredths, so that the sum
    # does not depend on the order in which tasks finish
    hundredths = F.sum(F.rint(F.col("rubric_coverage") * 100).cast("long"))
    return T.round_half_even(hundredths / F.nullif(F.count("rubric_coverage"), F.lit(0)) / 100, 3)


def _rate(flag: str) -> Column:
    return T.round_half_even(F.count_if(F.col(flag)) / F.nullif(F.count(flag), F.lit(0)), 3)


def overall(scored: DataFrame) -> DataFrame:
    """One row over the successful answers; zeros when there are none."""
    ok = scored.withColumn("_ok", succeeded())
    for c in ("rubric_coverage", "has_doi_citation", "has_confidence_label"):
        ok = ok.withColumn(c, F.when(F.col("_ok"), F.col(c)))
    return ok.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if("_ok").alias("successful"),
        F.coalesce(_mean_coverage(), F.lit(0.0)).alias("avg_rubric_coverage"),
        F.coalesce(_rate("has_doi_citation"), F.lit(0.0)).alias("doi_citation_rate"),
        F.coalesce(_rate("has_confidence_label"), F.lit(0.0)).alias("confidence_label_rate"),
    )


def by_category(scored: DataFrame) -> DataFrame:
    return scored.where(succeeded()).groupBy("category").agg(_mean_coverage().alias("avg_rubric_coverage"))


def rollup(scored: DataFrame) -> DataFrame:
    """``overall`` and ``by_category`` in one pass: a row per category, and one for all with a null category and ``level`` 1.

    A null category of a question is a category of its own, with ``level`` 0.
    """
    ok = scored.where(succeeded())
    return ok.rollup("category").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("successful"),
        F.coalesce(_mean_coverage(), F.lit(0.0)).alias("avg_rubric_coverage"),
        F.coalesce(_rate("has_doi_citation"), F.lit(0.0)).alias("doi_citation_rate"),
        F.coalesce(_rate("has_confidence_label"), F.lit(0.0)).alias("confidence_label_rate"),
    )


def only_categories(questions: DataFrame, categories: list[str] | None) -> DataFrame:
    return questions.where(F.col("category").isin(categories)) if categories else questions


def confidence_distribution(answers: DataFrame) -> DataFrame:
    """All four labels with their counts, zero where a label does not occur."""
    counts = [F.count_if(F.col("confidence") == label).alias(label) for label in vocab.CONFIDENCE_LABELS]
    return answers.agg(*counts).unpivot([], vocab.CONFIDENCE_LABELS, "confidence", "n_answers")
