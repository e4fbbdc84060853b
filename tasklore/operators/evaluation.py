"""Scores of generated answers against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.functions import similarity, text

REPORT_ROWS = 5


def score(pairs: DataFrame) -> DataFrame:
    """Add cleaned texts, exact match, term recall and similarity to (expected, generated) rows."""
    cleaned = pairs.withColumns({"generated_clean": similarity.clean(F.col("generated")),
                                 "expected_clean": similarity.clean(F.col("expected"))})
    g, e = F.col("generated_clean"), F.col("expected_clean")
    return cleaned.withColumns({
        "exact_match": similarity.exact_match(g, e),
        "correct_extraction": similarity.term_recall(g, e),
        "similarity_score": similarity.jaccard(g, e)})


def _rates():
    n = F.count("*")
    return [
        n.alias("num_examples"),
        F.try_divide(F.count_if("correct_extraction"), n).alias("accuracy"),
        F.try_divide(F.count_if("exact_match"), n).alias("exact_match_rate"),
        F.count_if("correct_extraction").alias("correct_extractions"),
        F.count_if("exact_match").alias("exact_matches"),
    ]


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(*_rates())


def by_category(scored: DataFrame, category: str) -> DataFrame:
    return scored.groupBy(category).agg(*_rates(), F.avg("similarity_score").alias("avg_similarity"))


def best_and_worst(scored: DataFrame, key: str, k: int = REPORT_ROWS) -> DataFrame:
    """Top and bottom rows by similarity, ties by key; two bounded top-k selections, no global window."""
    def part(name: str, *order) -> DataFrame:
        return scored.orderBy(*order).limit(k).select(
            F.lit(name).alias("part"), key, "similarity_score", "exact_match", "correct_extraction",
            text.preview(F.col("generated")).alias("generated_preview"), text.preview(F.col("expected")).alias("expected_preview"))

    worst = part("worst", F.col("similarity_score"), F.col(key).desc())
    return part("best", F.col("similarity_score").desc(), key).unionByName(worst)


def perplexity(losses: DataFrame, loss: str = "loss") -> DataFrame:
    return losses.agg(F.avg(loss).alias("average_loss"), F.exp(F.avg(loss)).alias("perplexity"),
                      F.count(loss).alias("num_examples"))
