"""Search by text, and the route of each question: supported, below the threshold, or no documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.embedders import Embedder, not_blank
from pageloom.operators.search import TOP_K, top_k

THRESHOLD = 0.2


def check_threshold(threshold: object) -> None:
    """Raises ValueError unless the threshold is a real number from -1 to 1."""
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)) or not math.isfinite(threshold) or not -1 <= threshold <= 1:
        raise ValueError(f"similarity_threshold must be a number from -1 to 1, got {threshold!r}")


def build_index(chunks: DataFrame, embed: Embedder, order: list[str]) -> DataFrame:
    """The chunks with a ``vector`` and a ``position`` of their own, which rises in the given order; repeated chunks have different ones.

    Positions depend on the run of the sort: write the index, or make it durable, before it is used twice.
    """
    return chunks.orderBy(*order).withColumn("position", F.monotonically_increasing_id()).withColumn("vector", embed(F.col("text")))


def search(index: DataFrame, questions: DataFrame, embed: Embedder, k: int = TOP_K) -> DataFrame:
    """(query, position, score, rank) of questions (query, question) against an index; a blank question is an error."""
    asked = questions.select("query", embed(not_blank(F.col("question"))).alias("vector"))
    return top_k(index, asked, k)


def route_status(top_score: Column, threshold: float = THRESHOLD) -> Column:
    """Status of a question by its best score; null means that nothing is indexed. The threshold itself is supported."""
    return F.when(top_score.isNull(), "no_documents").when(top_score >= F.lit(float(threshold)), "supported").otherwise("below_threshold")


# The texts of the reasons.
def route_reason(top_score: Column, threshold: float = THRESHOLD) -> Column:
    """The status in words, scores to three decimals (rounded as Java does)."""
    wanted = f"{threshold:.3f}"
    shown = F.format_string("%.3f", top_score)
    below = F.concat(F.lit("Top similarity "), shown, F.lit(f" is below the threshold of {wanted}, so the documents most likely do not cover this question."))
    meets = F.concat(F.lit("Top similarity "), shown, F.lit(f" meets the threshold of {wanted}."))
    return F.when(top_score.isNull(), "No documents have been indexed.").when(top_score >= F.lit(float(threshold)), meets).otherwise(below)


def route(questions: DataFrame, results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query, status, supported, reason, top_score, results): one row for every question, with its results in rank order."""
    check_threshold(threshold)
    carried = [c for c in results.columns if c not in ("query",)]
    gathered = results.groupBy("query").agg(F.max("score").alias("top_score"), F.array_sort(F.collect_list(F.struct("rank", *[c for c in carried if c != "rank"]))).alias("results"))
    routed = questions.select("query").join(gathered, "query", "left")
    status = route_status(F.col("top_score"), threshold)
    return routed.select("query", status.alias("status"), (status == "supported").alias("supported"), route_reason(F.col("top_score"), threshold).alias("reason"), "top_score", "results")
