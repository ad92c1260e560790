"""Averages and error rates over questions, and the area under the ROC curve.

The grouped forms give null where an average is undefined. The checked forms run one action and raise
ValueError instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of scores that running sums are split into.
RANGES = 4096


def rate(condition: Column) -> Column:
    """Share of rows with a true condition, as an aggregate."""
    return F.avg(condition.cast("double"))


def false_reject_rate(accepted: Column, answerable: Column) -> Column:
    """Share of answerable questions that were not accepted."""
    return F.avg(F.when(answerable, (~accepted).cast("double")))


def false_refusal_rate(refused: Column, answerable: Column) -> Column:
    """Share of answerable questions that were refused."""
    return false_reject_rate(~refused, answerable)


def false_accept_rate(accepted: Column, answerable: Column) -> Column:
    """Share of unanswerable questions that were accepted."""
    return F.avg(F.when(~answerable, accepted.cast("double")))


def checked(df: DataFrame, aggregate: Column, what: str) -> float:
    """The value of an aggregate over a table; ValueError where it is undefined."""
    value = df.agg(aggregate.alias("value")).first()["value"]
    if value is None:
        raise ValueError(f"No {what} to average over")
    return float(value)


def mean_reciprocal_rank(df: DataFrame, column: str = "reciprocal_rank") -> float:
    """Average of reciprocal ranks; ValueError for none, or for one outside 0 to 1."""
    row = df.agg(F.avg(column).alias("mean"), F.count_if(~F.col(column).between(0.0, 1.0)).alias("wrong")).first()
    if row["wrong"]:
        raise ValueError("Reciprocal ranks must be between 0 and 1")
    if row["mean"] is None:
        raise ValueError("No reciprocal ranks to average over")
    return float(row["mean"])


def grouped_auroc(df: DataFrame, by: list[str], score: str, answerable: str) -> DataFrame:
    """(by, auroc): probability that an answerable row scores above an unanswerable one, ties counting half.

    Rows are first counted by distinct score, so the running sum goes over distinct scores only; null where
    a class is missing. Null scores and labels take no part.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(answerable).isNotNull())
    counts = rows.groupBy(*by, score).agg(F.count_if(F.col(answerable)).alias("p"), F.count_if(~F.col(answerable)).alias("n"))
    # running sums first over ranges of scores, then inside each range, so no group is summed in one task
    ends = counts.groupBy(*by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    ranged = counts.join(ends, by).withColumn("_range", F.when(F.col("_high") > F.col("_low"), F.floor((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")) * (RANGES - 1))).otherwise(0))
    held = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_held"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*by, "_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    wins = ranged.join(offsets, [*by, "_range"]).withColumn("w", F.col("p") * (below + F.col("n") / 2))
    return wins.groupBy(*by).agg(F.try_divide(F.sum("w"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def auroc(df: DataFrame, score: str, answerable: str) -> float:
    """AUROC of a table; ValueError for NaN scores and where a class is missing."""
    if df.where(F.isnan(F.col(score).cast("double"))).limit(1).count():
        raise ValueError("Scores must not be NaN")
    row = grouped_auroc(df.withColumn("_all", F.lit(1)), ["_all"], score, answerable).first()
    if row is None or row["auroc"] is None:
        raise ValueError("AUROC needs at least one answerable and one unanswerable question")
    return float(row["auroc"])
