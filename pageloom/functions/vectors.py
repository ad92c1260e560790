"""Vector functions over array columns, and the best answer span of start and end logits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    """Euclidean length, in double precision."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length))


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest."""
    top = F.array_max(logits)
    raised = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def window_ranges(n_tokens: Column, size: int | Column, stride: int) -> Column:
    """array<struct<start,end>> of windows of ``size`` tokens, each overlapping the one before by ``stride``; no tokens give one empty window.

    A size given as a column must be above the stride in every row.
    """
    if isinstance(size, int) and size <= stride or stride < 0:
        raise ValueError(f"window size must be above the stride, got {size} and {stride}")
    step = size - F.lit(stride)
    count = F.when(n_tokens <= size, 1).otherwise(1 + F.ceil((n_tokens - size) / step)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct((i * step).cast("int").alias("start"), F.least(i * step + size, n_tokens).cast("int").alias("end")),
    )


def best_span_rows(start: np.ndarray, end: np.ndarray, context: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, score) of the best span of each row; the score is 0 where "no answer" (position 0) is at least as likely.

    Probabilities are taken over the context and position 0. Spans hold at most ``longest`` tokens of the
    context; ties go to the earlier start, then the earlier end.
    """
    seen = context.copy()
    seen[:, 0] = True
    shares = []
    for logits in (np.asarray(start, float), np.asarray(end, float)):
        hidden = np.where(seen, logits, -np.inf)
        raised = np.exp(hidden - hidden.max(axis=1, keepdims=True))
        shares.append(raised / raised.sum(axis=1, keepdims=True))
    none = shares[0][:, 0] * shares[1][:, 0]
    first, last = (np.where(context, x, 0.0) for x in shares)
    n, width = context.shape
    best, reach = np.zeros((n, width)), np.zeros((n, width), np.int64)
    for ahead in range(min(longest, width)):
        scores = first[:, : width - ahead] * last[:, ahead:]
        better = scores > best[:, : width - ahead]
        best[:, : width - ahead][better] = scores[better]
        reach[:, : width - ahead][better] = ahead
    at = best.argmax(axis=1)
    rows = np.arange(n)
    score = best[rows, at]
    return at, at + reach[rows, at], np.where(score > none, score, 0.0)


def best_spans(windows: DataFrame, keys: list[str], start: str, end: str, allowed: str, longest: int) -> DataFrame:
    """(keys, start_token, end_token, score) of the best span of each window, or none where "no answer" wins.

    ``start`` and ``end`` are arrays of logits, ``allowed`` the context positions. Every window is decided
    where it is, in Arrow batches; nothing is shuffled.
    """

    @F.pandas_udf("start_token int, end_token int, score double")
    def found(starts: pd.Series, ends: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        width = max(map(len, starts), default=0)
        logits = [np.full((len(starts), width), -np.inf) for _ in range(2)]
        context = np.zeros((len(starts), width), bool)
        for row, (s, e, c) in enumerate(zip(starts, ends, contexts)):
            logits[0][row, : len(s)], logits[1][row, : len(e)] = s, e
            context[row, np.asarray(c, np.int64)] = True
        return pd.DataFrame(dict(zip(("start_token", "end_token", "score"), best_span_rows(*logits, context, longest))))

    scored = windows.where(F.size(start) > 0).withColumn("_s", found.asNondeterministic()(start, end, allowed))
    return scored.where("_s.score > 0").select(*keys, "_s.start_token", "_s.end_token", "_s.score")


def ranked(df: DataFrame, by: list[str], score: str, ties: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank by falling score; ties by the given columns."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *ties)))
