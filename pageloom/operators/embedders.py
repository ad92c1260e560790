"""Embedders: functions from a string column to a column of unit vectors, given to the operators that need one.

They need no model; one that does is given as a function that is called once in each Python worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[Column], Column]
_VECTOR = T.ArrayType(T.FloatType())
#: Words whose hashes are remembered, and texts counted at once.
WORDS, AT_ONCE = 2**17, 512


def embedder(embed: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embedder:
    """An embedder around a model that is made once in each worker: texts -> matrix; rows are normalised, nulls stay null."""

    @F.pandas_udf(_VECTOR)
    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embed()
        for batch in batches:
            there = batch.notna()
            out = pd.Series([None] * len(batch), dtype=object, index=batch.index)
            if there.any():
                matrix = model(batch[there].tolist())
                lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
                matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0).astype(np.float32)
                out[there] = pd.Series([*matrix], index=batch.index[there], dtype=object)
            yield out

    return lambda text: embedded(text)


def keyword_embedder(keywords: Sequence[str]) -> Embedder:
    """Counts of the given words, letter case aside; texts without any get the zero vector."""

    def make():
        return lambda texts: np.array([[x.lower().count(word.lower()) for word in keywords] for x in texts], float).reshape(len(texts), len(keywords))

    return embedder(make)


def hashing_embedder(dimension: int = 256) -> Embedder:
    """Signed hashed counts of words, damped by their logarithm; equal on every machine."""

    def make():
        word = re.compile(r"\w+")

        @lru_cache(WORDS)
        def place(found: str) -> int:
            code = int(hashlib.md5(found.encode()).hexdigest()[:8], 16)
            return code % dimension + (dimension if code >= 2**31 else 0)

        def embed(texts: list[str]) -> np.ndarray:
            matrix = np.zeros((len(texts), dimension))
            for first in range(0, len(texts), AT_ONCE):
                places = [[place(x) for x in word.findall(text.lower())] for text in texts[first : first + AT_ONCE]]
                rows = np.repeat(np.arange(len(places)), [len(x) for x in places])
                counts = np.bincount(rows * 2 * dimension + np.fromiter(chain.from_iterable(places), int, len(rows)), minlength=len(places) * 2 * dimension).reshape(-1, 2, dimension)
                matrix[first : first + AT_ONCE] = counts[:, 1] - counts[:, 0]
            return np.sign(matrix) * np.log1p(np.abs(matrix))

        return embed

    return embedder(make)


def not_blank(text: Column, what: str = "Question") -> Column:
    """The text, or an error where it is null or blank."""
    return F.when(text.rlike(r"(?U)\S"), text).otherwise(F.raise_error(F.lit(f"{what} must not be empty")))
