"""Exact cosine search: every query vector against every indexed vector, the best k of each query.

Vectors are normalised once; a zero vector scores 0 with everything. Queries meet the index in blocks of
bounded size, one after the other. A task multiplies in single precision and computes again, in double
precision, the pairs that could be among the best by the error that single precision can have; what a query
has found so far in the task is the bound for what follows, and only the best k of a task leave it. Ties are
broken by position, in the task as in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.vectors import l2_normalize, ranked
from pageloom.session import block_by_block

TOP_K = 5
#: Query vectors of one block at least, and of one matrix product.
BLOCK, AT_ONCE = 4096, 256
#: Bytes of query vectors in one block, where that is more of them.
SENT = 32 * 2**20
#: Indexed vectors of one matrix product, bytes of the index (as stored) in one task where that makes more tasks than cores, and results that a task holds.
TILE, TASK, HELD = 2048, 128 * 2**20, 2**22
#: Candidates of a query in a tile above which the whole tile is computed again instead of single pairs, and numbers that pairs take up at once.
CROWD, GATHERED = 64, 2**22
#: Digits of a score; equal vectors tie whatever the order in which their products were added.
DIGITS = 12


def check_k(k: object) -> None:
    """Raises ValueError unless k is a positive integer (numpy's too, never a bool)."""
    if isinstance(k, (bool, np.bool_)) or not isinstance(k, (int, np.integer)) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")


def checked_vectors(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """The rows with normalised vectors; a vector of another length stops the job before anything is kept."""
    right = F.size(vector) == dimension
    made = F.when(right, l2_normalize(F.col(vector))).otherwise(F.raise_error(F.concat(F.lit(f"expected vectors of {dimension} numbers, got "), F.size(vector).cast("string"))))
    return rows.withColumn(vector, made)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def best_of_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest entries of each row, the smaller column first among equals."""
    width = scores.shape[1]
    least = np.partition(scores, width - k, axis=1)[:, width - k, None] if k < width else -np.inf
    row, column = np.nonzero(scores >= least)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, np.arange(len(scores)))
    kept = np.arange(len(row)) - starts[row] < k
    return row[kept], column[kept]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """One row for each vector; ValueError unless all have one length."""
    lengths = pc.list_value_length(vectors).unique().to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"expected vectors of one length, got {sorted(lengths)}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), *lengths or [0])


#: (row, place, score) of what each row has found, by row, then from the best.
Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best_of_both(parts: list[Best], rows: int, k: int) -> Best:
    row, place, score = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((np.unique(place, return_inverse=True)[1] if place.dtype == object else place, -score, row))
    row, place, score = row[order], place[order], score[order]
    kept = (np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row] < k) & (score > -np.inf)
    return row[kept], place[kept], score[kept]


def best_with_tile(best: Best, wanted: np.ndarray, quick: np.ndarray, places: np.ndarray, units: np.ndarray, down: np.ndarray, k: int, own: np.ndarray | None = None) -> Best:
    """The k best of each row of ``wanted`` among what it has and a tile of vectors (``units``, in the order of their places).

    ``quick`` and ``down`` are the rows, and the tile turned, in single precision. ``own`` has the place that
    each row must not find.
    """
    rows, width = len(wanted), len(units)
    counts = np.bincount(best[0], minlength=rows)
    full = counts >= k
    least = np.full(rows, -np.inf, np.float32)
    # twice what single precision can be off, for products of so many numbers of unit vectors
    slack = (units.shape[1] + 8) * 2.0**-23
    least[full] = best[2][np.cumsum(counts)[full] - 1] - slack
    products = quick @ down
    near = np.flatnonzero(products.max(axis=1) >= least)
    if not len(near):
        return best
    products, least = products[near], least[near]
    starting = np.flatnonzero(~full[near])
    if len(starting) and width > k:
        first = products[starting]
        if own is not None:
            first[np.equal.outer(own[near[starting]], places)] = -np.inf
        least[starting] = np.partition(first, width - k, axis=1)[:, width - k] - 2 * slack
    row, column = np.nonzero(products >= least[:, None])
    crowded = np.bincount(row, minlength=len(near)) > CROWD
    single = ~crowded[row]
    row, column, parts = near[row[single]], column[single], [best]
    if own is not None:
        other = own[row] != places[column]
        row, column = row[other], column[other]
    step = max(1, GATHERED // max(1, units.shape[1]))
    for first in range(0, len(row), step):
        r, c = row[first : first + step], column[first : first + step]
        parts.append((r, places[c], np.round(np.einsum("ij,ij->i", wanted[r], units[c]), DIGITS)))
    if crowded.any():
        whole = near[crowded]
        scores = np.round(wanted[whole] @ units.T, DIGITS)
        if own is not None:
            scores[np.equal.outer(own[whole], places)] = -np.inf
        r, c = best_of_rows(scores, k)
        parts.append((whole[r], places[c], scores[r, c]))
    return _best_of_both(parts, rows, k)


def top_k(index: DataFrame, queries: DataFrame, k: int = TOP_K, not_self: bool = False, block: int | None = None) -> DataFrame:
    """(query, position, score, rank): the k best positions of every query, all of them if there are fewer; vectors of different lengths stop the job.

    Null ids and vectors take no part. An empty index or query set gives no rows. ``not_self`` leaves out a
    position equal to the query. ``block`` is the number of query vectors in one block.
    """
    check_k(k)
    types = {f.name: f.dataType for f in (*index.schema.fields, *queries.schema.fields)}
    schema = T.StructType([T.StructField("query", types["query"]), T.StructField("position", types["position"]), T.StructField("score", T.DoubleType())])
    rows = index.select("position", "vector").where("position is not null and vector is not null")
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    rows = rows.coalesce(max(index.sparkSession.sparkContext.defaultParallelism, min(size // TASK, 2**20)))
    asked = queries.select("query", "vector").where("query is not null and vector is not null")

    def search(found: pa.Table) -> tuple[DataFrame, Broadcast]:
        names, vectors = (found.column(c).combine_chunks() for c in ("query", "vector"))
        sent = index.sparkSession.sparkContext.broadcast((names, _matrix(vectors)))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = sent.value
            wanted = _unit(matrix.astype(float))
            quick = wanted.astype(np.float32)
            named = names.to_numpy(zero_copy_only=False)
            groups = [slice(first, first + AT_ONCE) for first in range(0, len(names), AT_ONCE)]
            best: list[Best] = []

            def results(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
                for group, (row, place, score) in zip(groups, best):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(group.start + row)), pa.array(place, kind), pa.array(score)], schema.names)
                best.clear()

            kind = None
            for batch in batches:
                if not len(names) or not len(batch):
                    continue
                kind, vectors = batch.column(0).type, _matrix(batch.column(1))
                if wanted.shape[1] != vectors.shape[1]:
                    raise ValueError(f"expected query vectors of {vectors.shape[1]} numbers, got {wanted.shape[1]}")
                places = batch.column(0).to_numpy(zero_copy_only=False)
                order = np.argsort(places, kind="stable")
                places, vectors = places[order], vectors[order]
                if not best:
                    best += [(np.zeros(0, int), places[:0], np.zeros(0))] * len(groups)
                for first in range(0, len(places), TILE):
                    units = _unit(vectors[first : first + TILE].astype(float))
                    there = ~np.isnan(units).any(axis=1)
                    if not there.any():
                        continue
                    units, tile = units[there], places[first : first + TILE][there]
                    down = np.ascontiguousarray(units.T, np.float32)
                    for n, group in enumerate(groups):
                        best[n] = best_with_tile(best[n], wanted[group], quick[group], tile, units, down, k, named[group].astype(tile.dtype) if not_self else None)
                if sum(len(x[0]) for x in best) > HELD:
                    yield from results(kind)
            if best:
                yield from results(kind)

        return rows.mapInArrow(nearest, schema), sent

    if block is None:
        numbers = asked.agg(F.max(F.size("vector"))).first()[0] or 1
        block = max(BLOCK, SENT // (numbers * (4 if isinstance(types["vector"].elementType, T.FloatType) else 8)))
    found = block_by_block(asked, ["query"], math.ceil(asked.count() / block), search, DataFrame.toArrow)
    return ranked(found, ["query"], "score", ["position"]).where(F.col("rank") <= k)
