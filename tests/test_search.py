import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.functions import vectors
from pageloom.operators import embedders, readers, routing, search


def test_best_of_rows_keeps_the_smaller_column_among_equals():
    scores = np.array([[1.0, 3, 3, 2, 3], [0, 0, 0, 0, 0], [5, 4, 3, 2, 1]])
    for k in (1, 2, 4, 5, 9):
        row, column = search.best_of_rows(scores, k)
        for i, line in enumerate(scores):
            want = sorted(range(5), key=lambda j: (-line[j], j))[:k]
            assert column[row == i].tolist() == want


def test_normalisation_and_product(spark):
    row = spark.range(1).select(vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d")).first()
    assert row.v == [0.6, 0.8] and row.z == [0.0, 0.0] and row.d == 11.0


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_search_equals_numpy_with_ties_zeros_and_nulls(spark, block):
    rng = np.random.default_rng(3)
    matrix = rng.integers(-2, 3, (60, 4)).astype(float)
    matrix[7] = 0
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)] + [(None, [1.0] * 4), (99, None)], "position long, vector array<double>")
    queries = index.where("position % 9 = 0").withColumnRenamed("position", "query").repartition(3)
    unit = matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) > 0, n, 1)
    got = {}
    for r in search.top_k(index, queries, 5, not_self=True, block=block).collect():
        got[r.query, r["rank"]] = r.position
    for q in range(0, 60, 9):
        scores = np.round(unit @ unit[q], 12)
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-scores[i], i))
        assert [scores[got[q, k + 1]] for k in range(5)] == [scores[i] for i in order[:5]]
    few = search.top_k(index.where("position < 3"), queries.where("query = 9"), 10)
    assert few.count() == 3
    assert search.top_k(index.limit(0), queries, 3).count() == 0 and search.top_k(index, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("k", [0, -1, True, 1.0, "3", None])
def test_k_is_checked(spark, k):
    with pytest.raises(ValueError):
        search.check_k(k)


def test_vectors_of_wrong_length_stop_the_job(spark):
    index = spark.createDataFrame([(1, [1.0, 2.0])], "position long, vector array<double>")
    with pytest.raises(Exception, match="expected query vectors of 2 numbers, got 3"):
        search.top_k(index, spark.createDataFrame([(7, [1.0, 2.0, 3.0])], "query long, vector array<double>")).collect()
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert search.checked_vectors(df, "v", 2).count() == 1
    with pytest.raises(Exception, match="expected vectors of 3"):
        search.checked_vectors(df, "v", 3).collect()


@pytest.mark.parametrize("threshold", [True, "0.2", 1.1, math.nan, math.inf, None])
def test_threshold_is_checked(threshold):
    with pytest.raises(ValueError):
        routing.check_threshold(threshold)


def test_route_at_the_threshold(spark):
    results = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.2 - 2**-40), (3, 1, 0.9), (3, 2, 0.1)], "query long, rank int, score double")
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query long")
    rows = {r.query: r for r in routing.route(asked, results).collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["supported", "below_threshold", "supported", "no_documents"]
    assert rows[4].top_score is None and rows[4].reason == "No documents have been indexed." and not rows[4].supported
    assert rows[2].reason.startswith("Top similarity 0.200 is below the threshold of 0.200") and [x["rank"] for x in rows[3].results] == [1, 2]


def test_embedders_and_text_search(spark):
    chunks = spark.createDataFrame([("d", 1, 0, "The pump and the valve"), ("d", 1, 1, "A meter"), ("d", 2, 0, None)], "source string, page_number int, chunk_index int, text string")
    embed = embedders.keyword_embedder(["pump", "meter"])
    index = routing.build_index(chunks, embed, ["source", "page_number", "chunk_index"])
    asked = spark.createDataFrame([(1, "Which meter?"), (2, "Nothing")], "query long, question string")
    best = {r.query: r for r in routing.search(index, asked, embed).join(index, "position").where("rank = 1").collect()}
    assert best[1].text == "A meter" and best[1].score == pytest.approx(1.0) and best[2].score == 0.0
    with pytest.raises(Exception, match="Question must not be empty"):
        routing.search(index, spark.createDataFrame([(1, " ")], "query long, question string"), embed).collect()
    lengths = chunks.where("text is not null").select(vectors.norm(embedders.hashing_embedder(64)(F.col("text"))).alias("n")).collect()
    assert all(r.n == pytest.approx(1.0, abs=1e-5) for r in lengths)


def naive_windows(n, size, stride):
    out, start = [], 0
    while True:
        end = min(start + size, n)
        out.append((start, end))
        if end == n:
            return out
        start = end - stride


def test_windows(spark):
    for size, stride in ((5, 2), (4, 0), (10, 9)):
        rows = spark.range(40).select("id", vectors.window_ranges(F.col("id").cast("int"), size, stride).alias("w")).collect()
        for r in rows:
            assert [(x.start, x.end) for x in r.w] == naive_windows(r.id, size, stride)
    with pytest.raises(ValueError):
        vectors.window_ranges(F.lit(3), 4, 4)


def test_best_spans_of_rows_of_different_lengths(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(40):
        n = 12 + i % 3
        start, end = rng.normal(0, 3, n).round(3), rng.normal(0, 3, n).round(3)
        rows.append((i, start.tolist(), end.tolist(), list(range(3, n - 2))))
        seen = [0, *range(3, n - 2)]
        s, e = np.exp(start) / np.exp(start[seen]).sum(), np.exp(end) / np.exp(end[seen]).sum()
        best = max(((s[a] * e[b], -a, -b) for a in range(3, n - 2) for b in range(a, min(a + 4, n - 2))))
        if best[0] > s[0] * e[0]:
            want[i] = (-best[1], -best[2], pytest.approx(best[0]))
    df = spark.createDataFrame([*rows, (99, [], [], []), (98, None, None, None)], "id int, s array<double>, e array<double>, c array<int>")
    assert {r.id: (r.start_token, r.end_token, r.score) for r in vectors.best_spans(df, ["id"], "s", "e", "c", 4).collect()} == want


def test_a_task_gives_its_best_once_and_reads_the_index_once_for_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(7)
    index = spark.createDataFrame([(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(400)], "position long, vector array<double>").repartition(2)
    queries = spark.range(5000).select(F.col("id").alias("query"), F.array(*(((F.col("id") * n) % 7 - 3).cast("double") for n in (1, 2, 3))).alias("vector"))
    seen = {}
    monkeypatch.setattr(search, "ranked", lambda found, *rest: seen.update(rows=found.groupBy("query").count().agg(F.max("count")).first()[0]) or vectors.ranked(found, *rest))
    inner = search.block_by_block
    monkeypatch.setattr(search, "block_by_block", lambda items, keys, blocks, *rest: seen.update(blocks=blocks) or inner(items, keys, blocks, *rest))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = search.top_k(index, queries, 3)
        assert found.groupBy("query").count().where("count = 3").count() == 5000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen["blocks"] == 1 and seen["rows"] <= 3 * 2


@pytest.mark.parametrize("k", [1, 4, 90])
def test_tiles_in_single_precision_lose_nothing(monkeypatch, k):
    rng = np.random.default_rng(k)
    matrix = search._unit(np.vstack([rng.normal(0, 1, (300, 24)), rng.integers(-1, 2, (300, 24)), np.repeat(rng.normal(0, 1, (1, 24)), 100, 0), np.zeros((20, 24))]).astype(float))
    matrix = matrix[rng.permutation(len(matrix))]
    # close to each other by less than single precision can tell
    matrix[100:140] = search._unit(matrix[99] + rng.normal(0, 1e-9, (40, 24)))
    wanted = np.vstack([matrix[::30], matrix[99:100], np.zeros((1, 24))])
    own = np.array([*range(0, len(matrix), 30), 99, -1])
    for left_out in (None, own):
        best = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        for first in range(0, len(matrix), 50):
            units = matrix[first : first + 50]
            best = search.best_with_tile(best, wanted, wanted.astype(np.float32), np.arange(first, first + len(units)), units, np.ascontiguousarray(units.T, np.float32), k, left_out)
        scores = np.round(wanted @ matrix.T, search.DIGITS)
        if left_out is not None:
            scores[np.equal.outer(left_out, np.arange(len(matrix)))] = -np.inf
        row, column = search.best_of_rows(scores, k)
        assert best[0].tolist() == row.tolist()
        assert np.abs(best[2] - scores[row, column]).max() < 1e-11 and np.mean(best[1] == column) > 0.99
