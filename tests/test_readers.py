import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.functions import vectors
from pageloom.functions.text import NOT_AVAILABLE
from pageloom.operators import readers
from pageloom.operators.readers import extractive_reader, generative_reader, overlap_reader, packed_prompts, padded, word_offsets

TASK = "id int, question string, context array<struct<chunk_id:string,text:string>>, seconds double"
CONTEXT = [("c0", "The pump runs for 18 months."), ("c1", "  "), ("c2", "The key is in the safe."), ("c3", None)]


def slow_best(start, end, allowed, longest):
    """Best span by trying all of them."""
    seen = [0, *allowed]
    p = [np.exp(x[seen] - x[seen].max()) / np.exp(x[seen] - x[seen].max()).sum() for x in (start, end)]
    share = [dict(zip(seen, x)) for x in p]
    best = max(((share[0][i] * share[1][j], -i, -j) for i in allowed for j in allowed if i <= j < i + longest), default=(0, 0, 0))
    return (-best[1], -best[2]) if best[0] > share[0][0] * share[1][0] else None


def test_best_spans_of_a_batch_equal_trying_all():
    rng = np.random.default_rng(5)
    for n, width, longest in ((20, 9, 3), (20, 14, 30), (5, 2, 1)):
        start, end = rng.normal(size=(n, width)).round(1), rng.normal(size=(n, width)).round(1)
        context = rng.random((n, width)) < 0.8
        context[:, 0] = False
        first, last, score = vectors.best_span_rows(start, end, context, longest)
        for row in range(n):
            want = slow_best(start[row], end[row], [*np.flatnonzero(context[row])], longest)
            assert (want is None) == (score[row] == 0) and (want is None or want == (first[row], last[row]))


def test_padded_batch():
    batch = padded([["how", "long"], ["why"]], [["a", "b", "c"], []])
    assert batch.tokens.tolist() == [["", "how", "long", "", "a", "b", "c", ""], ["", "why", "", "", "", "", "", ""]]
    assert batch.attention.sum(axis=1).tolist() == [8, 4] and batch.segments.tolist() == [[0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 1, 0, 0, 0, 0]]
    assert batch.context.tolist() == [[False] * 4 + [True] * 3 + [False], [False] * 8]


def pointer(word, high=6.0, fails=()):
    """A model that points at one word, and cannot read windows with some others."""

    def make():
        def model(batch):
            if any(x in batch.tokens for x in fails):
                raise RuntimeError("cannot read")
            logits = np.where(batch.tokens == word, high, 0.0)
            logits[:, 0] = 1.0
            return logits, logits

        return model

    return make


def test_extractive_reader(spark):
    long = [("x", "word " * 50 + "18 " + "word " * 50), ("y", "none 18")]
    rows = [(1, "How long?", CONTEXT), (2, " ", CONTEXT), (3, "a?", [CONTEXT[1]]), (4, "a " * 30, CONTEXT), (5, "How long?", long), (6, "How long?", [("z", "no such word")]), (7, None, None), (8, "How long?", [("b", "bad 18")])]
    tasks = spark.createDataFrame([(*r, 9.0) for r in rows], TASK)
    out = {r.id: r for r in extractive_reader(pointer("18", fails=("bad",)), max_length=20, doc_stride=2)(tasks, ["id"]).collect()}
    assert len(out) == 8
    assert (out[1].prediction, out[1].answer_chunk_id, out[1].used_chunk_ids) == ("18", "c0", ["c0", "c2"]) and CONTEXT[0][1][out[1].start_char : out[1].end_char] == "18"
    assert (out[5].prediction, out[5].answer_chunk_id, out[5].start_char) == ("18", "y", 5) or out[5].answer_chunk_id == "x"
    assert out[6].prediction is None and out[6].error is None and out[6].used_chunk_ids == ["z"]
    assert "Question must not" in out[2].error and "at least one chunk" in out[3].error and "too long" in out[4].error and "Question must" in out[7].error
    assert out[8].error == "RuntimeError: cannot read" and out[8].used_chunk_ids is None
    none = extractive_reader(pointer("18"), max_length=20, doc_stride=2, min_score=1.1)(tasks.where("id = 1"), ["id"]).first()
    assert none.prediction is None and none.confidence is None and none.error is None


def test_prompts_hold_as_many_leading_chunks_as_fit(spark):
    base = len(word_offsets(spark.range(1).select(readers.build_prompt(F.lit("Why?"), F.array().cast("array<string>"))).first()[0]))
    context = [(f"c{i}", f" one two three four{i} ") for i in range(4)]
    tasks = spark.createDataFrame([(1, "Why?", context, 0.0)], TASK)
    for room in range(0, 26):
        row = packed_prompts(tasks, ["id"], max_input_tokens=base + room).first()
        fitting = min(4, room // 5)
        if room < 2:
            assert "too long" in row.error and row.prompt is None
            continue
        assert row.error is None and len(row.used_chunk_ids) == max(1, fitting) and len(word_offsets(row.prompt)) <= base + room
        assert ("[1] one two three four0" in row.prompt) == (room >= 5) and f"[{max(1, fitting)}] one" in row.prompt
        assert room >= 5 or "[1] " + " ".join("one two three".split()[: room - 1]) + "\n\nQuestion" in row.prompt


def test_generative_reader(spark):
    replies = {"a": " 18 months ", "b": "Not available.", "c": "unanswerable", "d": "", "e": "no answer"}
    tasks = spark.createDataFrame([(i, x, CONTEXT, 0.0) for i, x in enumerate([*replies, "f", None])], TASK)

    def make():
        return lambda prompts: [replies[x.rpartition("Question: ")[2].split()[0]] for x in prompts]

    out = {r.id: r for r in generative_reader(make)(tasks, ["id"]).collect()}
    assert [out[i].prediction for i in range(5)] == ["18 months", NOT_AVAILABLE, NOT_AVAILABLE, NOT_AVAILABLE, "no answer"]
    assert out[0].used_chunk_ids == ["c0", "c2"] and out[5].error == "KeyError: 'f'" and "must not be empty" in out[6].error


def test_failures_stay_in_their_rows(spark):
    tasks = spark.createDataFrame([(1, "How long does the pump run?", CONTEXT, 0.0), (2, " ", CONTEXT, 0.0), (3, "Why?", [], 0.0), (4, None, None, 0.0)], TASK)
    rows = {r.id: r for r in overlap_reader()(tasks, ["id"]).collect()}
    assert rows[1].prediction.startswith("The pump") and rows[1].error is None and rows[1].answer_chunk_id == "c0" and rows[1].start_char == 0
    assert "Question must not be empty" in rows[2].error and "at least one chunk" in rows[3].error and rows[4].prediction is None

    def broken():
        raise OSError("no weights")

    for reader in (generative_reader(broken), extractive_reader(broken)):
        assert {r.error for r in reader(tasks.where("id = 1"), ["id"]).collect()} == {"reader failed to load: OSError: no weights"}
    assert overlap_reader()(tasks.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("size,stride", [(3, 3), (2, 5)])
def test_windows_must_be_wider_than_their_stride(size, stride):
    with pytest.raises(ValueError):
        vectors.window_ranges(F.lit(9), size, stride)


def test_overlap_reader_joins_answers_only_and_keeps_given_columns(spark):
    rows = [(1, "Which red valve?", [("a", "The pump is off. The red valve leaks."), ("b", "A red valve. Which red valve is it?"), ("c", "  ")]), (2, "Which?", [("d", "Nothing here.")]), (3, " ", [("e", "Which?")]), (4, "Which?", None)]
    tasks = spark.createDataFrame(rows, "id long, question string, context array<struct<chunk_id:string,text:string>>")
    read = readers.overlap_reader()(tasks, ["id"])
    got = {r.id: r for r in read.collect()}
    assert {i: got[i].context for i in got} == {i: tasks.where(F.col("id") == i).first().context for i in (1, 2, 3, 4)}
    assert (got[1].prediction, got[1].answer_chunk_id, got[1].confidence, got[1].start_char, got[1].used_chunk_ids) == ("Which red valve is it?", "b", 1.0, 13, ["a", "b"])
    assert got[2].prediction is None and got[2].error is None and got[2].used_chunk_ids == ["d"]
    assert got[3].error.startswith("ValueError: Question") and got[4].error.startswith("ValueError: Context") and got[4].used_chunk_ids is None
    plan = read.select("id", "prediction", "used_chunk_ids", "error")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
