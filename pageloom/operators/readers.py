"""Readers: answers from chunks, with the model as an exchangeable part.

A reader is a function from tasks (key columns, ``question`` and ``context``, an array of chunk_id and text in
order) to tasks with the OUTPUT columns. Guards, windows, prompt packing and the choice between windows are
relational; only tokenizing and the model's calls run in Arrow batches. A failing call becomes an error in its
row, never a failed job.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions import vectors
from pageloom.functions.text import NOT_AVAILABLE, build_prompt, says_not_available, strip
from pageloom.operators.chunking import split_sentences

OUTPUT = ["prediction", "used_chunk_ids", "confidence", "answer_chunk_id", "start_char", "end_char", "error", "seconds"]
#: (tasks, key columns) -> tasks with the OUTPUT columns, one row for each.
Reader = Callable[[DataFrame, list[str]], DataFrame]
Offsets = list[tuple[int, int]]
_CONTEXT = "array<struct<chunk_id:string,text:string>>"


def word_offsets(text: str) -> Offsets:
    """Tokens of the stand-in tokenizer: places of runs of non-blanks."""
    return [x.span() for x in re.finditer(r"\S+", text)]


def offsets_column(text: Column, tokenize: Callable[[str], Offsets] = word_offsets) -> Column:
    """array<struct<start,end>>: places of a text's tokens; null for null."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else [{"start": a, "end": b} for a, b in tokenize(x)] for x in batch], dtype=object)

    return placed.asNondeterministic()(text)


def guarded(tasks: DataFrame) -> DataFrame:
    """Tasks with ``context`` reduced to chunks with text, and ``error`` for a blank question or a context without any."""
    kept = F.filter(F.coalesce("context", F.array().cast(_CONTEXT)), lambda x: F.coalesce(strip(x["text"]) != "", F.lit(False)))
    error = F.when(F.coalesce(strip(F.col("question")), F.lit("")) == "", "ValueError: Question must not be empty").when(F.size("context") == 0, "ValueError: Context must include at least one chunk with text")
    return tasks.drop(*OUTPUT).withColumn("context", kept).withColumn("error", error)


def _answered(tasks: DataFrame, keys: list[str], answers: DataFrame, used: Column) -> DataFrame:
    """The given tasks with the OUTPUT columns: an answer's, or the guard's error.

    ``used`` may name ``_kept``, the ids of the chunks with text; they are taken before the join, which moves no texts then.
    """
    tasks = tasks.drop(*OUTPUT)
    guard = guarded(tasks.withColumn("_context", F.col("context"))).where(reduce(and_, (F.col(k).isNotNull() for k in keys)))
    own = [F.col("_context" if c == "context" else c).alias(c) for c in tasks.columns]
    kept = guard.select(*own, F.transform("context", lambda x: x["chunk_id"]).alias("_kept"), F.col("error").alias("_guard"))
    joined = kept.join(answers, keys, "left")
    error = F.coalesce("_guard", "error")
    out = {
        "prediction": F.col("prediction"), "used_chunk_ids": F.when(error.isNull(), used), "confidence": F.col("confidence").cast("double"), "answer_chunk_id": F.col("answer_chunk_id"),
        "start_char": F.col("start_char").cast("int"), "end_char": F.col("end_char").cast("int"), "error": error, "seconds": F.coalesce(F.col("seconds").cast("double"), F.lit(0.0)),
    }
    return joined.select(*tasks.columns, *(v.alias(k) for k, v in out.items()))


def _called(model: Callable, rows: int, call: Callable[[slice], object]) -> tuple[list, list]:
    """(results, errors) of a model called on a whole batch at once; where that fails, on each row alone, so that only the failing rows have errors."""
    try:
        return [*call(slice(0, rows))], [None] * rows
    except Exception:  # found again below, in the row it belongs to
        results, errors = [], []
        for row in range(rows):
            try:
                results += [*call(slice(row, row + 1))]
                errors.append(None)
            except Exception as raised:  # recorded in its row
                results.append(None)
                errors.append(f"{type(raised).__name__}: {raised}")
        return results, errors


def _loaded(make: Callable) -> tuple[object, str | None]:
    try:
        return make(), None
    except Exception as raised:  # recorded in every row, so that other readers' results survive
        return None, f"reader failed to load: {type(raised).__name__}: {raised}"


@dataclass(frozen=True)
class Padded:
    """One batch for an extractive model: position 0, the question, a separator, the window, a separator, then padding.

    ``tokens`` holds strings ("" in special places), ``attention`` 1 where no padding is, ``segments`` 1 in the
    window and its separator, ``context`` true in the window.
    """

    tokens: np.ndarray
    attention: np.ndarray
    segments: np.ndarray
    context: np.ndarray


def padded(questions: Sequence[Sequence[str]], windows: Sequence[Sequence[str]]) -> Padded:
    """Pairs of question and window tokens on one width, that of the longest pair."""
    widths = [len(q) + len(w) + 3 for q, w in zip(questions, windows)]
    shape = len(widths), max(widths, default=0)
    tokens, numbers = np.full(shape, "", object), np.arange(shape[1])[None]
    begins = np.array([len(q) + 2 for q in questions])[:, None]
    ends = np.array(widths)[:, None]
    for row, (question, window) in enumerate(zip(questions, windows)):
        tokens[row, 1 : len(question) + 1] = question
        tokens[row, len(question) + 2 : len(question) + 2 + len(window)] = window
    attention = numbers < ends
    return Padded(tokens, attention.astype(np.int8), (attention & (numbers >= begins)).astype(np.int8), (numbers >= begins) & (numbers < ends - 1))


#: Start and end logits of a batch, in the shape of its tokens.
SpanModel = Callable[[Padded], tuple[np.ndarray, np.ndarray]]


def extractive_reader(make: Callable[[], SpanModel], tokenize: Callable[[str], Offsets] = word_offsets, max_length: int = 384, doc_stride: int = 128, longest: int = 30, min_score: float = 0.1) -> Reader:
    """A reader around a model that is made once in each worker and called once for each batch of windows.

    The best window wins, the earlier one on ties; no answer where "no answer" is likelier or the score is below ``min_score``.
    """

    def read(tasks: DataFrame, keys: list[str]) -> DataFrame:
        own = guarded(tasks).where("error is null").withColumn("_q", offsets_column(F.col("question"), tokenize))
        size = F.lit(max_length - 3) - F.size("_q")
        sized = own.withColumn("_size", size).withColumn("_long", F.col("_size") <= doc_stride)
        too_long = sized.where("_long").select(*keys, F.concat(F.lit("ValueError: Question is too long ("), F.size("_q").cast("string"), F.lit(f" tokens) for max_length={max_length}")).alias("error"))
        chunks = sized.where("not _long").select(*keys, "question", "_q", "_size", F.posexplode("context").alias("_place", "_c"))
        tokens = chunks.withColumn("_t", offsets_column(F.col("_c.text"), tokenize))
        cut = tokens.select("*", F.posexplode(vectors.window_ranges(F.size("_t"), F.col("_size"), doc_stride)).alias("_window", "_w"))
        words = lambda text, places: F.transform(places, lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"]))
        inside = F.slice("_t", F.col("_w.start") + 1, F.col("_w.end") - F.col("_w.start"))
        rows = cut.select(*keys, "_place", "_window", "_c", inside.alias("_t"), words(F.col("question"), F.col("_q")).alias("_question"), words(F.col("_c.text"), inside).alias("_tokens"))

        def predicted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            model, broken = _loaded(make)
            for questions, windows in batches:
                began = time.perf_counter()
                n, begins = len(questions), questions.map(len).to_numpy() + 2

                def call(rows: slice, questions=questions, windows=windows) -> list:
                    batch = padded([*questions.iloc[rows]], [*windows.iloc[rows]])
                    return [*zip(*vectors.best_span_rows(*model(batch), batch.context, longest))]

                found, errors = ([None] * n, [broken] * n) if broken else _called(model, n, call)
                spans = [(None, None, None) if x is None or not x[2] > 0 else (int(x[0]) - b, int(x[1]) - b, float(x[2])) for x, b in zip(found, begins)]
                out = pd.DataFrame(spans, columns=["first", "last", "score"]).astype({"first": "Int32", "last": "Int32", "score": "Float64"})
                yield out.assign(error=errors, seconds=(time.perf_counter() - began) / max(1, n))

        called = F.pandas_udf(predicted, "first int, last int, score double, error string, seconds double")
        scored = rows.withColumn("_s", called.asNondeterministic()("_question", "_tokens"))
        start, end = F.get("_t", F.col("_s.first"))["start"], F.get("_t", F.col("_s.last"))["end"]
        answer = F.struct(F.substring(F.col("_c.text"), start + 1, end - start).alias("prediction"), F.col("_s.score").alias("confidence"), F.col("_c.chunk_id").alias("answer_chunk_id"), start.alias("start_char"), end.alias("end_char"))
        order = F.struct(-F.col("_s.score"), "_place", "_window")
        best = scored.groupBy(*keys).agg(F.min_by(F.when(F.col("_s.score") >= min_score, answer), F.when(F.col("_s.score").isNotNull(), order)).alias("_b"), F.max("_s.error").alias("error"), F.sum("_s.seconds").alias("seconds"))
        answers = best.select(*keys, "_b.*", "error", "seconds").unionByName(too_long, allowMissingColumns=True)
        return _answered(tasks, keys, answers, F.col("_kept"))

    return read


def packed_context(chunks: DataFrame, keys: list[str], order: list[str], tokens: Column, budget: int | Column) -> DataFrame:
    """The leading chunks of each group, with their ``place``, whose token counts add up to at most the budget.

    For counters that add up and count at least 1 a chunk: no more than ``budget`` chunks can fit, and a
    group, however large, is cut to these before and after the shuffle.
    """
    ordered = Window.partitionBy(*keys).orderBy(*order)
    leading = chunks.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= budget)
    cost = F.sum(tokens).over(Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return leading.withColumn("tokens_so_far", cost).where(F.col("tokens_so_far") <= budget)


def packed_prompts(tasks: DataFrame, keys: list[str], tokenize: Callable[[str], Offsets] = word_offsets, max_input_tokens: int = 512) -> DataFrame:
    """(keys, prompt, used_chunk_ids, error): prompts of the leading chunks that fit; where not even the first does, of its beginning.

    For tokenizers whose counts add up over parts that blank lines set apart. A chunk costs its number in
    brackets and its text; each text is tokenized once.
    """
    none = F.array().cast("array<string>")
    own = guarded(tasks).where("error is null").withColumn("_base", F.size(offsets_column(build_prompt(F.col("question"), none), tokenize)))
    parts = own.select(*keys, "question", (F.lit(max_input_tokens) - F.col("_base")).alias("_room"), F.posexplode("context").alias("_place", "_c"))
    label = F.concat(F.lit("["), (F.col("_place") + 1).cast("string"), F.lit("]"))
    parts = parts.withColumns({"_label": F.size(offsets_column(label, tokenize)), "_t": offsets_column(strip(F.col("_c.text")), tokenize)})
    fitting = packed_context(parts, keys, ["_place"], F.col("_label") + F.size("_t"), F.col("_room"))
    room = F.col("_room") - F.col("_label")
    last = F.get("_t", F.least(room, F.size("_t")) - 1)["end"]
    first = parts.where("_place = 0").join(fitting.select(*keys).distinct(), keys, "left_anti")
    cut = first.where(room > 0).select(*keys, "question", "_place", F.col("_c.chunk_id").alias("chunk_id"), F.substring(strip(F.col("_c.text")), F.lit(1), last).alias("text"))
    whole = fitting.select(*keys, "question", "_place", F.col("_c.chunk_id").alias("chunk_id"), F.col("_c.text").alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("_place", "chunk_id", "text")))
    gathered = whole.unionByName(cut).groupBy(*keys, "question").agg(listed.alias("_l"))
    prompts = gathered.select(*keys, build_prompt(F.col("question"), F.transform("_l", lambda x: x["text"])).alias("prompt"), F.transform("_l", lambda x: x["chunk_id"]).alias("used_chunk_ids"))
    error = F.lit(f"ValueError: Question is too long for max_input_tokens={max_input_tokens}")
    return prompts.withColumn("error", F.lit(None).cast("string")).unionByName(first.where(room <= 0).select(*keys, error.alias("error")), allowMissingColumns=True)


#: Replies to a batch of prompts, in order.
TextModel = Callable[[list[str]], Sequence[str]]


def generative_reader(make: Callable[[], TextModel], tokenize: Callable[[str], Offsets] = word_offsets, max_input_tokens: int = 512) -> Reader:
    """A reader around a model that is made once in each worker and called once for each batch of prompts.

    Replies that mean "no answer" become one fixed sentence.
    """

    @F.pandas_udf("reply string, error string, seconds double")
    def replied(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, broken = _loaded(make)
        for batch in batches:
            began, n = time.perf_counter(), len(batch)
            replies, errors = ([None] * n, [broken] * n) if broken else _called(model, n, lambda rows, batch=batch: model([*batch.iloc[rows]]))
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object), "seconds": (time.perf_counter() - began) / max(1, n)})

    def read(tasks: DataFrame, keys: list[str]) -> DataFrame:
        prompts = packed_prompts(tasks, keys, tokenize, max_input_tokens)
        asked = prompts.where("error is null").withColumn("_r", replied.asNondeterministic()("prompt"))
        reply = strip(F.col("_r.reply"))
        answers = asked.select(*keys, F.when(says_not_available(reply), NOT_AVAILABLE).otherwise(reply).alias("prediction"), F.col("used_chunk_ids").alias("_used"), F.col("_r.error").alias("error"), F.col("_r.seconds").alias("seconds"))
        answers = answers.unionByName(prompts.where("error is not null").select(*keys, "error"), allowMissingColumns=True)
        for name, kind in (("confidence", "double"), ("answer_chunk_id", "string"), ("start_char", "int"), ("end_char", "int")):
            answers = answers.withColumn(name, F.lit(None).cast(kind))
        return _answered(tasks, keys, answers, F.col("_used"))

    return read


def word_set(text: Column) -> Column:
    """The different lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}_]+"), F.lit(0)))


def overlap_reader(max_tokens: int = 30) -> Reader:
    """A stand-in extractive reader without a model: the sentence that shares most words with the question, the first one on ties."""

    def read(tasks: DataFrame, keys: list[str]) -> DataFrame:
        own = guarded(tasks).where("error is null").withColumn("_q", word_set(F.col("question")))
        chunks = own.select(*keys, "_q", F.posexplode("context").alias("_place", "_c")).withColumn("_s", split_sentences(F.col("_c.text")))
        score = lambda x: F.size(F.array_intersect("_q", word_set(x))) / F.greatest(F.size("_q"), F.lit(1))
        # the best sentence of each chunk before anything is sorted, and no text of a chunk after
        rated = F.filter(F.transform("_s", lambda x, n: F.struct((-score(x)).alias("less"), n.alias("n"), x.alias("sentence"))), lambda x: x["less"] < 0)
        rows = chunks.select(*keys, "_place", "_c", F.array_min(rated).alias("_r")).where("_r is not null")
        cut = F.array_join(F.slice(F.split("_r.sentence", " "), 1, max_tokens), " ")
        start = F.position(F.col("_r.sentence"), F.col("_c.text")) - 1
        answer = F.struct(cut.alias("prediction"), (-F.col("_r.less")).alias("confidence"), F.col("_c.chunk_id").alias("answer_chunk_id"), start.alias("start_char"), (start + F.length(cut)).alias("end_char"))
        best = rows.select(*keys, answer.alias("_a"), F.struct("_r.less", "_place").alias("_o")).groupBy(*keys).agg(F.min_by("_a", "_o").alias("_b"))
        answers = best.select(*keys, "_b.*", F.lit(None).cast("string").alias("error"), F.lit(0.0).alias("seconds"))
        return _answered(tasks, keys, answers, F.col("_kept"))

    return read
