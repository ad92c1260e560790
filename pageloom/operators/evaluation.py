"""Evaluation runs: read every question with gold and retrieved context, score, combine and diagnose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.answers import answer_containment, exact_match, lexical_support, list_item_recall, token_f1
from pageloom.functions.text import base_name, is_refusal
from pageloom.operators import chunking, readers, retrieval, routing
from pageloom.operators.embedders import Embedder
from pageloom.operators.search import check_k
from pageloom.session import written

GOLD, RETRIEVED = "gold_context", "retrieved_context"
MODES = (GOLD, RETRIEVED)


def reader_modes(answerable: Column) -> Column:
    """Both modes for answerable questions, the retrieved context only for the others."""
    return F.when(answerable, F.array(F.lit(GOLD), F.lit(RETRIEVED))).otherwise(F.array(F.lit(RETRIEVED)))


def score_predictions(read: DataFrame, generative: bool) -> DataFrame:
    """Adds the answer metrics to read tasks (question columns, prediction, error, ``used_texts``).

    A refusal is scored as an empty answer. Unanswerable questions have no answer metrics; a failed call
    has none at all and is not a refusal.
    """
    failed = F.col("error").isNotNull()
    refused = ~failed & is_refusal(F.col("prediction"))
    counted = F.when(refused, F.lit("")).otherwise(F.col("prediction"))
    df = read.withColumn("refused", refused).withColumn("_scored", counted)
    answer = F.col("_scored")
    rated = ~failed & F.col("answerable")
    listed = F.col("category") == "list"
    recall = F.when(rated & listed, list_item_recall(answer, F.col("list_items")))
    contained = F.when(rated, answer_containment(answer, F.col("answers")))
    support = F.when(~failed & ~F.col("refused"), lexical_support(F.col("prediction"), F.col("used_texts"))) if generative else F.lit(None).cast("double")
    df = df.withColumns(
        {
            "exact_match": F.when(rated, exact_match(answer, F.col("answers"))),
            "token_f1": F.when(rated, token_f1(answer, F.col("answers"))),
            "answer_containment": contained,
            "list_item_recall": recall,
            "lexical_support": support,
        }
    )
    return df.withColumn("correct", F.when(rated, F.when(listed, F.col("list_item_recall") == 1.0).otherwise(F.col("answer_containment")))).drop("_scored")


def end_to_end(routed: Column, supported: Column, answerable: Column, read: Column, failed: Column, refused: Column, correct: Column) -> Column:
    """struct(outcome, correct) of the whole pipeline, from the route and the reader's row for the retrieved context.

    ``routed`` and ``read`` say whether there is a route and a reader row at all.
    """
    true_refusal = ~answerable
    return (
        F.when(~routed, F.struct(F.lit("error").alias("outcome"), F.lit(None).cast("boolean").alias("correct")))
        .when(~supported, F.struct(F.lit("refused_by_router").alias("outcome"), true_refusal.alias("correct")))
        .when(~read | failed, F.struct(F.lit("error").alias("outcome"), F.lit(None).cast("boolean").alias("correct")))
        .when(refused, F.struct(F.lit("refused_by_reader").alias("outcome"), true_refusal.alias("correct")))
        .otherwise(F.struct(F.lit("answered").alias("outcome"), F.when(answerable, F.coalesce(correct, F.lit(False))).otherwise(F.lit(False)).alias("correct")))
    )


def diagnosis(outcome: Column, correct: Column, answerable: Column, all_retrieved: Column, supported: Column, all_used: Column, gold_there: Column, gold_correct: Column) -> Column:
    """Why a question ended as it did; the first stage that failed names it."""
    return (
        F.when(outcome == "error", "error")
        .when(~answerable, F.when(outcome.isin("refused_by_router", "refused_by_reader"), outcome).otherwise("false_accept"))
        .when(F.coalesce(correct, F.lit(False)), "correct")
        .when(~all_retrieved, "retrieval_miss")
        .when(~supported, "router_reject")
        .when(~all_used, "context_dropped")
        .when(~gold_there, "error")
        .when(F.coalesce(gold_correct, F.lit(False)), "reader_distracted")
        .otherwise("reader_error")
    )


def index_chunks(pages: DataFrame, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks of all pages (source, page_number, text), ready for the index."""
    return chunking.page_chunks(pages, size, overlap)


def retrieve(questions: DataFrame, index: DataFrame, embed: Embedder, k: int = 5, threshold: float = routing.THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(results, routes): ranked chunks of every question in a durable index, and its route; blank questions have an error in place of a route."""
    asked = questions.where(F.col("question").rlike(r"(?U)\S")).select(F.col("id").alias("query"), "question")
    found = routing.search(index, asked, embed, k)
    results = written(found.join(index.drop("vector"), "position"))
    routes = routing.route(asked, results.select("query", "rank", "position", "score"), threshold).drop("results")
    blank = questions.select(F.col("id").alias("query")).join(routes.select("query"), "query", "left_anti").withColumn("error", F.lit("retrieval and routing failed: ValueError: Question must not be empty"))
    routes = routes.withColumn("error", F.lit(None).cast("string")).unionByName(blank, allowMissingColumns=True)
    return results, written(routes.withColumnRenamed("query", "id"))


def run_evaluation(questions: DataFrame, pages: DataFrame, embed: Embedder, make_readers: dict[str, tuple[readers.Reader, bool]], k: int = 5, threshold: float = routing.THRESHOLD) -> DataFrame:
    """One nested record for each question: retrieval, route, reader rows, end-to-end outcomes, diagnosis and errors.

    ``make_readers`` maps a reader's name to (reader, whether it is generative). Questions are told apart
    by id; ``pages`` has source, page_number and text. ``k`` must reach the deepest hit that is recorded.
    """
    check_k(k)
    if k < max(retrieval.DEPTHS):
        raise ValueError(f"k must be at least {max(retrieval.DEPTHS)}, the deepest hit that is recorded, got {k}")
    index = written(routing.build_index(written(index_chunks(pages)), embed, ["source", "page_number", "chunk_index"]))
    results, routes = retrieve(questions, index, embed, k, threshold)
    passages = written(retrieval.clean_passages(questions))
    # the one join of passages with chunks; all that follows is by position
    relevant = written(retrieval.relevant_pairs(passages, index.drop("vector"), cleaned=True).select("id", "passage_index", "position", "chunk_id", "chunk_index"))
    hits = results.select(F.col("query").alias("id"), "position", "rank").join(relevant, ["id", "position"])
    metrics = written(retrieval.retrieval_metrics(retrieval.passage_ranks(passages, hits)))
    gold = retrieval.gold_context(retrieval.first_chunks(passages, relevant, F.struct("chunk_index", "chunk_id", "position"), "position"))
    tasks = reader_tasks(questions, gold, index, results, routes)
    tasks = written(tasks.withColumn("context_chunk_ids", F.transform("context", lambda x: x["chunk_id"])))
    used = relevant.select("id", "passage_index", "chunk_id").distinct()
    parts = []
    for name, (reader, generative) in make_readers.items():
        read = reader(tasks, ["id", "mode"])
        read = read.withColumn("error", F.coalesce("context_error", "error"))
        for column in ("prediction", "used_chunk_ids", "confidence", "answer_chunk_id"):
            read = read.withColumn(column, F.when(F.col("error").isNull(), F.col(column)))
        texts = F.transform(F.filter("context", lambda x: F.array_contains("used_chunk_ids", x["chunk_id"])), lambda x: x["text"])
        scored = score_predictions(read.withColumn("used_texts", texts).withColumn("reader", F.lit(name)), generative)
        parts.append(scored.drop("context", "used_texts", "context_error", "question", "answers", "list_items", "category"))
    rows = written(reduce(DataFrame.unionByName, parts))
    rows = rows.join(used_passages(rows, passages, used), ["id", "reader", "mode"], "left")
    routes = routes.withColumns({"threshold": F.lit(float(threshold)), "k": F.lit(int(k))})
    return assemble(questions, metrics, routes, annotated(results, relevant), rows)


def reader_tasks(questions: DataFrame, gold: DataFrame, index: DataFrame, results: DataFrame, routes: DataFrame) -> DataFrame:
    """(id, mode, question columns, context, context_error): what each question is read with; contexts hold chunks in order."""
    chunk = F.struct("chunk_id", "text")
    ordered = lambda place: F.transform(F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct(place, chunk.alias("c"))))), lambda x: x["c"])
    named = gold.select("id", "error", F.posexplode_outer("context").alias("place", "position")).join(index.select("position", "chunk_id", "text"), "position", "left")
    gold_context = named.groupBy("id").agg(F.max("error").alias("context_error"), ordered("place").alias("context"))
    found = results.groupBy(F.col("query").alias("id")).agg(ordered("rank").alias("context"))
    lost = routes.where("error is not null").select("id", F.lit("no retrieved context: retrieval failed").alias("context_error"))
    own = questions.select("id", "question", "category", "answerable", "answers", F.coalesce("list_items", F.array().cast("array<string>")).alias("list_items"))
    moded = own.withColumn("mode", F.explode(reader_modes(F.col("answerable"))))
    with_gold = moded.where(F.col("mode") == GOLD).join(gold_context, "id", "left")
    with_found = moded.where(F.col("mode") == RETRIEVED).join(found, "id", "left").join(lost, "id", "left")
    return with_gold.unionByName(with_found)


def used_passages(rows: DataFrame, passages: DataFrame, relevant: DataFrame) -> DataFrame:
    """(id, reader, mode, passages_in_used_context): for each passage in order, whether a used chunk contains it.

    ``relevant`` has id, passage_index and chunk_id of chunks that contain a passage, each once.
    """
    used = rows.where("error is null").select("id", "reader", "mode", F.explode("used_chunk_ids").alias("chunk_id"))
    met = used.join(relevant, ["id", "chunk_id"]).select("id", "reader", "mode", "passage_index").distinct().withColumn("held", F.lit(True))
    every = rows.where("error is null and answerable").select("id", "reader", "mode").join(passages.select("id", "passage_index"), "id")
    joined = every.join(met, ["id", "reader", "mode", "passage_index"], "left")
    listed = F.array_sort(F.collect_list(F.struct("passage_index", F.coalesce("held", F.lit(False)).alias("held"))))
    return joined.groupBy("id", "reader", "mode").agg(F.transform(listed, lambda x: x["held"]).alias("passages_in_used_context"))


def annotated(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """(id, results): the ranked chunks of each question, with their place in the corpus and the question's passages that each contains."""
    held = relevant.groupBy(F.col("id").alias("query"), "position").agg(F.array_sort(F.collect_list("passage_index")).alias("passages"))
    joined = results.join(held, ["query", "position"], "left").withColumns({"source": base_name(F.col("source")), "passages": F.coalesce("passages", F.array().cast("array<int>"))})
    kept = F.struct("rank", "score", "chunk_id", "source", F.col("page_number").alias("page"), "chunk_index", "passages")
    return joined.groupBy(F.col("query").alias("id")).agg(F.array_sort(F.collect_list(kept)).alias("results"))


#: Columns of a reader's row in a record.
READER_ROW = [
    "reader", "mode", "context_chunk_ids", "used_chunk_ids", "passages_in_used_context", "prediction", "refused", "confidence", "answer_chunk_id", "start_char", "end_char",
    "exact_match", "token_f1", "answer_containment", "list_item_recall", "lexical_support", "correct", "seconds", "error",
]


def assemble(questions: DataFrame, metrics: DataFrame, routes: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """One nested record for each question, with outcomes and diagnosis for each reader.

    Metrics of retrieval are null, and passage ranks empty, for unanswerable questions.
    """
    side = {m: rows.where(F.col("mode") == m).select("id", "reader", F.struct(*READER_ROW).alias(n)) for m, n in ((GOLD, "gold"), (RETRIEVED, "found"))}
    pairs = side[RETRIEVED].join(side[GOLD], ["id", "reader"], "full")
    base = pairs.join(questions.select("id", "answerable"), "id").join(routes.select("id", "supported", F.col("status").isNotNull().alias("routed")), "id", "left").join(metrics.select("id", "passage_ranks"), "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = end_to_end(yes(F.col("routed")), yes(F.col("supported")), F.col("answerable"), F.col("found").isNotNull(), yes(F.col("found.error").isNotNull()), yes(F.col("found.refused")), F.col("found.correct"))
    base = base.withColumn("o", outcome)
    ranks = F.coalesce("passage_ranks", F.array().cast("array<int>"))
    used = F.coalesce("found.passages_in_used_context", F.array().cast("array<boolean>"))
    gold_there = F.col("gold").isNotNull() & F.col("gold.error").isNull()
    label = diagnosis(F.col("o.outcome"), F.col("o.correct"), F.col("answerable"), F.forall(ranks, lambda r: r.isNotNull()), yes(F.col("supported")), F.forall(used, lambda u: u), gold_there, F.col("gold.correct"))
    shown = F.when(F.col("o.outcome").isin("answered", "refused_by_reader"), F.col("found.prediction"))
    side_rows = F.array_compact(F.array("gold", "found"))
    ended = base.withColumn("_rows", side_rows).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("reader", F.col("o.outcome").alias("outcome"), shown.alias("prediction"), F.col("o.correct").alias("correct")))).alias("end_to_end"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reader", label.alias("label"))))).alias("diagnosis"),
        F.array_sort(F.flatten(F.collect_list("_rows"))).alias("readers"),
    )
    metric = [c for c in metrics.columns if c.startswith("hit_")] + ["reciprocal_rank"]
    joined = questions.join(metrics, "id", "left").join(routes.withColumnRenamed("error", "_lost"), "id", "left").join(found, "id", "left").join(ended, "id", "left")
    rated = [F.when(F.col("answerable"), F.col(c)).alias(c) for c in metric]
    shown_ranks = F.when(F.col("answerable"), F.coalesce("passage_ranks", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>"))
    retrieval_part = F.when(F.col("_lost").isNull(), F.struct("results", "top_score", shown_ranks.alias("passage_ranks"), *rated))
    route_part = F.when(F.col("_lost").isNull(), F.struct("status", "supported", "reason", "top_score", "threshold", "k"))
    failed = F.transform(F.filter("readers", lambda x: x["error"].isNotNull()), lambda x: F.concat(x["reader"], F.lit(" "), x["mode"], F.lit(": "), x["error"]))
    errors = F.concat(F.array_compact(F.array("_lost")), F.coalesce(failed, F.array().cast("array<string>")))
    return joined.select(*questions.columns, retrieval_part.alias("retrieval"), route_part.alias("routing"), "readers", "end_to_end", "diagnosis", errors.alias("errors"))


def summarize(records: DataFrame) -> DataFrame:
    """(split, category, reader, questions, correct_rate, refusal_rate): outcomes by group."""
    flat = records.select("split", "category", F.explode("end_to_end").alias("e")).select("split", "category", "e.*")
    return flat.groupBy("split", "category", "reader").agg(F.count("*").alias("questions"), F.avg(F.col("correct").cast("double")).alias("correct_rate"), F.avg(F.col("outcome").startswith("refused").cast("double")).alias("refusal_rate"))
