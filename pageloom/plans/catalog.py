"""Registered queries over the test tables. The SQL that says the same is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import answers, text, vectors
from pageloom.operators import chunking, evaluation, rates, readers, retrieval, routing, search, validation
from pageloom.operators.embedders import hashing_embedder
from pageloom.plans import oracle
from pageloom.session import spread, table, written

Query = Callable[[SparkSession, str], DataFrame]


#: Best score from which a question counts as covered, for the hashing embedder.
COVERED = 0.3


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, results, routes) of every question among the chunks of all pages."""
    pages = spread(table(spark, sf_dir, "page_data"))
    chunks = written(chunking.page_chunks(pages, keep=["page_id"]))  # the sort samples them before it moves them
    index = written(routing.build_index(chunks, hashing_embedder(), ["page_id", "chunk_index"]))
    asked = table(spark, sf_dir, "questions").select(F.col("id").alias("query"), "question")
    results = written(routing.search(index, asked, hashing_embedder()))
    return index, results, routing.route(asked, results, threshold=COVERED)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, status, rank, chunk_id, score): every question searched among the chunks of all pages, and routed."""
    index, results, routes = _searched(spark, sf_dir)
    found = results.join(index.select("position", "chunk_id"), "position").join(routes.select("query", "status"), "query")
    return found.select(F.col("query").alias("id"), "status", "rank", "chunk_id", F.round("score", 6).alias("score"))


def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route of each question in words."""
    return _searched(spark, sf_dir)[2].select(F.col("query").alias("id"), "status", "supported", "reason")


def _retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, results, _ = _searched(spark, sf_dir)
    passages = _passages(spark, sf_dir)
    found = results.join(index.drop("vector"), "position").withColumnRenamed("query", "asked")
    hits = retrieval.relevant_pairs(passages, found, cleaned=True).where("id = asked")
    return retrieval.retrieval_metrics(retrieval.passage_ranks(passages, hits))


def retrieval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of each question's passages among its results, and what they are worth."""
    ranks = F.array_join(F.transform("passage_ranks", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    hits = [f"hit_{kind}_at_{k}" for k in retrieval.DEPTHS for kind in ("any", "all")]
    return _retrieval(spark, sf_dir).select("id", ranks.alias("ranks"), *hits, F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def mean_reciprocal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank of the questions of each split and category."""
    asked = table(spark, sf_dir, "questions").where("answerable").select("id", "split", "category")
    return _retrieval(spark, sf_dir).join(asked, "id").groupBy("split", "category").agg(F.count("*").alias("n"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


def gold_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question whose evidence is in the index: its first containing chunks, in order."""
    passages = _passages(spark, sf_dir)
    relevant = written(retrieval.relevant_pairs(passages, spread(table(spark, sf_dir, "document_chunks"))).select("id", "passage_index", "chunk_index", "chunk_row_id", text.clean_text(F.col("text")).alias("text")))
    gold = retrieval.gold_context(retrieval.first_chunks(passages, relevant, F.struct("chunk_index", "chunk_row_id"), "chunk_row_id")).where("error is null")
    named = gold.select("id", F.posexplode("context").alias("place", "chunk_row_id")).join(relevant.select("id", "chunk_row_id", "text").distinct(), ["id", "chunk_row_id"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    contexts = named.groupBy("id").agg(listed.alias("texts"))
    return table(spark, sf_dir, "questions").select("id", "question").join(contexts, "id").select("id", text.build_prompt(F.col("question"), F.col("texts")).alias("prompt"))


# text


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "page_data")).select("page_id", text.clean_text(F.col("text")).alias("clean"))


def page_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = spread(table(spark, sf_dir, "page_data")).select("page_id", text.clean_text(F.col("text")).alias("clean"))
    found = clean.select("page_id", chunking.split_sentences(F.col("clean")).alias("s"))
    return found.select("page_id", F.posexplode("s").alias("sentence_index", "sentence"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_chunks(spread(table(spark, sf_dir, "page_data")), keep=["page_id"])


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.page_chunks(spread(table(spark, sf_dir, "page_data")))
    return chunks.groupBy(text.base_name(F.col("source")).alias("file")).agg(F.count("*").alias("chunks"), F.countDistinct("page_number").alias("pages"), F.max(F.length("text")).alias("longest"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "document_chunks")
    return own.select("chunk_row_id", text.chunk_id(F.col("source"), F.col("page_number"), F.col("chunk_index")).alias("made_id"))


def normalized_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("question_id", "reader", "mode", text.normalize_answer(F.col("prediction")).alias("normalized"), F.size(text.answer_tokens(F.coalesce("prediction", F.lit("")))).alias("n_tokens"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader rows without whole-row repeats."""
    return table(spark, sf_dir, "reader_records").distinct()


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), "answerable", "category", "answers", "list_items", "split")
    joined = _records(spark, sf_dir).join(questions, "question_id").withColumn("used_texts", F.array().cast("array<string>"))
    return evaluation.score_predictions(joined, generative=False)


def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ["question_id", "reader", "mode", "finished_at", "exact_match", F.round("answer_f1", 6).alias("answer_f1"), "answer_containment", F.round("list_item_recall", 6).alias("list_item_recall"), "correct"]
    return _scored(spark, sf_dir).withColumnRenamed("token_f1", "answer_f1").select(*kept)


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("question_id", "reader", "mode", "finished_at", text.is_refusal(F.col("prediction")).alias("declines"), text.says_not_available(F.col("prediction")).alias("not_available"))


def lexical_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), F.col("evidence.text").alias("sources"))
    joined = _records(spark, sf_dir).where("prediction is not null").join(sources, "question_id")
    known = F.filter("sources", lambda x: x.isNotNull())
    return joined.select("question_id", "reader", "mode", "finished_at", F.round(answers.lexical_support(F.col("prediction"), known), 6).alias("support"))


# rates


def error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).where("error is null")
    refused, answerable = F.col("refused"), F.col("answerable")
    return scored.groupBy("reader", "mode").agg(
        F.round(rates.rate(refused), 6).alias("refusal_rate"),
        F.round(rates.false_refusal_rate(refused, answerable), 6).alias("false_refusal_rate"),
        F.round(rates.false_accept_rate(~refused, answerable), 6).alias("false_accept_rate"),
    )


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _records(spark, sf_dir).join(table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), "answerable"), "question_id")
    return rates.grouped_auroc(joined.where(~F.isnan("confidence")), ["mode"], "confidence", "answerable").select("mode", F.round("auroc", 6).alias("auroc")).where("auroc is not null")


def correct_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).where("error is null and answerable")
    return scored.groupBy("category", "reader", "mode").agg(F.count("*").alias("n"), F.round(rates.rate(F.col("correct")), 6).alias("correct_rate"))


# vectors


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "embeddings")
    index = own.select(F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    return index, index.where("position % 20 = 0").withColumnRenamed("position", "query")


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _vectors(spark, sf_dir)
    return search.top_k(index, queries, not_self=True).select("query", "position", F.round("score", 5).alias("score"), "rank")


def vector_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _vectors(spark, sf_dir)
    results = search.top_k(index, queries, k=1, not_self=True)
    routed = routing.route(queries, results, threshold=0.5)
    return routed.select("query", "status", "supported", F.round("top_score", 5).alias("top_score"))


def label_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = _vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    results = search.top_k(index, queries, not_self=True)
    wanted = queries.select("query").join(labels.withColumnsRenamed({"vec_id": "query", "label": "wanted"}), "query")
    hits = results.join(labels.withColumnsRenamed({"vec_id": "position", "label": "got"}), "position").join(wanted, "query").where("wanted = got")
    passages = wanted.select(F.col("query").alias("id"), F.lit(0).alias("passage_index"))
    ranks = retrieval.passage_ranks(passages, hits.select(F.col("query").alias("id"), F.lit(0).alias("passage_index"), "rank"))
    metrics = retrieval.retrieval_metrics(ranks)
    return metrics.select("id", "hit_any_at_1", "hit_any_at_3", "hit_any_at_5", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 10).alias("s"), F.transform(F.concat(F.slice("embedding", 18, 1000), F.slice("embedding", 1, 17)), lambda x: x * 10).alias("e"))
    context = F.sequence(F.lit(1), F.size("s") - 1)
    found = vectors.best_spans(own.withColumn("c", context), ["vec_id"], "s", "e", "c", 8)
    return found.select("vec_id", "start_token", "end_token", F.round("score", 6).alias("score"))


# joins of evidence, pages and chunks


def evidence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _passages(spark, sf_dir)
    pairs = retrieval.relevant_pairs(passages, spread(table(spark, sf_dir, "document_chunks")))
    return pairs.select("id", "passage_index", "chunk_row_id")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.clean_passages(table(spark, sf_dir, "questions"))


def gold_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = retrieval.gold_chunks(_passages(spark, sf_dir), spread(table(spark, sf_dir, "document_chunks")))
    context = retrieval.gold_context(gold)
    return context.select("id", F.array_join("context", ",").alias("context"), F.col("error").isNotNull().alias("failed"))


def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each passage: unknown file, no such page, no text, or on how many scans of its page it stands."""
    pages, passages = table(spark, sf_dir, "page_data"), _passages(spark, sf_dir)
    files = pages.select(text.base_name(F.col("source")).alias("file")).distinct().withColumn("known", F.lit(True))
    cited = retrieval.cited_pages(spread(pages), passages).select("file", "page", text.clean_text(F.col("text")).alias("page_text"), F.lit(True).alias("there"))
    joined = passages.join(files, "file", "left").join(cited, ["file", "page"], "left")
    held = F.coalesce(F.contains("page_text", "passage"), F.lit(False))
    grouped = joined.groupBy("id", "passage_index").agg(F.max("known").alias("known"), F.max("there").alias("there"), F.max("passage").alias("passage"), F.count_if(held).alias("scans"))
    state = F.when(F.col("known").isNull(), "unknown source").when(F.col("there").isNull(), "no such page").when(F.coalesce("passage", F.lit("")) == "", "no text").when(F.col("scans") == 0, "not on page").otherwise("found")
    return grouped.select("id", "passage_index", state.alias("state"), "scans")


def evidence_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "page_data")).select(text.clean_text(F.col("text")).alias("text"))
    return retrieval.corpus_occurrences(_passages(spark, sf_dir), pages)


def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest sentence of its page that holds each passage; null where it spans several."""
    passages = _passages(spark, sf_dir).where("passage <> ''")
    cited = retrieval.cited_pages(spread(table(spark, sf_dir, "page_data")), passages).select("file", "page", text.clean_text(F.col("text")).alias("page_text"))
    cut = cited.select("file", "page", "page_text", chunking.split_sentences(F.col("page_text")).alias("sentences"))
    joined = passages.join(cut, ["file", "page"]).where(F.contains("page_text", "passage"))
    length = F.array_min(F.transform(F.filter("sentences", lambda s: F.contains(s, F.col("passage"))), F.length))
    return joined.groupBy("id", "passage_index").agg(F.min(length).alias("shortest"))


# validation and selection


def duplicate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_questions(table(spark, sf_dir, "questions"))


def duplicate_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_ids(table(spark, sf_dir, "document_chunks").withColumnRenamed("chunk_id", "id"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dataset_counts(table(spark, sf_dir, "questions"))["by_category"]


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dataset_counts(table(spark, sf_dir, "questions"))["by_tag"]


def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dataset_counts(table(spark, sf_dir, "questions"))["totals"]


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.dataset_counts(table(spark, sf_dir, "questions"))["by_split"]


def dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of all questions against the latest scan of each page; a page without text is there, but holds nothing."""
    scans = spread(table(spark, sf_dir, "page_data")).select(text.base_name(F.col("source")).alias("file"), F.col("page_number").alias("page"), F.coalesce("text", F.lit("")).alias("text"), "page_id")
    latest = scans.groupBy("file", "page").agg(F.max_by("text", "page_id").alias("text"))
    return validation.dataset_problems(table(spark, sf_dir, "questions"), latest)


def unread_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions for which a reader and mode has no row."""
    asked = table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), "split", F.explode(evaluation.reader_modes(F.col("answerable"))).alias("mode"))
    wanted = asked.withColumn("reader", F.explode(F.array(F.lit("extractive"), F.lit("generative"))))
    return wanted.join(table(spark, sf_dir, "reader_records"), ["question_id", "reader", "mode"], "left_anti").select("question_id", "split", "reader", "mode")


# readers and the whole pipeline


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n\t]+"), lambda x: x != ""))
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.window_ranges(count, 96, 32)).alias("window", "w"))
    return own.select("doc_id", "window", F.col("w.start").alias("start_token"), F.col("w.end").alias("end_token"))


def packed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each chunked page, the leading chunks within a budget of 200 words, as a numbered context."""
    clean = spread(table(spark, sf_dir, "document_chunks")).where("text is not null").select("source", "page_number", "chunk_index", "chunk_row_id", text.clean_text(F.col("text")).alias("text")).where("text <> ''")
    fitted = readers.packed_context(clean, ["source", "page_number"], ["chunk_index", "chunk_row_id"], F.size(F.split("text", " ")), 200)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return fitted.groupBy("source", "page_number").agg(F.count("*").cast("int").alias("chunks"), text.format_context(listed).alias("context"))


def reader_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-to-end outcome and diagnosis of each question and reader, from the delivered reader rows.

    A question counts as routed when a page it cites is indexed, and its evidence as retrieved when a chunk holds each passage.
    """
    questions = table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), "answerable", "category", "answers", "list_items")
    scored = _scored(spark, sf_dir)
    order = F.struct("finished_at", "received_at", F.coalesce("prediction", F.lit("")))
    first = scored.groupBy("question_id", "reader", "mode").agg(F.min_by(F.struct("refused", "correct", "error"), order).alias("r"))
    found = first.where(F.col("mode") == evaluation.RETRIEVED).select("question_id", "reader", F.col("r").alias("found"))
    gold = first.where(F.col("mode") == evaluation.GOLD).select("question_id", "reader", F.col("r").alias("gold"))
    every = questions.select("question_id", "answerable").withColumn("reader", F.explode(F.array(F.lit("extractive"), F.lit("generative"))))
    passages = _passages(spark, sf_dir)
    chunks = spread(table(spark, sf_dir, "document_chunks"))
    indexed = chunks.select(text.base_name(F.col("source")).alias("file"), F.col("page_number").alias("page")).distinct()
    routed = passages.join(indexed, ["file", "page"], "left_semi").select(F.col("id").alias("question_id")).distinct().withColumn("supported", F.lit(True))
    holding = retrieval.relevant_pairs(passages, chunks).select("id", "passage_index").distinct().withColumn("held", F.lit(True))
    whole = passages.join(holding, ["id", "passage_index"], "left").groupBy(F.col("id").alias("question_id")).agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("retrieved"))
    joined = every.join(found, ["question_id", "reader"], "left").join(gold, ["question_id", "reader"], "left").join(routed, "question_id", "left").join(whole, "question_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    there, answerable, supported = F.lit(True), F.col("answerable"), yes(F.col("supported"))
    outcome = evaluation.end_to_end(there, supported, answerable, F.col("found").isNotNull(), yes(F.col("found.error").isNotNull()), yes(F.col("found.refused")), F.col("found.correct"))
    df = joined.withColumn("o", outcome)
    gold_there = F.col("gold").isNotNull() & F.col("gold.error").isNull()
    label = evaluation.diagnosis(F.col("o.outcome"), F.col("o.correct"), answerable, F.coalesce("retrieved", F.lit(True)), supported, F.lit(True), gold_there, F.col("gold.correct"))
    return df.select("question_id", "reader", F.col("o.outcome").alias("outcome"), F.col("o.correct").alias("right"), label.alias("diagnosis"))


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with the stand-in embedder and reader: outcome and diagnosis of each question."""
    questions = table(spark, sf_dir, "questions").dropDuplicates(["id"])
    pages = spread(table(spark, sf_dir, "page_data")).where("text is not null").groupBy("source", "page_number").agg(F.max_by("text", "page_id").alias("text"))
    records = evaluation.run_evaluation(questions, pages, hashing_embedder(), {"overlap": (readers.overlap_reader(), False)}, threshold=0.3)
    return records.select("id", "routing.status", "retrieval.hit_any_at_5", F.col("end_to_end")[0]["outcome"].alias("outcome"), F.col("diagnosis")["overlap"].alias("diagnosis"))


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    own = (
        flagship, question_routes, retrieval_records, mean_reciprocal_ranks, gold_prompts, split_counts, clean_pages, page_sentences, chunk_pages, chunk_counts, chunk_ids, normalized_predictions, answer_metrics, refusals, lexical_support, error_rates, auroc, correct_by_category,
        vector_top_k, vector_routes, label_retrieval, best_spans, evidence_chunks, gold_contexts, evidence_pages, evidence_occurrences, evidence_sentences,
        duplicate_questions, duplicate_chunk_ids, category_counts, tag_counts, dataset_totals, dataset_problems, unread_questions, token_windows, packed_prompts, reader_outcomes, evaluation_run,
    )
    return {x.__name__: x for x in own}


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
