"""Relevance of chunks to evidence passages, and what a ranking is worth.

A chunk is relevant to a passage when file name and page agree and the clean passage stands in the clean
chunk. The join is an equi-join on (file, page) with the containment as its residual condition, so
Catalyst can broadcast the passages while they are small and shuffle both sides when they are not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import base_name, clean_text
from pageloom.operators.search import check_k
from pageloom.session import block_by_block

DEPTHS = (1, 3, 5)


def clean_passages(questions: DataFrame) -> DataFrame:
    """(id, passage_index, file, page, passage) for every evidence passage of the questions, cleaned once."""
    cited = questions.select("id", F.posexplode("evidence").alias("passage_index", "e"))
    return cited.select("id", "passage_index", F.col("e.source").alias("file"), F.col("e.page").alias("page"), clean_text(F.col("e.text")).alias("passage"))


def relevant_pairs(passages: DataFrame, chunks: DataFrame, cleaned: bool = False) -> DataFrame:
    """(passage columns, chunk columns): pairs of a passage and a chunk that contains it.

    ``passages`` has file, page and passage (clean); ``chunks`` has source, page_number and text. Empty and
    null passages are relevant to nothing. Only chunks of cited pages are cleaned.
    """
    text = F.col("text") if cleaned else clean_text(F.col("text"))
    asked = passages.where("passage <> ''")
    joined = asked.join(cited_pages(chunks, asked).withColumn("_clean", text), ["file", "page"])
    return joined.where(F.contains("_clean", "passage")).drop("_clean")


def cited_pages(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """The rows (source, page_number) of pages that a passage (file, page) cites, with ``file`` and ``page``."""
    named = rows.withColumn("file", base_name(F.col("source"))).withColumn("page", F.col("page_number"))
    return named.join(passages.select("file", "page").distinct(), ["file", "page"], "left_semi")


def passage_ranks(passages: DataFrame, ranked_hits: DataFrame) -> DataFrame:
    """(id, passage_index, rank): the first rank at which each passage is held, null where no retrieved chunk holds it.

    ``ranked_hits`` has id, passage_index and rank of relevant retrieved chunks.
    """
    first = ranked_hits.groupBy("id", "passage_index").agg(F.min("rank").alias("rank"))
    return passages.select("id", "passage_index").distinct().join(first, ["id", "passage_index"], "left")


def retrieval_metrics(ranks: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(id, passage_ranks, hit_any_at_k, hit_all_at_k, reciprocal_rank) of each question with evidence; ValueError for a depth below 1."""
    for k in depths:
        check_k(k)
    aggregates = [F.transform(F.array_sort(F.collect_list(F.struct("passage_index", "rank"))), lambda x: x["rank"]).alias("passage_ranks")]
    for k in depths:
        within = F.coalesce(F.col("rank") <= k, F.lit(False))
        aggregates += [F.bool_or(within).alias(f"hit_any_at_{k}"), F.bool_and(within).alias(f"hit_all_at_{k}")]
    aggregates.append(F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))
    return ranks.groupBy("id").agg(*aggregates)


def gold_chunks(passages: DataFrame, chunks: DataFrame, order: str = "chunk_index", name: str = "chunk_id") -> DataFrame:
    """(id, passage_index, chunk): for each passage the containing chunk that stands first on its page; null where none does."""
    return first_chunks(passages, relevant_pairs(passages, chunks), F.struct(order, name), name)


def first_chunks(passages: DataFrame, relevant: DataFrame, order: Column, name: str) -> DataFrame:
    """(id, passage_index, chunk): the name of the relevant chunk that is first in an order, null for a passage without any."""
    held = relevant.groupBy("id", "passage_index").agg(F.min_by(name, order).alias("chunk"))
    return passages.select("id", "passage_index").join(held, ["id", "passage_index"], "left")


def gold_context(gold: DataFrame) -> DataFrame:
    """(id, context, error): chunks in order of their first passage, each once; an error names a passage without chunk."""
    listed = F.array_sort(F.collect_list(F.struct("passage_index", "chunk")))
    found = gold.groupBy("id").agg(listed.alias("_all"))
    missing = F.filter("_all", lambda x: x["chunk"].isNull())
    error = F.when(F.size(missing) > 0, F.concat("id", F.lit(": no chunk contains the evidence passage "), missing[0]["passage_index"].cast("string")))
    context = F.when(F.size(missing) == 0, F.array_distinct(F.transform("_all", lambda x: x["chunk"])))
    return found.select("id", context.alias("context"), error.alias("error"))


#: Characters of passages that are compiled into one automaton and sent to the tasks at once.
BLOCK_CHARS = 4_000_000


def corpus_occurrences(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage, occurrences): how often each distinct passage stands in all texts, without overlaps inside a text.

    Every text is scanned once for each block of passages by an automaton of all passages of the block;
    counts are added up before the shuffle. Passages that occur nowhere count 0; empty ones are left out.
    """
    distinct = passages.select("passage").where("passage <> ''").distinct()

    def search(found: list) -> tuple[DataFrame, Broadcast]:
        sent = texts.sparkSession.sparkContext.broadcast([r[0] for r in found])

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, passage in enumerate(sent.value):
                automaton.add_word(passage, (i, len(passage)))
            automaton.make_automaton()
            total: dict[int, int] = {}
            for batch in batches if len(automaton) else ():
                for text in batch.iloc[:, 0].dropna():
                    free: dict[int, int] = {}
                    for end, (i, length) in automaton.iter(text):
                        if end - length + 1 >= free.get(i, 0):
                            free[i] = end + 1
                            total[i] = total.get(i, 0) + 1
            if total:
                yield pd.DataFrame({"passage": [sent.value[i] for i in total], "n": [*total.values()]})

        return texts.mapInPandas(scan, "passage string, n long"), sent

    size = distinct.agg(F.sum(F.length("passage"))).first()[0] or 0
    counted = block_by_block(distinct, ["passage"], math.ceil(size / BLOCK_CHARS), search)
    total = counted.groupBy("passage").agg(F.sum("n").alias("n"))
    return distinct.join(total, "passage", "left").select("passage", F.coalesce("n", F.lit(0)).cast("long").alias("occurrences"))
