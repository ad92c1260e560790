"""Encoding of a corpus with a public tokenizer, word by word over the whole corpus.

Texts are cut into pre-tokens by Spark, once, and the cuts kept in a written table. The different pre-tokens
of the corpus are counted in one shuffle and each is encoded once; its ids are joined back by word and put in
order again by place. Pre-tokens that make up a large share of the corpus are few by definition: their table
has a proven size and is looked up where the text is, so only the rare ones are shuffled and no join key is
hot. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import written

#: Pre-tokens above this share of all of them are broadcast; there are at most 1 / HOT of them, each of at most HOT_CHARS characters.
HOT, HOT_CHARS = 1 / 200_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary file is installed; pass another path for files kept elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The public pattern that cuts texts into pre-tokens, in Java's dialect (Unicode classes for blanks)."""
    import public_tokenizers

    return "(?U)" + public_tokenizers.PATTERN


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """The table with the ids (array<int>) of each pre-token; the vocabulary is read once by every Python worker."""
    schema = T.StructType([*words.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=_ranks(path), special_tokens={})
        for batch in batches:
            yield batch.assign(ids=[own.encode_ordinary(x) for x in batch[column]])

    return words.mapInPandas(encoded, schema)


def _runs(words: pa.ListArray, known: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text the ids of its known pre-tokens, cut into runs at the others, and these others in order.

    ``ids`` holds the ids of all known pre-tokens in a row, ``lengths`` how many each has.
    """
    flat = words.flatten()
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64))))
    code = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    unknown = np.flatnonzero(code < 0)
    size = np.where(code >= 0, np.append(lengths, 0)[code], 0)
    before = np.concatenate(([0], np.cumsum(size)))
    first = np.concatenate(([0], np.cumsum(lengths)))[code]
    values = ids[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
    # a run ends before every unknown pre-token and with the text
    at = np.concatenate((unknown, ends[1:]))
    order = np.argsort(np.concatenate((2 * unknown + 1, 2 * ends[1:])), kind="stable")
    inner = pa.ListArray.from_arrays(np.concatenate(([0], before[at[order]])).astype(np.int32), pa.array(values, pa.int32()))
    missing = np.searchsorted(unknown, ends)
    outer = (missing + np.arange(len(ends))).astype(np.int32)
    return pa.ListArray.from_arrays(outer, inner), pa.ListArray.from_arrays(missing.astype(np.int32), flat.take(pa.array(unknown)))


def encode_texts(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of every row, without special tokens; an empty list for empty and null texts.

    Every row comes out once, repeated ids and null ids included; other columns are ignored.
    """
    path = path or vocabulary_path()
    words = F.regexp_extract_all(F.coalesce(text_column, F.lit("")), F.lit(split_pattern()), F.lit(0))
    cut = written(rows.select(F.col(id_column), F.monotonically_increasing_id().alias("_row"), words.alias("_words")))
    counted = cut.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocabulary = written(encode_words(counted, path))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    hot = (F.col("n") > total * HOT) & (F.length("word") <= HOT_CHARS)
    frequent = vocabulary.where(hot).select("word", "ids").toArrow().combine_chunks()  # fewer than 1 / HOT rows
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value["word"].combine_chunks().cast(pa.string())
        lengths = pc.list_value_length(sent.value["ids"]).to_numpy().astype(np.int64)
        ids = pc.list_flatten(sent.value["ids"]).to_numpy().astype(np.int32)
        for batch in batches:
            runs, rare = _runs(batch.column(2), known, lengths, ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), runs, rare], [id_column, "_row", "_runs", "_rare"])

    schema = T.StructType([*cut.schema.fields[:2], T.StructField("_runs", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("_rare", T.ArrayType(T.StringType()))])
    placed = written(cut.mapInArrow(looked_up, schema))
    rare = placed.select("_row", F.posexplode("_rare").alias("place", "word")).join(vocabulary.where(~hot).select("word", "ids"), "word")
    gathered = rare.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"]).alias("_found"))
    whole = placed.where(F.size("_rare") == 0).select(id_column, F.element_at("_runs", 1).alias("ids"))
    between = F.zip_with(F.slice("_runs", 1, F.size("_found")), "_found", lambda run, found: F.concat(run, found))
    filled = placed.where(F.size("_rare") > 0).select(id_column, "_row", "_runs").join(gathered, "_row")
    return whole.unionByName(filled.select(id_column, F.concat(F.flatten(between), F.element_at("_runs", -1)).alias("ids")))


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """(token int, piece binary): the vocabulary as a table."""
    return spark.createDataFrame([(rank, token) for token, rank in _ranks(path or vocabulary_path()).items()], "token int, piece binary")


def decode_ids(encoded: DataFrame, id_column: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id, text) of encoded rows, by a join with the table of token bytes; an empty text for an empty list.

    Rows are told apart by id; a repeated id must repeat its list.
    """
    rows = encoded.dropDuplicates([id_column])
    parts = rows.select(id_column, F.posexplode("ids").alias("place", "token")).join(F.broadcast(token_bytes(encoded.sparkSession, path)), "token")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.hex("piece").alias("piece"))))
    texts = parts.groupBy(id_column).agg(F.decode(F.unhex(F.array_join(F.transform(ordered, lambda x: x["piece"]), "")), "UTF-8").alias("text"))
    return rows.select(id_column).join(texts, id_column, "left").select(id_column, F.coalesce("text", F.lit("")).alias("text"))
