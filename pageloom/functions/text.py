"""Text functions over string columns: cleaning, paths, answer normalisation.

Null texts stay null. Java's ``(?U)`` makes the classes cover Unicode, as the definitions ask for.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of text cleaning (word broken over a line; characters that are deleted).
BROKEN_WORD = r"(?U)(?<=[A-Za-z])[-\u00ad]\s*\n\s*(?=[a-z])"
DELETED = r"[\x00-\x08\x0e-\x1f\x7f\u00ad\u200b\ufeff]"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
PUNCTUATION = string.punctuation
# Replies that decline to answer.
NOT_AVAILABLE = "The answer is not available in the provided documents."
REFUSALS = (NOT_AVAILABLE, "not available", "unanswerable", "no answer")
NOT_AVAILABLE_REPLIES = ("not available", "unanswerable")
# Fixed value: the instruction of a prompt.
PROMPT_HEAD = 'Answer the question using only the context below. If the context does not contain the answer, reply "not available".\n\nContext:\n'


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition, which Spark has no function for; ASCII texts pass through."""
    for batch in batches:
        yield batch.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


nfkc = nfkc.asNondeterministic()  # or Catalyst would repeat it in the filters it pushes down


def strip(text: Column) -> Column:
    """Without blanks of any kind at the ends (Spark's trim takes off spaces only)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(text: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def clean_text(text: Column) -> Column:
    """One line of clean prose: NFKC, words joined over line breaks, invisible characters deleted, blanks collapsed."""
    joined = F.regexp_replace(nfkc(text), BROKEN_WORD, "")
    return collapse(F.regexp_replace(joined, DELETED, ""))


def base_name(path: Column) -> Column:
    """The part of a path after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def chunk_id(source: Column, page: Column, index: Column) -> Column:
    """``<file>:p<page>:c<index>``."""
    return F.concat(base_name(source), F.lit(":p"), page.cast("string"), F.lit(":c"), index.cast("string"))


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the articles a, an and the, blanks collapsed."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(?:a|an|the)\b", " "))


def answer_tokens(text: Column) -> Column:
    """Words of a normalised answer; an empty array where nothing is left."""
    return F.filter(F.split(normalize_answer(text), " "), lambda t: t != "")


def is_refusal(prediction: Column, phrases: tuple[str, ...] = REFUSALS) -> Column:
    """Whether a prediction is missing, empty once normalised, or exactly a refusal phrase."""
    plain = normalize_answer(prediction)
    return prediction.isNull() | (plain == "") | plain.isin([normalize_phrase(x) for x in phrases])


def normalize_phrase(phrase: str) -> str:
    """normalize_answer of one string, for building plans."""
    bare = "".join(" " if x.isspace() else x for x in phrase.lower() if x not in PUNCTUATION)
    return " ".join(x for x in bare.split() if x not in ("a", "an", "the"))


def says_not_available(output: Column) -> Column:
    """Whether a generated text means that the context holds no answer."""
    plain = F.lower(strip(F.regexp_replace(output, r"(?U)[^\w\s]", "")))
    return (plain == "") | plain.isin(*NOT_AVAILABLE_REPLIES)


def count_occurrences(text: Column, part: Column) -> Column:
    """How often a string stands in another, without overlaps; null for an empty part."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, (gone / F.length(part)).cast("int"))


def format_context(texts: Column) -> Column:
    """``[1] text`` parts of an array of texts, stripped, with blank lines between."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), strip(x))), "\n\n")


def build_prompt(question: Column, texts: Column) -> Column:
    """The instruction that asks for an answer from the numbered context only."""
    return F.concat(F.lit(PROMPT_HEAD), format_context(texts), F.lit("\n\nQuestion: "), strip(question), F.lit("\nAnswer:"))


def raise_unless(valid: Column, value: Column, message: str) -> Column:
    """The value, or an error at run time where the condition does not hold; kept in the value's path so that it cannot be pruned."""
    return F.when(valid, value).otherwise(F.raise_error(F.lit(message)))
