"""Answer metrics as column expressions over predictions and arrays of references.

Empty reference arrays and null predictions give null; there is no form that raises instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.text import answer_tokens, normalize_answer


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A column of a value that is computed once; a lambda would compute an expression from outside again for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def exact_match(prediction: Column, references: Column) -> Column:
    """Whether the normalised prediction equals any normalised reference."""
    return F.when(F.size(references) > 0, let(normalize_answer(prediction), lambda wanted: F.exists(references, lambda r: normalize_answer(r) == wanted)))


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(
        F.array_distinct(left), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(left, lambda x: x == t)), F.size(F.filter(right, lambda x: x == t)))
    )


def pair_f1(predicted: Column, expected: Column) -> Column:
    """F1 of two token arrays: 1 where both are empty, 0 where one is."""
    common = multiset_overlap(predicted, expected)
    empty = (F.size(predicted) == 0) | (F.size(expected) == 0)
    both = (F.size(predicted) == 0) & (F.size(expected) == 0)
    harmonic = F.try_divide(2.0 * common, (F.size(predicted) + F.size(expected)).cast("double"))
    return F.when(both, 1.0).when(empty, 0.0).otherwise(harmonic)


def token_f1(prediction: Column, references: Column) -> Column:
    """Best token F1 against any reference."""
    return let(answer_tokens(prediction), lambda predicted: F.array_max(F.transform(references, lambda r: let(answer_tokens(r), lambda expected: pair_f1(predicted, expected)))))


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), normalize_answer(text), F.lit(" "))


def _holds(padded: Column, part: Column) -> Column:
    return let(_padded(part), lambda p: (F.trim(p) != "") & F.contains(padded, p))


def answer_containment(prediction: Column, references: Column) -> Column:
    """Whether any reference stands in the prediction as a run of whole words."""
    return F.when(F.size(references) > 0, let(_padded(prediction), lambda padded: F.exists(references, lambda r: _holds(padded, r))))


def list_item_recall(prediction: Column, items: Column) -> Column:
    """Share of the items that stand in the prediction as runs of whole words; null without items."""
    return F.when(F.size(items) > 0, let(_padded(prediction), lambda padded: F.size(F.filter(items, lambda r: _holds(padded, r)))) / F.size(items))


def lexical_support(answer: Column, sources: Column) -> Column:
    """Share of the answer's words, with repeats, that stand anywhere in the sources; null without words."""
    words = answer_tokens(answer)
    held = let(F.array_distinct(F.flatten(F.transform(sources, answer_tokens))), lambda known: F.size(F.filter(words, lambda w: F.array_contains(known, w))))
    return F.when(F.size(words) > 0, held / F.size(words))
