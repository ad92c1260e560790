"""Splitting of oversized texts at natural boundaries, by packing a structure tree.

The text of a row is brought into its measured form: nothing without width, accents composed, and every
run of blanks and line breaks as one character (a line break where it holds one, else a blank). Headings,
blank lines and list markers give a tree: document, sections, paragraphs, lines and list items, sentences,
words. Sibling subtrees are merged bottom-up as long as they fit; only oversized nodes are descended into.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.lookalike import is_widthless
from pageloom.llm.sentences import MARKER, sentence_ends

LIMIT, OVERLAP = 1000, 200
HEADING = re.compile(r"#{1,6} |(?:\d+\.)+\d* \S|[^\n]{1,80}[^\n.!?:;,。！？।؟]$")
CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
RUN = re.compile(r"\s+")


def measured(text: str) -> tuple[str, dict[int, str]]:
    """The measured form, and the kind of each line break in it by place: ``blank`` line or plain ``line``."""
    if not text.isascii():
        for char in filter(is_widthless, set(text)):
            text = text.replace(char, "")
        text = unicodedata.normalize("NFC", text)
    elif CONTROLS.search(text):
        text = CONTROLS.sub("", text)
    kinds: dict[int, str] = {}
    out: list[str] = []
    length, blank = 0, False
    for line in text.splitlines():
        if words := line.split():
            line = " ".join(words)
            if out:
                kinds[length] = "blank" if blank else "line"
                length += 1
            out.append(line)
            length, blank = length + len(line), False
        else:
            blank = True
    return "\n".join(out), kinds


def measured_length(text: str) -> int:
    """Code points of the measured form."""
    return len(measured(text)[0])


def _cut(start: int, end: int, places: list[int]) -> list[tuple[int, int]]:
    bounds = [start, *(x for x in places if start < x < end), end]
    return list(zip(bounds, bounds[1:]))


class _Tree:
    """Boundaries of one measured text, coarse to fine; a node is a span and a depth, its children the next finer cut."""

    def __init__(self, text: str, kinds: dict[int, str]) -> None:
        self.text = text
        breaks = sorted(kinds)
        starts = [0, *(x + 1 for x in breaks)]
        lines = {s: text[s : (breaks[i] if i < len(breaks) else len(text))] for i, s in enumerate(starts)}
        after_blank = {0} | {x + 1 for x in breaks if kinds[x] == "blank"}
        before_blank = {s for i, s in enumerate(starts) if i < len(breaks) and kinds[breaks[i]] == "blank"}
        heading = [s for s in starts if s in after_blank and (lines[s].startswith("#") or s in before_blank and HEADING.match(lines[s]) and not MARKER.match(lines[s]))]
        items = [s for s in starts if MARKER.match(lines[s])]
        titles = set(heading)
        after_heading = {b for a, b in zip(starts, starts[1:]) if a in titles}
        # a heading stays with what follows it: no cut between them unless nothing else is left
        self.paragraphs = sorted(after_blank)
        self.sentences: list[int] | None = None
        self.levels = [heading, sorted(after_blank - {0} - after_heading), sorted(items), sorted(after_blank)]

    def sentence_starts(self) -> list[int]:
        """Starts of all sentences but those at the start of a paragraph; found once for a text."""
        if self.sentences is None:
            self.sentences = []
            for start, end in _cut(0, len(self.text), self.paragraphs):
                for stop in sentence_ends(self.text[start:end]):
                    if start + stop < end - 1:
                        self.sentences.append(start + stop + self.text[start + stop].isspace())
        return self.sentences

    def between(self, places: list[int], start: int, end: int) -> list[int]:
        return places[bisect_right(places, start) : bisect_left(places, end)]

    def children(self, start: int, end: int, depth: int) -> list[tuple[int, int]]:
        if depth < len(self.levels):
            return _cut(start, end, self.between(self.levels[depth], start, end))
        if depth == len(self.levels):
            return _cut(start, end, self.between(self.sentence_starts(), start, end))
        if depth == len(self.levels) + 1:
            return _cut(start, end, [start + x.end() for x in RUN.finditer(self.text[start:end])])
        return []

    def pack(self, start: int, end: int, depth: int, limit: int) -> list[tuple[int, int]]:
        """Spans of at most ``limit`` characters that cover a node."""
        if end - start <= limit:
            return [(start, end)]
        if depth > len(self.levels) + 1:
            return self._hard(start, end, limit)
        spans: list[tuple[int, int]] = []
        for child in self.children(start, end, depth):
            for span in self.pack(*child, depth + 1, limit):
                if spans and span[1] - spans[-1][0] <= limit:
                    spans[-1] = (spans[-1][0], span[1])
                else:
                    spans.append(span)
        return spans

    def _hard(self, start: int, end: int, limit: int) -> list[tuple[int, int]]:
        """Cuts where nothing natural is left; never before a combining mark if another place is there."""
        spans = []
        while end - start > limit:
            stop = start + limit
            while stop > start + 1 and unicodedata.category(self.text[stop])[0] == "M":
                stop -= 1
            if stop == start + 1:
                stop = start + limit
            spans.append((start, stop))
            start = stop
        return [*spans, (start, end)]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Consecutive pieces of a text, each at most ``limit`` characters long in its measured form.

    A text within the limit is one piece. A piece after the first begins with up to ``overlap`` characters
    of its predecessor, from the earliest sentence, else word, that starts there. Null and blank: none.
    """
    if text is None or not text.strip():
        return []
    whole, kinds = measured(text)
    if len(whole) <= limit:
        return [whole] if whole else []
    tree = _Tree(whole, kinds)
    spans = tree.pack(0, len(whole), 0, limit - overlap)
    pieces = [whole[slice(*spans[0])].strip()]
    for before, (start, end) in zip(spans, spans[1:]):
        lowest = max(before[0], start - overlap)
        place = lowest
        if lowest > before[0]:
            natural = [*tree.between(tree.sentence_starts(), lowest - 1, start)[:1], *tree.between(tree.paragraphs, lowest - 1, start)[:1]]
            word = RUN.search(whole, lowest, start)
            place = min(natural) if natural else word.end() if word else lowest if overlap else start
        pieces.append(whole[place:end].strip())
    return [x for x in pieces if x]


def pieces_column(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<string> of the pieces of a string column."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError(f"limit must be positive and overlap from 0 to less than it, got {limit} and {overlap}")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([split_text(x, limit, overlap) for x in batch], dtype=object)

    return cut.asNondeterministic()(text)  # or Catalyst would repeat it in the filter of the explode


def split_rows(rows: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id, n_pieces, chunk_index, piece): every row's text in pieces, numbered from 0.

    Rows without text give no piece; repeated rows are split each on their own; other columns are ignored.
    """
    cut = rows.select(F.col(id_column).alias("row_id"), pieces_column(F.col(text_column), limit, overlap).alias("pieces"))
    return cut.select("row_id", F.size("pieces").alias("n_pieces"), F.posexplode("pieces").alias("chunk_index", "piece"))


def oversized_rows(rows: DataFrame, id_column: str, text_column: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id) of rows that the operator had to split."""
    return split_rows(rows, id_column, text_column, limit, overlap).where("chunk_index = 1").select("row_id")
