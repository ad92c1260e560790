"""Sentence units of multilingual text, as end offsets into the stored text.

A pushdown automaton runs over each paragraph: one stack holds open quotations and brackets, another the
levels of lists, each with its marker and the number of its current item. Only the characters that can matter (terminators,
quotation marks, brackets, line breaks, blanks between Thai words) are visited. A full stop is looked up,
word by word from its end, in a trie of abbreviations; other scripts bring their own terminators.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.lookalike import LETTER_CLASSES

# Abbreviations that stand before a name and never end a sentence.
BEFORE_NAMES = "dr mr mrs ms messrs mme mlle prof st sr sra srta hr fr herr gen col capt lt sgt rev hon mt ft dra ing dipl κ κα κος δρ डॉ श्री श्रीमती г-н г-жа им акад проф д-р أ د م".split()
# Abbreviations that stand before a number; before a capital letter they end a sentence.
BEFORE_NUMBERS = "no nos nr núm vol fig figs p pp pg ch sec sect art arts abs abb bd pág págs cap eq ref col tab n° стр рис гл табл см п пп ст № σελ εικ αρ पृ सं approx ca env aprox vs v ed".split()
# Abbreviations inside sentences; they end one only before a capital letter.
INSIDE = "etc inc ltd co corp jr bros dept est al usw bzw ggf evtl vgl ff d.h z.b u.a ej p.ej p.ex ex cf eg e.g i.e ie viz resp approx a.m p.m am pm u.s u.k n.b г гг в вв др т.д т.п т.е тыс млн руб κ.λπ π.χ κτλ λ.χ h min kg km cm mm м кг км ч S.A".lower().split()
# Abbreviations that never end a sentence, whatever follows.
NEVER = "e.g i.e cf vs viz z.b d.h bzw vgl p.ex p.ej approx env aprox ca см т.е π.χ eg ie u.s u.k".split()

TERMINATORS = ".!?。！？।॥؟۔…．｡⁈⁇‽;" "·"
OPENERS = {"“": "”", "‘": "’", "«": "»", "‹": "›", "„": "“", "(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "‚": "‘", '"': '"', "＂": "＂", "［": "］"}
CLOSERS = set(OPENERS.values()) | {"”"}
ZERO = "\u200b-\u200f\u2060-\u2064\ufeff\u00ad\u034f\u202a-\u202e\u2066-\u2069\ufe00-\ufe0f"
BLANK = r"[^\S\n]"
THAI = "฀-๿"
PARAGRAPH_GAP = re.compile(rf"\n(?:{BLANK}|[{ZERO}])*\n(?:\s|[{ZERO}])*| ")
EVENT = re.compile(rf"[.!?。！？।॥؟۔…．｡⁈⁇‽]+|[“”‘’«»‹›„‚\"＂()\[\]{{}}（）「」『』【】《》〈〉［］]|\n|(?<=[{THAI}])[{ZERO}]*{BLANK}+[{ZERO}]*(?=[{THAI}])|[;;](?=\s|$)")
MARKER = re.compile(rf"(?:{BLANK}|[{ZERO}])*(?:(?P<bullet>[•●◦▪‣∙*·–—\-+]|\[[ xX]?\])|(?P<open>[(（])?(?P<n>[0-9０-９]{{1,3}}|[a-zA-Zａ-ｚ]|[ivx]{{1,4}})(?P<close>[.)）．]))(?={BLANK})")
HEADING = re.compile(r"(?:#{1,6}\s+\S|(?:[0-9]+\.)+[0-9]+\.?\s+\S|[IVX]+\.\s+\S)")
CJK_END = "。！？｡"
ENDS = re.compile(rf"[.!?。！？।॥؟۔…．｡:：;；][”’»“\")\]）」』{ZERO}]*$")
SKIP = re.compile(rf"[{ZERO}]+")
#: Characters before a full stop that are looked at; no abbreviation is longer.
LONGEST_WORD = 64
_LIKE = {ord(x): group[0] for group in LETTER_CLASSES for x in group[1:]}


def _plain(word: str) -> str:
    """A word for the trie: one character for those that look alike, composed, lower case, nothing without width."""
    return unicodedata.normalize("NFKC", SKIP.sub("", word)).translate(_LIKE).lower()


def _trie(words: list[str], label: str, into: dict) -> None:
    for word in words:
        node = into
        for char in reversed(_plain(word)):
            node = node.setdefault(char, {})
        node.setdefault("", set()).add(label)


ABBREVIATIONS: dict = {}
for _words, _label in ((BEFORE_NAMES, "name"), (BEFORE_NUMBERS, "number"), (INSIDE, "inside"), (NEVER, "never")):
    _trie(_words, _label, ABBREVIATIONS)


def _labels(word: str) -> set[str]:
    node = ABBREVIATIONS
    for char in reversed(word):
        if (node := node.get(char)) is None:
            return set()
    return node.get("", set())


def _starts(text: str, at: int, end: int) -> str:
    """The first three characters with a width at a place, blanks before them left out; fewer at the end."""
    while at < end and (text[at].isspace() or SKIP.match(text[at])):
        at += 1
    return SKIP.sub("", text[at : min(at + 9, end)])[:3]


def _stop_ends(text: str, start: int, begin: int, after: str, gap: bool) -> bool:
    """Whether a full stop at ``start`` ends its sentence; ``after`` is what follows, ``gap`` whether blanks do."""
    at, earliest = start, max(begin, start - LONGEST_WORD)
    while at > earliest and not text[at - 1].isspace() and text[at - 1] not in "([{“‘«„\"（/":
        at -= 1
    word = _plain(text[at:start])
    for mark in ("'", "’"):
        if mark in word and len(word.rpartition(mark)[2]) > 1:
            word = word.rpartition(mark)[2]
    first = unicodedata.normalize("NFKC", after[:1])
    upper, digit = first.isupper() or first.istitle(), first.isdigit()
    if not gap:
        return len(word) > 2 and word.isalpha() and upper and len(after) > 1 and after[1].islower()
    if not word:
        return upper
    labels = _labels(word)
    if "never" in labels or "name" in labels and not after[:1] == "":
        return False
    if "number" in labels and (digit or not upper):
        return False
    if len(word) == 1 and word.isalpha():  # an initial, or one of several shortened words in a row
        if not unicodedata.normalize("NFKC", SKIP.sub("", text[at:start])).islower() or len(after) > 1 and after[1] == ".":
            return False
    if digit and word.isdigit() and len(word) < 3 and at == begin:
        return False
    if first.islower() and not (len(after) > 1 and after[1].isupper()):
        return False
    if word.isdigit() and len(word) <= 2 and upper and _month_follows(text, start + 1):
        return False
    return True


# Month names that follow a day written with a full stop.
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner".split()


def _month_follows(text: str, at: int) -> bool:
    rest = SKIP.sub("", unicodedata.normalize("NFKC", text[at : at + 24])).strip().split()
    return bool(rest) and rest[0].strip(".,;").translate(_LIKE).lower() in _MONTHS_PLAIN


_MONTHS_PLAIN = {x.translate(_LIKE) for x in MONTHS}


def _paired(events: list[re.Match]) -> dict[int, int]:
    """Place of each opening mark that is closed in its paragraph -> place of its closing mark (a pushdown pass)."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    for event in events:
        mark = event.group()
        if len(mark) != 1 or (mark not in OPENERS and mark not in CLOSERS):
            continue
        if mark in CLOSERS and any(mark == wanted for wanted, _ in stack):
            while stack:
                wanted, at = stack.pop()
                if wanted == mark:
                    pairs[at] = event.start()
                    break
        elif mark in OPENERS:
            stack.append((OPENERS[mark], event.start()))
    return pairs


def _paragraph(text: str, begin: int, end: int, ends: list[int]) -> None:
    """Appends the ends of the units of text[begin:end], which holds no blank line."""
    events = list(EVENT.finditer(text, begin, end))
    pairs = _paired(events) if events else {}
    depth_until, unit, line = begin, begin, begin
    greek = None
    levels: list[tuple[str, int]] = []

    def marker(at: int, previous: str, first: bool) -> bool:
        """Whether a list item begins at a line; its level is then on top of the stack, deeper ones are popped."""
        found = MARKER.match(text, at, end)
        if not found:
            return False
        if found["bullet"]:
            kind, value, opens = found["bullet"][0], 0, first or bool(levels) or bool(ENDS.search(previous))
        else:
            number = unicodedata.normalize("NFKC", found["n"])
            kind = f"{found['open'] or ''}{'9' if number.isdigit() else 'a'}{found['close']}"
            value = int(number) if number.isdigit() else ord(number[0].lower()) - 96 if len(number) == 1 else -1
            opens = first and (found["close"] != "." or number.isdigit()) or value == 1 and (number.isdigit() or found["close"] != ".") and bool(ENDS.search(previous))
        for depth in range(len(levels) - 1, -1, -1):
            if levels[depth][0] == kind and (found["bullet"] or value in (levels[depth][1] + 1, -1)):
                del levels[depth:]
                levels.append((kind, value))
                return True
        if opens:
            levels.append((kind, value))
        return opens

    def close(at: int) -> None:
        nonlocal unit
        last = at
        while last > unit and (text[last - 1].isspace()):
            last -= 1
        if text[unit:last].strip():
            ends.append(last)
            unit = at

    body = MARKER.match(text, begin, end).end() if marker(begin, "", True) else begin
    for event in events:
        at, mark = event.start(), event.group()
        if at < body:
            continue
        if mark == "\n":
            previous = text[line:at]
            if marker(at + 1, previous.rstrip(), False):
                close(at)
                body, depth_until = MARKER.match(text, at + 1, end).end(), at
            elif not levels and line == begin and HEADING.match(previous.strip()) and not ENDS.search(previous.rstrip()) and _starts(text, at, end)[:1].isupper():
                close(at)
            elif at >= depth_until and at > begin and "฀" <= text[at - 1] <= "๿" and "฀" <= _starts(text, at, end)[:1] <= "๿":
                close(at)
            line = at + 1
        elif at in pairs:
            depth_until = max(depth_until, pairs[at])
        elif at < depth_until or mark[0] in CLOSERS or mark[0] in OPENERS:
            if at == depth_until and mark[0] in CLOSERS and at > begin and SKIP.sub("", text[max(begin, at - 4) : at])[-1:] in (*".!?…。！？।؟", ")"):
                stop = event.end()
                after = _starts(text, stop, end)
                before = SKIP.sub("", text[max(begin, at - 4) : at])[-1:]
                if before != ")" and stop < end and text[stop].isspace() and after[:1] and not after[0].islower() and after[0] not in ",;:–—-.!?" and not unicodedata.category(after[0]) in ("Pe", "Pf"):
                    close(stop)
        elif mark.isspace() or SKIP.match(mark):
            close(at)
        elif mark[0] in ";;":
            if greek is None:
                greek = sum("Ͱ" <= x <= "Ͽ" for x in text[begin:end]) * 3 > end - begin
            if greek and _starts(text, event.end(), end)[:1].isupper():
                close(event.end())
        else:
            stop = event.end()
            while stop < end and (text[stop] in CLOSERS and text[stop] not in ("“",) or SKIP.match(text[stop]) or text[stop] == "“" and stop not in pairs):
                stop += 1
            after, gap = _starts(text, stop, end), stop >= end or text[stop].isspace()
            if not after:
                continue
            kind = mark[-1]
            if any(x in CJK_END for x in mark):
                closed = stop > event.end()
                if not closed or gap:
                    close(stop)
            elif kind in "।॥؟۔":
                close(stop)
            elif mark in (".", "．"):
                if _stop_ends(text, at, max(unit, begin), after, gap):
                    close(stop)
            elif mark.strip(".…．") == "":
                if gap and (after[0].isupper() or (after[0] in OPENERS and not after[1:2].islower())):
                    close(stop)
            elif gap and not (after[0].islower() and not after[1:2].isupper()):
                if after[0] not in "-–—,;:":
                    close(stop)
            elif not gap and after[0].isupper() and after[1:2].islower():
                close(stop)
    close(end)


def sentence_ends(text: str | None) -> list[int]:
    """End offsets (code points of the stored text) of its sentence units; none for null and blank texts."""
    if text is None or not text.strip():
        return []
    text = text.replace("\r\n", " \n").replace("\r", "\n").replace("\u2028", "\n") if "\r" in text or "\u2028" in text else text
    ends: list[int] = []
    at = 0
    for gap in PARAGRAPH_GAP.finditer(text):
        if gap.start() > at:
            _paragraph(text, at, gap.start(), ends)
        at = gap.end()
    if at < len(text):
        _paragraph(text, at, len(text), ends)
    return ends


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _ends(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([sentence_ends(x) for x in batch], dtype=object)


_ends = _ends.asNondeterministic()  # or Catalyst would repeat it in the filter of the explode


def ends_column(text: Column) -> Column:
    """array<int> of unit ends of a string column; an empty array for null, empty and blank texts."""
    return _ends(text)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("unit", T.StringType())])))
def _units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        out = []
        for text in batch:
            ends = sentence_ends(text)
            out.append([{"start_char": a, "end_char": b, "unit": text[a:b].lstrip()} for a, b in zip([0, *ends], ends)])
        yield pd.Series(out, dtype=object)


_units = _units.asNondeterministic()


def sentence_units(rows: DataFrame, id_column: str, text_column: str, with_text: bool = False) -> DataFrame:
    """(row_id, unit_index, start_char, end_char[, unit]) of every row; rows without text give none.

    Repeated rows give their units once each; extra columns are ignored. A unit is cut where its text is, so
    nothing but itself goes with it.
    """
    own = F.col(text_column)
    if with_text:
        found = rows.select(F.col(id_column).alias("row_id"), F.posexplode(_units(own)).alias("unit_index", "u"))
        return found.select("row_id", "unit_index", "u.start_char", "u.end_char", "u.unit")
    found = rows.select(F.col(id_column).alias("row_id"), _ends(own).alias("ends"))
    spans = F.transform("ends", lambda end, i: F.struct(F.when(i == 0, 0).otherwise(F.get("ends", i - 1)).alias("start_char"), end.alias("end_char")))
    units = found.select("row_id", F.posexplode(spans).alias("unit_index", "u"))
    return units.select("row_id", "unit_index", "u.start_char", "u.end_char")
