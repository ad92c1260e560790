"""One consistent form for text that looks the same but is written in different characters.

The code points of the whole corpus are counted by Spark. From the counted alphabet (bounded by Unicode,
never by the data) look-alike classes are computed by union-find over strings and code points: blanks,
characters without width, full- and half-width forms, ligatures, accents and look-alike letters of other
scripts. Each class is represented by its most frequent code point; strings that consist of several
code points are represented by the composition of their parts' representatives, so the form of a text
does not depend on how it was composed. Texts are rewritten greedily, longest match first, by one
Aho-Corasick automaton, which every Python worker builds once from the broadcast classes.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.session import written

# Letters of different scripts that print alike, one class per row.
LETTER_CLASSES = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YΥҮ", "ZΖ",
    "aа", "cсϲ", "dԁ", "eе", "hһ", "iі", "jјϳ", "lӏ", "oоο", "pр", "qԛ", "sѕ", "vν", "wԝ", "xх", "yу", "ΓГ", "ΠП", "ΦФ", "μµ",
)
# Hyphens that print alike.
HYPHENS = "-‐‑"
# Characters without width that are neither format nor control characters.
WIDTHLESS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
# Compatibility forms that do not print like what they stand for.
UNLIKE = "ſϐϑϒϕϖϰϱϴϵ"
ALIKE_TAGS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")


@cache
def is_blank(char: str) -> bool:
    """Whether a character prints as a blank (or breaks the line)."""
    return unicodedata.category(char) in ("Zs", "Zl", "Zp") or char in "\t\n\x0b\x0c\r\x85"


@cache
def is_widthless(char: str) -> bool:
    """Whether a character prints nothing at all."""
    kind = unicodedata.category(char)
    return (kind in ("Cf", "Cc") and not is_blank(char)) or char in WIDTHLESS or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF


class _Sets:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, item: str) -> str:
        self.parent.setdefault(item, item)
        root = item
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[item] != root:
            self.parent[item], item = root, self.parent[item]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


@dataclass
class LookalikeClasses:
    """Rewrite rules (pattern -> consistent form); only their size, bounded by Unicode, is broadcast."""

    rules: dict[str, str] = field(default_factory=dict)

    def rewriter(self):
        """A function text -> consistent form, around one automaton."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern, form in self.rules.items():
            automaton.add_word(pattern, (len(pattern), form))
        automaton.make_automaton()
        ascii_rules = [p for p in self.rules if p.isascii() and p not in "\t\n\x0b\x0c\r"]
        rules = bool(self.rules)

        def rewrite(text: str | None) -> str | None:
            if text is None:
                return None
            if text.isascii() and not any(p in text for p in ascii_rules):
                return " ".join(text.split())
            text = unicodedata.normalize("NFC", text)
            parts, at = [], 0
            for end, (length, form) in automaton.iter_long(text) if rules else ():
                parts.append(text[at : end - length + 1])
                parts.append(form)
                at = end + 1
            if parts:
                parts.append(text[at:])
                text = unicodedata.normalize("NFC", "".join(parts))
            return " ".join(text.split())

        return rewrite


def build_classes(counts: dict[str, int]) -> LookalikeClasses:
    """Classes and rewrite rules for an alphabet with its frequencies."""
    sets = _Sets()
    for letters in (*LETTER_CLASSES, HYPHENS):
        for other in letters[1:]:
            sets.union(letters[0], other)
    for char in counts:
        if is_blank(char):
            sets.union(char, " ")
        elif is_widthless(char):
            sets.union(char, "")
        elif char not in UNLIKE:
            tag, _, parts = unicodedata.decomposition(char).rpartition("> ")
            if parts and (not tag or f"{tag}>" in ALIKE_TAGS):
                sets.union(char, "".join(chr(int(x, 16)) for x in parts.split()))
    members: dict[str, list[str]] = {}
    for item in sets.parent:
        members.setdefault(sets.find(item), []).append(item)
    chosen: dict[str, str] = {}
    expansion: dict[str, str] = {}
    for group in members.values():
        points, strings = [x for x in group if len(x) == 1], sorted(x for x in group if len(x) != 1)
        if strings:  # spelled out, part by part; nothing at all for what has no width
            expansion |= dict.fromkeys(points, strings[0])
            continue
        simple = [x for x in points if unicodedata.normalize("NFC", x) == x] or points
        chosen |= dict.fromkeys(points, " " if " " in group else min(simple, key=lambda x: (-counts.get(x, 0), x)))

    def form(text: str, depth: int = 0) -> str:
        return "".join(form(expansion[x], depth + 1) if x in expansion and depth < 8 else chosen.get(x, x) for x in text)

    alphabet = set(counts) | {x for x in sets.parent if len(x) == 1}
    rules = {x: y for x in alphabet if (y := unicodedata.normalize("NFC", form(x))) != x}
    marks = [x for x in counts if unicodedata.combining(x)]
    for base in [x for x in rules if rules[x] and unicodedata.category(x)[0] == "L"]:
        for mark in marks:
            if len(y := unicodedata.normalize("NFC", rules[base] + form(mark))) == 1:
                rules[base + mark] = y
    return LookalikeClasses(rules)


def count_code_points(texts: DataFrame) -> DataFrame:
    """(code_point, n) over a whole string column; counted per partition before the shuffle."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            points = np.frombuffer("".join(batch.iloc[:, 0].dropna()).encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(points):
                counted = np.bincount(points)
                total[: len(counted)] += counted
        there = np.flatnonzero(total)
        yield pd.DataFrame({"code_point": there.astype(np.int32), "n": total[there]})

    return texts.mapInPandas(partial, "code_point int, n long").groupBy("code_point").agg(F.sum("n").alias("n"))


def fit(*columns: DataFrame) -> LookalikeClasses:
    """Classes for the alphabet of one-column tables; what reaches the driver is one count per code point in use."""
    together = columns[0].toDF("text")
    for other in columns[1:]:
        together = together.unionByName(other.toDF("text"))
    return build_classes({chr(r.code_point): r.n for r in count_code_points(together).collect()})


def consistent_form(text: Column, classes: LookalikeClasses) -> Column:
    """The consistent form of a string column: equal for texts that look the same, runs of blanks as one.

    Null stays null; empty and blank texts become empty.
    """
    spread = _spread(classes)

    @F.pandas_udf(T.StringType())
    def rewritten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = spread.value.rewriter()
        for batch in batches:
            yield pd.Series([rewrite(x) for x in batch], dtype=object)

    # told to be nondeterministic, or Catalyst would repeat it in the filters it pushes down
    return rewritten.asNondeterministic()(text)


def _spread(classes: LookalikeClasses):
    from pyspark.sql import SparkSession

    return SparkSession.active().sparkContext.broadcast(classes)


def lookalike_members(rows: DataFrame, group: list[str], id_column: str, text_column: str, classes: LookalikeClasses) -> DataFrame:
    """(group columns, id, written, looks): 256-bit hashes of each row's text and of its form, in a written table.

    Rows without id, and null and blank texts, are left out.
    """
    formed = rows.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(
        *group, F.col(id_column).alias("id"), F.unhex(F.sha2(text_column, 256)).alias("written"), consistent_form(F.col(text_column), classes).alias("form")
    )
    # written once: the forms are costly, and the hashes are read by every join below
    return written(formed.where(F.col("form") != "").select(*group, "id", "written", F.unhex(F.sha2("form", 256)).alias("looks")))


def lookalike_classes(members: DataFrame, group: list[str]) -> DataFrame:
    """(group columns, id, class, rows, strings): every row with its class of texts that look the same, its rows and different strings.

    Hashes are counted before they are joined, so a class that fills a third of the table is one row where it is counted.
    """
    strings = members.groupBy(*group, "looks", "written").agg(F.count("*").alias("n"))
    sizes = strings.groupBy(*group, "looks").agg(F.sum("n").alias("rows"), F.count("*").alias("strings"))
    return members.join(sizes, [*group, "looks"]).select(*group, "id", F.lower(F.hex("looks")).alias("class"), "rows", "strings")


def lookalike_pairs(members: DataFrame, group: list[str]) -> DataFrame:
    """Pairs (group columns, id_a < id_b) of members of one group whose texts look the same but differ as strings.

    Only hashes are shuffled. Copies of one string are first gathered under it, so a text that fills a
    third of the table is compared as one string; its rows are paired only with rows of other strings.
    A repeated id gives each pair once.
    """
    several = members.groupBy(*group, "looks").agg(F.min("written").alias("low"), F.max("written").alias("high")).where("low <> high").select(*group, "looks")
    members = members.join(several, [*group, "looks"], "left_semi")
    strings = members.select(*group, "looks", "written").distinct()
    other = strings.withColumnRenamed("written", "other")
    twins = strings.join(other, [*group, "looks"]).where("written < other")
    left = members.withColumnRenamed("id", "a")
    right = members.withColumnRenamed("id", "b").withColumnRenamed("written", "other")
    pairs = twins.join(left, [*group, "looks", "written"]).join(right, [*group, "looks", "other"])
    return pairs.select(*group, F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).where("id_a <> id_b").distinct()
