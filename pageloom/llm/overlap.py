"""Same or nearly same records on both sides of a train / evaluation split.

Distinct normalised texts of the evaluation side are cut into segments, more than the allowed changes can
touch, so that a known number of them stands in a true copy unchanged and near its place. Shards of
evaluation texts are compiled into Aho-Corasick automata that scan the training texts; matched intervals are
merged into the coverage of each evaluation text, and candidates that have enough of their segments are
compared exactly. Texts too short for that are compared with all training texts of like length. As numbers
and codes must agree, texts are sharded by their digits; a shard that grows beyond its bound is split into
blocks of evaluation texts and slices of training texts, so no task holds an unbounded group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.folding import UNSPACED, digits_of, distance, fold, letters_in, letters_of
from pageloom.llm.lookalike import LookalikeClasses, fit
from pageloom.session import durable, written

#: Changes of a near copy: letters (a swap of neighbours is one), words, and characters of scripts without blanks that make up WORDS words.
LETTERS, WORDS, CHARACTERS = 3, 2, 8
#: Segments that must be left of a near copy.
LEFT = 2
#: Letters of the evaluation texts of one task, and of the training texts that it scans.
BLOCK, SLICE = 500_000, 2_000_000
SPLIT_WORDS = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+(?:[-'’.:/_]+[^\W_{UNSPACED}]+)*")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")


def reach(folded: str) -> tuple[int, int, int]:
    """What can change in a near copy of a folded form: letters (at least as many as its two longest words have), and characters of scripts without blanks."""
    words = sorted(map(len, SPLIT_WORDS.findall(folded)), reverse=True)
    return words[0] if words else 0, words[1] if len(words) > 1 else 0, CHARACTERS if ANY_UNSPACED.search(folded) else 0


def widest_change(first: int, second: int, single: int) -> int:
    """Letters by which a near copy can be shorter, or two copies shifted."""
    return LETTERS + max(first + second, single)


def segments(letters: str, first: int, second: int, single: int) -> list[tuple[int, str]]:
    """(offset, segment) of an evaluation text: the fewest equal parts of which the allowed changes leave LEFT untouched; none where no number of parts does.

    A letter's change touches one part or, as a swap, two; a word that changes at most as many as its letters
    can reach into; a changed character of a script without blanks one.
    """
    n = len(letters)
    for parts in range(LEFT + 2 * LETTERS, n + 1):
        size = n // parts
        touched = 2 * LETTERS + max(sum((x + size - 2) // size + 1 for x in (first, second) if x), single)
        if parts - touched >= LEFT:
            bounds = [n * i // parts for i in range(parts + 1)]
            return [(a, letters[a:b]) for a, b in zip(bounds, bounds[1:])]
    return []


def merged_length(spans: list[tuple[int, int]]) -> int:
    """Total length of a union of intervals."""
    total, reach = 0, 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


def _tokens(form: str) -> list[tuple[str, bool, bool]]:
    """(folded word, has a digit, looks like a name) of a consistent form; a name is capitalised inside a sentence."""
    out = []
    for found in SPLIT_WORDS.finditer(form):
        word = found.group()
        before = form[: found.start()].rstrip(" “\"'(«„[¿¡")
        inside = bool(before) and before[-1] not in ".!?:。！？"
        out.append((letters_of(word), any(x.isdigit() for x in word), inside and word[0].isupper() and not word.isupper() or inside and len(word) > 1 and word.isupper()))
    return [x for x in out if x[0]]


def nearly_same(a: str, b: str) -> bool:
    """Whether two consistent forms are the same or nearly: a few letters or one or two words apart, numbers, codes and names alike."""
    x, y = _tokens(a), _tokens(b)
    left, right = [t[0] for t in x], [t[0] for t in y]
    if "".join(left) == "".join(right):
        return True
    letters = words = 0
    unspaced = 0
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        gone, come = x[i:j], y[k:m]
        before, after = "".join(t[0] for t in gone), "".join(t[0] for t in come)
        if before == after:
            continue
        if digits_of(before) != digits_of(after):
            return False
        near = distance(before, after, LETTERS) if gone and come else LETTERS + 1
        coded = any(t[1] for t in gone) or any(t[1] for t in come)
        named = any(t[2] for t in gone) and any(t[2] for t in come)
        if coded:
            return False
        if named and near > 1:
            return False
        if (any(t[2] for t in gone) or any(t[2] for t in come)) and near > LETTERS:
            return False
        if all(len(t[0]) == 1 and not t[0].isascii() for t in (*gone, *come)):
            unspaced += max(len(gone), len(come))
        elif near <= LETTERS and near * 3 <= max(len(before), len(after)):
            letters += near
        else:
            words += max(len(gone), len(come))
    return letters <= LETTERS and words + (unspaced + 3) // 4 <= WORDS and unspaced * 3 <= len("".join(left))


def normalised(rows: DataFrame, classes: LookalikeClasses) -> DataFrame:
    """Adds ``form`` (consistent form), ``letters``, ``digits`` and ``reach`` for a string column ``text``."""
    spread = rows.sparkSession.sparkContext.broadcast(classes)

    def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = spread.value.rewriter()
        for batch in batches:
            forms = [rewrite(x) for x in batch["text"]]
            folded = [fold(x) for x in forms]
            letters = [letters_in(x) for x in folded]
            yield batch.drop(columns="text").assign(form=forms, letters=letters, digits=[digits_of(x) for x in letters], reach=[reach(x) for x in folded])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInPandas(formed, f"{fields}, form string, letters string, digits string, reach array<int>").where("letters <> ''")


class _Automaton:
    """Evaluation texts of one route, compiled; training texts are scanned one by one."""

    def __init__(self, letters: list[str], reaches: list[tuple[int, int, int]]) -> None:
        import ahocorasick

        self.lengths = np.array([len(x) for x in letters])
        self.change = np.array([widest_change(*x) for x in reaches])
        where: dict[str, list[tuple[int, int, int]]] = {}
        self.short = []
        for row, (text, own) in enumerate(zip(letters, reaches)):
            parts = segments(text, *own)
            if not parts:
                self.short.append(row)
            for number, (offset, segment) in enumerate(parts):
                where.setdefault(segment, []).append((row, offset, number))
        self.automaton = ahocorasick.Automaton()
        for segment, places in where.items():
            self.automaton.add_word(segment, (len(segment), np.array(places, np.int64)))
        self.automaton.make_automaton()
        self.parts = 1 + max((number for places in where.values() for *_, number in places), default=0)

    def candidates(self, letters: str, own: tuple[int, int, int]) -> Iterator[tuple[int, float]]:
        """(row, coverage) of evaluation texts of which enough segments stand near their places; short texts of like length with coverage 0."""
        change = widest_change(*own)
        near = np.maximum(self.change, change)
        like = (self.lengths - self.change <= len(letters)) & (len(letters) - change <= self.lengths)
        for row in self.short:
            if like[row]:
                yield row, 0.0
        hits = [np.column_stack((places, np.full(len(places), end - length + 1), np.full(len(places), length))) for end, (length, places) in self.automaton.iter(letters)] if len(self.automaton) else []
        if not hits:
            return
        row, offset, number, at, length = np.concatenate(hits).T
        there = like[row] & (np.abs(at - offset) <= near[row])
        _, first = np.unique(row[there] * self.parts + number[there], return_index=True)
        row, offset, length = row[there][first], offset[there][first], length[there][first]
        enough = np.bincount(row, minlength=len(self.lengths)) >= LEFT
        for found in np.flatnonzero(enough).tolist():
            own = row == found
            yield found, merged_length([*zip(offset[own].tolist(), (offset[own] + length[own]).tolist())]) / int(self.lengths[found])


def _scan(key, evaluation: pd.DataFrame, training: pd.DataFrame) -> pd.DataFrame:
    """Pairs (hash of evaluation text, hash of training text, coverage) of one block and slice."""
    found: list[tuple[str, str, float]] = []
    sides: list[dict[int, list[tuple]]] = []
    for side, prefix in ((evaluation, "e_"), (training, "t_")):
        rows: dict[int, list[tuple]] = {}
        for route, *row in zip(*(side[prefix + x].tolist() for x in ("route", "hash", "form", "letters", "reach"))):
            rows.setdefault(route, []).append(tuple(row))
        sides.append(rows)
    for route, own in sides[0].items():
        automaton = _Automaton([x[2] for x in own], [x[3] for x in own]) if route in sides[1] else None
        for digest, form, letters, own_reach in sides[1].get(route, ()):
            found += [(own[row][0], digest, coverage) for row, coverage in automaton.candidates(letters, own_reach) if nearly_same(own[row][1], form)]
    return pd.DataFrame(found, columns=["evaluation", "training", "coverage"])


def overlapping_texts(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """(evaluation, training, coverage): hashes of overlapping distinct texts, both sides with hash, kind, form, letters, digits, reach."""
    sides = [written(x.dropDuplicates(["hash"]).select("hash", "form", "letters", "reach", F.xxhash64("kind", "digits").alias("route"))) for x in (evaluation, training)]
    counts = [x.groupBy("route").agg(F.sum(F.length("letters") + 1).alias("n")) for x in sides]
    both = counts[0].withColumnRenamed("n", "n_eval").join(counts[1].withColumnRenamed("n", "n_train"), "route")
    both = written(both.select("route", F.ceil(F.col("n_eval") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_train") / SLICE).cast("int").alias("slices"), "n_eval", "n_train"))
    totals = both.agg(F.sum("n_eval").alias("e"), F.sum("n_train").alias("t")).first()
    shards = max(1, -(-(totals["e"] or 0) // (BLOCK // 4)), -(-(totals["t"] or 0) // (SLICE // 4)))
    routed = both.select("route", "blocks", "slices", F.when((F.col("blocks") > 1) | (F.col("slices") > 1), F.col("route")).otherwise(F.pmod("route", F.lit(shards))).alias("shard"))
    left = sides[0].join(routed, "route").withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = sides[1].join(routed, "route").withColumn("slice", F.pmod(F.xxhash64("hash"), F.col("slices")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keep = ["shard", "block", "slice", "hash", "route", "form", "letters", "reach"]
    keys = ["shard", "block", "slice"]
    left, right = left.select(keep).toDF(*(f"e_{x}" for x in keep)), right.select(keep).toDF(*(f"t_{x}" for x in keep))
    grouped = left.groupBy([f"e_{x}" for x in keys]).cogroup(right.groupBy([f"t_{x}" for x in keys]))
    return grouped.applyInPandas(_scan, "evaluation string, training string, coverage double")


def question_texts(questions: DataFrame) -> DataFrame:
    """(id, split, kind, text): question and evidence texts of questions that have an id and a split."""
    own = questions.where("id is not null and split is not null")
    asked = own.select("id", "split", F.lit("question").alias("kind"), F.col("question").alias("text"))
    cited = own.select("id", "split", F.explode("evidence").alias("e")).select("id", "split", F.lit("evidence").alias("kind"), F.col("e.text").alias("text"))
    return asked.unionByName(cited).where("text is not null")


def cross_split_pairs(questions: DataFrame) -> DataFrame:
    """(id_a, id_b, split, kind, coverage): a train question and a dev or test question that overlap, the smaller id first.

    Texts are compared once however many questions hold them. A pair comes out once for each kind of text,
    with its best coverage. Null splits take no part; null, empty and symbol-only texts match nothing.
    """
    texts = question_texts(questions)
    classes = fit(texts.select("text"))
    formed = written(normalised(texts, classes).withColumn("hash", F.sha2(F.concat_ws("\u0001", "kind", "form"), 256)))
    sides = formed.where("split in ('dev', 'test')"), formed.where("split = 'train'")
    pairs = overlapping_texts(*sides)
    held = [x.select("id", "split", "kind", "hash").distinct() for x in sides]
    joined = pairs.join(held[0].select(F.col("hash").alias("evaluation"), F.col("id").alias("x"), "split", "kind"), "evaluation")
    joined = joined.join(held[1].select(F.col("hash").alias("training"), F.col("id").alias("y")), "training")
    return joined.groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "split", "kind").agg(F.max("coverage").alias("coverage"))


def overlap_report(questions: DataFrame) -> DataFrame:
    """(split, source, questions, overlapping, pairs): overlaps with train per evaluation split and cited file name.

    Questions without evidence, or whose evidence names no source, are counted under a null source.
    """
    pairs = durable(cross_split_pairs(questions).select("id_a", "id_b").distinct())
    held = questions.where("id is not null and split in ('dev', 'test')").select("id", "split", F.explode_outer("evidence.source").alias("path"))
    held = held.select("id", "split", F.trim(F.element_at(F.split(F.regexp_replace("path", r"\\", "/"), "/"), -1)).alias("source")).distinct()
    hits = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    joined = held.join(hits, "id", "left")
    return joined.groupBy("split", "source").agg(F.countDistinct("id").alias("questions"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
