"""Evaluation passages inside a training corpus, found through FM-indexes over shards of the corpus.

A shard is a bounded run of documents of one partition, as words (single characters in scripts without
blanks). Its suffix array is sorted by prefix doubling, its Burrows-Wheeler transform kept as a wavelet
matrix. Phrases of the evaluation items, sent to all shards block by block, are searched
backwards all at once through wavelet ranks; occurrences are located by stepping to sampled suffix
positions. Hits of one item at one place in a document are merged, and every merged place is aligned word
by word with the item, however few its hits are, unless it lacks what every holder of half an item has:
a fifth of the item's pairs of neighbouring words, half of its words in any order, and two thirds of the
numbers and codes of some half.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.llm.folding import UNSPACED, words_of
from pageloom.llm.lookalike import LookalikeClasses, fit
from pageloom.session import Written

#: Words in a phrase, words between sampled suffix positions, words in a shard, characters of items sent out at once.
PHRASE, SAMPLED, SHARD, BLOCK_CHARS = 5, 4, 150_000, 4_000_000
#: Words below which an item is searched by shorter phrases, and their words: half of it, a few words changed, still holds one.
SHORTER = ((25, 3), (60, 4))
#: Least share of an item that counts as held.
HELD = 0.5
#: Where unchanged runs of PHRASE words hold less than the first share of an item, the second share of the words between the ends of its held half must be unchanged.
COVERED, UNCHANGED = 0.25, 2 / 3
#: Words by which the place of a hit may drift from the item's own order (a page header, dropped words).
DRIFT = 40
#: Least share of an item's pairs of neighbouring words in a place that can hold half of it: runs of PHRASE words that make up COVERED
#: of the item have 4/5 of them, and so have successive runs of which UNCHANGED is left; one pair less for rounding.
NEIGHBOURS = COVERED * (PHRASE - 1) / PHRASE
#: Places that are counted at once.
AT_ONCE = 20_000
#: Entries of a table of items and pairs; larger blocks of items are looked up by search.
TABLE = 50_000_000
#: Characters that stand for a word of DRIFT in scripts without blanks.
LETTERS = {"thai": 4, "han": 2}
UNSPACED_WORD = re.compile(f"[{UNSPACED}]")


class WaveletMatrix:
    """Ranks and access over a sequence of small integers, for whole arrays of queries."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.bits = max(1, int(largest).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(symbols) - self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each end."""
        low, high = np.zeros_like(ends), ends.copy()
        for depth in range(self.bits):
            bit = (symbols >> (self.bits - 1 - depth)) & 1
            ones = self.ones[depth]
            low = np.where(bit == 1, self.zeros[depth] + ones[low], low - ones[low])
            high = np.where(bit == 1, self.zeros[depth] + ones[high], high - ones[high])
        return high - low

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        places, symbols = places.copy(), np.zeros_like(places)
        for depth in range(self.bits):
            ones = self.ones[depth]
            bit = ones[places + 1] - ones[places]
            symbols = symbols * 2 + bit
            places = np.where(bit == 1, self.zeros[depth] + ones[places], places - ones[places])
        return symbols


def _radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of non-negative 64-bit keys, sixteen bits at a time (numpy sorts these by radix)."""
    order = np.arange(len(keys))
    for shift in range(0, max(1, int(keys.max(initial=0)).bit_length()), 16):
        order = order[np.argsort((keys[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order; a shorter suffix comes first.

    Suffixes are sorted by as many leading symbols as a key holds; those that agree in them, few but for
    repeated passages, are told apart by prefix doubling.
    """
    n = len(symbols)
    bits = int(symbols.max(initial=0) + 1).bit_length()
    step = max(1, 63 // bits)
    padded = np.concatenate((symbols + 1, np.zeros(step, np.int64)))
    keys = np.zeros(n, np.int64)
    for at in range(step):
        keys = (keys << bits) | padded[at : at + n]
    order = _radix_order(keys)
    fresh = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]]))[:n]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    places = np.arange(n)
    while len(places := places[~(fresh & np.append(fresh[1:], True))]):
        own = order[places]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        sorted_ = np.argsort(key, kind="stable")
        own, key = own[sorted_], key[sorted_]
        order[places] = own
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[own] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        step *= 2
    return order


class FMIndex:
    """Full-text index of one shard of symbols from 1; 0 ends it."""

    def __init__(self, symbols: np.ndarray) -> None:
        symbols = np.concatenate((symbols, [0])).astype(np.int64)
        order = suffix_array(symbols)
        transformed = symbols[order - 1]
        largest = int(symbols.max())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=largest + 1)))).astype(np.int64)
        self.matrix = WaveletMatrix(transformed, largest)
        sampled = order % SAMPLED == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase (a row of symbols), backwards from its last symbol."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.sampled), np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            low = self.before[symbol] + self.matrix.rank(symbol, low)
            high = self.before[symbol] + self.matrix.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row, by stepping backwards to a sampled one."""
        rows, steps, places = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.sampled[at]
            places[open_[done]] = self.samples[self.sample_rank[at[done]]] + steps[open_[done]]
            open_, at = open_[~done], at[~done]
            symbol = self.matrix.access(at)
            rows[open_] = self.before[symbol] + self.matrix.rank(symbol, at)
            steps[open_] += 1
        return places


def _phrase_words(words: list[str]) -> int:
    """Words in the phrases by which an item is searched."""
    return next((size for below, size in SHORTER if len(words) < below), PHRASE)


def _drift(words: list[str]) -> float:
    """DRIFT in words as `words_of` counts them: characters in scripts without blanks."""
    weight = sum(LETTERS["thai"] if "\u0e00" <= x <= "\u0e7f" else LETTERS["han"] if len(x) == 1 and UNSPACED_WORD.match(x) else 1 for x in words)
    return DRIFT * weight / max(1, len(words))


class _Phrases:
    """All different phrases of one length, as word numbers, and the items and places they stand at."""

    def __init__(self, numbers: list[np.ndarray], chosen: list[int], size: int) -> None:
        phrases: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item in chosen:
            own = numbers[item].tolist()
            for at in range(len(own) - size + 1):
                phrases.setdefault(tuple(own[at : at + size]), []).append((item, at))
        self.phrases = np.array([*phrases], np.int64).reshape(-1, size)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in phrases.values()]))).astype(np.int64)
        places = np.array([x for group in phrases.values() for x in group], np.int64).reshape(-1, 2)
        self.item, self.at = places[:, 0], places[:, 1]


class _Items:
    """Evaluation items of one block as words, with every phrase they hold."""

    def __init__(self, rows: list[tuple[int, str]], rewrite) -> None:
        self.ids = [x for x, _ in rows]
        self.words = [words_of(rewrite(x)) for _, x in rows]
        self.counts = [Counter(x) for x in self.words]
        self.facts = [_Facts(x) for x in self.words]
        self.drift = np.array([_drift(x) for x in self.words])
        self.lengths = np.array([len(x) for x in self.words], np.int64)
        self.vocabulary: dict[str, int] = {}
        self.numbers = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in own], np.int64) for own in self.words]
        chosen: dict[int, list[int]] = {}
        for item, words in enumerate(self.words):
            if words:  # items shorter than a phrase are held only whole
                chosen.setdefault(_phrase_words(words) if len(words) >= PHRASE else len(words), []).append(item)
        self.phrases = [_Phrases(self.numbers, found, size) for size, found in chosen.items()]
        pairs = [(item, a * len(self.vocabulary) + b) for item, own in enumerate(self.numbers) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
        item, pair = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.pairs, pair = np.unique(pair, return_inverse=True)
        self.own_pairs = np.unique(item * len(self.pairs) + pair)
        self.table = None
        if len(self.words) * len(self.pairs) <= TABLE:
            self.table = np.zeros(len(self.words) * len(self.pairs), bool)
            self.table[self.own_pairs] = True

    def holds(self, item: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbouring words (a number of self.pairs) stands in the item."""
        key = item * len(self.pairs) + pair
        return self.table[key] if self.table is not None else np.isin(key, self.own_pairs)


def _shards(batch: pd.DataFrame, rewrite) -> Iterator[list[tuple[int, list[str]]]]:
    """Documents as words, in shards of bounded size; a longer document is a shard of its own."""
    shard, size = [], 0
    for doc, text in zip(batch["doc"], batch["text"]):
        words = words_of(rewrite(text))
        if size + len(words) > SHARD and shard:
            yield shard
            shard, size = [], 0
        shard.append((doc, words))
        size += len(words) + 1
    if shard:
        yield shard


class _Symbols:
    """A shard as one row of symbols: words from 2, 1 after each document."""

    def __init__(self, shard: list[tuple[int, list[str]]]) -> None:
        self.codes: dict[str, int] = defaultdict(count(2).__next__)
        code = self.codes.__getitem__  # a new word takes the next number
        parts, starts, at = [], [], 0
        for _, words in shard:
            starts.append(at)
            parts.append(np.fromiter(map(code, words), np.int64, len(words)))
            parts.append(ONE)
            at += len(words) + 1
        self.text = np.concatenate(parts)
        self.begins = np.array(starts, np.int64)


ONE = np.ones(1, np.int64)


def _occurrences(symbols: _Symbols, items: _Items) -> tuple[np.ndarray, ...]:
    """(document, place in it, item, place in it) of every phrase of the items in a shard."""
    begins = symbols.begins
    code_of = np.array([symbols.codes.get(x, 0) for x in items.vocabulary], np.int64)
    index, parts = None, [(np.zeros(0, np.int64),) * 4]
    for own in items.phrases:
        known = code_of[own.phrases]
        there = np.flatnonzero((known > 0).all(axis=1))
        if not len(there):
            continue
        index = index or FMIndex(symbols.text)
        low, high = index.search(known[there])
        counts = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        places = index.locate(rows)
        phrase = there[np.repeat(np.arange(len(there)), counts)]
        each = own.starts[phrase + 1] - own.starts[phrase]
        flat = np.repeat(own.starts[phrase] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
        places = np.repeat(places, each)
        document = np.searchsorted(begins, places, side="right") - 1
        parts.append((document, places - begins[document], own.item[flat], own.at[flat]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _digit_words(words: list[str]) -> set[int]:
    return {i for i, x in enumerate(words) if any(c.isdigit() for c in x)}


def _neighbours(symbols: _Symbols, items: _Items, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many pairs of neighbouring words of each place (of the whole shard) stand in its item."""
    number = np.full(len(symbols.codes) + 2, -1, np.int64)
    for word, own in items.vocabulary.items():
        if word in symbols.codes:
            number[symbols.codes[word]] = own
    words = number[symbols.text]
    pair = np.where((words[:-1] >= 0) & (words[1:] >= 0), words[:-1] * len(items.vocabulary) + words[1:], -1)
    at = np.minimum(np.searchsorted(items.pairs, pair), max(0, len(items.pairs) - 1))
    places = np.flatnonzero(items.pairs[at] == pair) if len(items.pairs) else np.zeros(0, np.int64)
    known = at[places]  # only places whose pair is one of some item are looked at
    low, high = np.searchsorted(places, begin), np.searchsorted(places, np.maximum(end - 1, begin))
    held = np.zeros(len(item), np.int64)
    for first in range(0, len(item), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        counts = high[part] - low[part]
        row = np.repeat(np.arange(len(counts)), counts)
        flat = np.repeat(low[part] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        held[part] = np.bincount(row[items.holds(item[part][row], known[flat])], minlength=len(counts))
    return held


def aligned_share(item: list[str], window: list[str], facts: list[int] | None = None) -> float:
    """Share of an item's words that stand in a window in order, in runs of words; 0 where most of its numbers and codes differ."""
    blocks = [b for b in SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks() if b.size]
    long = [b for b in blocks if b.size >= min(4, _phrase_words(item), len(item))]
    if not long:
        return 0.0
    pairs = [b for b in blocks if b.size >= 2 or long[0].a <= b.a < long[-1].a]
    first, last = pairs[0].a, pairs[-1].a + pairs[-1].size
    blocks = [b for b in blocks if first <= b.a < last]
    facts = {i for i in (_digit_words(item) if facts is None else facts) if first <= i < last}
    matched = {i for b in blocks for i in range(b.a, b.a + b.size)}
    if facts and len(facts & matched) * 3 < len(facts) * 2:
        return 0.0
    if sum(b.size for b in blocks if b.size >= PHRASE) < COVERED * len(item) and not _few_changed(blocks, len(item)):
        return 0.0
    return len(matched) / len(item)


class _Facts:
    """Places of an item's numbers and codes, and how few of them any half of it has."""

    def __init__(self, words: list[str]) -> None:
        self.places = sorted(_digit_words(words))
        self.words = [words[i] for i in self.places]
        self.length, self.half = len(words), math.ceil(HELD * len(words))
        so_far = np.cumsum(np.bincount([x + 1 for x in self.places], minlength=self.length + 1))
        self.fewest = int((so_far[self.half :] - so_far[: self.length + 1 - self.half]).min()) if self.places else 0

    def there(self, held: set[str]) -> bool:
        """Whether some half of the item, or more of it, has two thirds of its numbers and codes among the words of a place."""
        if not self.places:
            return True
        found = [x in held for x in self.words]
        if 3 * sum(found) < 2 * self.fewest:
            return False
        gained = np.zeros(self.length + 1, np.int64)
        gained[[x + 1 for x in self.places]] = [1 if x else -2 for x in found]
        gained = np.cumsum(gained)
        return bool((gained[self.half :] >= np.minimum.accumulate(gained[: self.length + 1 - self.half])).any())


def _few_changed(blocks: list, words: int) -> bool:
    """Whether some successive runs hold half of an item with few words changed or left out among them, in one place."""
    for i, first in enumerate(blocks):
        matched = 0
        for last in blocks[i:]:
            matched += last.size
            span = last.a + last.size - first.a
            if matched >= max(HELD * words, min(PHRASE, words)) and matched >= UNCHANGED * span and last.b + last.size - first.b <= span + DRIFT:
                return True
    return False


def _places(document: np.ndarray, item: np.ndarray, shift: np.ndarray, drift: np.ndarray, lengths: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, begin, end) of hits, in order of document, item and shift, merged while their shifts drift no further apart."""
    apart = (document[1:] != document[:-1]) | (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > drift[item[1:]])
    edges = np.concatenate(([0], np.flatnonzero(apart) + 1, [len(document)])) if len(document) else np.zeros(1, np.int64)
    start, stop = edges[:-1], edges[1:]
    document, item = document[start], item[start]
    margin = (drift[item] // 4).astype(np.int64)
    return document, item, np.maximum(0, shift[start] - margin), np.minimum(size[document], shift[stop - 1] + lengths[item] + margin)


def _leaks(shard: list[tuple[int, list[str]]], items: _Items) -> Iterator[tuple[int, int, float, int, int]]:
    symbols = _Symbols(shard)
    document, place, item, at = _occurrences(symbols, items)
    short = items.lengths[item] < PHRASE if len(item) else np.zeros(0, bool)
    order = np.lexsort((place[short], item[short], document[short]))
    seen: set[tuple[int, int]] = set()
    for doc, found, start in zip(document[short][order].tolist(), item[short][order].tolist(), place[short][order].tolist()):
        if (doc, found) not in seen:
            seen.add((doc, found))
            yield shard[doc][0], items.ids[found], 1.0, start, start + len(items.words[found])
    document, place, item, at = document[~short], place[~short], item[~short], at[~short]
    if not len(document):
        return
    shift = place - at
    order = np.lexsort((shift, item, document))
    document, item, shift = document[order], item[order], shift[order]
    size = np.diff(np.concatenate((symbols.begins, [len(symbols.text)]))) - 1
    # by DRIFT alone too: a place too wide may hold like-worded text beside the item
    places = [_places(document, item, shift, np.full(len(items.drift), float(DRIFT)), items.lengths, size)]
    wide = items.drift[item] != DRIFT
    places.append(_places(document[wide], item[wide], shift[wide], items.drift, items.lengths, size))
    document, item, begin, end = (np.concatenate(x) for x in zip(*places))
    offset = symbols.begins[document]
    near = _neighbours(symbols, items, item, offset + begin, offset + end) >= np.maximum(1, NEIGHBOURS * items.lengths[item] - 1)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for doc, found, first, last in zip(*(x[near].tolist() for x in (document, item, begin, end))):
        words, window = items.words[found], shard[doc][1][first:last]
        if not items.facts[found].there({*window}):
            continue
        # words in any order are no fewer than words in order
        there = Counter(window)
        if sum(min(n, there[x]) for x, n in items.counts[found].items() if x in there) < max(HELD * len(words), PHRASE):
            continue
        share = aligned_share(words, window, items.facts[found].places)
        if share >= HELD and round(share * len(words)) >= PHRASE and share > best.get((doc, found), (0.0,))[0]:
            best[doc, found] = share, first, last
    for (doc, found), (share, first, last) in best.items():
        yield shard[doc][0], items.ids[found], share, first, last


def leaked_items(documents: DataFrame, items: DataFrame, classes: LookalikeClasses | None = None) -> DataFrame:
    """(doc_id, item_id, share, start_word, end_word): documents that hold at least half of an item in one place.

    Every document is searched for every item; a pair comes out once, with its best place. Rows without
    id or text, and texts without words, hold nothing and are held by nothing; documents with the same id
    count as one; other columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), "text")
    asked = items.where("item_id is not null and text is not null").select("item_id", "text")
    spread = spark.sparkContext.broadcast(classes or fit(texts.select("text"), asked.select("text")))
    schema = "doc_id long, item_id long, share double, start_word int, end_word int"

    def searched(block: DataFrame):
        """A block's hits, and the broadcast that holds its items."""
        sent = spark.sparkContext.broadcast([tuple(x) for x in block.collect()])

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rewrite = spread.value.rewriter()
            block_items = _Items(sent.value, rewrite)
            for batch in batches:
                for shard in _shards(batch, rewrite):
                    yield pd.DataFrame([*_leaks(shard, block_items)], columns=["doc_id", "item_id", "share", "start_word", "end_word"])

        return texts.mapInPandas(search, schema), sent

    blocks = math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS)
    if blocks <= 1:
        found, _ = searched(asked)
    else:  # block by block, so that neither the driver nor a task holds more than one
        held = Written(spark)
        for block in range(blocks):
            hits, sent = searched(asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block))
            held.add(hits)
            sent.destroy()
        found = held.rows(T._parse_datatype_string(schema))
    best = F.max(F.struct("share", "start_word", "end_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.share", "b.start_word", "b.end_word")
