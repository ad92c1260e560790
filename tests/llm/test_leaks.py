import random

import numpy as np

from pageloom.llm import leaks
from pageloom.llm.leaks import FMIndex, leaked_items, suffix_array

WORDS = "pump valve meter clerk door night report signal counts checks stores every remote fixed annual spare under above near green steady light".split()


def test_index_finds_and_locates_all_occurrences():
    rng = np.random.default_rng(1)
    for n, letters in ((1, 3), (7, 2), (900, 5), (2000, 60)):
        text = rng.integers(1, letters + 1, n)
        suffixes = sorted(range(n), key=lambda i: [*text[i:]])
        assert suffix_array(text).tolist() == suffixes
        index = FMIndex(text)
        phrases = rng.integers(1, letters + 1, (30, min(3, n)))
        for phrase, low, high in zip(phrases, *index.search(phrases)):
            want = [i for i in range(n - len(phrase) + 1) if (text[i : i + len(phrase)] == phrase).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(9)) + f" {rng.choice('ABC')}{rng.randrange(10**5):05}."


def test_copies_parts_and_changes_are_found_and_likenesses_are_not(spark):
    rng = random.Random(4)
    items = [(i, " ".join(sentence(rng) for _ in range(5))) for i in range(30)] + [(98, None), (99, "?!"), (100, "two words")]
    docs, want = [], set()
    for doc in range(120):
        around = [sentence(rng) for _ in range(4)]
        item = rng.randrange(30)
        words = items[item][1].split()
        kind = doc % 6
        if kind == 0:
            part = items[item][1].upper().replace(",", "")
        elif kind == 1:
            part = " ".join(words[: len(words) * 7 // 10])
        elif kind == 2:
            part = " ".join(w if rng.random() > 0.06 else "other" for w in words)
        elif kind == 3:
            part = "\n".join([" ".join(words[:20]), "", "A manual, page 8", "", " ".join(words[20:])])
        elif kind == 4:
            part = " ".join(words[:12])
        else:
            part = " ".join(w if w[0] not in "ABC" else f"B{rng.randrange(10**5):05}." for w in words)
        if kind < 4:
            want.add((doc, item))
        docs.append((doc, " ".join(around[:2]) + "\n\n" + part + "\n\n" + " ".join(around[2:]), 0.0))
    docs += [(500, None, 0.0), (501, "", 0.0), (None, items[0][1], 0.0), (502, "here are two words", 0.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, share double")
    held = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaked_items(df, held).collect()}
    assert found == want | {(502, 100)}


def test_short_items_and_changed_words_lose_nothing(spark):
    rng = random.Random(9)
    fresh = lambda n: ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]
    items, docs, want = [], [], set()
    for size, held, changes in ((14, 8, (3,)), (14, 9, (3, 6)), (14, 14, (4, 9)), (14, 14, (3, 7, 11)), (20, 12, (4, 8)), (40, 24, (4, 9, 14, 19)), (40, 25, (4, 8, 12, 16, 20)), (14, 6, ()), (40, 18, ())):
        words = fresh(size)
        part = [fresh(1)[0] if i in changes else x for i, x in enumerate(words[:held])]
        items.append((len(items), " ".join(words)))
        docs.append((len(docs), " ".join(fresh(30) + part + fresh(30))))
        want |= {(docs[-1][0], items[-1][0])} if held - len(changes) >= size / 2 else set()
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaked_items(df, asked).collect()} == want and len(want) == 7


def test_like_words_scattered_over_a_text_are_no_leak():
    item = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(44)]
    scattered = [x for at in range(0, 44, 8) for x in item[at : at + 4] + ["other"] * 4]
    assert leaks.aligned_share(item, scattered) == 0
    assert leaks.aligned_share(item, ["other"] * 9 + item[:24]) == 24 / 44


def test_drift_is_counted_by_script():
    assert leaks._drift(["pump", "valve"]) == leaks.DRIFT and leaks._drift([*"传感器"]) == 2 * leaks.DRIFT and leaks._drift([*"ผู้ดูแล"]) == 4 * leaks.DRIFT


def test_item_blocks_and_small_shards_lose_nothing(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(sentence(rng) for _ in range(4))) for i in range(12)]
    docs = [(i, sentence(rng) + " " + items[i % 12][1]) for i in range(36)]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    assert {(r.doc_id, r.item_id) for r in leaked_items(df, held).collect()} == {(i, i % 12) for i in range(36)}


def test_shards_with_repeated_passages_are_sorted_whole():
    rng = np.random.default_rng(3)
    run = rng.integers(1, 4, 300)
    text = np.concatenate((run, [7], run, [7], run[:150], np.ones(90, np.int64)))
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: [*text[i:]])


def test_half_with_the_facts_of_another_half_is_looked_at():
    item = ["w" + chr(97 + i % 26) * (1 + i // 26) if i % 5 else f"{i}9" for i in range(40)]
    facts = leaks._Facts(item)
    assert facts.there({*item[:20]}) and facts.there({*item[20:]})
    assert not facts.there({x for x in item if x.startswith("w")})
    assert leaks._Facts(["a"] * 9).there(set())


def test_items_of_less_than_a_phrase_are_found_whole(spark):
    df = spark.createDataFrame([(1, "one Two, three"), (2, "one three"), (3, "x two three one two three")], "doc_id long, text string")
    held = spark.createDataFrame([(1, "two three"), (2, "one")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in leaked_items(df, held).collect()) == [(1, 1, 1, 3), (1, 2, 0, 1), (2, 2, 0, 1), (3, 1, 1, 3), (3, 2, 3, 4)]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    held = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaked_items(none, held).count() == 0
    assert leaked_items(none.union(spark.createDataFrame([(1, "x")], "doc_id long, text string")), held.limit(0)).count() == 0
