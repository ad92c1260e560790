import random

import pytest

from pageloom.llm.folding import digits_of, distance, fold, letters_of, words_of
from pageloom.llm.lookalike import fit
from pageloom.llm.overlap import cross_split_pairs, merged_length, nearly_same, normalised, overlap_report, question_texts, reach, segments, widest_change

QUESTION = "id string, question string, split string, evidence array<struct<source:string,page:int,text:string>>, hash string, form string"
BASE = "When should the spare beacon in Vashsan send its temporary badges to unit KYN-60305?"


@pytest.mark.parametrize(
    "other,same",
    [
        (BASE.lower(), True),
        (BASE.replace("beacon", "baecon"), True),
        (BASE.replace("send", "really send"), True),
        (BASE.replace("spare ", ""), True),
        (BASE.replace("spare", "local").replace("send", "bring"), True),
        (BASE.rstrip("?").replace(" ", "  "), True),
        (BASE.replace("60305", "60306"), False),
        (BASE.replace("KYN", "KYM"), False),
        (BASE.replace("Vashsan", "Peltal"), False),
        (BASE.replace("spare", "local").replace("send", "bring").replace("badges", "forms"), False),
        ("Where is unit KYN-60305?", False),
    ],
)
def test_nearly_same(other, same):
    assert nearly_same(BASE, other) is same and nearly_same(other, BASE) is same


@pytest.mark.parametrize("text", ["Новый счётчик к 5 КВ", "Ο μετρητής Μέτρο Κλειδί", "Straße Über", "İstanbul café"])
def test_folding_sets_case_aside_in_every_script(text):
    assert letters_of("5 μm") != letters_of("5 mm")
    assert letters_of(text.upper()) == letters_of(text.lower()) == letters_of(text)


def test_helpers():
    assert merged_length([(0, 4), (2, 6), (9, 10)]) == 7
    parts = segments(letters_of(BASE), *reach(fold(BASE)))
    assert "".join(x for _, x in parts) == letters_of(BASE) and 8 < len(parts) < 40 and segments("ab", *reach("ab")) == []
    assert widest_change(*reach("the pump runs")) == 3 + 8 and widest_change(*reach("水泵")) == 3 + 8
    assert digits_of("a１b२c3") == "123" and letters_of("Ça-va 5") == "cava5" and words_of("certifi-\ncates NK-5") == ["certificates", "nk5"]
    assert distance("abcd", "acbd", 2) == 1 and distance("abc", "xyz", 2) == 3


def changed(rng, text):
    """A near copy: up to three letters and two words changed, added or dropped, in texts of few or many words."""
    words = text.split()
    for _ in range(rng.randrange(3)):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [rng.choice(["north", "a", "extraordinary", ""])]
    out = [*" ".join(words)]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = [rng.choice("aeiou ")]
    return "".join(out)


def test_no_near_copy_is_missed_however_short():
    from pageloom.llm.overlap import _Automaton

    rng = random.Random(7)
    words = "pump valve meter clerk door night report signal counts checks stores every remote fixed annual spare of in the a".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 4, 5, 9, 14]))) for _ in range(300)]
    automaton = _Automaton([letters_of(x) for x in texts], [reach(fold(x)) for x in texts])
    pairs = 0
    for row, text in enumerate(texts):
        for _ in range(6):
            copy = changed(rng, text)
            if letters_of(copy) and nearly_same(text, copy):
                pairs += 1
                assert row in dict(automaton.candidates(letters_of(copy), reach(fold(copy)))), (text, copy)
    assert pairs > 900 and 0 < len(automaton.short) < len(texts)


def rows():
    rng = random.Random(2)
    words = "pump valve meter clerk door night report signal counts checks stores every remote fixed annual spare".split()
    out = []
    for i in range(160):
        if i % 4 and out and rng.random() < 0.5:
            text = rng.choice(out)[1]
            if text and rng.random() < 0.7:
                parts = text.split()
                at = rng.randrange(len(parts))
                if not any(c.isdigit() for c in parts[at]):
                    parts[at] = rng.choice([parts[at][::-1], "really " + parts[at], parts[at][1:] + "x"])
                text = " ".join(parts)
        else:
            text = " ".join(rng.choice(words) for _ in range(9)) + f" {rng.randrange(5)}"
        split = rng.choice(["train", "train", "dev", "test", None])
        out.append((f"q{i:03}", text, split, [("f.pdf", 1, rng.choice([text, None, "", "The door is shut. " + text]))]))
    return out + [("n", None, "train", None), (None, BASE, "dev", None), ("s", "?!", "train", None), ("t", "?!", "dev", None), ("q001", out[1][1], out[1][2], out[1][3])]


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "h", "f") for r in rows()], QUESTION)
    texts = question_texts(df)
    formed = normalised(texts, fit(texts.select("text"))).collect()
    want = set()
    for a in (x for x in formed if x.split == "train"):
        for b in (x for x in formed if x.split in ("dev", "test")):
            if a.kind == b.kind and nearly_same(b.form, a.form):
                want.add((min(a.id, b.id), max(a.id, b.id), b.split, a.kind))
    found = {(r.id_a, r.id_b, r.split, r.kind) for r in cross_split_pairs(df).collect()}
    assert len(want) > 20 and found == want
    report = overlap_report(df).collect()
    assert {r.split for r in report} == {"dev", "test"} and all(0 <= r.overlapping <= r.questions for r in report)


def test_blocks_and_slices_lose_nothing(spark, monkeypatch):
    from pageloom.llm import overlap

    df = spark.createDataFrame([(*r, "h", "f") for r in rows()], QUESTION)
    whole = {(r.id_a, r.id_b) for r in cross_split_pairs(df).collect()}
    monkeypatch.setattr(overlap, "BLOCK", 400)
    monkeypatch.setattr(overlap, "SLICE", 400)
    assert {(r.id_a, r.id_b) for r in cross_split_pairs(df).collect()} == whole


def test_empty(spark):
    df = spark.createDataFrame([], QUESTION)
    assert cross_split_pairs(df).count() == 0 and overlap_report(df).count() == 0
