import random
import unicodedata

import pytest

import pyarrow as pa

from pageloom.llm import quality
from pageloom.llm.quality import STATISTICS, classify, common_words, statistics_table, text_statistics

NOUNS = "pump valve meter clerk door report signal tank key log".split()


def corpus():
    rng = random.Random(8)
    say = lambda: f"The {rng.choice(NOUNS)} stays near the {rng.choice(NOUNS)} until the {rng.choice(NOUNS)} is ready."
    item = lambda: f"- {rng.choice(NOUNS)} and {rng.choice(NOUNS)}"
    row = lambda: f"| {rng.choice(NOUNS)} | {rng.randrange(999)} | {rng.randrange(999)} |"
    noise = lambda: "".join(rng.choice("zqxjkvwbp") for _ in range(rng.randrange(3, 9)))
    out = []
    for i in range(300):
        kind = ("prose", "prose", "prose", "list", "table", "junk")[i % 6]
        if kind == "prose":
            text = " ".join(say() for _ in range(6)) + ("\n" + "\n".join(item() for _ in range(3)) if i % 5 == 0 else "")
        elif kind == "list":
            text = say() + "\n" + "\n".join(item() for _ in range(25))
        elif kind == "table":
            text = "\n".join(row() for _ in range(15))
        else:
            text = ". ".join(" ".join(noise() for _ in range(8)) for _ in range(6))
        out.append((i, text, kind))
    return out


def test_mixture_tells_prose_from_the_rest(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, " \n", "x"), (None, "The pump stays near the door until the key is ready.", "x")], "doc_id long, text string, kind string")
    out = {r.doc_id: r for r in classify(df).collect()}
    assert all((out[i].kind == "prose") == (kind == "prose") for i, _, kind in rows)
    assert all(out[i].kind is None and out[i].n_words == 0 for i in (900, 901, 902)) and out[None].kind == "prose"


def test_statistics_of_one_text():
    texts = pa.array(["Ab cd. Ef\n- x y\n- z w\n• q r", None, " \u200b\n", "", "泵停止。ＡＢ 5%"])
    table = statistics_table(texts, pa.array(["ab"]))
    one = table.iloc[0]
    assert (one.n_words, one.n_lines, one.n_printed) == (9, 4, 16) and one.marked_share == pytest.approx(15 / 24)
    assert one.common_share == pytest.approx(1 / 9) and one.line_end_share == 0 and one.cell_share == 0
    assert one.letter_share == pytest.approx(12 / 16) and one.mean_word_length == pytest.approx(12 / 9) and one.variety == pytest.approx(11 / 12)
    assert (table.iloc[1:4].to_numpy() == 0).all() and list(table.columns) == STATISTICS
    last = table.iloc[4]
    assert last.n_words == 4 and last.common_share == pytest.approx(1 / 4) and last.digit_ratio == pytest.approx(1 / 8)


def test_rows_and_lines():
    rows = ["| a | b |\n| c | d |", "k=1 v=2\nk=3 v=4", "a;b;c;d;e", "2001-02-03T04:05 started", "- a, b\nplain line.", "x" * 50 + " y"]
    table = statistics_table(pa.array(rows), pa.array([], pa.string()))
    assert table.cell_share.tolist() == [1, 1, 1, 1, 0, 0] and table.ended_share[4] == pytest.approx(11 / 17) and table.long_share[5] == pytest.approx(50 / 51)


def test_portions_change_nothing(monkeypatch):
    texts = pa.array([t for _, t, _ in corpus()[:40]] + [None, "", "x" * 400])
    whole = statistics_table(texts, pa.array(["the", "stays"]))
    monkeypatch.setattr(quality, "AT_ONCE", 300)
    parts = [*quality._portions(texts)]
    assert len(parts) > 5 and sum(map(len, parts)) == len(texts)
    import pandas as pd

    pd.testing.assert_frame_equal(pd.concat([statistics_table(x, pa.array(["the", "stays"])) for x in parts], ignore_index=True), whole)


def test_columns_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "One two.", 7), (1, "One two.", 7), (2, "one", 7)], "doc_id long, text string, n_words int")
    assert [r.n_words for r in text_statistics(df).collect()] == [2, 2, 1]
    assert [r.word for r in common_words(df, 1).collect()] == ["one"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert classify(empty).count() == 0
    assert [r.kind for r in classify(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [None]


def test_common_words_are_a_share_of_their_script_or_language_at_every_size(spark):
    many = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(4500))
    rows = [(many, "en")] * 6 + [("η αντλία", None)] * 4 + [("der wagen", "de")] * 3
    small = {r.word for r in common_words(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert {*many.split(), "η", unicodedata.normalize("NFKD", "αντλία"), "der", "wagen"} == small  # no rank over all scripts cuts the less frequent ones
    rows = [("the pump", "en")] * 1990 + [("the qzx", "und")] * 3 + [("le quai", "fr")] * 7
    large = {r.word for r in common_words(spark.createDataFrame(rows, "text string, lang string")).collect()}
    assert large == {"the", "pump", "le", "quai"}  # three documents in two thousand are too few
