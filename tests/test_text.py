import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.functions import text
from pageloom.operators import chunking

CLEAN = [
    ("ﬁrst infor-\nmation", "first information"),
    ("soft­\n hyphen co­-op", "softhyphen co-op"),
    ("A-\nBig x-\n1", "A- Big x- 1"),
    ("zero​width\x07 bell\x1cgone", "zerowidth bellgone"),
    (" a\t b \n\n　c ", "a b c"),
    ("", ""),
    (None, None),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CLEAN)], "i int, t string")
    got = [r.c for r in df.select("i", text.clean_text(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [b for _, b in CLEAN]
    assert all(chunking.cleaned(a) == b for a, b in CLEAN if a is not None)


def test_paths_ids_and_refusals(spark):
    df = spark.createDataFrame([("/a/b.pdf", 3, 0), ("b.pdf", 1, 2)], "s string, p int, c int")
    assert [r[0] for r in df.select(text.chunk_id(F.col("s"), F.col("p"), F.col("c"))).collect()] == ["b.pdf:p3:c0", "b.pdf:p1:c2"]
    cases = [(None, True, None), ("", True, True), (" The. ", True, False), ("Not available!", True, True), ("not available in Berlin", False, False), ("No answer", True, False), ("unanswerable", True, True), ("2024", False, False)]
    rows = spark.createDataFrame([(x,) for x, *_ in cases], "t string").select(text.is_refusal(F.col("t")), text.says_not_available(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(a, b) for _, a, b in cases]


@pytest.mark.parametrize("raw,plain", [("The  U.S. an apple", "us apple"), ("79,500", "79500"), ("SHA-256 a", "sha256"), ("Ana the theatre", "ana theatre"), ("!?", ""), ("Éa the é", "éa é")])
def test_normalize_answer(spark, raw, plain):
    assert spark.range(1).select(text.normalize_answer(F.lit(raw))).first()[0] == plain == text.normalize_phrase(raw)


def test_prompt_and_counts(spark):
    row = spark.range(1).select(text.build_prompt(F.lit(" Why? "), F.array(F.lit(" a %s"), F.lit("b"))).alias("p"), text.count_occurrences(F.lit("aaaa"), F.lit("aa")).alias("n"), text.count_occurrences(F.lit("a"), F.lit("")).alias("z")).first()
    assert row.p.endswith("Context:\n[1] a %s\n\n[2] b\n\nQuestion: Why?\nAnswer:") and row.n == 2 and row.z is None


SENTENCES = [
    ("One. Two! Three? Four", ["One.", "Two!", "Three?", "Four"]),
    ("Dr. Low came. He left.", ["Dr. Low came.", "He left."]),
    ("J. Low wrote 2. Scope here.", ["J. Low wrote 2. Scope here."]),
    ('He said "Go." Then left.', ['He said "Go."', "Then left."]),
    ("See e.g. Fig. 3. É fine.", ["See e.g. Fig. 3. É fine."]),
    ("it ends. but not here.", ["it ends. but not here."]),
    ("", []),
]


@pytest.mark.parametrize("line,want", SENTENCES)
def test_sentences_by_both_forms(spark, line, want):
    assert chunking.sentences_of(line) == want
    df = spark.createDataFrame([(1, line)], "id int, t string")
    folded = [r.sentence for r in chunking.split_sentences_sql(df, ["id"], "t").orderBy("sentence_index").collect()]
    assert folded == want


def naive_chunks(line, size, overlap):
    import textwrap

    units = []
    for s in chunking.sentences_of(line):
        units += [s] if len(s) <= size else textwrap.wrap(s, size, break_on_hyphens=False)
    out, run = [], []
    for unit in units:
        if run and len(" ".join(run + [unit])) > size:
            out.append(" ".join(run))
            keep = [i for i in range(len(run) + 1) if len(" ".join(run[i:])) <= overlap and len(" ".join(run[i:] + [unit])) <= size]
            run = run[keep[0] :] if keep else []
        run.append(unit)
    return out + [" ".join(run)] if run else out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=25), st.sampled_from([(20, 0), (40, 15), (60, 50), (25, 24)]))
def test_chunks_equal_a_naive_fold(lengths, sizes):
    line = " ".join("W" * n + "." for n in lengths)
    chunks = chunking.chunks_of(line, *sizes)
    assert chunks == naive_chunks(line, *sizes)
    assert all(len(x) <= sizes[0] for x in chunks)


def test_page_chunks_nulls_repeats_and_checks(spark):
    df = spark.createDataFrame([("d/a.pdf", 1, "One. " * 300, 9), ("d/a.pdf", 1, "One. " * 300, 9), ("d/a.pdf", 2, None, 9), ("d/b.pdf", 1, " \n", 9)], "source string, page_number int, text string, chunk_index int")
    rows = chunking.page_chunks(df).collect()
    assert {r.chunk_id for r in rows} == {"a.pdf:p1:c0", "a.pdf:p1:c1"} and len(rows) == 4
    assert chunking.page_chunks(df.limit(0)).count() == 0
    for bad in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.page_chunks(df.limit(0), *bad)
