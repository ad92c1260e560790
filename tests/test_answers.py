import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pageloom.functions import answers
from pageloom.functions.text import normalize_phrase
from pageloom.operators import rates

CASES = [
    # prediction, references, exact, f1, contained
    ("The pump", ["a pump"], True, 1.0, True),
    ("red pump", ["pump"], False, 2 / 3, True),
    ("18 months.", ["2024", "18 months"], True, 1.0, True),
    ("2024", ["2"], False, 0.0, False),
    ("d d b b", ["b b b c"], False, 0.5, False),
    ("", ["the"], True, 1.0, False),
    ("x", ["the"], False, 0.0, False),
    ("x", [], None, None, None),
    (None, ["x"], None, None, None),
]


def test_metrics_of_answers(spark):
    df = spark.createDataFrame([(i, p, r) for i, (p, r, *_) in enumerate(CASES)], "i int, p string, r array<string>")
    p, r = F.col("p"), F.col("r")
    rows = df.select("i", answers.exact_match(p, r).alias("e"), answers.token_f1(p, r).alias("f"), answers.answer_containment(p, r).alias("c")).orderBy("i").collect()
    for row, (_, _, exact, f1, contained) in zip(rows, CASES):
        if f1 is None:
            assert not row.e and not row.c
            continue
        assert row.e is exact and row.c is contained and row.f == pytest.approx(f1)


def test_token_f1_against_counters(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("bcde") for _ in range(rng.randrange(6))), " ".join(rng.choice("bcde") for _ in range(rng.randrange(6)))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, p string, r string")
    got = {x.i: x.f for x in df.select("i", answers.token_f1(F.col("p"), F.array("r")).alias("f")).collect()}
    for i, p, r in rows:
        a, b = Counter(normalize_phrase(p).split()), Counter(normalize_phrase(r).split())
        common = sum((a & b).values())
        want = float(a == b) if not a or not b else 2 * common / (sum(a.values()) + sum(b.values()))
        assert got[i] == pytest.approx(want)


def test_recall_and_support(spark):
    row = spark.range(1).select(
        answers.list_item_recall(F.lit("Contain it and notify the fans."), F.array(F.lit("notify fans"), F.lit("fan"), F.lit("the"), F.lit("contain it"))).alias("r"),
        answers.lexical_support(F.lit("thirty days days x"), F.array(F.lit("Thirty DAYS"), F.lit("other"))).alias("s"),
        answers.lexical_support(F.lit("the"), F.array(F.lit("x"))).alias("none"),
        answers.lexical_support(F.lit("y"), F.array().cast("array<string>")).alias("zero"),
    ).first()
    assert (row.r, row.s, row.none, row.zero) == (0.5, 0.75, None, 0.0)


def test_rates(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False), (True, False), (True, False)], "accepted boolean, answerable boolean")
    a, q = F.col("accepted"), F.col("answerable")
    assert rates.checked(df, rates.false_reject_rate(a, q), "x") == 0.5
    assert rates.checked(df, rates.false_accept_rate(a, q), "x") == pytest.approx(2 / 3)
    assert rates.checked(df, rates.false_refusal_rate(~a, q), "x") == 0.5
    with pytest.raises(ValueError):
        rates.checked(df.where(~q), rates.false_reject_rate(a, q), "answerable questions")


def test_mean_reciprocal_rank(spark):
    assert rates.mean_reciprocal_rank(spark.createDataFrame([(1.0,), (0.5,), (0.0,)], "reciprocal_rank double")) == 0.5
    for bad in ([], [(1.5,)], [(-0.1,)]):
        with pytest.raises(ValueError):
            rates.mean_reciprocal_rank(spark.createDataFrame(bad, "reciprocal_rank double"))


def test_auroc_against_pairs(spark):
    rng = random.Random(2)
    for n in (5, 60):
        rows = [(float(rng.randrange(6)), bool(i % 3)) for i in range(n)] + [(None, True)]
        df = spark.createDataFrame(rows, "s double, y boolean")
        p, q = [s for s, y in rows if y and s is not None], [s for s, y in rows if not y]
        want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
        assert rates.auroc(df, "s", "y") == pytest.approx(want)
    for bad in ([(1.0, True)], [], [(float("nan"), True), (1.0, False)]):
        with pytest.raises(ValueError):
            rates.auroc(spark.createDataFrame(bad, "s double, y boolean"), "s", "y")
