"""The rules of the dataset, on questions drawn field by field from pools of right and wrong values, against the same rules in SQL."""

import random
import re

import duckdb
import pytest

from pageloom.operators import validation
from pageloom.plans import oracle
from pageloom.sources.questions import QUESTION

PAGES = [
    ("m/oven.pdf", 1, 1, "Oven guide. The oven needs 40 minutes to heat. Close the lower door, then start the fan."),
    ("m/oven.pdf", 2, 2, "Mr. Reed cleans the oven. A spare lamp is in the drawer. The fan is loud."),
    ("m/oven.pdf", 3, 3, None),
    ("n/lamp.pdf", 1, 4, "an older scan"),
    ("n/lamp.pdf", 1, 5, "The fan is loud. " + "It is " + "very " * 55 + "bright here."),
]
HEAT, DOOR, LAMP = ("oven.pdf", 1, "The oven needs 40 minutes to heat."), ("oven.pdf", 1, "Close the lower door, then start the fan."), ("oven.pdf", 2, "A spare lamp is in the drawer.")
PASSAGES = [
    HEAT, DOOR, LAMP, ("oven.pdf", 1, "The  oven needs\n40 minutes to heat."), ("stove.pdf", 1, "x"), (None, 1, "x"), ("oven.pdf", 7, "x"), ("oven.pdf", None, "x"), ("oven.pdf", 3, "x"), ("oven.pdf", 1, "​"), ("oven.pdf", 1, None),
    ("oven.pdf", 2, HEAT[2]), ("oven.pdf", 2, "The fan is loud."), ("oven.pdf", 1, "guide. The oven needs"), ("lamp.pdf", 1, "bright here."), ("lamp.pdf", 1, "an older scan"),
]
#: For each field what it mostly is, and what it sometimes is.
POOLS = {
    "question": (["How long does the oven heat?", "Where is the lamp?"], [" \n", "", None, "WHERE is the lamp? "]),
    "answerable": ([True], [False, None]),
    "category": ([*validation.ANSWERABLE], [*validation.UNANSWERABLE, "riddle", None]),
    "answers": ([["40 minutes"], ["Drawer"]], [[], ["40 minutes", " "], ["yes"], ["no", "yes"], ["90 minutes"], None]),
    "failure_tags": ([[], ["vague"], ["requires_reasoning"]], [["zz", "vague", "aa"], ["vague", "vague"], None]),
    "split": (["dev", "test"], ["train", None]),
    "list_items": ([[], ["oven", "HEAT"]], [["oven"], ["oven", "whale", "it's"], None]),
}


def drawn(n):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        odd = rng.choice([0.0, 0.1, 0.4])
        row = {x: rng.choice(wrong if rng.random() < odd else right) for x, (right, wrong) in POOLS.items()}
        row["evidence"] = None if rng.random() < odd / 4 else [rng.choice(PASSAGES if rng.random() < odd else PASSAGES[:3]) for _ in range(rng.choice([0, 1, 1, 2, 2] if rng.random() < odd else [1, 2]))]
        if row["category"] in validation.UNANSWERABLE and rng.random() < 0.5:
            row |= {"answerable": False, "answers": [], "evidence": [], "list_items": []}
        rows.append(tuple((row | {"id": f"q{i:04}", "notes": ""})[x.split()[0]] for x in ("id", "question", "answerable", "category", "answers", "evidence", "failure_tags", "split", "list_items", "notes")))
    return [*rows, rows[3]]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rules")
    questions = spark.createDataFrame(drawn(700), QUESTION)
    questions.coalesce(1).write.parquet(str(folder / "q"))
    spark.createDataFrame(PAGES, "source string, page_number int, page_id long, text string").coalesce(1).write.parquet(str(folder / "g"))
    pages = spark.createDataFrame([(s.split("/")[1], n, t or "") for s, n, i, t in PAGES if i != 4], "file string, page int, text string")
    base = duckdb.connect()
    for name, part in (("questions", "q"), ("page_data", "g")):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{part}/*.parquet'")
    got = [tuple(r) for r in validation.dataset_problems(questions.dropDuplicates(), pages).select("part", "id", "ordinal", "message").collect()]
    want = base.sql(f"SELECT part, id, ordinal, message FROM ({oracle.statements()['dataset_problems'].replace('FROM questions', 'FROM (SELECT DISTINCT * FROM questions)')})").fetchall()
    return got, want


def test_drawn_questions_have_the_same_problems_in_sql(both):
    got, want = both
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 500


def test_every_rule_is_met_and_some_questions_are_right(both):
    messages = [m for _, _, _, m in both[0]]
    kinds = {re.sub(r"'.*|\[.*|\d+.*", "", m.partition(": ")[2]).strip() for m in messages}
    assert len(kinds) >= 22, sorted(kinds)
    assert {f"q{i:04}" for i in range(700)} - {i for _, i, _, _ in both[0]}


def test_order_and_duplicates_of_a_dataset(spark):
    row = ("q1", "Where is the lamp?", True, "factoid", ["drawer"], [LAMP], ["vague"], "dev", [], "")
    questions = spark.createDataFrame([row, row, ("q2", " where IS the lamp? ", *row[2:])], QUESTION)
    pages = spark.createDataFrame([(s.split("/")[1], n, t or "") for s, n, i, t in PAGES if i != 4], "file string, page int, text string")
    messages = [r.message for r in validation.dataset_problems(questions, pages).orderBy("part", "id", "ordinal").collect()]
    assert messages == ["q1: duplicate id", "duplicate question 'where is the lamp?'"]
    counts = validation.dataset_counts(questions)
    assert tuple(counts["totals"].first()) == (3, 3, 0) and counts["by_tag"].first().n == 3
    assert validation.dataset_problems(questions.limit(0), pages).count() == 0


def test_selection(spark):
    row = ("q1", "Where is the lamp?", True, "factoid", ["drawer"], [LAMP], ["vague"], "dev", [], "")
    questions = spark.createDataFrame([row, ("q2", *row[1:7], "test", [], "")], QUESTION)
    assert [r.id for r in validation.select_questions(questions, "test").collect()] == ["q2"]
    assert validation.select_questions(questions, ids=["q2", "q1"]).count() == 2
    for split, ids in (("odd", None), ("all", ["q9"]), ("dev", ["q2"])):
        with pytest.raises(ValueError):
            validation.select_questions(questions, split, ids)
