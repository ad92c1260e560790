import random

import pytest

from pageloom.llm import splits
from pageloom.llm.splits import deal_splits, forest_citations, mixed_questions, page_citations, question_groups, spanning_forest

QUESTION = "id string, split string, evidence array<struct<source:string,page:int,text:string>>, root long"
TARGETS = [("train", 0.8), ("dev", 0.1), ("test", 0.1)]


def components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(("m", a))] = find(("k", b))
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "empty"])
def test_forest_spans_the_components(spark, kind):
    rng = random.Random(3)
    links = {
        "random": [(f"q{rng.randrange(90)}", f"p{rng.randrange(80)}") for _ in range(110)],
        "chain": [(f"q{i}", f"p{i + d}") for i in range(60) for d in (0, 1)],
        "star": [(f"q{i}", "p0") for i in range(200)] + [("z", "p9")],
        "empty": [],
    }[kind]
    df = spark.createDataFrame(links, "id string, page string")
    nodes, forest = spanning_forest(df, "id", "page")
    got = {}
    for r in nodes.collect():
        got.setdefault(r.root, set()).add((r.tag, r.name))
    assert {frozenset(g) for g in got.values()} == components(links)
    assert forest.count() == nodes.count() - len(got)


def questions(spark, rows):
    return spark.createDataFrame([(i, s, e, 1) for i, s, e in rows], QUESTION)


def test_citations_and_mixed_groups(spark):
    rows = [
        ("a", "train", [("x/Doc_1.pdf", 3, "t")]),
        ("b", "dev", [(" y\\dос_1.pdf ", 3, None), (None, 3, "t")]),
        ("g", None, [("КЕY.pdf", 7, "t")]),
        ("h", None, [("key.pdf", 7, "t")]),
        ("c", None, [("doc_1.pdf", 3, "t"), ("other.pdf", None, "t")]),
        ("d", "test", [("doc_1.pdf", 4, "t")]),
        ("e", "train", None),
        ("f", "dev", []),
        (None, "dev", [("doc_1.pdf", 4, "t")]),
    ]
    df = questions(spark, rows)
    assert {(r.id, r.page.split("#")[1]) for r in page_citations(df).collect()} == {("a", "3"), ("b", "3"), ("c", "3"), ("d", "4"), ("g", "7"), ("h", "7")}
    assert sorted(r.id for r in mixed_questions(df).collect()) == ["a", "b", "c"]
    assert len({r.group for r in question_groups(df).collect()}) == 5
    assert mixed_questions(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [200_000, 0])
def test_forest_by_name_holds_the_groups_together(spark, monkeypatch, sent):
    monkeypatch.setattr(splits, "SENT", sent)
    rng = random.Random(1)
    rows = [(f"q{i}", None, [(f"f{rng.randrange(12)}.pdf", rng.randrange(6), "t") for _ in range(rng.randrange(3))]) for i in range(80)]
    df = questions(spark, rows)
    edges = forest_citations(df).collect()
    links = [(i, f"{s}#{p}") for i, _, e in rows for s, p, _ in e]
    assert components([(r.id, r.page) for r in edges]) == components(links) and {(r.id, r.page) for r in edges} <= set(links)
    assert len(edges) == sum(len(x) - 1 for x in components(links)) and len({r.group for r in edges}) == len(components(links))
    assert forest_citations(df.limit(0)).count() == 0


def test_dealing_keeps_groups_and_meets_shares(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for size in [700, 90, 40] + [rng.choice([1, 1, 1, 1, 2, 3, 5]) for _ in range(700)]:
        rows += [(f"q{n + i}", n) for i in range(size)]
        n += size
    grouped = spark.createDataFrame(rows, "id string, group long")
    dealt = deal_splits(grouped, spark.createDataFrame(TARGETS, "split string, share double")).toPandas()
    assert len(dealt) == len(rows) and dealt.groupby("group").split.nunique().max() == 1
    shares = dealt.split.value_counts(normalize=True)
    assert all(abs(shares[name] - share) < 0.01 for name, share in TARGETS)


def test_dealing_of_nothing_and_bad_targets(spark):
    none = spark.createDataFrame([], "id string, group long")
    assert deal_splits(none, spark.createDataFrame(TARGETS, "split string, share double")).count() == 0
    with pytest.raises(ValueError):
        deal_splits(none, spark.createDataFrame([("train", None)], "split string, share double"))
