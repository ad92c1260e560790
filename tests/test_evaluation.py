from pyspark.sql import functions as F

from pageloom.operators import evaluation, readers, retrieval
from pageloom.operators.embedders import keyword_embedder
from pageloom.sources import records
from pageloom.sources.questions import QUESTION

# routed, supported, answerable, read, failed, refused, correct -> outcome, right
ENDS = [
    (False, False, True, True, False, False, True, "error", None),
    (True, False, True, True, False, False, True, "refused_by_router", False),
    (True, False, False, False, False, False, None, "refused_by_router", True),
    (True, True, True, False, False, False, None, "error", None),
    (True, True, True, True, True, False, None, "error", None),
    (True, True, True, True, False, True, False, "refused_by_reader", False),
    (True, True, False, True, False, True, None, "refused_by_reader", True),
    (True, True, True, True, False, False, True, "answered", True),
    (True, True, True, True, False, False, None, "answered", False),
    (True, True, False, True, False, False, None, "answered", False),
]
# outcome, correct, answerable, all retrieved, supported, all used, gold there, gold correct -> label
LABELS = [
    ("error", None, True, True, True, True, True, True, "error"),
    ("refused_by_router", True, False, True, False, True, False, None, "refused_by_router"),
    ("refused_by_reader", True, False, True, True, True, False, None, "refused_by_reader"),
    ("answered", False, False, True, True, True, False, None, "false_accept"),
    ("answered", True, True, False, True, False, False, None, "correct"),
    ("answered", False, True, False, True, False, True, True, "retrieval_miss"),
    ("refused_by_router", False, True, True, False, False, True, True, "router_reject"),
    ("answered", False, True, True, True, False, True, True, "context_dropped"),
    ("answered", False, True, True, True, True, False, None, "error"),
    ("answered", False, True, True, True, True, True, True, "reader_distracted"),
    ("answered", False, True, True, True, True, True, False, "reader_error"),
]


def test_end_to_end_table(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ENDS)], "i int, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean, outcome string, wanted boolean")
    out = df.select("outcome", "wanted", evaluation.end_to_end(*(F.col(x) for x in "abcdefg")).alias("o")).collect()
    assert all(r.o.outcome == r.outcome and r.o.correct == r.wanted for r in out)


def test_diagnosis_table(spark):
    df = spark.createDataFrame(LABELS, "o string, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean, label string")
    assert all(r.label == r.got for r in df.select("label", evaluation.diagnosis(*(F.col(x) for x in "oabcdefg")).alias("got")).collect())


def test_retrieval_metrics(spark):
    passages = spark.createDataFrame([("q", 0), ("q", 1), ("r", 0)], "id string, passage_index int")
    hits = spark.createDataFrame([("q", 0, 4), ("q", 0, 2), ("q", 1, 5)], "id string, passage_index int, rank int")
    out = {r.id: r for r in retrieval.retrieval_metrics(retrieval.passage_ranks(passages, hits)).collect()}
    assert out["q"].passage_ranks == [2, 5] and out["r"].passage_ranks == [None]
    assert (out["q"].hit_any_at_1, out["q"].hit_any_at_3, out["q"].hit_all_at_3, out["q"].hit_all_at_5, out["q"].reciprocal_rank) == (False, True, False, True, 0.5)
    assert out["r"].reciprocal_rank == 0.0 and not out["r"].hit_any_at_5


def test_occurrences_do_not_overlap_and_blocks_lose_nothing(spark, monkeypatch):
    texts = spark.createDataFrame([("aaaa b",), ("aa",), (None,)], "t string")
    passages = spark.createDataFrame([("aa",), ("b",), ("a b",), ("z",), ("",), (None,), ("aa",)], "passage string")
    for size in (4_000_000, 2):
        monkeypatch.setattr(retrieval, "BLOCK_CHARS", size)
        assert {(r.passage, r.occurrences) for r in retrieval.corpus_occurrences(passages, texts).collect()} == {("aa", 3), ("b", 1), ("a b", 1), ("z", 0)}


PAGES = [("c/m.pdf", 1, "Pump manual. The pump runs for 18 months."), ("c/m.pdf", 2, "Key manual. The key is in the safe."), ("c/n.pdf", 1, "Door manual. The door is red and blue.")]


def scripted():
    replies = {"pump": "18 months", "key": "the cellar", "door": "red and blue", "cat": "18 months", "none": "", "broken": ValueError}

    def reply(prompts):
        found = [replies[x.rpartition("Question: ")[2].split()[0]] for x in prompts]
        if ValueError in found:
            raise ValueError("no")
        return found

    return reply


def question(i, text, answers, evidence, category="factoid", items=()):
    return (i, text, bool(answers), category if answers else "unanswerable_off_topic", answers, evidence, [], "dev", list(items), "")


def test_whole_run(spark, tmp_path):
    rows = [
        question("q1", "pump how long", ["18 months"], [("m.pdf", 1, "The pump runs for 18 months.")]),
        question("q2", "key where is the key", ["safe"], [("m.pdf", 2, "The key is in the safe.")]),
        question("q3", "door which colours", ["red and blue"], [("n.pdf", 1, "The door is red and blue.")], "list", ["red", "blue"]),
        question("q4", "cat what", [], []),
        question("q5", "cat and pump", [], []),
        question("q6", "none about the pump", ["18 months"], [("m.pdf", 1, "The pump runs for 18 months.")]),
        question("q7", "broken pump", ["18 months"], [("m.pdf", 1, "The pump runs for 18 months.")]),
        question("q8", " ", ["18 months"], [("m.pdf", 1, "The pump runs for 18 months.")]),
        question("q9", "key about the pump", ["safe"], [("m.pdf", 2, "no such text")]),
    ]
    questions = spark.createDataFrame(rows, QUESTION)
    pages = spark.createDataFrame(PAGES, "source string, page_number int, text string")
    out = evaluation.run_evaluation(questions, pages, keyword_embedder(["pump", "key", "door"]), {"scripted": (readers.generative_reader(scripted), True)})
    got = {r.id: r for r in out.collect()}
    labels = {i: r.diagnosis["scripted"] for i, r in got.items()}
    assert labels == {
        "q1": "correct", "q2": "reader_error", "q3": "correct", "q4": "refused_by_router", "q5": "false_accept",
        "q6": "reader_error", "q7": "error", "q8": "error", "q9": "retrieval_miss",
    }
    assert got["q1"].retrieval.passage_ranks == [1] and got["q1"].routing.status == "supported" and got["q4"].retrieval.passage_ranks == []
    assert {r["mode"] for r in got["q1"].readers} == {"gold_context", "retrieved_context"} and len(got["q4"].readers) == 1
    assert any("no retrieved context" in x for x in got["q8"].errors) and got["q8"].routing is None
    assert any("no chunk contains" in x for x in got["q9"].errors)
    assert got["q6"].end_to_end[0].outcome == "refused_by_reader" and got["q3"].readers[0].list_item_recall == 1.0
    chunks = evaluation.index_chunks(pages)
    run = records.save_run(out, chunks, str(tmp_path / "run"), {"k": 1})
    assert run["chunks"] == 3 and run["questions_with_errors"] == 3
    back = records.read_records(spark, str(tmp_path / "run" / "records.jsonl"), out.schema)
    assert {r.id: r.diagnosis["scripted"] for r in back.collect()} == labels
    assert evaluation.summarize(out).agg(F.sum("questions")).first()[0] == 9
