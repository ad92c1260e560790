import json

import pytest

from pageloom.sources import pages, questions, records
from pageloom.streaming import ingest

GOOD = {"id": "q1", "question": "Why?", "answerable": True, "category": "factoid", "answers": ["x"], "evidence": [{"source": "a.pdf", "page": 1, "text": "x"}], "failure_tags": [], "split": "dev"}


def test_text_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Title\none \n  === PAGE BREAK ===  \n\ntwo\n", encoding="utf-8")
    rows = pages.read_text_pages(spark, str(tmp_path / "a.txt")).collect()
    assert [(r.page_number, r.text) for r in rows] == [(1, "Title\none"), (2, "two")]
    (tmp_path / "b.txt").write_text("one\n=== PAGE BREAK ===\n \n", encoding="utf-8")
    with pytest.raises(Exception, match="page 2 is empty"):
        pages.read_text_pages(spark, str(tmp_path / "b.txt")).collect()


@pytest.mark.parametrize(
    "change,message",
    [
        ({}, None),
        ({"list_items": ["a"], "notes": "n"}, None),
        ({"split": None}, None),
        ({"split": ...}, "2: missing fields ['split']"),
        ({"zeta": 1, "alpha": 2}, "2: unknown fields ['alpha', 'zeta']"),
        ({"evidence": "x"}, "2: a field has the wrong type"),
        ({"evidence": [{"source": "a.pdf", "text": "x"}]}, "2: an evidence passage lacks source, page or text"),
        ({"evidence": [{"source": "a.pdf", "page": None, "text": "x", "line": 3}]}, "2: an evidence passage has unknown fields"),
        ({"evidence": []}, None),
        ("{nope", "2: not a valid JSON object"),
        ("[1]", "2: not a valid JSON object"),
    ],
)
def test_strict_questions(spark, tmp_path, change, message):
    line = change if isinstance(change, str) else json.dumps({k: v for k, v in (GOOD | change).items() if v is not ...})
    path = tmp_path / "q.jsonl"
    path.write_text("\n" + line + "\n \n" + json.dumps(GOOD | {"id": "q2"}), encoding="utf-8")
    if message:
        with pytest.raises(ValueError) as error:
            questions.read_questions(spark, str(path))
        assert message in str(error.value)
    else:
        rows = questions.read_questions(spark, str(path)).collect()
        assert [r.id for r in rows] == ["q1", "q2"] and rows[1].list_items == [] and rows[1].notes == "" and (not rows[0].evidence or rows[0].evidence[0].page == 1)


def test_questions_of_several_files_keep_their_order(spark, tmp_path):
    for name, ids in (("b", ["q3", "q1"]), ("a", ["q9", "q2", "q5"])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(GOOD | {"id": x}) for x in ids), encoding="utf-8")
    assert [r.id for r in questions.read_questions(spark, str(tmp_path / "*.jsonl")).collect()] == ["q9", "q2", "q5", "q3", "q1"]


def test_records_keep_nulls_and_folders_are_new(spark, tmp_path):
    df = spark.createDataFrame([("b", None, [None, 2], 1), ("a", 1.5, [], 0)], "id string, score double, ranks array<int>, place int")
    records.write_records(df, str(tmp_path / "r"), "place")
    df = df.drop("place")
    lines = [x for f in sorted((tmp_path / "r").glob("part-*")) for x in f.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"id": "a", "score": 1.5, "ranks": []}, {"id": "b", "score": None, "ranks": [None, 2]}]
    assert records.read_records(spark, str(tmp_path / "r"), df.schema).count() == 2
    with pytest.raises(Exception):
        records.write_records(df, str(tmp_path / "r"))
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert records.file_digests(spark, str(tmp_path / "x.bin")) == {"x.bin": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}


def test_stream_appends_each_page_once(spark, tmp_path):
    schema = "source string, page_number int, text string"
    for part, rows in enumerate([[("a", 1, "One. Two.")], [("a", 2, "Three."), ("b", 1, None)]]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.page_stream(spark, str(tmp_path / "in"), schema)
        ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == (1, 2)[part]
