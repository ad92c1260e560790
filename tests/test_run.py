import json

from pageloom.plans.run import main, report_main
from pageloom.sources import records

PAGES = "Pump manual. The pump runs for 18 months.\n=== PAGE BREAK ===\nKey manual. The key is in the safe."
QUESTION = {"id": "q1", "question": "How long does the pump run?", "answerable": True, "category": "factoid", "answers": ["18 months"], "evidence": [{"source": "m.pdf", "page": 1, "text": "The pump runs for 18 months."}], "failure_tags": [], "split": "dev"}


def test_command_line(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "m.txt").write_text(PAGES, encoding="utf-8")
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(json.dumps(QUESTION), encoding="utf-8")
    bad.write_text(json.dumps(QUESTION | {"answers": ["19 years"]}), encoding="utf-8")
    corpus, out = str(tmp_path / "corpus" / "*.txt"), str(tmp_path / "run")
    end = ["--rename", ".txt", ".pdf"]
    assert main([str(good), corpus, "--output-dir", out, *end]) == 0
    run = json.loads((tmp_path / "run" / "run.json").read_text())
    assert run["chunks"] == 2 and set(run["files"]) == {"good.jsonl", "m.txt"} and run["questions_with_errors"] == 0
    assert run["settings"]["k"] == 5 and run["settings"]["embedder"] == "hashing" and run["settings"]["packages"]["pyspark"] and run["reader_seconds"] == {"overlap": 0.0}
    assert main([str(good), corpus, "--output-dir", out, *end]) == 1
    assert main([str(bad), corpus, "--output-dir", str(tmp_path / "r2"), *end]) == 1
    assert main([str(good), str(tmp_path / "none" / "*.txt"), "--output-dir", str(tmp_path / "r3")]) == 1
    assert main([str(good), corpus, "--output-dir", str(tmp_path / "r4"), "--split", "test", *end]) == 1
    assert main([str(good), corpus, "--output-dir", str(tmp_path / "r5"), "--readers", "odd", *end]) == 1
    assert not (tmp_path / "r2").exists()


def test_records_are_saved_in_the_order_of_the_dataset_with_their_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text(PAGES, encoding="utf-8")
    asked = ["q3", "q1", "q2"]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(QUESTION | {"id": i, "question": f"{QUESTION['question']} {i}"}) for i in asked), encoding="utf-8")
    assert main([str(tmp_path / "q.jsonl"), str(tmp_path / "m.txt"), "--output-dir", str(tmp_path / "run"), "--rename", ".txt", ".pdf"]) == 0
    saved = [json.loads(x) for f in sorted((tmp_path / "run" / "records.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["id"] for x in saved] == asked
    best = saved[0]["retrieval"]["results"][0]
    assert (best["chunk_id"], best["source"], best["page"], best["chunk_index"], best["passages"]) == ("m.pdf:p1:c0", "m.pdf", 1, 0, [0])
    assert saved[0]["routing"]["threshold"] == 0.2 and saved[0]["routing"]["k"] == 5 and saved[0]["readers"][0]["context_chunk_ids"] == ["m.pdf:p1:c0"]
    back = records.read_records(spark, str(tmp_path / "run" / "records.jsonl"))
    assert back.where("size(errors) = 0").count() == 3 and "_corrupt_record" not in back.columns


def test_report_on_a_dataset(spark, tmp_path, capsys):
    (tmp_path / "m.x.txt").write_text(PAGES, encoding="utf-8")
    cited = [{"source": "m.x.pdf", "page": 1, "text": "The pump runs for 18 months."}]
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps(QUESTION | {"id": "q1", "evidence": cited} | x) for x in ({}, {"id": "q2", "question": "Why?", "split": "odd"})), encoding="utf-8")
    arguments = [str(tmp_path / "q.jsonl"), str(tmp_path / "m.x.txt"), "--rename", ".txt", ".pdf"]
    assert report_main(arguments) == 1
    said = capsys.readouterr().out.splitlines()
    assert "totals 2 2 0" in said and "by_split odd 1" in said and said[-1] == "q2: unknown split 'odd'" and sum("q" in x and ": " in x for x in said) == 1
    assert report_main([str(tmp_path / "none.jsonl"), *arguments[1:]]) == 1


def test_all_problems_of_a_dataset_are_reported(spark, tmp_path, capsys):
    (tmp_path / "m.txt").write_text(PAGES, encoding="utf-8")
    (tmp_path / "bad.jsonl").write_text("\n".join(json.dumps(QUESTION | {"id": f"q{i}", "question": f"How long does pump {i} run?", "answers": ["19 years"]}) for i in range(25)), encoding="utf-8")
    assert main([str(tmp_path / "bad.jsonl"), str(tmp_path / "m.txt"), "--output-dir", str(tmp_path / "run"), "--rename", ".txt", ".pdf"]) == 1
    said, listed = capsys.readouterr().err, spark.read.json(str(tmp_path / "run-problems"))
    assert {r.id for r in listed.collect()} == {f"q{i}" for i in range(25)}
    assert f"{listed.count()} problems" in said and "the first 20" in said and not (tmp_path / "run").exists()
