"""A whole evaluation from files: read, validate, select, run, save. Also the command line.

``python -m pageloom.plans.run QUESTIONS PAGES --split dev --output-dir DIR``, and
``python -m pageloom.plans.run check QUESTIONS PAGES`` for the report on a dataset alone.
"""

from __future__ import annotations

import argparse
import platform
import sys
import time
from collections.abc import Sequence
from importlib.metadata import version

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import base_name
from pageloom.operators import chunking, evaluation, readers, routing, validation
from pageloom.operators.embedders import Embedder, hashing_embedder
from pageloom.session import durable, local_session
from pageloom.sources import pages as page_source
from pageloom.sources import questions as question_source
from pageloom.sources import records

# The wording of the error messages below.
#: Problems that an error message shows; all of them are written beside the output folder.
SHOWN = 20
PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow", "pyahocorasick")
#: Readers by name, and whether they are generative.
READERS: dict[str, tuple[readers.Reader, bool]] = {"overlap": (readers.overlap_reader(), False)}


def corpus_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source, page_number, text) of all paged text files of a path; FileNotFoundError if there are none."""
    try:
        found = page_source.read_text_pages(spark, path)
        empty = found.isEmpty()
    except AnalysisException as error:
        raise FileNotFoundError(f"No documents in {path}") from error
    if empty:
        raise FileNotFoundError(f"No documents in {path}")
    return found


def dataset_report(questions: DataFrame, pages: DataFrame) -> dict:
    """Problems of a dataset: their rows, how many there are, and the first SHOWN messages."""
    rows = durable(validation.dataset_problems(questions, pages.select(base_name(F.col("source")).alias("file"), F.col("page_number").alias("page"), "text")))
    return {"rows": rows, "problems": rows.count(), "first": [r.message for r in rows.orderBy("part", "id", "ordinal").limit(SHOWN).collect()]}


def report_main(argv: Sequence[str] | None = None) -> int:
    """Prints the counts and every problem of a dataset; exit code 1 where there are problems or the input is wrong."""
    parser = argparse.ArgumentParser(description="Check a question set against its corpus.")
    parser.add_argument("questions")
    parser.add_argument("pages")
    parser.add_argument("--rename", nargs=2, default=("", ""), metavar=("FROM", "TO"))
    args = parser.parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    try:
        questions = durable(question_source.read_questions(spark, args.questions))
        pages = durable(renamed(corpus_pages(spark, args.pages), tuple(args.rename)))
    except (ValueError, FileNotFoundError, AnalysisException) as error:
        print(error, file=sys.stderr)
        return 1
    for name, counts in validation.dataset_counts(questions).items():
        for row in counts.orderBy(*counts.columns).toLocalIterator():
            print(name, *row.asDict().values())
    report = dataset_report(questions, pages)
    for row in report["rows"].orderBy("part", "id", "ordinal").toLocalIterator():
        print(row.message)
    return 1 if report["problems"] else 0


def renamed(pages: DataFrame, rename: tuple[str, str]) -> DataFrame:
    """Pages whose sources have another ending, where evidence cites files in another format."""
    before, after = rename
    if not before:
        return pages
    return pages.withColumn("source", F.when(F.endswith("source", F.lit(before)), F.concat(F.expr(f"left(source, length(source) - {len(before)})"), F.lit(after))).otherwise(F.col("source")))


def evaluate(
    spark: SparkSession,
    questions_path: str,
    pages_path: str,
    output_dir: str | None = None,
    split: str = "all",
    ids: Sequence[str] | None = None,
    names: Sequence[str] = ("overlap",),
    embed: Embedder | None = None,
    make_readers: dict[str, tuple[readers.Reader, bool]] | None = None,
    k: int = 5,
    threshold: float = routing.THRESHOLD,
    embedder: str = "hashing",
    rename: tuple[str, str] = ("", ""),
) -> dict:
    """Runs the evaluation and saves it to a new folder; any problem of the dataset stops it before a model is made.

    Without ``output_dir`` the folder is named by the local time. ``embedder`` is the name of ``embed`` in run.json.
    ``rename`` replaces the end of the pages' file names, where evidence cites files in another format.
    """
    known = READERS | (make_readers or {})
    unknown = sorted(set(names) - set(known))
    if unknown:
        raise ValueError(f"Unknown readers {unknown}; choose from {sorted(known)}")
    routing.check_threshold(threshold)
    began = time.perf_counter()
    output_dir = output_dir or records.run_folder()
    questions = durable(question_source.read_questions(spark, questions_path))
    order = questions.select("id", F.monotonically_increasing_id().alias("place"))
    pages = durable(renamed(corpus_pages(spark, pages_path), rename))
    report = dataset_report(questions, pages)
    if report["problems"]:
        listed = f"{str(output_dir).rstrip('/')}-problems"
        report["rows"].write.mode("overwrite").json(listed)
        raise ValueError(f"The dataset has {report['problems']} problems, all of them in {listed}; the first {len(report['first'])}:\n" + "\n".join(report["first"]))
    chosen = durable(validation.select_questions(questions, split, list(ids) if ids else None))
    checked = time.perf_counter()
    found = durable(evaluation.run_evaluation(chosen, pages, embed or hashing_embedder(), {x: known[x] for x in names}, k, threshold))
    settings = {
        "chunk_size": chunking.SIZE, "chunk_overlap": chunking.OVERLAP, "k": k, "threshold": threshold, "embedder": embedder, "readers": list(names),
        "selection": {"split": split, "ids": list(ids) if ids else None, "questions": chosen.count()},
        "python": platform.python_version(), "packages": {x: version(x) for x in PACKAGES},
        "timings_seconds": {"reading": round(checked - began, 2), "evaluation": round(time.perf_counter() - checked, 2)},
    }
    digests = records.file_digests(spark, questions_path) | records.file_digests(spark, pages_path)
    return records.save_run(found, evaluation.index_chunks(pages), output_dir, settings, digests, order)


def main(argv: Sequence[str] | None = None) -> int:
    """Exit code 1 where the input or the output folder is wrong."""
    parser = argparse.ArgumentParser(description="Evaluate retrieval and readers on a question set.")
    parser.add_argument("questions")
    parser.add_argument("pages")
    parser.add_argument("--output-dir")
    parser.add_argument("--split", default="all")
    parser.add_argument("--ids", nargs="*")
    parser.add_argument("--readers", nargs="*", default=["overlap"])
    parser.add_argument("--rename", nargs=2, default=("", ""), metavar=("FROM", "TO"))
    args = parser.parse_args(argv)
    try:
        run = evaluate(SparkSession.getActiveSession() or local_session(), args.questions, args.pages, args.output_dir, args.split, args.ids, args.readers, rename=tuple(args.rename))
    except (ValueError, FileExistsError, FileNotFoundError, AnalysisException) as error:
        print(error, file=sys.stderr)
        return 1
    print(f"{run['settings']['selection']['questions']} questions, {run['chunks']} chunks, {run['questions_with_errors']} with errors")
    return 0


if __name__ == "__main__":
    sys.exit(report_main(sys.argv[2:]) if sys.argv[1:2] == ["check"] else main())
