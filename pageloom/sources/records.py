"""Run folders: nested records as JSON Lines with explicit nulls, the index, and the run's description."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageloom.functions.text import base_name
from pageloom.sources.questions import QUESTION


def write_records(records: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object a line, nulls written out; fails if the folder exists. ``order`` names a column that gives the order across files and is left out."""
    rows = records.orderBy(order).drop(order) if order else records
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


#: One reader's row in a record, and a whole record as `pageloom.operators.evaluation.assemble` makes it.
READER_ROW = (
    "struct<reader:string,mode:string,context_chunk_ids:array<string>,used_chunk_ids:array<string>,passages_in_used_context:array<boolean>,prediction:string,refused:boolean,confidence:double,answer_chunk_id:string,"
    "start_char:int,end_char:int,exact_match:boolean,token_f1:double,answer_containment:boolean,list_item_recall:double,lexical_support:double,correct:boolean,seconds:double,error:string>"
)
RECORD = (
    f"{QUESTION}, retrieval struct<results:array<struct<rank:int,score:double,chunk_id:string,source:string,page:int,chunk_index:int,passages:array<int>>>,top_score:double,passage_ranks:array<int>,"
    "hit_any_at_1:boolean,hit_all_at_1:boolean,hit_any_at_3:boolean,hit_all_at_3:boolean,hit_any_at_5:boolean,hit_all_at_5:boolean,reciprocal_rank:double>, "
    "routing struct<status:string,supported:boolean,reason:string,top_score:double,threshold:double,k:int>, "
    f"readers array<{READER_ROW}>, end_to_end array<struct<reader:string,outcome:string,prediction:string,correct:boolean>>, diagnosis map<string,string>, errors array<string>"
)


def read_records(spark: SparkSession, path: str, schema: StructType | str = RECORD) -> DataFrame:
    """Records written by write_records, blank lines skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def index_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, page, chunk_index, text) of an index, sources as bare file names."""
    return chunks.select("chunk_id", base_name(F.col("source")).alias("source"), F.col("page_number").alias("page"), "chunk_index", "text")


def file_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of each matching file, by bare name."""
    files = spark.read.format("binaryFile").load(path)
    return {r.name: r.digest for r in files.select(base_name(F.col("path")).alias("name"), F.sha2("content", 256).alias("digest")).collect()}


def run_folder(base: str = "runs", now: datetime | None = None) -> str:
    """The default folder of a run, named by local time."""
    return f"{base.rstrip('/')}/{(now or datetime.now()).strftime('%Y-%m-%d-%H%M%S')}"


def save_run(records: DataFrame, chunks: DataFrame, folder: str, settings: dict, digests: dict[str, str] | None = None, order: DataFrame | None = None) -> dict:
    """Writes records, index and run.json into a new folder of any file system Spark writes to; FileExistsError if it is there.

    ``order`` (id, place) gives the records' order, that of the dataset; without it they are ordered by id.
    """
    spark = records.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(f"{folder} exists")
    placed = records.join(order.select("id", F.col("place").alias("_place")), "id", "left").select(*records.columns, "_place") if order is not None else records.withColumn("_place", F.col("id"))
    write_records(placed, f"{folder}/records.jsonl", "_place")
    write_records(index_rows(chunks).withColumn("_place", F.struct("source", "page", "chunk_index")), f"{folder}/index.jsonl", "_place")
    seconds = records.select(F.explode("readers").alias("r")).groupBy("r.reader").agg(F.round(F.sum("r.seconds"), 3).alias("s")).collect()
    run = {
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "settings": settings,
        "files": digests or {},
        "chunks": chunks.count(),
        "questions_with_errors": records.where(F.size("errors") > 0).count(),
        "reader_seconds": {r.reader: r.s for r in sorted(seconds, key=lambda r: r.reader)},
    }
    out = files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run.json"))
    try:
        out.write(bytearray(json.dumps(run, indent=2).encode()))
    finally:
        out.close()
    return run
