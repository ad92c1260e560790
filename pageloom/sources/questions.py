"""Questions in JSON Lines, read strictly: exactly the known fields, the first bad line named."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "id string, question string, answerable boolean, category string, answers array<string>, "
    "evidence array<struct<source:string,page:int,text:string>>, failure_tags array<string>, split string, list_items array<string>, notes string"
)
REQUIRED = ("answerable", "answers", "category", "evidence", "failure_tags", "id", "question", "split")
OPTIONAL = ("list_items", "notes")
PASSAGE = ("page", "source", "text")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value): non-blank lines of text files with their 1-based numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "value"))
    return whole.select("file", (F.col("n") + 1).alias("line_number"), "value").where(F.col("value").rlike(r"(?U)\S"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions in order of file and line; ValueError names file, line and reason of the first bad line.

    Evidence passages need exactly source, page and text. list_items and notes default to an empty array
    and text. Files are read whole, one task each.
    """
    lines = numbered_lines(spark, path)
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", f"{QUESTION}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # the keys of each passage as they are written, which the parsed struct no longer shows
    passages = F.from_json(F.get_json_object("value", "$.evidence"), "array<map<string,string>>")
    needed = F.array(*map(F.lit, PASSAGE))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, REQUIRED)), keys))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL))))
    shown = lambda names: F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))
    reason = (
        F.when(keys.isNull(), "not a valid JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing fields "), shown(missing)))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown fields "), shown(unknown)))
        .when(F.col("p._bad").isNotNull(), "a field has the wrong type")
        .when(F.exists("cited", lambda x: F.size(F.array_except(needed, F.map_keys(x))) > 0), "an evidence passage lacks source, page or text")
        .when(F.exists("cited", lambda x: F.size(F.array_except(F.map_keys(x), needed)) > 0), "an evidence passage has unknown fields")
    )
    checked = lines.withColumn("p", parsed).withColumn("cited", passages).withColumn("reason", reason)
    bad = checked.where("reason is not null").orderBy("file", "line_number").select("file", "line_number", "reason").first()
    if bad:
        raise ValueError(f"{bad.file}:{bad.line_number}: {bad.reason}")
    filled = {"list_items": F.coalesce("p.list_items", F.array().cast("array<string>")), "notes": F.coalesce("p.notes", F.lit(""))}
    names = [x.split()[0] for x in QUESTION.replace("array<struct<source:string,page:int,text:string>>", "x").split(", ")]
    return checked.select("file", "line_number", *(filled.get(x, F.col(f"p.{x}")).alias(x) for x in names)).orderBy("file", "line_number").drop("file", "line_number")
