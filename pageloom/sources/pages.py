"""Page sources: paged text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import strip

# Fixed value: the line that separates pages.
PAGE_BREAK = "=== PAGE BREAK ==="


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source, page_number, text) of text files whose pages stand between separator lines; an empty page stops the job."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "\r\n?", "\n").alias("value"))
    pages = whole.select("source", F.posexplode(F.split("value", rf"(?Um)^[^\S\n]*{PAGE_BREAK}[^\S\n]*$")).alias("n", "page"))
    text = strip(F.col("page"))
    checked = F.when(text != "", text).otherwise(F.raise_error(F.concat("source", F.lit(": page "), (F.col("n") + 1).cast("string"), F.lit(" is empty"))))
    return pages.select("source", (F.col("n") + 1).alias("page_number"), checked.alias("text"))
