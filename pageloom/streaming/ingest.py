"""Pages as they arrive: a stateless stream from page files to chunks, appended to a table.

Chunking needs one page at a time, so the stream holds no state and no watermark; late pages are chunked
when they come. Pages delivered twice are dropped where a watermark bounds how long they are remembered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators.chunking import OVERLAP, SIZE, page_chunks


def page_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """A stream of page rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def distinct_pages(pages: DataFrame, time: str = "loaded_at", within: str = "7 days") -> DataFrame:
    """Pages without repeats of (source, page_number, text) that arrive within the given time of each other."""
    return pages.withWatermark(time, within).dropDuplicatesWithinWatermark(["source", "page_number", "text"])


def ingest(pages: DataFrame, table_folder: str, checkpoint: str, size: int = SIZE, overlap: int = OVERLAP) -> StreamingQuery:
    """Chunks all pages that are there and appends them, each exactly once, to a Parquet folder."""
    chunks = page_chunks(pages, size, overlap)
    return chunks.writeStream.format("parquet").option("path", table_folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
