"""Session helpers: a local session for tests, table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of a table that is small enough to be spread over all cores.
SMALL = 256 * 2**20


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "pageloom") -> SparkSession:
    """A local session with the settings the queries are tested under (UTC, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAGELOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, where a table is below SMALL bytes and read in fewer parts; else the table as it is.

    A Parquet row group cannot be split, so a small file would keep a Python hop on one core. What is
    shuffled for it is bounded by SMALL, whatever the number of cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < SMALL and df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is used on a local master only; a cluster has to name one.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder.

    Never a local checkpoint, so a lost executor loses nothing.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Written:
    """A Parquet table in the shared folder that cuts lineage as a checkpoint does, compressed and by column; gone when the session ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def add(self, df: DataFrame) -> None:
        """Appends rows."""
        df.write.mode("append").option("compression", "zstd").parquet(self.path)

    def rows(self, schema: StructType) -> DataFrame:
        """All rows that were added."""
        return self.spark.read.schema(schema).parquet(self.path)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from a written table."""
    table = Written(df.sparkSession)
    table.add(df)
    return table.rows(df.schema)


def block_by_block(items: DataFrame, keys: list[str], blocks: int, search: Callable[[Any], tuple[DataFrame, Broadcast]], gather: Callable[[DataFrame], Any] = DataFrame.collect) -> DataFrame:
    """What a search finds for all items, which meet the tasks in blocks by a hash of the keys.

    ``search`` makes a plan for the rows of one block, as ``gather`` has them, and the broadcast that holds them. A single block
    stays lazy; several are run one after the other into a written table, and each broadcast is destroyed
    before the next, so neither the driver nor a task holds more than one block.
    """
    if blocks <= 1:
        return search(gather(items))[0]
    held = Written(items.sparkSession)
    for block in range(blocks):
        found, sent = search(gather(items.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == block)))
        held.add(found)
        sent.destroy()
    return held.rows(found.schema)
