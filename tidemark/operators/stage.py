"""Materialise a frame that several passes read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SENT_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by the session; in a local session its own warehouse folder stands in."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    return folder


def run_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; the file system removes it when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: several passes read only their columns, lost tasks rerun from it."""
    path = f"{run_folder(df.sparkSession, 'stage')}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_key(small: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """``small``, one row per key, staged to be joined to a row table: sent to every task while it has at most ``rows`` rows, merged by key beyond.

    Without it the planner compares sizes of files: rows that compress well are broadcast themselves, others are shuffled by a handful of keys.
    """
    table = staged(small)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")
