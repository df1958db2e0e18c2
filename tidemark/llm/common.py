"""Helpers shared by the corpus operators: table access, ASCII lower-casing, staged tables in the shared folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
BLANKS = " \t\n\x0b\f\r"  # [\x20\x09-\x0D]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept. Pure ASCII texts take the cheap built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local-thread")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one; the file system removes it when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, keeps columns prunable, survives lost executors."""
    path = f"{run_folder(df.sparkSession, label)}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT = 10_000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, a staged table with one row per key whose column n counts at most the key's rows in `rows`.

    Keys with 1/HOT of all rows or more are HOT at most, so they are broadcast and their rows stay where they are; the
    rest are joined by key, where none can fill a task.
    """
    often = F.col(n) * HOT >= rows.count()
    hot, cold = F.broadcast(keyed.where(often)), keyed.where(~often)
    rest = rows.join(F.broadcast(keyed.where(often).select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(hot, on).unionByName(rest)


def drop_staged(df: DataFrame) -> None:
    """Remove the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
