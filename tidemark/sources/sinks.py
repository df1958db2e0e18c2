"""Sinks: the LONG table, guarded CSV export, result tables, the append-only decision log, file inventory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from .digests import long_files_sha256, resumable

LONG_SCHEMA = "metric_id string, timestamp timestamp_ntz, value double, source string, unit string, flags string, source_file string, source_row bigint"
LONG_COLUMNS = [x.split()[0] for x in LONG_SCHEMA.split(", ")]


def write_long(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Observation table: partitioned by source, rows range-clustered by (metric, time), zstd.

    Range partitioning samples the data, so a metric with a third of all rows is cut into as many tasks as its
    share asks for, and every file keeps tight min/max statistics for pruning.
    """
    (df.select(*LONG_COLUMNS).repartitionByRange("source", "metric_id", "timestamp", "source_row")
     .sortWithinPartitions("source", "metric_id", "timestamp", "source_row")
     .write.mode(mode).option("compression", "zstd").partitionBy("source").parquet(path))


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """The table as ``raw`` rows with the microsecond clock; filters on source, metric and ``timestamp`` reach the files."""
    return spark.read.schema(LONG_SCHEMA).parquet(path).withColumn("t", C.micros("timestamp"))


def export_rows(obs: DataFrame, metrics: Sequence[str], start: int, end: int) -> DataFrame:
    """Filtered raw rows in (timestamp, metric) order with text guarded against spreadsheet formulas."""
    rows = obs.filter(F.col("metric_id").isin(*metrics) & C.half_open("t", start, end) & C.in_period(start, end))
    texts = [x for x in ("metric_id", "source", "unit", "flags", "source_file") if x in rows.columns]
    for x in texts:
        rows = rows.withColumn(x, C.csv_safe(x))
    return rows.orderBy("timestamp", "metric_id", "source_row")


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """CSV parts in the frame's order; a byte-order mark in the first header cell when asked for."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else w.format(fmt).save(f"{path}/{name}"))


def with_content_id(records: DataFrame) -> DataFrame:
    """Content-hash id over the sorted columns of each record."""
    names = sorted(records.columns)
    return records.withColumn("record_id", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))


def append_log(spark: SparkSession, records: DataFrame, path: str) -> None:
    """Append records whose content id is not in the log yet; repeating a batch adds nothing."""
    new = with_content_id(records).dropDuplicates(["record_id"])
    try:
        old = spark.read.schema("record_id string").parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        old = None
    if old is not None:
        new = new.join(old, "record_id", "left_anti")
    new.write.mode("append").parquet(path)


def newest(records: DataFrame, by: str, n: int) -> DataFrame:
    return records.orderBy(F.col(by).desc(), "record_id").limit(n)


def file_inventory(spark: SparkSession, path: str, whole: int = 256 << 20) -> DataFrame:
    """Path, bytes and SHA-256 of every file; a task reads no more than ``whole`` bytes of a file.

    A longer file is hashed in ranges, each by a task that goes on from the state the last one left. Hadoop skips or
    decompresses some names when it reads ranges: those files are read whole (up to 2 GB), as all are without the C library.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = ["path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")]
    # The files' metadata is looked at before a file is opened.
    ranged = (F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").rlike(r"^[_.]|\.(gz|bz2|deflate|snappy|lz4|lzo|zst)$")
    long = [tuple(r) for r in files.filter(ranged).select("path", "length").collect()] if resumable() else []
    if not long:
        return files.select(*columns)
    digests = spark.createDataFrame(long_files_sha256(spark, long, whole), "path string, bytes long, sha256 string")
    return files.filter(~ranged).select(*columns).unionByName(digests)
