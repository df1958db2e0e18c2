"""Readers that turn exports into LONG rows: wide telemetry, paired (time, value) sheets, tag dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

TIME_COLUMNS = ("date", "timestamp", "datetime")


@dataclass(frozen=True)
class Pair:
    """One independent series of a paired sheet."""

    time: str
    value: str
    metric_id: str
    unit: str | None = None


def read_text_csv(spark: SparkSession, path, header: bool = True) -> DataFrame:
    """All columns as text; nothing is inferred, so the file is scanned once and parsed leniently later."""
    return spark.read.option("header", header).option("mode", "PERMISSIVE").option("multiLine", False).csv(path)


def with_file_row(df: DataFrame, first: int = 2, out: str = "source_row") -> DataFrame:
    """1-based row number of each line in its own file (``first`` = row of the first data line).

    Splits of a file are numbered by their byte offset; rows inside a split by the task's running id.  The only
    table that is ordered holds one row per split.
    """
    d = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_f", F.xxhash64("_metadata.file_path")).withColumn(
        "_b", F.col("_metadata.file_block_start"))
    split = d.groupBy("_f", "_b").agg(F.min("_id").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    split = split.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return d.join(split, ["_f", "_b"]).withColumn(out, F.col("_id") - F.col("_lo") + F.col("_before") + first).drop("_id", "_lo", "_before", "_f", "_b")


def time_column(columns: Sequence[str]) -> str:
    for name in columns:
        if name.strip().lower() in TIME_COLUMNS:
            return name
    raise ValueError("no date column")


def parsed(raw_time: Column, raw_value: Column) -> list[Column]:
    v = C.parse_number(raw_value)
    return [C.parse_time(raw_time).alias("timestamp"), v.alias("value"), v.isNull().alias("invalid"), C.is_zoned(raw_time).alias("zoned")]


def wide_to_long(df: DataFrame, plant: str, source_file: str, time: str | None = None, row: str = "source_row",
                 source: str = "kip") -> DataFrame:
    """Wide telemetry (one time column, one column per tag) to LONG; service columns are dropped.

    Rows with an unreadable or zoned time are kept here with a NULL timestamp so that they can be tallied;
    :func:`accepted` removes them.
    """
    time = time or time_column(df.columns)
    tags = [x for x in df.columns if x not in (time, row) and not x.lower().startswith("unnamed")]
    cells = F.array(*[F.struct(F.lit(x).alias("code"), F.col(f"`{x}`").cast("string").alias("_v")) for x in tags])
    # The time is read once per row, before the row unfolds into its tags.
    t = F.col(time).cast("string")
    long = df.select(C.parse_time(t).alias("timestamp"), C.is_zoned(t).alias("zoned"), F.col(row).alias("source_row"), F.inline(cells))
    long = long.withColumn("value", C.parse_number("_v"))
    return long.select(
        F.concat(F.lit(f"{plant}."), "code").alias("metric_id"), "timestamp", "value", F.col("value").isNull().alias("invalid"), "zoned",
        F.lit(source).alias("source"), F.lit(None).cast("string").alias("unit"), F.lit(source_file).alias("source_file"), "source_row")


def paired_to_long(df: DataFrame, pairs: Sequence[Pair], source: str, source_file: str, row: str = "source_row") -> DataFrame:
    """Every (time, value) column pair becomes its own series; a pair is skipped only when both cells are empty."""
    cells = F.array(*[
        F.struct(F.lit(p.metric_id).alias("metric_id"), F.lit(p.unit).cast("string").alias("unit"),
                 F.col(p.time).cast("string").alias("_t"), F.col(p.value).cast("string").alias("_v")) for p in pairs])
    long = df.select(F.col(row).alias("source_row"), F.inline(cells)).filter(F.col("_t").isNotNull() | F.col("_v").isNotNull())
    return long.select("metric_id", *parsed(F.col("_t"), F.col("_v")), F.lit(source).alias("source"), "unit",
                       F.lit(source_file).alias("source_file"), "source_row")


def accepted(long: DataFrame) -> DataFrame:
    """Rows with a usable local time, plus the microsecond clock ``t``."""
    return long.filter(F.col("timestamp").isNotNull()).drop("zoned").withColumn("t", C.micros("timestamp"))


def rejected(long: DataFrame) -> DataFrame:
    """Tally of rows without a usable time by metric and cause."""
    cause = F.when(F.col("zoned"), "timezone_timestamp").otherwise("invalid_timestamp")
    return long.filter(F.col("timestamp").isNull()).groupBy(cause.alias("code"), "metric_id").agg(F.count("*").alias("count"))


def lab_pairs(groups: Sequence[str | None], codes: Sequence[str | None], units: Sequence[str | None], columns: Sequence[str],
              plant_of, point_of) -> list[Pair]:
    """Series of a laboratory sheet: the group header is carried to the right until the next one."""
    out, current = [], None
    for i in range(0, len(columns) - 1, 2):
        current = (groups[i] or "").strip() or current
        code = (codes[i] or "").strip()
        if current and code:
            out.append(Pair(columns[i], columns[i + 1], f"lims.{plant_of(current)}.{point_of(current)}.{code}", (units[i] or "").strip() or None))
    return out


def analyser_pairs(heads: Sequence[str | None], units: Sequence[str | None], columns: Sequence[str], plant: str) -> list[Pair]:
    """Series of an analyser sheet: a headed column whose left neighbour is headed too is that neighbour's value."""
    has = [bool((h or "").strip()) for h in heads]
    return [
        Pair(columns[i], columns[i + 1], f"pak.{plant}.{heads[i].strip().split(':')[-1]}", (units[i] or "").strip() or None)
        for i in range(len(columns) - 1) if has[i] and not (i and has[i - 1])]


def tag_dimension(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(plant, tag, description) from side-by-side (description, tag) columns; the last row of a repeated tag wins."""
    cells = F.array(*[F.struct(F.lit(p).alias("plant"), F.trim(F.col(t).cast("string")).alias("tag"), F.trim(F.col(d).cast("string")).alias("d"))
                      for p, d, t in pairs])
    rows = df.select("source_row", F.inline(cells)).filter(F.coalesce("tag", F.lit("")) != "")
    return rows.groupBy("plant", "tag").agg(F.max_by(F.coalesce(F.nullif("d", F.lit("")), "tag"), "source_row").alias("description"))


def merge_wide(frames: dict[str, DataFrame], time: str = "timestamp") -> DataFrame:
    """Outer join of wide frames on time with a prefix per frame.

    Repeated times are first reduced map-side: a cell with differing values becomes NULL.  A NULL beside a value
    also counts as a difference.
    """
    out = None
    for name, df in frames.items():
        vals = [x for x in df.columns if x != time]

        def cell(x):
            same = (F.min(x) == F.max(x)) & (F.count(x) == F.count("*"))
            return F.when(same, F.max(x)).alias(f"{name}__{x}")

        g = df.filter(F.col(time).isNotNull()).groupBy(time).agg(*[cell(x) for x in vals])
        out = g if out is None else out.join(g, time, "full_outer")
    return out


def route(path: str, first_cell: str = "", lab_words: Sequence[str] = ("lims", "lab"), analyser_words: Sequence[str] = ("pak", "analyser"),
          tag_words: Sequence[str] = ("tags",)) -> str | None:
    """Source kind from the file name, then from the first header cell."""
    name, head = PurePosixPath(path).name.lower(), first_cell.lower()
    if name.startswith("~$"):
        return None
    if any(w in name for w in analyser_words) or head.startswith("24-2000:"):
        return "pak"
    if any(w in name for w in lab_words) or any(w in head for w in lab_words):
        return "lims"
    if any(w in name for w in tag_words):
        return "tags"
    return "kip" if name.endswith(".csv") else None


def import_files(spark: SparkSession, files: Sequence[str], read: dict) -> tuple[DataFrame | None, list[dict]]:
    """Read each file with the reader of its kind; a failing or repeated source becomes an issue, the rest go on."""
    parts, issues, seen = [], [], set()
    for path in files:
        kind = route(path)
        if kind not in read:
            continue
        try:
            identity, long = read[kind](spark, path)
            if identity in seen:
                raise ValueError(f"repeated source {identity}")
            long.limit(0).collect()
            seen.add(identity)
            parts.append(long)
        except Exception as exc:
            issues.append({"code": "source_error", "file": path, "error": str(exc).splitlines()[0]})
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out, issues
