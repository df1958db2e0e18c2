"""The driver's tables seen as process telemetry.

``events`` plays the observation table: one metric per event type, purchases as
laboratory results (published four hours later), views as the online analyser,
the other three as controls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import MINUTE, micros, from_micros

LAB, ANALYSER, SECOND_ANALYSER = "ev.purchase", "ev.view", "ev.click"
CONTROLS = ("ev.click", "ev.error", "ev.signup")
LIMIT = 100.0
# 2024-01-01 .. 2024-01-31 in the data; current period = second half.
START, MIDDLE, END = "2024-01-01 00:00:00", "2024-01-16 00:00:00", "2024-01-31 00:00:00"
AT = "2024-01-20 12:00:00"
AFTER_AT = "2024-01-20 12:01:00"  # observation times are whole minutes
BEFORE_MIDDLE = "2024-01-15 23:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ntz(text: str):
    return F.expr(f"TIMESTAMP_NTZ'{text}'")


def at(text: str):
    return micros(ntz(text))


def obs(spark: SparkSession, sf: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observation rows with the long microsecond clock ``t`` beside ``timestamp``.

    ``[start, end)``, in whole minutes, bounds the stored time column itself, so it reaches the files.
    """
    e = table(spark, sf, "events")
    if start:
        e = e.filter(F.col("ts") >= ntz(start))
    if end:
        e = e.filter(F.col("ts") < ntz(end))
    return from_events(e)


def from_events(events: DataFrame) -> DataFrame:
    """Event rows (batch or streaming) as observations."""
    e = events.select("event_id", "ts", "event_type", "value")
    raw = micros("ts")
    t = raw - F.pmod(raw, F.lit(MINUTE))
    return e.select(
        F.concat(F.lit("ev."), "event_type").alias("metric_id"),
        t.alias("t"),
        from_micros(t).alias("timestamp"),
        "value",
        F.when(F.col("event_type") == "purchase", "lims").when(F.col("event_type") == "view", "pak").otherwise("kip").alias("source"),
        F.lit(None).cast("string").alias("unit"),
        F.when(F.col("value") < 1, "invalid").when(F.col("value") > 250, "suspect").otherwise("").alias("flags"),
        F.lit("events").alias("source_file"),
        F.col("event_id").alias("source_row"),
    )


def one_per_time(df: DataFrame, keys=("metric_id", "t")) -> DataFrame:
    """Keep the last row (largest source_row) of every (metric, time)."""
    best = df.groupBy(*keys).agg(F.max_by("value", "source_row").alias("value"), F.max("source_row").alias("source_row"))
    return best


OBS = """WITH obs AS (
  SELECT 'ev.' || event_type AS metric_id, date_trunc('minute', ts) AS timestamp, value,
         CASE event_type WHEN 'purchase' THEN 'lims' WHEN 'view' THEN 'pak' ELSE 'kip' END AS source,
         CASE WHEN value < 1 THEN 'invalid' WHEN value > 250 THEN 'suspect' ELSE '' END AS flags,
         event_id AS source_row
  FROM events),
clean AS (
  SELECT metric_id, timestamp, epoch_us(timestamp) AS t, arg_max(value, source_row) AS value, max(source_row) AS source_row
  FROM obs WHERE NOT contains(flags, 'invalid') AND NOT contains(flags, 'conflict') GROUP BY 1, 2, 3)
"""
VALID = "(value IS NOT NULL AND isfinite(value) AND NOT contains(flags,'invalid') AND NOT contains(flags,'conflict'))"
SUSPECT = "(contains(flags,'flatline') OR contains(flags,'suspect'))"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
