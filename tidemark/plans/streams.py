"""Streaming jobs drained over the event table, and the batch sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.stage import run_folder
from ..sources import sinks as W
from ..streaming import jobs as J
from .adapter import ANALYSER, LAB, LIMIT, OBS, from_events, obs, table, ts_text
from .registry import query, rounded
from .series import round_all

H, M = C.HOUR, C.MINUTE


def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return from_events(J.open_events(spark, f"{sf}/events*.parquet", schema))


def drained(df, mode="append", writer=None, store=None):
    return df.sparkSession.read.parquet(J.drain(df, mode, writer, store))


@query("stream_tumbling", "R2", OBS + f""", w AS (SELECT metric_id, time_bucket(INTERVAL 1 HOUR, timestamp) AS start, * EXCLUDE (metric_id) FROM obs) SELECT metric_id, {ts_text('start')} AS start, min(value) AS min, max(value) AS max, round(avg(value), 9) AS mean, count(value) AS count FROM w GROUP BY metric_id, start""")
def _(spark, sf):
    return round_all(J.newest_state(drained(J.tumbling(stream(spark, sf)), "update"), ["metric_id", "start"]), 9)


@query("stream_sliding_exceedance", "R3", OBS + f""", w AS (SELECT metric_id, value, unnest(range(time_bucket(INTERVAL 1 HOUR, timestamp) - INTERVAL 5 HOUR, time_bucket(INTERVAL 1 HOUR, timestamp) + INTERVAL 1 SECOND, INTERVAL 1 HOUR)) AS start FROM obs)
   SELECT metric_id, {ts_text('start')} AS start, round(avg(CASE WHEN value > {LIMIT} THEN 1.0 ELSE 0.0 END), 9) AS share, count(*) AS n FROM w GROUP BY 1, 2""")
def _(spark, sf):
    return round_all(J.newest_state(drained(J.sliding_exceedance(stream(spark, sf), LIMIT), "update"), ["metric_id", "start"]), 9)


@query("stream_late_results", "R1", OBS + f""" SELECT metric_id, {ts_text("date_trunc('day', timestamp)")} AS start, count(*) AS n, round(avg(value), 9) AS mean FROM obs WHERE source = 'lims' GROUP BY metric_id, date_trunc('day', timestamp)""")
def _(spark, sf):
    return round_all(J.newest_state(drained(J.late_results(stream(spark, sf).filter("source = 'lims'")), "update"), ["metric_id", "start"]), 9)


@query("stream_without_copies", "R5", OBS + "SELECT metric_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT DISTINCT metric_id, timestamp, value FROM obs) GROUP BY 1")
def _(spark, sf):
    d = drained(J.without_copies(stream(spark, sf).select("metric_id", "timestamp", "value")))
    return d.groupBy("metric_id").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("stream_latest", "R6", OBS + f"SELECT metric_id, {ts_text('timestamp')} AS timestamp, value FROM obs QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY timestamp DESC, source_row DESC) = 1")
def _(spark, sf):
    d = drained(J.latest(stream(spark, sf)), "update")
    last = d.groupBy("metric_id").agg(F.max(F.struct("batch", "t", "value")).alias("b"))
    return last.select("metric_id", C.from_micros("b.t").alias("timestamp"), F.col("b.value").alias("value"))


@query("stream_interval_join", "R7", OBS + f"""SELECT l.source_row AS lab_row, a.source_row AS analyser_row, round(a.value - l.value, 6) AS difference FROM obs l JOIN obs a ON a.metric_id = '{ANALYSER}' AND a.timestamp <= l.timestamp AND a.timestamp >= l.timestamp - INTERVAL 10 MINUTE WHERE l.metric_id = '{LAB}'""")
def _(spark, sf):
    s = stream(spark, sf)
    j = J.lab_analyser_join(s.filter(F.col("metric_id") == LAB), s.filter(F.col("metric_id") == ANALYSER))
    return drained(j).select("lab_row", "analyser_row", rounded(F.col("analyser") - F.col("lab")).alias("difference"))


@query("stream_flatline_alarm", "R4", OBS + f""", q AS (SELECT metric_id, epoch_us(timestamp) AS t, source_row, floor(value / 100) AS v FROM obs), a AS (SELECT *, coalesce(v = lag(v) OVER w AND t - lag(t) OVER w <= {2 * H}, FALSE) AS same FROM q WINDOW w AS (PARTITION BY metric_id ORDER BY t, source_row)),
   g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY metric_id ORDER BY t, source_row) AS run FROM a), s AS (SELECT *, min(t) OVER (PARTITION BY metric_id, run) AS st FROM g)
   SELECT metric_id, source_row, st AS run_start FROM s WHERE same AND t - st >= {2 * H} AND t <= (SELECT max(t) FROM q) - {H}""")
def _(spark, sf):
    s = stream(spark, sf).withColumn("value", F.floor(F.col("value") / 100).cast("double"))
    # the last hour's rows still wait for late ones
    return drained(J.flatline_alarm(s, 2 * H, 2 * H), store=J.ROCKSDB).select("metric_id", "source_row", "run_start")


@query("stream_idempotent_append", "R8", OBS + "SELECT metric_id, count(DISTINCT timestamp) AS n FROM obs GROUP BY 1")
def _(spark, sf):
    path = run_folder(spark, "append") + "/table"
    keys = ["metric_id", "timestamp"]
    for _ in range(2):  # the second run replays the same input and must add nothing
        J.drain(stream(spark, sf).select(*keys, "value"), "append", lambda _out: J.idempotent_append(path, keys))
    return spark.read.parquet(path).groupBy("metric_id").agg(F.count("*").alias("n"))


@query("long_table_round_trip", "S6 S7", OBS + f"SELECT source, metric_id, count(*) AS rows, round(sum(value), 4) AS total, {ts_text('min(timestamp)')} AS start, {ts_text('max(timestamp)')} AS \"end\" FROM obs GROUP BY 1, 2")
def _(spark, sf):
    path = run_folder(spark, "long") + "/table"
    W.write_long(obs(spark, sf), path)
    return W.read_long(spark, path).groupBy("source", "metric_id").agg(
        F.count("*").alias("rows"), rounded(F.sum("value"), 4).alias("total"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


@query("result_tables", "S20", "SELECT o_orderpriority AS candidate, CAST(year(o_orderdate) AS INTEGER) AS period, count(*) AS rows FROM orders GROUP BY 1, 2")
def _(spark, sf):
    path = run_folder(spark, "results") + "/table"
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("candidate"), F.year("o_orderdate").alias("period")).agg(F.count("*").alias("rows"))
    W.write_results({"coverage": o}, path)
    return spark.read.schema("candidate string, period int, rows bigint").option("header", True).csv(f"{path}/coverage")
