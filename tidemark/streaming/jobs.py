"""Structured Streaming forms of the batch rules.

Each function takes a streaming (or batch) frame of observations with an event-time column ``timestamp`` and
returns a frame; :func:`drain` runs one to the end of what is available.  After all input each equals its batch rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import columns as C
from ..operators.stage import run_folder


def clocked(df: DataFrame, delay: str, column: str = "timestamp") -> DataFrame:
    """Watermarks need a zoned TIMESTAMP; the local time is read in the session zone and cast back on output."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def _start() -> Column:
    return F.col("window.start").cast("timestamp_ntz").alias("start")


def late_results(labs: DataFrame, delay: str = "4 hours", width: str = "1 day") -> DataFrame:
    """Results per sampling day; a result may arrive ``delay`` after sampling before its day closes."""
    return clocked(labs, delay).groupBy(F.window("timestamp", width), "metric_id").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean")).select("metric_id", _start(), "n", "mean")


def tumbling(obs: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Down-sampling per window (mean instead of the batch median)."""
    return clocked(obs, delay).groupBy(F.window("timestamp", width), "metric_id").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.count("value").alias("count")).select(
        "metric_id", _start(), "min", "max", "mean", "count")


def sliding_exceedance(obs: DataFrame, limit: float, length: str = "6 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return clocked(obs, delay).groupBy(F.window("timestamp", length, slide), "metric_id").agg(
        F.avg((F.col("value") > limit).cast("double")).alias("share"), F.count("*").alias("n")).select("metric_id", _start(), "share", "n")


def without_copies(obs: DataFrame, keys: Sequence[str] = ("metric_id", "timestamp", "value"), delay: str = "4 hours") -> DataFrame:
    """Copies arriving within the delay are dropped."""
    return clocked(obs, delay).dropDuplicatesWithinWatermark(list(keys))


def latest(obs: DataFrame) -> DataFrame:
    """Newest value per metric (update mode); partial maxima are combined before the shuffle."""
    return obs.groupBy("metric_id").agg(F.max(F.struct("t", "source_row", "value")).alias("b")).select("metric_id", "b.t", "b.source_row", "b.value")


def lab_analyser_join(labs: DataFrame, analyser: DataFrame, back: int = 10 * C.MINUTE, delay: str = "4 hours") -> DataFrame:
    """Lab samples with analyser readings at most ``back`` before them; both sides keep bounded state.

    The equality key is a time bucket as wide as the interval, so the state of one series spreads over its buckets.
    """
    slot = C.bucket("t", back)
    l = labs.select(F.explode(F.array(slot, slot - 1)).alias("slot"), F.col("timestamp").alias("sampled"), F.col("value").alias("lab"), F.col("source_row").alias("lab_row"))
    a = analyser.select(slot.alias("slot"), F.col("timestamp").alias("read_at"), F.col("value").alias("analyser"), F.col("source_row").alias("analyser_row"))
    l, a = clocked(l, delay, "sampled"), clocked(a, delay, "read_at")
    near = F.expr(f"read_at <= sampled AND read_at >= sampled - INTERVAL {back // C.SECOND} SECONDS")
    return l.join(a, (l["slot"] == a["slot"]) & near).drop("slot")


class FlatRuns(StatefulProcessor):
    """Per metric: rows the watermark hasn't passed yet, and the run that the passed rows end in.

    Rows wait until they are final, so neither their order of arrival nor the cut into micro-batches matters. The buffer holds one
    delay's rows of a metric; an event-time timer stands at the earliest of them.
    """

    def __init__(self, hold: int, gap: int):
        self.hold, self.gap = hold, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, t long, source_row long, value double")
        self.run = handle.getValueState("run", "run_start long, last_t long, last_v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            new = pdf[["ms", "t", "source_row", "value"]].dropna(subset=["value"])
            if len(new):
                self.waiting.appendList([(int(r.ms), int(r.t), int(r.source_row), float(r.value)) for r in new.itertuples(index=False)])
                self.handle.registerTimer(int(new["ms"].min()))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[2]))
        later = [r for r in rows if r[0] > mark]
        start, last_t, last_v = self.run.get() if self.run.exists() else (None, None, None)
        hits = []
        for ms, t, row, v in rows:
            if ms > mark:
                continue
            if start is None or v != last_v or t - last_t > self.gap:
                start = t
            elif t - start >= self.hold:
                hits.append((key[0], t, row, start))
            last_t, last_v = t, v
        if start is not None:
            self.run.update((start, last_t, last_v))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        yield pd.DataFrame(hits, columns=["metric_id", "t", "source_row", "run_start"])

    def close(self) -> None:
        pass


def flatline_alarm(obs: DataFrame, hold: int = 6 * C.HOUR, gap: int = 20 * C.MINUTE, delay: str = "1 hour") -> DataFrame:
    """Rows on a run of equal values already ``hold`` long, each once the watermark has passed it; rows up to ``delay`` late count.

    Runs in append mode with the RocksDB state store (see :func:`drain`). Rows without a value are no readings.
    """
    rows = clocked(obs, delay).select("metric_id", "timestamp", F.unix_millis("timestamp").alias("ms"), "t", "source_row", F.col("value").cast("double").alias("value"))
    return rows.groupBy("metric_id").transformWithStateInPandas(
        FlatRuns(hold, gap), "metric_id string, t long, source_row long, run_start long", "append", "eventTime")


def idempotent_append(path: str, keys: Sequence[str], time: str = "timestamp"):
    """foreachBatch writer that appends only rows whose key is not in the table yet; a replayed batch adds nothing.

    The table is partitioned by day and ``time`` is part of the key, so a batch reads only the days it brings.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        new = batch.dropDuplicates(list(keys)).withColumn("day", F.to_date(time))
        first, last = new.agg(F.min("day"), F.max("day")).first()
        try:
            old = batch.sparkSession.read.parquet(path).where(F.col("day").between(first, last)).select(*keys)
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
            old = None
        if old is not None:
            new = new.join(old, list(keys), "left_anti")
        new.write.mode("append").partitionBy("day").parquet(path)

    return write


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(df: DataFrame, mode: str = "append", writer=None, store: str | None = None) -> str:
    """Run the stream over everything available and return the folder of its output table.

    The default writer keeps one folder per micro-batch, so a retried batch replaces its own output. ``store`` names the
    state store for this query (ROCKSDB for arbitrary state); the session's own setting comes back.
    """
    spark = df.sparkSession
    folder = run_folder(spark, "stream")
    out = f"{folder}/table"
    write = writer(out) if writer else (lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}"))
    before = spark.conf.get(STORE, None)
    if store:
        spark.conf.set(STORE, store)
    try:
        query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if store and before:
            spark.conf.set(STORE, before)
        elif store:
            spark.conf.unset(STORE)
    return out


def newest_state(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last state of each key from a table of update-mode batches: windows still open at the end of the input are in it."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def open_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
