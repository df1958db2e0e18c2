"""Quality flags on import and profiling of columns, time axes and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import islands, neighbour
from .quantiles import PER_RANGE, quantiles


def per_file(rows: DataFrame, *keys: str) -> list[str]:
    return [*keys, "source_file"] if "source_file" in rows.columns else list(keys)


def collapse_copies(rows: DataFrame) -> DataFrame:
    """One row per (file, metric, time, value, invalid) with ``copies``; map-side combined, so a hot copy group shrinks before the shuffle.

    Each file is handled on its own; the row, source and unit kept are those of the group's first row.
    """
    keep = [x for x in ("source", "unit") if x in rows.columns]
    out = rows.groupBy(*per_file(rows, "metric_id", "t"), "value", "invalid").agg(F.min(F.struct("source_row", *keep)).alias("_first"), F.count("*").alias("copies"))
    return out.select("*", *[F.col(f"_first.{x}").alias(x) for x in ("source_row", *keep)]).drop("_first")


def mark_conflicts(collapsed: DataFrame) -> DataFrame:
    """``conflict`` on every survivor of a file's (metric, time) that holds more than one distinct (value, invalid)."""
    keys = per_file(collapsed, "metric_id", "t")
    clash = collapsed.groupBy(*keys).agg(F.count("*").alias("_k"), F.sum("copies").alias("conflict_rows")).filter("_k > 1").drop("_k")
    return collapsed.join(clash, keys, "left").withColumn("conflict", F.col("conflict_rows").isNotNull())


def mark_flatline(rows: DataFrame, hold: int = 6 * C.HOUR, gap: int = 20 * C.MINUTE, sources: Sequence[str] = ("kip", "pak"),
                  width: int = C.DAY) -> DataFrame:
    """``flatline`` once an unbroken run of equal values is ``hold`` long; invalid rows and long gaps end a run.

    Only telemetry and analysers can flatline.
    """
    on = F.col("source").isin(*sources)
    same = (F.col("value") == F.col("prev.value")) & ~F.col("prev.invalid") & ~F.col("invalid") & (F.col("t") - F.col("prev.t") <= gap)
    d = islands(rows, per_file(rows, "metric_id"), "t", ["source_row"], ~F.coalesce(same, F.lit(False)), ["value", "invalid"], width, "_start")
    flat = on & ~F.col("_break") & (F.col("t") - F.col("_start") >= hold)
    return d.withColumn("flatline", F.coalesce(flat, F.lit(False))).drop("prev", "_break", "_start", "_chunk")


def flag_observations(rows: DataFrame, hold: int = 6 * C.HOUR, gap: int = 20 * C.MINUTE, width: int = C.DAY, suspect=None) -> DataFrame:
    """Import rules in order: collapse copies, mark conflicts, flatline runs, physical range; flags packed as text."""
    d = mark_flatline(mark_conflicts(collapse_copies(rows)), hold, gap, width=width)
    d = d.withColumn("suspect", C.suspect_range("metric_id", "value") if suspect is None else suspect)
    return d.withColumn("flags", C.pack_flags(**{k: F.col(k) for k in ("invalid", "conflict", "flatline", "suspect")}))


def issue_tally(flagged: DataFrame) -> DataFrame:
    """Issues by (code, metric): conflict counts rows before copies were collapsed."""
    codes = F.array(
        F.struct(F.lit("duplicate").alias("code"), (F.col("copies") - 1).alias("n")),
        # survivors' copies add up to the group as it was before collapsing
        F.struct(F.lit("conflict").alias("code"), F.when(F.col("conflict"), F.col("copies")).otherwise(0).alias("n")),
        F.struct(F.lit("suspect").alias("code"), F.col("suspect").cast("long").alias("n")),
        F.struct(F.lit("flatline").alias("code"), F.col("flatline").cast("long").alias("n")))
    return flagged.select("metric_id", F.inline(codes)).groupBy("code", "metric_id").agg(F.sum("n").alias("count")).filter("count > 0")


def source_stats(flagged: DataFrame) -> DataFrame:
    """Manifest counters per source and file."""
    return flagged.groupBy("source", "source_file").agg(
        F.count("*").alias("rows"), F.count_distinct("t").alias("frame_count"), C.from_micros(F.min("t")).alias("start"),
        C.from_micros(F.max("t")).alias("end"), F.count_if("invalid").alias("invalid_count"),
        F.count_if(F.col("flatline") | F.col("suspect")).alias("suspect_count"), F.sum(F.col("copies") - 1).alias("duplicate_count"))


def metric_quality(obs: DataFrame) -> DataFrame:
    return obs.groupBy("metric_id").agg(
        F.count("*").alias("count"), F.count_if(~C.is_valid()).alias("invalid_count"), F.count_if(C.is_suspect()).alias("suspect_count"),
        F.count_if(C.has_flag("flags", "flatline")).alias("flatline_count"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))


def suspect_ranking(q: DataFrame, top: int = 8) -> DataFrame:
    return q.filter("count > 0 AND suspect_count > 0").withColumn("percentage", F.col("suspect_count") / F.col("count") * 100).orderBy(
        F.col("percentage").desc(), F.col("suspect_count").desc(), "metric_id").limit(top)


# --- profiling ------------------------------------------------------------------


def unparseable(df: DataFrame, time: str, value: str) -> DataFrame:
    """Rows where either cell is present and one of them cannot be read."""
    some = F.col(time).isNotNull() | F.col(value).isNotNull()
    return df.filter(some & (C.parse_time(time).isNull() | C.parse_number(value).isNull()))


def duplicate_times(rows: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Rows, distinct times and repeated times per key."""
    per = rows.groupBy(*keys, t).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count("*").alias("unique_times"), F.count_if(F.col("n") > 1).alias("repeated_times"),
                                  (F.sum("n") - F.count("*")).alias("surplus_rows"))


def constant_runs(rows: DataFrame, keys: Sequence[str], order: str, value: str, width: int, time: str | None = None) -> DataFrame:
    """Runs of equal consecutive values: (keys, run_start, value, rows, last order value, start/end of ``time``)."""
    same = F.col(value).eqNullSafe(F.col(f"prev.{value}")) & F.col(value).isNotNull()
    d = islands(rows, keys, order, [], ~same, [value], width, "run_start")
    aggs = [F.min(value).alias("value"), F.count("*").alias("rows"), F.max(order).alias("run_end")]
    if time:
        aggs += [F.min(time).alias("start"), F.max(time).alias("end")]
    return d.groupBy(*keys, "run_start").agg(*aggs)


def column_profile(rows: DataFrame, keys: Sequence[str], order: str, value: str, width: int, per_range: int = PER_RANGE) -> DataFrame:
    """Count, missing, distinct, moments, quantiles, zeros, negatives, unchanged share, longest constant run per key."""
    x = F.col(value)
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("count"), F.count_if(x.isNull()).alias("missing"), F.count_distinct(value).alias("nunique"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(x == 0).alias("zero_count"),
        F.count_if(x < 0).alias("negative_count"))
    q = quantiles(rows, keys, value, [0.01, 0.05, 0.5, 0.95, 0.99], ["p01", "p05", "median", "p95", "p99"], per_range)
    runs = constant_runs(rows, keys, order, value, width)
    # Rows equal to their predecessor = rows minus the first of every run of a known value.
    runs = runs.groupBy(*keys).agg(
        F.max(F.when(F.col("value").isNotNull(), F.col("rows"))).alias("longest_constant_rows"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("rows") - 1).otherwise(0)).alias("_same"), F.sum("rows").alias("_rows"))
    out = base.join(q, list(keys)).join(runs, list(keys))
    return out.withColumn("unchanged_adjacent_fraction", F.col("_same") / F.col("_rows")).drop("_same", "_rows")


def time_profile(rows: DataFrame, keys: Sequence[str], t: str = "t", order: Sequence[str] = ("source_row",), width: int = C.DAY,
                 per_range: int = PER_RANGE) -> DataFrame:
    """Start, end, repeated times, median step and longest gap per key."""
    d = neighbour(rows.select(*keys, t, *order), keys, t, list(order), [], width, "prev").withColumn("step", (F.col(t) - F.col(f"prev.{t}")) / C.SECOND)
    base = d.groupBy(*keys).agg(C.from_micros(F.min(t)).alias("start"), C.from_micros(F.max(t)).alias("end"),
                                F.count_if(F.col("step") == 0).alias("duplicate_timestamps"), (F.max("step") / 3600).alias("max_gap_hours"))
    return base.join(quantiles(d, keys, "step", [0.5], ["median_step_seconds"], per_range), list(keys))


def step_counts(rows: DataFrame, keys: Sequence[str], top: int = 8, t: str = "t", order: Sequence[str] = ("source_row",), width: int = C.DAY) -> DataFrame:
    """Most frequent step sizes per key."""
    d = neighbour(rows.select(*keys, t, *order), keys, t, list(order), [], width, "prev").withColumn("step_seconds", (F.col(t) - F.col(f"prev.{t}")) / C.SECOND)
    n = d.filter("step_seconds IS NOT NULL").groupBy(*keys, "step_seconds").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "step_seconds")
    return n.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).drop("rn")


def largest_gaps(rows: DataFrame, keys: Sequence[str], top: int = 5, t: str = "t", width: int = C.DAY) -> DataFrame:
    d = neighbour(rows.select(*keys, t).distinct(), keys, t, [], [], width, "prev")
    d = d.filter(F.col("prev").isNotNull()).withColumn("gap_hours", (F.col(t) - F.col(f"prev.{t}")) / C.HOUR)
    w = Window.partitionBy(*keys).orderBy(F.col("gap_hours").desc(), t)
    return d.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top).select(
        *keys, C.from_micros(f"prev.{t}").alias("previous_time"), C.from_micros(t).alias("time"), "gap_hours")


def correlations(wide: DataFrame, target: str, others: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column with the target, strongest first, from one pass."""
    one = wide.agg(*[F.corr(target, x).alias(x) for x in others])
    return one.unpivot([], list(others), "name", "r").filter("r IS NOT NULL").orderBy(F.abs("r").desc(), "name")


def correlated_pairs(wide: DataFrame, columns: Sequence[str], threshold: float = 0.995) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    one = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r").filter(F.abs("r") > threshold)


# --- operating state ----------------------------------------------------------------


def operating_state(feed, mean, shutdown: float = 0.10, transition: float = 0.60):
    share = C.c(feed) / C.c(mean)
    return F.when(share.isNull(), "unknown").when(share < shutdown, "shutdown").when(share < transition, "transition").otherwise("normal")


def load_severity(values: dict[str, tuple], cap: float = 12.0):
    """Largest positive z of the load signals over ``cap``; NULL when any signal is missing. ``values[name] = (x, mean, std)``."""
    zs = [F.greatest(F.lit(0.0), (C.c(x) - C.c(m)) / C.c(s)) for x, m, s in values.values()]
    known = None
    for x, _, _ in values.values():
        known = C.c(x).isNotNull() if known is None else known & C.c(x).isNotNull()
    return F.when(known, (F.greatest(*zs) if len(zs) > 1 else zs[0]) / cap)


def severity_class(index):
    i = C.c(index)
    return F.when(i > 2 / 3, "high").when(i > 1 / 3, "elevated").when(i.isNotNull(), "normal")
