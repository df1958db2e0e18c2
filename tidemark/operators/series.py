"""Statistics, down-sampling, durations and snapshots over observation rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import neighbour
from .quantiles import PER_RANGE, quantiles
from .timejoin import asof

QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def period_statistics(obs: DataFrame, start: int, end: int, exclude_suspect: bool = False,
                      per_range: int = PER_RANGE) -> DataFrame:
    """Per metric over ``[start, end)`` with the preceding equal-length period's median beside it.

    Every aggregate combines map-side; the quantiles are taken over counted values.
    """
    previous = start - (end - start)
    v = C.valid_value("value", "flags", exclude_suspect)
    base = obs.filter((F.col("t") >= previous) & (F.col("t") < end)).select(
        "metric_id", "t", "source_row", (F.col("t") >= start).alias("current"), v.alias("v"),
        (~C.is_valid()).alias("bad"), C.is_suspect().alias("odd"))
    now = F.col("current")
    v, seen = F.when(now, F.col("v")), now & F.col("v").isNotNull()
    at_first = F.when(seen, F.struct("t", "source_row"))
    out = base.groupBy("metric_id").agg(
        F.count_if(now).alias("_rows"), F.count(v).alias("count"), F.count_if(now & F.col("bad")).alias("invalid_count"), F.count_if(now & F.col("odd")).alias("suspect_count"),
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("range"),
        F.min(F.when(seen, F.struct("v", "t"))).getField("t").alias("min_t"),
        F.max(F.when(seen, F.struct("v", (-F.col("t")).alias("n")))).getField("n").alias("max_n"),
        F.min_by("v", at_first).alias("first"), F.max_by("v", at_first).alias("last"),
        F.min(F.when(seen, F.col("t"))).alias("first_t"), F.max(F.when(seen, F.col("t"))).alias("last_t")).filter("_rows > 0")
    q = quantiles(base, ["metric_id", "current"], "v", list(QUANTILES.values()), list(QUANTILES), per_range)
    q = q.groupBy("metric_id").agg(*[F.max(F.when(now, F.col(n))).alias(n) for n in QUANTILES], F.max(F.when(~now, F.col("median"))).alias("previous_median"))
    out = out.join(q, "metric_id", "left")
    return out.select(
        "metric_id", "count", "invalid_count", "suspect_count", "mean", "min", "max", "std", "range",
        C.from_micros("min_t").alias("min_at"), C.from_micros(-F.col("max_n")).alias("max_at"),
        "p05", "median", "p95", (F.col("p75") - F.col("p25")).alias("iqr"),
        "first", "last", C.from_micros("first_t").alias("first_at"), C.from_micros("last_t").alias("last_at"),
        (F.col("last") - F.col("first")).alias("change"), "previous_median",
        (F.col("median") - F.col("previous_median")).alias("median_change"))


def exceedance(obs: DataFrame, limit: float, exclude_suspect: bool = False) -> DataFrame:
    return obs.filter(C.is_valid("value", "flags", exclude_suspect)).groupBy("metric_id").agg(
        F.count("*").alias("count"), F.count_if(F.col("value") > limit).alias("exceed_count"),
        F.avg(F.when(F.col("value") > limit, 1.0).otherwise(0.0)).alias("exceed_fraction"))


def held_minutes(obs: DataFrame, start: int, end: int, hold: int, width: int = C.DAY) -> DataFrame:
    """Each reading is held until the next one, at most ``hold``; clipped to ``[start, end)``.

    History starts one hold earlier, so a reading before the period can cover its beginning.
    """
    rows = obs.filter((F.col("t") >= start - hold) & (F.col("t") < end))
    rows = neighbour(rows, ["metric_id"], "t", ["source_row"], [], width, "next", ahead=True)
    until = F.least(F.coalesce(F.col("next.t"), F.col("t") + hold), F.col("t") + hold, F.lit(end))
    return rows.withColumn("minutes", F.greatest(F.lit(0), until - F.greatest(F.col("t"), F.lit(start))) / C.MINUTE).drop("next", "_chunk")


def durations(obs: DataFrame, start: int, end: int, limit: float, hold: int = 10 * C.MINUTE, width: int = C.DAY) -> DataFrame:
    """Observed, exceeding and suspect minutes per metric, and the observed share of the period."""
    good = C.is_valid("value", "flags", True)
    d = held_minutes(obs, start, end, hold, width).groupBy("metric_id").agg(
        F.sum(F.when(good, F.col("minutes")).otherwise(0.0)).alias("observed_minutes"),
        F.sum(F.when(good & (F.col("value") > limit), F.col("minutes")).otherwise(0.0)).alias("exceed_minutes"),
        F.sum(F.when(C.is_suspect(), F.col("minutes")).otherwise(0.0)).alias("suspect_minutes"))
    return d.withColumn("coverage", F.col("observed_minutes") / ((end - start) / C.MINUTE))


def composition(d: DataFrame, period_minutes: float) -> DataFrame:
    """Below / above / suspect / missing minutes and percent, one row each."""
    cap = lambda x, room: F.least(F.greatest(x, F.lit(0.0)), room)
    total = F.lit(float(period_minutes))
    above = cap(F.col("exceed_minutes"), total)
    below = cap(F.col("observed_minutes") - above, total - above)
    odd = cap(F.col("suspect_minutes"), total - above - below)
    missing = F.greatest(F.lit(0.0), total - above - below - odd)
    parts = [("below", below), ("above", above), ("suspect", odd), ("missing", missing)]
    return d.select("metric_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("part"), x.alias("minutes"), (x / total * 100).alias("percent")) for k, x in parts])))


def agreement(lab: DataFrame, analyser: DataFrame, tolerance: int = 10 * C.MINUTE, width: int = C.DAY) -> DataFrame:
    """Analyser minus lab over as-of pairs: n, bias, mean absolute error. Both sides carry t, value, source_row."""
    pairs = asof(lab.withColumn("_k", F.lit(0)), analyser.withColumn("_k", F.lit(0)), ["_k"], "t", "t", ["value"],
                 ["source_row"], tolerance, width, "near").filter(F.col("near").isNotNull())
    e = F.col("near.value") - F.col("value")
    return pairs.agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"))


def histogram(obs: DataFrame, bins: int = 20, exclude_suspect: bool = False) -> DataFrame:
    """Equal-width bins between the metric's minimum and maximum; last bin closed, empty bins kept."""
    v = obs.filter(C.is_valid("value", "flags", exclude_suspect)).select("metric_id", "value")
    span = v.groupBy("metric_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = span.withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0)))
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.col("w")).cast("int"))
    n = v.join(span, "metric_id").groupBy("metric_id", b.alias("bin")).agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))))
    return grid.join(n, ["metric_id", "bin"], "left").select(
        "metric_id", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("from"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("to"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def downsample(obs: DataFrame, start: int, end: int, limit: int = 600, exclude_suspect: bool = False,
               per_range: int = PER_RANGE) -> DataFrame:
    """At most ``limit`` peak-preserving points per metric; raw rows where the metric has few enough.

    Minimum and maximum come from every row of a bucket, so a single peak survives.
    """
    width = max(1.0, (end - start) / C.SECOND / limit)
    rows = obs.filter((F.col("t") >= start) & (F.col("t") < end)).select(
        "metric_id", "t", "source_row", "flags", C.valid_value("value", "flags", exclude_suspect).alias("v"))
    size = rows.groupBy("metric_id").agg(F.count("*").alias("_n"))
    rows = rows.join(size, "metric_id")
    few = rows.filter(F.col("_n") <= limit).select(
        "metric_id", "t", F.col("v").alias("value"), F.col("v").alias("min"), F.col("v").alias("max"), "flags", F.lit(1).cast("long").alias("count"),
        F.lit(False).alias("aggregated"))
    many = rows.filter(F.col("_n") > limit).withColumn("bucket", F.floor((F.col("t") - start) / C.SECOND / F.lit(width)))
    key = ["metric_id", "bucket"]
    flags = F.flatten(F.transform(F.collect_set("flags"), lambda x: F.split(x, r"\|")))
    flags = F.array_join(F.array_sort(F.array_distinct(F.filter(flags, lambda x: x != ""))), "|")
    out = many.groupBy(*key).agg(F.min("t").alias("t"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("count"), flags.alias("flags"))
    out = out.join(quantiles(many, key, "v", [0.5], ["value"], per_range), key, "left")
    return few.unionByName(out.select("metric_id", "t", "value", "min", "max", "flags", "count", F.lit(True).alias("aggregated")))


def gap_markers(points: DataFrame, start: int, end: int, limit: int = 600, continuous: bool = True) -> DataFrame:
    """Adds an empty point flagged ``gap`` where spacing exceeds max(20 min, two bucket widths).

    The input is already bounded by ``limit`` points per metric, so the window is small.
    """
    width = max(1.0, (end - start) / C.SECOND / limit)
    far, step = int(max(1200.0, width * 2) * C.SECOND), int(max(600.0, width) * C.SECOND)
    w = Window.partitionBy("metric_id").orderBy("t", "value")
    prev = F.lag("t").over(w)
    d = points.withColumn("_p", prev)
    marks = d.filter((F.col("t") - F.col("_p") > far) & F.lit(continuous)).select(
        "metric_id", (F.col("_p") + step).alias("t"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("min"),
        F.lit(None).cast("double").alias("max"), F.lit("gap").alias("flags"), F.lit(0).cast("long").alias("count"), "aggregated")
    return d.drop("_p").unionByName(marks)


def snapshot(obs: DataFrame, at: int, freshness: DataFrame, lab_delay: int = C.LAB_DELAY_MINUTES * C.MINUTE, catalog: DataFrame | None = None) -> DataFrame:
    """Newest reading per metric known at ``at``: value, age, change, freshness and reason; labs only once published.

    With a ``catalog`` (metric_id, source) every metric of it has a row: ``missing`` where nothing was known yet.
    The two newest rows are found with a rank limit that Spark applies before the shuffle.
    """
    cut = F.when(F.col("source") == "lims", F.lit(at - lab_delay)).otherwise(F.lit(at))
    newest = Window.partitionBy("metric_id").orderBy(F.col("t").desc(), F.col("source_row").desc())
    two = obs.filter(F.col("t") <= cut).withColumn("rn", F.row_number().over(newest)).filter("rn <= 2")
    ok = F.when(~C.has_flag("flags", "invalid") & ~C.has_flag("flags", "conflict"), C.finite("value"))
    one = lambda i, x: F.max(F.when(F.col("rn") == i, x))
    g = two.groupBy("metric_id").agg(
        one(1, F.col("source")).alias("source"), one(1, F.col("t")).alias("t"), one(1, ok).alias("value"),
        one(1, F.col("flags")).alias("flags"), one(2, ok).alias("prior"))
    age = (F.lit(at) - F.col("t")) / C.MINUTE
    if catalog is not None:
        known = catalog.select("metric_id", F.col("source").alias("_source"))
        g = known.join(g, "metric_id", "full_outer").withColumn("source", F.coalesce("source", "_source")).drop("_source")
    state = F.when(F.col("t").isNull(), "missing").when(age <= F.coalesce("fresh_minutes", F.lit(10)), "fresh").otherwise("stale")
    reason = F.when(F.col("t").isNull(), "no_reading").when(F.col("value").isNull(), "not_usable").when(state == "stale", "older_than_limit").otherwise("")
    return g.join(F.broadcast(freshness), "source", "left").select(
        "metric_id", "source", "value", C.from_micros("t").alias("timestamp"), age.alias("age_minutes"), F.coalesce("flags", F.lit("")).alias("flags"),
        state.alias("freshness"), reason.alias("reason"),
        (F.col("value") - F.col("prior")).alias("delta"),
        C.from_micros(F.when(F.col("source") == "lims", F.col("t") + lab_delay).otherwise(F.col("t"))).alias("available_at"))


def snapshot_alerts(snap: DataFrame, watched: Sequence[str], limit: float) -> DataFrame:
    """Danger above the limit, warnings for a missing or stale reading and for any quality flag."""
    rules = F.array_compact(F.array(
        F.when(F.col("value") > limit, F.struct(F.lit("danger").alias("severity"), F.lit("above_limit").alias("code"))),
        F.when(F.col("freshness") == "missing", F.struct(F.lit("warning").alias("severity"), F.lit("missing").alias("code"))),
        F.when(F.col("freshness") == "stale", F.struct(F.lit("warning").alias("severity"), F.lit("not_fresh").alias("code"))),
        F.when(F.col("flags") != "", F.struct(F.lit("warning").alias("severity"), F.lit("flagged").alias("code")))))
    return snap.filter(F.col("metric_id").isin(*watched)).select("metric_id", F.inline(rules))


def virtual_limit_metrics(obs: DataFrame, base: Sequence[str], limit: float) -> DataFrame:
    """Margin ``limit - v`` and excess ``max(v - limit, 0)`` of the base metrics, as further observations."""
    rows = obs.filter(F.col("metric_id").isin(*base))
    v = C.valid_value()
    kinds = F.array(
        F.struct(F.lit("margin").alias("kind"), (F.lit(limit) - v).alias("x")),
        F.struct(F.lit("excess").alias("kind"), F.when(v.isNotNull(), F.greatest(v - limit, F.lit(0.0))).alias("x")))
    return rows.withColumn("_k", F.explode(kinds)).select(
        F.concat(F.lit("derived."), F.col("_k.kind"), F.lit("."), "metric_id").alias("metric_id"),
        *[x for x in obs.columns if x not in ("metric_id", "value")], F.col("_k.x").alias("value"))


def virtual_difference(obs: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """``first - second`` at equal timestamps with both flag strings."""
    a = obs.filter(F.col("metric_id") == first).select("t", "timestamp", F.col("value").alias("x"), F.col("flags").alias("fx"), "source_row")
    b = obs.filter(F.col("metric_id") == second).select("t", F.col("value").alias("y"), F.col("flags").alias("fy"))
    return a.join(b, "t").select(
        F.lit(name).alias("metric_id"), "t", "timestamp", (F.col("x") - F.col("y")).alias("value"),
        C.concat_flags("fx", "fy").alias("flags"), "source_row")


def fraction_curve(obs: DataFrame, fractions: DataFrame, at: int) -> DataFrame:
    """Points of the newest moment with at least two distinct fraction metrics, and whether they rise.

    ``fractions`` is the small dimension (metric_id, fraction).
    """
    ok = obs.filter(C.is_valid("value", "flags", True) & (F.col("t") <= at)).join(F.broadcast(fractions), "metric_id")
    newest = ok.groupBy("t").agg(F.countDistinct("metric_id").alias("_n")).filter("_n >= 2").orderBy(F.col("t").desc()).limit(1).select("t")
    pts = ok.join(F.broadcast(newest), "t").groupBy("t", "metric_id", "fraction").agg(F.max_by("value", "source_row").alias("value"))
    w = Window.partitionBy("t").orderBy("fraction")
    whole = Window.partitionBy("t")
    return pts.withColumn("_up", F.coalesce(F.col("value") >= F.lag("value").over(w), F.lit(True))).select(
        C.from_micros("t").alias("timestamp"), "metric_id", "fraction", "value",
        F.min("_up").over(whole).alias("monotonic"), ((F.lit(at) - F.col("t")) / C.MINUTE).alias("age_minutes"))
