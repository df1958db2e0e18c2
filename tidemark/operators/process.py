"""Process operators: formula status, laboratory diagnostics, physics features, step responses, resampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import CHUNK, last_where, neighbour

SLOT = 10 * C.MINUTE


def formula_status(unresolved: Column, values: Column, freshness: Column, flags: Column) -> Column:
    """First blocking cause of a formula from its input arrays (values, freshness, flag texts), else ok."""
    bad = F.exists(flags, lambda x: F.contains(x, F.lit("invalid")) | F.contains(x, F.lit("conflict")))
    odd = F.exists(flags, lambda x: F.contains(x, F.lit("flatline")) | F.contains(x, F.lit("suspect")))
    return (F.when(unresolved, "unresolved").when(F.exists(values, lambda x: x.isNull()), "missing").when(F.exists(freshness, lambda x: x != "fresh"), "stale")
            .when(bad, "unreliable").when(odd, "diagnostic_only").otherwise("ok"))


# --- laboratory diagnostics ------------------------------------------------------------


def latest_samples(obs: DataFrame, at: int, n: int = 3, delay: int = C.LAB_DELAY_MINUTES * C.MINUTE) -> DataFrame:
    """Newest ``n`` distinct published sample times per metric, copies reconciled, flagged samples kept.

    Copies are merged first, so the rank runs over one row per sample and its limit applies before the shuffle.
    """
    rows = obs.filter(F.col("t") <= at - delay)
    marks = F.split("flags", r"\|")
    g = rows.groupBy("metric_id", "t").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("copies"), F.count(C.finite("value")).alias("finite"),
        *[F.max(F.array_contains(marks, f)).alias(f"_{f}") for f in C.UNUSABLE_FLAGS],
        F.min("unit").alias("unit_lo"), F.max("unit").alias("unit_hi"), F.count("unit").alias("units"))
    conflict = (F.col("lo") != F.col("hi")) | F.col("_conflict")
    invalid = (F.col("finite") < F.col("copies")) | F.col("_invalid")
    g = g.withColumn("flags", C.pack_flags(conflict=F.coalesce(conflict, F.lit(False)), invalid=F.coalesce(invalid, F.lit(False)), **{f: F.col(f"_{f}") for f in ("suspect", "flatline", "gap")}))
    g = g.withColumn("value", F.when(F.col("lo") == F.col("hi"), F.col("lo")))
    g = g.withColumn("unit", F.when((F.col("unit_lo") == F.col("unit_hi")) & (F.col("units") == F.col("copies")), F.col("unit_lo")))
    w = Window.partitionBy("metric_id").orderBy(F.col("t").desc())
    return g.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("metric_id", "t", "rn", "value", "unit", "flags", "copies")


def usable_sample(at: int, fresh_minutes: Mapping[str, int] | int, units: DataFrame | None = None) -> tuple[Column, Column]:
    """(valid value?, reasons) of a reconciled sample joined with its ``expected_unit``."""
    bad = F.col("flags") != ""
    units_ok = F.col("unit").eqNullSafe(F.col("expected_unit")) & F.col("expected_unit").isNotNull()
    age = (F.lit(at) - F.col("t")) / C.MINUTE
    valid = F.col("value").isNotNull() & ~bad & units_ok
    return valid, C.reasons((F.col("value").isNull() | bad, "unreliable"), (~units_ok, "unit_not_confirmed"), (age > fresh_minutes, "stale"))


def median_of_latest(samples: DataFrame, at: int, max_age: int = 48 * C.HOUR) -> DataFrame:
    """Median of the latest samples, only if all are clean and the newest is recent; a bad one is not replaced."""
    ok = F.col("value").isNotNull() & (F.col("flags") == "")
    g = samples.groupBy("metric_id").agg(F.bool_and(ok).alias("clean"), F.max("t").alias("t"), F.array_sort(F.collect_list("value")).alias("v"))
    return g.select("metric_id", F.when(F.col("clean") & (F.lit(at) - F.col("t") <= max_age), C.median_of(F.col("v"))).alias("estimate"),
                    "clean", (F.lit(at) - F.col("t") <= max_age).alias("recent"))


# --- physics -----------------------------------------------------------------------------


def physics(temp, pressure, flow, gas) -> dict[str, Column]:
    """Guarded ratios, inverse Kelvin and logs; NULL outside the positive domain."""
    pos = lambda x: F.when(C.c(x) > 0, C.c(x))
    kelvin, p, f, g = pos(temp) + 273.15, pos(pressure), pos(flow), pos(gas)
    return {"kelvin": kelvin, "inverse_kelvin": 1000 / kelvin, "log_pressure": F.ln(p), "log_flow": F.ln(f), "gas_oil": g / f, "log_gas_oil": F.ln(g / f)}


def balance(features: Mapping[str, tuple[str, str | None, str]]) -> list[Column]:
    """Difference / ratio / value of tag pairs; a zero denominator gives NULL."""
    out = []
    for name, (a, b, kind) in features.items():
        e = F.col(a) if kind == "value" else F.col(a) - F.col(b) if kind == "difference" else F.when(F.col(b) != 0, F.col(a) / F.col(b))
        out.append(e.alias(name))
    return out


def kinetic_prediction(last, feed0, temp0, pressure0, flow0, feed, temp, pressure, flow, energy: Column, order: Column) -> tuple[Column, Column]:
    """(prediction, anchored?) of the first-order response anchored at the last published sample.

    Exposure comes from the sample; the new severity scales it with temperature, pressure and flow. Falls back to
    the last value when an input is missing or not positive.
    """
    cols = [C.c(x) for x in (last, feed0, temp0, pressure0, flow0, feed, temp, pressure, flow)]
    la, s0, t0, p0, f0, s, t, p, f = cols
    ok = F.lit(True)
    for x in cols:
        ok = ok & F.coalesce(x > 0, F.lit(False))
    ok = ok & F.coalesce(s0 > la, F.lit(False))
    heat = F.greatest(F.lit(-15.0), F.least(F.lit(15.0), energy / 8.314 * (1 / t0 - 1 / t)))
    severity = F.exp(heat) * F.pow(p / p0, order) * (f0 / f)
    return F.when(ok, s * F.exp(-F.ln(s0 / la) * severity)).otherwise(la), ok


# --- resampling and step responses -------------------------------------------------------------


def resample_last(series: DataFrame, slot: int = SLOT) -> DataFrame:
    """Last reading per metric and slot (slot index = floor(t / slot)); combines map-side."""
    return series.filter(F.col("value").isNotNull()).groupBy("metric_id", C.bucket("t", slot).alias("slot")).agg(F.max_by("value", "t").alias("value"))


def regular_grid(slots: DataFrame, keys: Sequence[str] = ("metric_id",), chunk: int = 144) -> DataFrame:
    """Every slot between the first and last of the key, missing ones NULL; generated chunk by chunk."""
    e = slots.groupBy(*keys).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    e = e.withColumn("c", F.explode(F.sequence(C.bucket("lo", chunk), C.bucket("hi", chunk))))
    g = e.withColumn("slot", F.explode(F.sequence(F.greatest(F.col("lo"), F.col("c") * chunk), F.least(F.col("hi"), F.col("c") * chunk + chunk - 1)))).select(*keys, "slot")
    return g.join(slots, [*keys, "slot"], "left")


def every_nth(grid: DataFrame, n: int = 3) -> DataFrame:
    return grid.filter(F.pmod("slot", F.lit(n)) == 0)


def slot_frames(slots: DataFrame, aggs: Mapping[str, tuple[Column, int, int]], before: int, after: int, width: int = 1008) -> DataFrame:
    """Aggregates over slots ``[i + lo, i + hi]`` of each row; halo slots are copied to neighbouring chunks.

    Slots are already one row per time step, so a chunk holds at most ``width + before + after`` rows.
    """
    own = C.bucket("slot", width)
    near = F.sequence(C.bucket(F.col("slot") - after, width), C.bucket(F.col("slot") + before, width))
    d = slots.withColumn("_own", own).withColumn(CHUNK, F.explode(near))
    for name, (e, lo, hi) in aggs.items():
        d = d.withColumn(name, e.over(Window.partitionBy(CHUNK).orderBy("slot").rangeBetween(lo, hi)))
    return d.filter(F.col(CHUNK) == F.col("_own")).drop("_own", CHUNK)


def step_events(wide: DataFrame, signal: str, specs: Mapping[str, tuple[float, bool]], regime: Column, quiet_share: float = 1 / 3,
                hours: int = 6, per_hour: int = 6, merged: bool = False) -> DataFrame:
    """Step events of each control with the signal's response by hour, divided by the step.

    ``wide`` has one row per slot (columns signal and controls).  A candidate is a one-hour change at or above the
    control's threshold inside the regime while every other control moved less than its share.  With ``merged``
    candidates at most an hour apart form one event: base before the first, response after the last, size = the
    largest step.
    """
    h, half = per_hour, per_hour // 2
    sig = F.when(regime, F.col(signal))
    d = wide.withColumn("_s", sig).withColumn("_ok", regime)
    aggs = {f"_p_{c}": (F.max(c), -h, -h) for c in specs}
    aggs["_base"] = (F.avg("_s"), -h, -1)
    for k in range(1, hours + 1):
        aggs[f"_r{k}"] = (F.avg("_s"), k * h - half, k * h + half - 1)
    d = slot_frames(d, aggs, h, (hours + 1) * h)
    for c, (_, relative) in specs.items():
        prev = F.col(f"_p_{c}")
        d = d.withColumn(f"_d_{c}", F.when(prev != 0, (F.col(c) / prev - 1) * 100) if relative else F.col(c) - prev)
    lim = wide.agg(F.min("slot").alias("_first"), F.max("slot").alias("_last"))
    d = d.join(F.broadcast(lim))  # one row
    out = None
    for c, (threshold, _) in specs.items():
        quiet = F.lit(True)
        for o, (t, _) in specs.items():
            if o != c:
                quiet = quiet & (F.abs(f"_d_{o}") < t * quiet_share)
        cand = d.filter(F.coalesce((F.abs(f"_d_{c}") >= threshold) & F.col("_ok") & quiet, F.lit(False))).withColumn("control", F.lit(c)).withColumn("step", F.col(f"_d_{c}"))
        cand = cand.select("control", "slot", "step", "_base", "_first", "_last", *[f"_r{k}" for k in range(1, hours + 1)])
        out = cand if out is None else out.unionByName(cand)
    if merged:
        out = _merge_candidates(out, h, hours)
    else:
        out = out.withColumn("first_slot", F.col("slot")).withColumn("last_slot", F.col("slot"))
    reach = (hours + 1) * h - half  # the last slot the response reads, one past
    out = out.filter((F.col("first_slot") - h >= F.col("_first")) & (F.col("last_slot") + reach <= F.col("_last")) & F.col("_base").isNotNull() & (F.col("step") != 0))
    for k in range(1, hours + 1):
        out = out.filter(F.col(f"_r{k}").isNotNull())
    return out.select("control", "first_slot", "last_slot", "step", *[((F.col(f"_r{k}") - F.col("_base")) / F.col("step")).alias(f"h{k}") for k in range(1, hours + 1)])


def _merge_candidates(cand: DataFrame, gap: int, hours: int) -> DataFrame:
    d = neighbour(cand, ["control"], "slot", [], [], 1008, "prev")
    new = F.col("prev").isNull() | (F.col("slot") - F.col("prev.slot") > gap)
    d = last_where(d, ["control"], ["slot"], new, F.col("slot"), "first_slot")
    at_last = lambda x: F.max_by(x, "slot").alias(x)
    # The earliest of the largest steps gives the size.
    biggest = F.max(F.struct(F.abs("step").alias("a"), (-F.col("slot")).alias("n"), F.col("step"))).getField("step").alias("step")
    return d.groupBy("control", "first_slot").agg(
        F.max("slot").alias("last_slot"), F.min_by("_base", "slot").alias("_base"), F.max("_first").alias("_first"), F.max("_last").alias("_last"), biggest,
        *[at_last(f"_r{k}") for k in range(1, hours + 1)])


def response_summary(events: DataFrame, hours: int = 6, keys: Sequence[str] = ("control",)) -> DataFrame:
    """Median response by hour, plateau (median of hours 2-4) and the first hour reaching 80% of it.

    Events are moves of one control, at most one per slot, so a group's values fit a percentile buffer.
    """
    d = events.groupBy(*keys).agg(F.count("*").alias("events"), *[F.percentile(f"h{k}", F.lit(0.5)).alias(f"h{k}") for k in range(1, hours + 1)])
    d = d.withColumn("coefficient", C.median_of(F.array("h2", "h3", "h4")))
    hit = lambda k: F.abs(f"h{k}") >= 0.8 * F.abs("coefficient")
    return d.withColumn("lag_minutes", F.when(hit(1), 60).when(hit(2), 120).when(hit(3), 180).otherwise(60))


def response_bootstrap(events: DataFrame, draws: int = 200, hours: int = 6) -> DataFrame:
    """Spread of the plateau under resampling of whole events: standard error and 80% interval per control.

    Events are few (operator moves); they are numbered per control and drawn by a hash.
    """
    e = events.withColumn("i", (F.row_number().over(Window.partitionBy("control").orderBy("first_slot")) - 1).cast("long"))
    n = e.groupBy("control").agg(F.count("*").alias("n"))
    d = n.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long")))).withColumn("slot_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    d = d.withColumn("i", C.drawn(F.col("n"), "control", "draw", "slot_no")).drop("n")
    s = response_summary(d.join(e, ["control", "i"]), hours, ["control", "draw"])
    return s.groupBy("control").agg(F.stddev_pop("coefficient").alias("se"), F.percentile("coefficient", F.lit(0.1)).alias("ci_low"), F.percentile("coefficient", F.lit(0.9)).alias("ci_high"))
