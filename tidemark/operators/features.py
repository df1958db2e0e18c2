"""Past-only features at prediction moments (origins), analyser cleaning, laboratory anchoring, support gates.

Series are rows ``(metric_id, t, value)`` with one valid reading per (metric, t).  Origins are rows with a long
``origin``.  Nothing here reads past an origin: every lookup is an as-of or a window closed at the origin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import islands, trailing
from .timejoin import asof, published_asof, range_frame, window_means, window_merge

FRESH = 30 * C.MINUTE


def clean_analyser(series: DataFrame, low: float = 0.0, high: float = 100.0, tolerance: float = 0.01,
                   plateau: int = 60 * C.MINUTE, width: int = C.DAY) -> DataFrame:
    """NULL for readings outside the open range, flagged flatline, or on a plateau already ``plateau`` long.

    Looks backwards only: cleaning a prefix equals the prefix of the cleaned whole.
    """
    ok = (F.col("value") > low) & (F.col("value") < high) & ~C.has_flag(F.coalesce("flags", F.lit("")), "flatline")
    d = series.withColumn("value", F.when(ok, F.col("value")))
    same = F.coalesce(F.abs(F.col("value") - F.col("prev.value")) <= tolerance, F.lit(False))
    d = islands(d, ["metric_id"], "t", [], ~same, ["value"], width, "_start")
    stuck = ~F.col("_break") & (F.col("t") - F.col("_start") >= plateau)
    return d.withColumn("value", F.when(~stuck, F.col("value"))).drop("prev", "_break", "_start", "_chunk")


def lookup(origins: DataFrame, series: DataFrame, wants: Mapping[str, tuple[str, int]], tolerance: int = FRESH,
           width: int = C.DAY, with_time: bool = False) -> DataFrame:
    """One row per distinct origin; ``wants[name] = (metric, shift)`` is the as-of value at ``origin - shift``.

    All wanted metrics and shifts ride in one pass over the series.
    """
    specs = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m"), F.lit(s).cast("long").alias("s")) for n, (m, s) in wants.items()])
    probe = origins.select("origin").distinct().withColumn("_w", F.explode(specs)).select(
        "origin", F.col("_w.n").alias("name"), F.col("_w.m").alias("metric_id"), (F.col("origin") - F.col("_w.s")).alias("_at"))
    used = sorted({m for m, _ in wants.values()})
    rows = series.filter(F.col("metric_id").isin(*used) & F.col("value").isNotNull())
    hit = asof(probe, rows, ["metric_id"], "_at", "t", ["value"], [], tolerance, width, "hit")
    pick = [F.max(F.when(F.col("name") == n, F.col("hit.value"))).alias(n) for n in wants]
    if with_time:
        pick += [F.max(F.when(F.col("name") == n, F.col("hit.t"))).alias(f"{n}_t") for n in wants]
    return hit.groupBy("origin").agg(*pick)


def rolling(origins: DataFrame, series: DataFrame, metrics: Mapping[str, str], spans: Mapping[str, tuple[int, int, int]],
            width: int = C.DAY) -> DataFrame:
    """``<name>_<span>`` = mean of the metric over ``(origin + lo, origin + hi]`` with at least min_count readings."""
    label = F.create_map(*[F.lit(x) for n, m in metrics.items() for x in (m, n)])
    probe = origins.select("origin").distinct().withColumn("metric_id", F.explode(F.array(*[F.lit(m) for m in metrics.values()])))
    rows = series.filter(F.col("metric_id").isin(*metrics.values()))
    g = window_means(probe, rows, ["metric_id"], "origin", "t", "value", spans, width).withColumn("_n", label[F.col("metric_id")])
    return g.groupBy("origin").agg(*[F.max(F.when(F.col("_n") == n, F.col(s))).alias(f"{n}_{s}") for n in metrics for s in spans])


def centred_mean(origins: DataFrame, series: DataFrame, metrics: Mapping[str, str], shift: int = 0,
                 half: int = 30 * C.MINUTE, min_count: int = 2, width: int = C.DAY) -> DataFrame:
    """``<name>_level`` = mean over ``(origin + shift - half, origin + shift + half]``."""
    return rolling(origins, series, metrics, {"level": (shift - half, shift + half, min_count)}, width)


def previous_lab(origins: DataFrame, labs: DataFrame, delay: int = C.LAB_DELAY_MINUTES * C.MINUTE,
                 max_age: int = 48 * C.HOUR, width: int = C.DAY) -> DataFrame:
    """Last non-negative result published by the origin, NULL if sampled more than ``max_age`` before it."""
    rows = labs.filter(F.col("value") >= 0).select(F.lit(0).alias("_k"), "t", "value")
    j = published_asof(origins.select("origin").distinct().withColumn("_k", F.lit(0)), rows, ["_k"], "origin", "t", ["value"], delay, max_age, (), width)
    return j.select("origin", F.col("lab.t").alias("lab_sample_t"), F.col("lab.available_at").alias("lab_available_t"), F.col("lab.value").alias("previous_lab"))


def lab_history(labs: DataFrame, series: DataFrame, analysers: Mapping[str, str], keep: int, width: int = C.DAY) -> DataFrame:
    """Each lab sample with its last ``keep`` samples: struct(t, value, diff_<analyser>...), oldest first.

    ``diff`` = lab minus the analyser averaged +-30 min around sampling.  The array is bounded by ``keep``, so an
    origin later needs a single as-of hit instead of a range join.
    """
    rows = labs.filter(F.col("value") >= 0).select("t", "value")
    level = centred_mean(rows.select(F.col("t").alias("origin")), series, analysers, width=width).withColumnRenamed("origin", "t")
    rows = rows.join(level, "t", "left").withColumn("_k", F.lit(0))
    diffs = []
    for n in analysers:
        rows = rows.withColumn(f"diff_{n}", F.col("value") - F.col(f"{n}_level"))
        diffs.append(f"diff_{n}")
    return trailing(rows, ["_k"], "t", [], ["value", *diffs], keep, max(width, C.DAY), "recent").select("_k", "t", "recent")


def anchor_at(origins: DataFrame, history: DataFrame, delay: int, max_age: int, width: int = C.DAY) -> DataFrame:
    """Origins with ``recent`` = bounded array of published samples not older than ``max_age``."""
    h = history.withColumn("_available", F.col("t") + F.lit(delay))
    j = asof(origins.select("origin").distinct().withColumn("_k", F.lit(0)), h, ["_k"], "origin", "_available", ["recent"], [], None, width, "_h")
    return j.select("origin", F.filter(F.coalesce(F.col("_h.recent"), F.array().cast(h.schema["recent"].dataType)), lambda x: x.t >= F.col("origin") - max_age).alias("recent"))


def last_n(array: Column, n: int) -> Column:
    return F.when(F.size(array) > n, F.slice(array, F.size(array) - n + 1, n)).otherwise(array)


def lab_anchor(origins: DataFrame, labs: DataFrame, series: DataFrame, analysers: Mapping[str, str], samples: int = 10,
               level_samples: int = 5, max_age: int = 45 * C.DAY, delay: int = C.LAB_DELAY_MINUTES * C.MINUTE,
               width: int = C.DAY) -> DataFrame:
    """Level = median of the last labs; offset = median (lab - analyser); number of usable pairs."""
    h = lab_history(labs, series, analysers, max(samples, level_samples), width)
    a = anchor_at(origins, h, delay, max_age, width)
    cols = ["origin", C.median_of(F.transform(last_n(F.col("recent"), level_samples), lambda x: x.value)).alias("level")]
    for n in analysers:
        d = F.transform(last_n(F.col("recent"), samples), lambda x: x[f"diff_{n}"])
        cols += [C.median_of(d).alias(f"offset_{n}"), F.size(F.filter(d, lambda x: x.isNotNull())).alias(f"pairs_{n}")]
    return a.select(*cols)


def anchored_features(origins: DataFrame, series: DataFrame, labs: DataFrame, analysers: Mapping[str, str],
                      controls: Mapping[str, str], max_lab_age: int = 48 * C.HOUR, anchor_age: int = 45 * C.DAY,
                      samples: int = 10, level_samples: int = 5, width: int = C.DAY) -> DataFrame:
    """Lab-anchored feature frame per origin (controls keyed T, F, P; F enters as a log change)."""
    T, Fl, P = controls["T"], controls["F"], controls["P"]
    wants = {n: (m, 0) for n, m in analysers.items()}
    wants |= {"T": (T, 0), "F": (Fl, 0), "P": (P, 0), "T1": (T, C.HOUR), "T3": (T, 3 * C.HOUR), "F3": (Fl, 3 * C.HOUR), "P3": (P, 3 * C.HOUR)}
    now = lookup(origins, series, wants, FRESH, width)
    means = rolling(origins, series, analysers, {"1h": (-C.HOUR, 0, 3), "24h": (-24 * C.HOUR, 0, 36)}, width)
    anchor = lab_anchor(origins, labs, series, analysers, samples, level_samples, anchor_age, width=width)
    prev = previous_lab(origins, labs, max_age=max_lab_age, width=width)
    f = now.join(means, "origin").join(anchor, "origin").join(prev, "origin")
    cols = ["origin"]
    for n in analysers:
        off = F.col(f"offset_{n}")
        cols += [C.floored_ln(F.col(n) + off).alias(f"ln_{n}"), C.floored_ln(F.col(f"{n}_1h") + off).alias(f"ln_{n}_1h"),
                 C.floored_ln(F.col(f"{n}_24h") + off).alias(f"ln_{n}_24h")]
    cols += [C.floored_ln("level").alias("ln_level"), C.floored_ln("previous_lab").alias("ln_previous_lab"),
             (F.col("T") - F.col("T1")).alias("dT_1h"), (F.col("T") - F.col("T3")).alias("dT_3h"),
             (C.floored_ln("F") - C.floored_ln("F3")).alias("dlnF_3h"), (F.col("P") - F.col("P3")).alias("dP_3h"),
             "T", "F", "P", "level", "previous_lab", "lab_sample_t", "lab_available_t"]
    cols += [x for n in analysers for x in (n, f"offset_{n}", f"pairs_{n}")]
    return f.select(*cols)


def dynamics_features(origins: DataFrame, series: DataFrame, analysers: Mapping[str, str], controls: Mapping[str, str],
                      width: int = C.DAY) -> DataFrame:
    """Raw analyser history and control moves per origin; no laboratory input."""
    hours = (1, 3, 6)
    wants = {n: (m, 0) for n, m in {**analysers, **controls}.items()}
    wants |= {f"{k}{h}": (m, h * C.HOUR) for k, m in controls.items() for h in hours}
    now = lookup(origins, series, wants, FRESH, width)
    spans = {"1h": (-C.HOUR, 0, 3), "6h": (-6 * C.HOUR, 0, 18), "24h": (-24 * C.HOUR, 0, 36)}
    f = now.join(rolling(origins, series, analysers, spans, width), "origin")
    cols = ["origin"]
    for n in analysers:
        cols += [C.floored_ln(n).alias(f"ln_{n}_raw")] + [C.floored_ln(f"{n}_{s}").alias(f"ln_{n}_raw_{s}") for s in spans]
    for h in hours:
        cols += [(F.col("T") - F.col(f"T{h}")).alias(f"dT_{h}h"), (C.floored_ln("F") - C.floored_ln(f"F{h}")).alias(f"dlnF_{h}h"),
                 (F.col("P") - F.col(f"P{h}")).alias(f"dP_{h}h")]
    return f.select(*cols, "T", "F", "P")


def telemetry_features(origins: DataFrame, series: DataFrame, metrics: Mapping[str, str], width: int = C.DAY) -> DataFrame:
    """Current value and 1 h / 6 h means per metric, all NULL unless the reading is fresh; newest reading time used."""
    now = lookup(origins, series, {n: (m, 0) for n, m in metrics.items()}, FRESH, width, with_time=True)
    means = rolling(origins, series, metrics, {"mean_1h": (-C.HOUR, 0, 1), "mean_6h": (-6 * C.HOUR, 0, 1)}, width)
    f = now.join(means, "origin")
    keep = [F.when(F.col(f"{n}_t").isNotNull(), F.col(f"{n}_{s}")).alias(f"{n}_{s}") for s in ("mean_1h", "mean_6h") for n in metrics]
    return f.select("origin", *metrics, *keep, F.greatest(*[F.col(f"{n}_t") for n in metrics]).alias("newest_t"))


def quiet_path(origins: DataFrame, series: DataFrame, metric: str, horizon: int, limit: float, log: bool = False,
               max_gap: int = FRESH, width: int = C.DAY) -> DataFrame:
    """True where the control stays within ``limit`` of its origin value over ``(origin, origin + horizon]`` and is observed throughout."""
    from .ordered import neighbour
    rows = series.filter((F.col("metric_id") == metric) & F.col("value").isNotNull()).select(
        F.lit(0).alias("_k"), "t", (C.floored_ln("value") if log else F.col("value")).alias("x"))
    rows = neighbour(rows, ["_k"], "t", [], [], width, "prev").withColumn("gap", F.col("t") - F.col("prev.t")).drop("_chunk", "prev")
    o = origins.select("origin").distinct().withColumn("_k", F.lit(0))
    ref = asof(o, rows, ["_k"], "origin", "t", ["x"], [], max_gap, width, "ref")
    path = window_merge(o, rows, ["_k"], "origin", "t", 0, horizon, {
        "hi": ("max", "x"), "lo": ("min", "x"), "n": ("count", "x"), "gap_max": ("max", "gap"), "last_t": ("max", "t")}, width)
    d = ref.join(path, ["_k", "origin"])
    quiet = (
        F.col("ref").isNotNull() & (F.col("n") > 0) & (F.greatest(F.col("hi") - F.col("ref.x"), F.col("ref.x") - F.col("lo")) < limit)
        & (F.col("gap_max") <= max_gap) & (F.col("origin") + horizon - F.col("last_t") <= max_gap))
    return d.select("origin", F.coalesce(quiet, F.lit(False)).alias("quiet"))


def lab_window(origins: DataFrame, labs: DataFrame, days: int = 7, delay: int = C.LAB_DELAY_MINUTES * C.MINUTE, width: int = C.DAY) -> DataFrame:
    """Published labs at the origin: median of last 3, last change, count and median over the last days."""
    rows = labs.select(F.lit(0).alias("_k"), (F.col("t") + delay).alias("p"), "value")
    o = origins.select("origin").distinct().withColumn("_k", F.lit(0))
    h = trailing(rows, ["_k"], "p", [], ["value"], 3, width, "last3").select("_k", "p", "last3")
    recent = asof(o, h, ["_k"], "origin", "p", ["last3"], [], None, width, "h")
    win = range_frame(o, rows, ["_k"], "origin", "p", ["value"], -days * C.DAY, 0,
                      {"n": F.count("value"), "m": F.percentile("value", F.lit(0.5))}, width)
    live = F.transform(F.filter("h.last3", lambda x: x.p > F.col("origin") - days * C.DAY), lambda x: x.value)
    return recent.join(win, ["_k", "origin"]).withColumn("_l", live).select(
        "origin", C.median_of(F.col("_l")).alias("lab_median3"), F.col("m").alias("lab_median_window"), F.col("n").alias("lab_count_window"),
        F.when(F.size("_l") > 1, F.element_at("_l", -1) - F.element_at("_l", -2)).alias("lab_delta"))


def origin_grid(series: DataFrame, step: int = 30 * C.MINUTE, lead: int = 24 * C.HOUR) -> DataFrame:
    """Origins every ``step`` from one day after the first full hour to the last reading."""
    e = series.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    first = F.ceil(F.col("lo") / C.HOUR).cast("long") * C.HOUR + lead
    # A grid is bounded by the calendar (48 origins a day); it is unfolded per day from one row.
    days = e.select(F.explode(F.sequence(C.bucket(first, C.DAY), C.bucket("hi", C.DAY))).alias("d"), first.alias("first"), "hi")
    return days.withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(C.DAY - step), F.lit(step)))).select(
        (F.col("d") * C.DAY + F.col("origin")).alias("origin"), "first", "hi").filter(
        (F.col("origin") >= F.col("first")) & (F.col("origin") <= F.col("hi"))).select("origin")


def applicability(frame: DataFrame, support: DataFrame, columns: Sequence[str], evidence: Sequence[str], controls: Sequence[str],
                  pairs: str | None = None, max_missing: float = 0.34, max_ood: float = 0.20, max_z: float = 8.0,
                  min_pairs: int = 3) -> DataFrame:
    """Gate per row against one-row (or per-key) ``support`` columns lower_/upper_/mean_/scale_<column> already joined in ``frame``.

    Adds missing_fraction, ood_fraction, max_abs_z, abstain reasons (pipe joined) and status.
    """
    d = frame.join(F.broadcast(support)) if support is not None else frame
    known = {x: C.finite(x).isNotNull() for x in columns}
    ood = {x: F.coalesce(known[x] & ((F.col(x) < F.col(f"lower_{x}")) | (F.col(x) > F.col(f"upper_{x}"))), F.lit(False)) for x in columns}
    total = lambda conds: reduce(lambda a, b: a + b, [k.cast("int") for k in conds])
    n_known, n_ood = total(known.values()), total(ood.values())
    zs = [F.abs((F.col(x) - F.col(f"mean_{x}")) / F.col(f"scale_{x}")) for x in columns]
    d = d.withColumn("missing_fraction", 1 - n_known / len(columns)).withColumn("ood_fraction", n_ood / F.greatest(F.lit(1), n_known))
    d = d.withColumn("max_abs_z", F.greatest(*zs))
    any_of = lambda xs, m: reduce(lambda a, b: a | b, [m[x] for x in xs])
    checks = [(~any_of(evidence, known), "no_evidence"), (~any_of(controls, known), "no_control_telemetry"),
              (F.col("missing_fraction") > max_missing, "too_many_missing_features"),
              (any_of(controls, ood) | (F.col("ood_fraction") > max_ood) | F.coalesce(F.col("max_abs_z") > max_z, F.lit(False)), "outside_training_support")]
    if pairs:
        checks.append((F.col(pairs) < min_pairs, "insufficient_lab_anchor"))
    d = d.withColumn("abstain_reasons", F.array_join(C.reasons(*checks), "|"))
    return d.withColumn("status", F.when(F.col("abstain_reasons") == "", "ok").otherwise("abstain"))


def in_regime(envelope: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """All named columns strictly inside their (low, high); NULL counts as outside."""
    parts = []
    for x, (low, high) in envelope.items():
        if low is not None:
            parts.append(F.col(x) > low)
        if high is not None:
            parts.append(F.col(x) < high)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))
