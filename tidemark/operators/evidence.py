"""What is known at each decision moment, and the named checks that a candidate has to pass.

One row is one moment, or one moment x candidate.  Readings of all roles ride in one as-of pass over the observations;
a moment's handful of readings then lie in its own row, so the evidence, its reasons and the gate are column logic.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import decide as K
from .evaluate import aged_lower_bound
from .ordered import neighbour
from .timejoin import asof

# Fixed limits of the product.
T95_MAX = 360.0
CETANE_MIN = 51.0
MAX_SAMPLE_DAYS = 60.0

NONE = "array<string>"


@dataclass(frozen=True)
class Role:
    """A metric in one use; the source class decides publication delay and freshness."""

    metric: str
    source: str


@dataclass(frozen=True)
class Roles:
    lab: Role
    analysers: Mapping[str, Role]
    controls: Mapping[str, Role]
    t95: Role
    cetane: Role
    pressure_drop: Role
    soft: Role | None = None

    def all(self) -> dict[str, Role]:
        rest = {"lab": self.lab, "t95": self.t95, "cetane": self.cetane, "pressure_drop": self.pressure_drop}
        return rest | ({"soft": self.soft} if self.soft else {}) | dict(self.analysers) | dict(self.controls)


# --- readings ---------------------------------------------------------------------------


def readings_at(moments: DataFrame, obs: DataFrame, roles: Mapping[str, Role], key: str = "moment",
                delay: int = C.LAB_DELAY_MINUTES * C.MINUTE, width: int = C.DAY) -> DataFrame:
    """Per distinct moment one struct column per role: the newest reading known then, whether usable or not.

    struct(value, t, age_minutes, flags, freshness, delta, available); ``value`` is NULL for invalid and conflicting rows,
    ``delta`` the change from the row before.  Equal times are ordered by ``source_row``.  Laboratory rows count from their
    publication on.  Rows without a moment are left out; a role without any reading is ``missing``.
    """
    ok = F.when(~C.has_flag(F.coalesce("flags", F.lit("")), "invalid") & ~C.has_flag(F.coalesce("flags", F.lit("")), "conflict"), C.finite("value"))
    rows = obs.filter(F.col("metric_id").isin(*{r.metric for r in roles.values()})).select("metric_id", "t", "source_row", ok.alias("value"), F.coalesce("flags", F.lit("")).alias("flags"))
    rows = neighbour(rows, ["metric_id"], "t", ["source_row"], ["value"], width, "_p").withColumn("prior", F.col("_p.value")).drop("_p", "_chunk")
    lag = lambda r: delay if r.source == "lims" else 0
    spec = F.array(*[F.struct(F.lit(n).alias("role"), F.lit(r.metric).alias("metric_id"), F.lit(lag(r)).cast("long").alias("lag"),
                              F.lit(C.FRESHNESS_MINUTES.get(r.source, 10)).alias("fresh")) for n, r in roles.items()])
    probe = moments.filter(F.col(key).isNotNull()).select(key).distinct().select(key, F.inline(spec)).withColumn("_at", F.col(key) - F.col("lag"))
    j = asof(probe, rows, ["metric_id"], "_at", "t", ["value", "flags", "prior"], ["source_row"], None, width, "h")
    age = (F.col(key) - F.col("h.t")) / C.MINUTE
    state = F.when(F.col("h").isNull(), "missing").when(age <= F.col("fresh"), "fresh").otherwise("stale")
    reading = F.struct(F.col("h.value").alias("value"), F.col("h.t").alias("t"), age.alias("age_minutes"), F.coalesce("h.flags", F.lit("")).alias("flags"),
                       state.alias("freshness"), (F.col("h.value") - F.col("h.prior")).alias("delta"), (F.col("h.t") + F.col("lag")).alias("available"))
    return j.select(key, "role", reading.alias("r")).groupBy(key).agg(*[F.any_value(F.when(F.col("role") == n, F.col("r")), ignoreNulls=True).alias(n) for n in roles])


# --- evidence ---------------------------------------------------------------------------


def _clean(r: Column) -> Column:
    return ~F.exists(F.split(r["flags"], r"\|"), lambda x: x.isin(*C.UNUSABLE_FLAGS))


def quality_evidence(readings: DataFrame, roles: Roles, anchors: DataFrame, drift: DataFrame, forecast: DataFrame, manual: DataFrame | None = None,
                     key: str = "moment", conflict_above: float = 2.0) -> DataFrame:
    """The evidence of each moment of ``readings``.

    ``anchors`` (key, offset_<analyser>, pairs_<analyser>), ``drift`` (key, pairs, sigma), ``forecast`` (key, nowcast, status,
    supported, alarm) and ``manual`` (key, manual_sulfur, manual_t95, manual_cetane) have at most one row per moment; a moment
    without one has no offset, the drift bound is then unknown, the forecast missing, nothing was entered by hand.

    The baseline is the entered value, else a supported nowcast, else the laboratory, the better analyser, the soft sensor.
    ``scenario_only`` marks moments with an entered baseline.  Analysers carry age, offset, adjusted value and number of
    pairs; they are compared after anchoring where both have an offset, raw otherwise, and only if both are fresh and clean.
    """
    names = list(roles.analysers)
    d = readings.join(anchors.select(key, *[x for n in names for x in (f"offset_{n}", f"pairs_{n}")]), key, "left")
    d = d.join(drift.select(key, F.col("pairs").alias("drift_pairs"), F.col("sigma").alias("drift_sigma")), key, "left")
    d = d.join(forecast.select(key, "nowcast", F.col("status").alias("forecast_status"), F.coalesce("supported", F.lit(False)).alias("forecast_supported"),
                               F.coalesce("alarm", F.lit(False)).alias("forecast_alarm")), key, "left")
    hand = ("manual_sulfur", "manual_t95", "manual_cetane")
    d = d.join(manual.select(key, *hand), key, "left") if manual is not None else d.select("*", *[F.lit(None).cast("double").alias(h) for h in hand])
    d = d.select("*", *[F.struct(F.col(f"{n}.value").alias("value"), F.col(f"{n}.age_minutes").alias("age_minutes"), F.col(f"offset_{n}").alias("offset"),
                                 (F.col(f"{n}.value") + F.col(f"offset_{n}")).alias("adjusted"), F.coalesce(f"pairs_{n}", F.lit(0)).alias("pairs")).alias(f"analyser_{n}") for n in names])

    soft = F.col("soft.value") if roles.soft else F.lit(None).cast("double")
    ranked = [(n, F.col(f"{n}.value"), _clean(F.col(n)), F.col(f"{n}.freshness") == "fresh", F.col(f"{n}.t")) for n in names]
    d = d.withColumn("_pick", K.choose_baseline(F.col("lab.value"), ranked, soft))
    by_hand = F.col("manual_sulfur").isNotNull()
    by_model = ~by_hand & F.coalesce((F.col("forecast_status") == "ok") & F.col("forecast_supported") & F.col("nowcast").isNotNull(), F.lit(False))
    now = F.struct(F.col("nowcast").alias("value"), F.col(key).alias("t"), F.lit(0.0).alias("age_minutes"), F.lit("").alias("flags"), F.lit("fresh").alias("freshness"),
                   F.lit(None).cast("double").alias("delta"), F.col(key).alias("available"))
    read = F.when(by_hand, F.lit(None)).when(by_model, now)
    for n in ["lab", *names, *(["soft"] if roles.soft else [])]:
        read = read.when(F.col("_pick.source") == n, F.col(n))
    d = d.withColumn("scenario_only", by_hand).withColumn("baseline_source", F.when(by_hand, "manual").when(by_model, "nowcast").otherwise(F.col("_pick.source")))
    d = d.withColumn("baseline", F.coalesce("manual_sulfur", F.when(by_model, F.col("nowcast")), F.col("_pick.value"))).withColumn("baseline_reading", read).drop("_pick")

    if len(names) == 2:
        a, b = names
        both = F.lit(True)
        for n in names:
            both = both & F.col(f"{n}.value").isNotNull() & (F.col(f"{n}.freshness") == "fresh") & _clean(F.col(n))
        off = [F.col(f"offset_{n}") for n in names]
        diff, bad = K.analyser_conflict(F.col(f"{a}.value"), F.col(f"{b}.value"), *off, both, conflict_above)
        basis = F.when(both, F.when(off[0].isNotNull() & off[1].isNotNull(), "anchored").otherwise("raw"))
        d = d.withColumn("comparison", F.struct(diff.alias("difference"), F.when(both, F.abs(F.col(f"{a}.value") - F.col(f"{b}.value"))).alias("raw_difference"), bad.alias("conflict"), basis.alias("basis")))
    else:
        d = d.withColumn("comparison", F.struct(F.lit(None).cast("double").alias("difference"), F.lit(None).cast("double").alias("raw_difference"), F.lit(False).alias("conflict"), F.lit(None).cast("string").alias("basis")))

    days = (F.col(key) - F.col("cetane.t")) / C.DAY
    aged = F.struct(F.col("manual_cetane").isNotNull().alias("manual"), F.coalesce("manual_cetane", "cetane.value").alias("value"),
                    F.when(F.col("manual_cetane").isNotNull(), 0.0).otherwise(days).alias("age_days"),
                    F.coalesce("manual_cetane", aged_lower_bound("cetane.value", days, "drift_sigma")).alias("lower_bound"),
                    (F.col("manual_cetane").isNotNull() | F.coalesce(days <= MAX_SAMPLE_DAYS, F.lit(False))).alias("usable"))
    t95 = F.struct(F.col("manual_t95").isNotNull().alias("manual"), F.coalesce("manual_t95", "t95.value").alias("value"))
    d = d.withColumn("t95_quality", t95).withColumn("cetane_quality", aged)
    d = d.withColumn("missing", C.reasons((F.col("baseline").isNull(), "sulfur_baseline")))
    known = F.lit(False)
    for n in roles.controls:
        known = known | F.col(f"{n}.value").isNotNull()
    aged_sample = ~F.col("cetane_quality.manual") & F.col("cetane.value").isNotNull() & (F.col("cetane.freshness") != "fresh") & F.col("cetane_quality.usable")
    return d.withColumn("warnings", C.reasons(
        (F.col("baseline_reading.freshness") == "stale", "stale_baseline"), (~known, "no_controls"), (F.col("forecast_status").isNull(), "no_forecast"),
        (by_hand, "manual_baseline"), (F.col("forecast_status") == "abstain", "forecast_abstains"), (F.col("forecast_alarm"), "forecast_alarm"), (aged_sample, "aged_cetane_sample")))


def labelled(name: str, reasons: Column) -> Column:
    return F.transform(reasons, lambda r: F.concat(F.lit(f"{name}:"), r))


def reading_failures(name: str, reading: str, key: str, require_fresh: bool = True) -> Column:
    """Labelled reasons why the reading cannot support a decision at the moment ``key``."""
    r = F.col(reading)
    return labelled(name, K.evidence_failures(r["value"], r["freshness"], r["flags"], r["available"], F.col(key), require_fresh))


def data_reasons(evidence: DataFrame, roles: Roles, state: Column, key: str = "moment") -> DataFrame:
    """Adds ``data_reasons``: why no decision can rest on the evidence, the operating state first; empty means reliable.

    With an entered baseline neither a reading of it, nor the forecast, nor the analysers are asked for.
    """
    observed = ~F.col("scenario_only")
    none = F.array().cast(NONE)
    parts = [F.when(F.size("missing") > 0, labelled("missing", F.col("missing"))).otherwise(none), F.when(observed, reading_failures("baseline", "baseline_reading", key)).otherwise(none)]
    parts += [reading_failures(n, n, key) for n in roles.controls]
    ok = F.coalesce(F.col("forecast_status") == "ok", F.lit(False))
    parts.append(C.reasons((observed & ~ok, "forecast:unavailable"), (observed & ok & ~F.col("forecast_supported"), "forecast:path_unsupported"),
                           (observed & F.col("comparison.conflict"), "analysers:conflict")))
    return evidence.withColumn("data_reasons", K.reliability(state, *parts))


# --- gate -------------------------------------------------------------------------------


def upper_envelope(knots: Column, end: Column) -> Column:
    """The largest value up to ``end`` of the piecewise-linear curve through ``knots`` (array of struct(minute, upper), by minute).

    Outside its knots the curve is level; without knots the result is NULL.
    """
    before, after = F.filter(knots, lambda k: k["minute"] <= end), F.filter(knots, lambda k: k["minute"] > end)
    a, b = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    at = F.when(a.isNull(), b["upper"]).when(b.isNull(), a["upper"]).otherwise(a["upper"] + (end - a["minute"]) * (b["upper"] - a["upper"]) / (b["minute"] - a["minute"]))
    return F.greatest(F.array_max(F.transform(before, lambda k: k["upper"])), at)


def named_check(name: str, passed: Column, applies: Column | None = None, missing: Column | None = None, why: Column | None = None) -> Column:
    """struct(name, passed, why) where the check applies.  A NULL fails, unless ``missing`` is given: then the check stays
    unassessed, and counts as a reason only where ``missing`` holds."""
    verdict = F.coalesce(passed, F.lit(False)) if missing is None else passed
    none = F.array().cast(NONE)
    reasons = F.when(verdict, none).when(~verdict, F.array(F.lit(name)) if why is None else why)
    if missing is not None:
        reasons = reasons.when(missing, F.array(F.lit(f"{name}_missing")))
    row = F.struct(F.lit(name).alias("name"), verdict.alias("passed"), reasons.otherwise(none).alias("why"))
    return row if applies is None else F.when(F.coalesce(applies, F.lit(False)), row)


def assessed_gate(df: DataFrame, target: float = K.HARD_LIMIT, t95_max: float = T95_MAX, cetane_min: float = CETANE_MIN, gain: float = 4.0,
                  key: str = "moment") -> DataFrame:
    """Adds ``checks`` (name, passed or NULL, why), ``reasons``, ``unassessed`` and ``passed`` to candidates with evidence.

    Needs the evidence columns and, per candidate: id, dT, dF, dP, final (level at the end of the horizon), product (with
    additive, or of the blend), severity, basis, risk_passed, within_design, additive_pct, intermediate_max; per blend (route
    ``blended``): blend_sulfur, blend_t95, blend_cetane, stock_met, additive_assessed, arrives, arriving_share (of the blend without additive), baseline_level
    (the baseline in the units of ``final``) and guard (upper level of what arrives).

    Direct route: risk, economic budget, alarm, T95 and cetane evidence.  Blend route: no credit for moves that do not reach the
    stored blend, limits, stock (three-valued) and the mass balance with the worst arriving level.
    """
    blend = F.coalesce(F.col("blended"), F.lit(False))
    direct = ~blend
    observed = ~F.col("scenario_only")
    limit = min(K.HARD_LIMIT, target)
    step = F.lit(True)
    for n, most in K.STEP_LIMITS.items():
        step = step & (F.abs(F.coalesce(f"d{n}", F.lit(0.0))) <= most + 1e-9)
    still = (F.col("dT") == 0) & (F.col("dF") == 0) & (F.col("dP") == 0)
    worst = F.greatest(F.col("guard"), F.col("baseline_level"), F.col("final"))
    guarded = F.col("blend_sulfur") + F.col("arriving_share") * (worst - F.col("final")) * (1 - F.col("additive_pct") / 100)
    t95, cetane = F.col("t95_quality"), F.col("cetane_quality")
    t95_why = F.when(t95["manual"], F.array().cast(NONE)).otherwise(reading_failures("t95", "t95", key))
    too_old = F.when(cetane["usable"], F.array().cast(NONE)).otherwise(F.array(F.lit("cetane:sample_too_old")))
    cetane_why = F.when(cetane["manual"], F.array().cast(NONE)).otherwise(F.concat(reading_failures("cetane", "cetane", key, False), too_old))
    d = df.withColumn("_t95_why", t95_why).withColumn("_cetane_why", cetane_why)
    bound = F.coalesce(cetane["lower_bound"], cetane["value"]) + gain * F.col("additive_pct")
    asked = lambda x: direct & x["value"].isNotNull()
    checks = [
        named_check("step_limit", step), named_check("sulfur_hard_limit", F.col("product") <= K.HARD_LIMIT), named_check("sulfur_target", F.col("product") <= target),
        named_check("intermediate_limit", F.coalesce(F.col("final") <= F.col("intermediate_max"), F.col("intermediate_max").isNull())),
        named_check("stored_blend_controls", still, blend & ~F.coalesce(F.col("arrives"), F.lit(False))),
        named_check("blend_sulfur_hard_limit", F.col("blend_sulfur") <= K.HARD_LIMIT, blend), named_check("blend_sulfur_target", F.col("blend_sulfur") <= limit, blend),
        named_check("blend_t95_target", F.col("blend_t95") <= min(T95_MAX, t95_max), blend), named_check("blend_cetane_target", F.col("blend_cetane") >= max(CETANE_MIN, cetane_min), blend),
        named_check("blend_stock", F.col("stock_met"), blend, observed), named_check("additive_sulfur_assessed", F.col("additive_assessed"), blend),
        named_check("blend_forecast_guard", F.when(F.col("guard").isNotNull(), guarded <= limit), blend & observed & F.col("arrives")),
        named_check("sulfur_risk_margin", F.col("risk_passed"), direct), named_check("economic_risk_budget", F.col("within_design"), direct & F.col("id").isin(*K.ECONOMIC)),
        named_check("forecast_alarm_resolved", F.col("basis") == "residual_quantiles", direct & observed & F.col("forecast_alarm")),
        named_check("t95_evidence", F.size("_t95_why") == 0, asked(t95) & ~t95["manual"], why=F.col("_t95_why")),
        named_check("t95", t95["value"] <= min(T95_MAX, t95_max), direct, observed),
        named_check("cetane_evidence", F.size("_cetane_why") == 0, asked(cetane) & ~cetane["manual"], why=F.col("_cetane_why")),
        named_check("cetane", F.when(cetane["value"].isNotNull(), bound >= max(CETANE_MIN, cetane_min) - 1e-9), direct, observed),
        named_check("load_severity", F.col("severity") <= 1)]
    d = d.withColumn("checks", F.array_compact(F.array(*checks))).drop("_t95_why", "_cetane_why")
    d = d.withColumn("reasons", F.array_distinct(F.concat("data_reasons", F.flatten(F.transform("checks", lambda c: c["why"])))))
    d = d.withColumn("unassessed", F.transform(F.filter("checks", lambda c: c["passed"].isNull()), lambda c: c["name"]))
    return d.withColumn("passed", F.size("reasons") == 0)
