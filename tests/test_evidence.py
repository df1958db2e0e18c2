"""Evidence per moment and the assessed gate, held against rules written out row by row."""
import math

import pytest
from pyspark.sql import functions as F

from helpers import MIN, observations, us
from tidemark.functions import columns as C
from tidemark.operators import evidence as V

BASE = us("2026-01-01 00:00:00")
ROLES = V.Roles(V.Role("lab", "lims"), {"a": V.Role("a", "pak"), "b": V.Role("b", "pak")}, {k: V.Role(k, "kip") for k in "TFP"},
                V.Role("t95", "lims"), V.Role("cet", "lims"), V.Role("dp", "kip"))


def by_hand(rows, role, at, delay=240):
    """The newest two rows of the role known at ``at`` minutes."""
    lag = delay if role.source == "lims" else 0
    known = sorted(((r[1], i, r) for i, r in enumerate(rows) if r[0] == role.metric and r[1] + lag <= at), key=lambda x: x[:2])
    if not known:
        return (None, "", "missing", None)
    ok = lambda r: None if (r[4] if len(r) > 4 else "") in ("invalid", "conflict") or r[2] is None or not math.isfinite(r[2]) else r[2]
    t, _, r = known[-1]
    prior = ok(known[-2][2]) if len(known) > 1 else None
    v = ok(r)
    return (v, r[4] if len(r) > 4 else "", "fresh" if at - t <= C.FRESHNESS_MINUTES[role.source] else "stale", None if v is None or prior is None else v - prior)


def test_readings_equal_the_rule_for_every_moment(spark):
    rows = [("lab", 0, 9.0, "lims"), ("lab", 300, 8.0, "lims"), ("lab", 300, 7.5, "lims"), ("a", 10, 9.5, "pak"), ("a", 400, float("nan"), "pak"), ("a", 420, 9.9, "pak", "invalid"),
            ("b", 405, 9.1, "pak", "suspect"), ("T", 2, 350.0, "kip"), ("T", 600, 352.0, "kip"), ("T", 3000, 340.0, "kip"), ("F", 541, 150.0, "kip"), ("cet", 0, 52.0, "lims"), ("t95", 5000, 355.0, "lims")]
    at = [0, 239, 240, 415, 425, 540, 545, 600, 610, 611, 3005, 5000, 5240, 90000]
    moments = spark.createDataFrame([(BASE + x * MIN,) for x in at] + [(BASE,), (None,)], "moment long")
    got = {r.moment: r for r in V.readings_at(moments, observations(spark, rows), ROLES.all(), width=C.HOUR).collect()}
    assert sorted(got) == [BASE + x * MIN for x in at]
    for x in at:
        for name, role in ROLES.all().items():
            r = got[BASE + x * MIN][name]
            assert (r.value, r.flags, r.freshness, r.delta) == by_hand(rows, role, x), (x, name)
            if r.t is not None:
                assert r.available <= BASE + x * MIN and r.age_minutes == (BASE + x * MIN - r.t) / MIN


def evidence(spark, rows, at, anchors=(), drift=(), forecast=(), manual=None):
    m = spark.createDataFrame([(BASE + x * MIN,) for x in at], "moment long")
    k = lambda xs: [(BASE + x[0] * MIN, *x[1:]) for x in xs]
    read = V.readings_at(m, observations(spark, rows), ROLES.all())
    a = spark.createDataFrame(k(anchors), "moment long, offset_a double, pairs_a long, offset_b double, pairs_b long")
    d = spark.createDataFrame(k(drift), "moment long, pairs long, sigma double")
    f = spark.createDataFrame(k(forecast), "moment long, nowcast double, status string, supported boolean, alarm boolean")
    h = None if manual is None else spark.createDataFrame(k(manual), "moment long, manual_sulfur double, manual_t95 double, manual_cetane double")
    return V.data_reasons(V.quality_evidence(read, ROLES, a, d, f, h), ROLES, F.lit("normal"))


def test_evidence_sources_comparison_and_reasons(spark):
    rows = [("a", 1000, 9.0, "pak"), ("b", 1000, 12.0, "pak"), *[(x, 1000, 1.0, "kip") for x in "TFP"], ("cet", 0, 52.0, "lims"), ("lab", 700, 8.0, "lims"), ("lab", 990, 1.0, "lims")]
    at = [900, 1000, 1001, 1002, 1003]
    e = {(r.moment - BASE) // MIN: r for r in evidence(
        spark, rows, at, anchors=[(1000, 0.5, 4, -2.0, 4)], drift=[(x, 9, 0.5) for x in at], forecast=[(1001, 8.5, "ok", True, False), (1002, 8.5, "ok", False, True), (1003, 8.5, "abstain", True, False)],
        manual=[(1002, 5.0, None, None)]).collect()}
    assert [e[x].baseline_source for x in at] == [None, "lab", "nowcast", "manual", "lab"]
    assert [e[x].baseline for x in at] == [None, 8.0, 8.5, 5.0, 8.0]
    # Anchored readings differ by 0.5, raw ones by 3.
    assert (e[1000].comparison.basis, e[1000].comparison.difference, e[1000].comparison.raw_difference, e[1000].comparison.conflict) == ("anchored", 0.5, 3.0, False)
    assert (e[1001].comparison.basis, e[1001].comparison.difference, e[1001].comparison.conflict) == ("raw", 3.0, True)
    assert e[1000].analyser_a.adjusted == 9.5 and e[1001].analyser_a.adjusted is None and e[1001].analyser_a.pairs == 0 and e[1001].analyser_a.age_minutes == 1.0
    days = 1000 / 1440
    assert e[1000].cetane_quality.lower_bound == pytest.approx(52 - 1.2816 * 0.5 * math.sqrt(days)) and e[1000].cetane_quality.usable
    assert e[1001].data_reasons == ["analysers:conflict"]
    assert e[1000].data_reasons == ["forecast:unavailable"]
    assert e[1002].scenario_only and e[1002].data_reasons == []
    assert e[1003].data_reasons == ["forecast:unavailable", "analysers:conflict"] and "forecast_abstains" in e[1003].warnings
    # Laboratory samples of minute 700 come out at minute 940: nothing is known at 900.
    assert e[900].missing == ["sulfur_baseline"] and e[900].data_reasons[:3] == ["missing:sulfur_baseline", "baseline:no_finite_value", "baseline:not_fresh"]
    assert {"T:no_finite_value", "T:unknown_time"} <= set(e[900].data_reasons)


def test_no_moments_and_no_observations(spark):
    assert evidence(spark, [("lab", 0, 1.0, "lims")], [], manual=[]).count() == 0
    r = V.readings_at(spark.createDataFrame([(BASE,)], "moment long"), observations(spark, [("other", 0, 1.0, "kip")]), ROLES.all()).first()
    assert {r[n].freshness for n in ROLES.all()} == {"missing"}


def test_upper_envelope(spark):
    d = spark.createDataFrame([(-5.0,), (0.0,), (30.0,), (90.0,), (150.0,), (500.0,)], "e double")
    knots = F.array(*[F.struct(F.lit(t).alias("minute"), F.lit(x).alias("upper")) for t, x in ((0, 1.0), (60, 3.0), (120, 2.0))])
    assert [r[0] for r in d.select(V.upper_envelope(knots, F.col("e"))).collect()] == [1.0, 1.0, 2.0, 3.0, 3.0, 3.0]
    none = F.array().cast("array<struct<minute:int,upper:double>>")
    assert {r[0] for r in d.select(V.upper_envelope(none, F.col("e"))).collect()} == {None}


FIELDS = dict(id="hold", dT=0.0, dF=0.0, dP=0.0, final=8.0, product=8.0, severity=0.5, basis="residual_quantiles", risk_passed=True, within_design=True, additive_pct=0.0, intermediate_max=None, blended=False,
              blend_sulfur=None, blend_t95=None, blend_cetane=None, stock_met=None, additive_assessed=None, arrives=False, arriving_share=0.0, baseline_level=8.0, guard=None, scenario_only=False, forecast_alarm=False,
              t95=350.0, t95_fresh="fresh", bound=52.0, usable=True, manual=False)
BLEND = dict(blended=True, blend_sulfur=9.0, blend_t95=355.0, blend_cetane=52.0, stock_met=True, additive_assessed=True)
CASES = [
    (dict(), [], []), (dict(dT=6.1), ["step_limit"], []), (dict(product=10.5), ["sulfur_hard_limit", "sulfur_target"], []), (dict(product=None), ["sulfur_hard_limit", "sulfur_target"], []),
    (dict(intermediate_max=7.0), ["intermediate_limit"], []), (dict(risk_passed=False, within_design=False), ["sulfur_risk_margin"], []), (dict(id="more_feed", dF=2.0, within_design=False), ["economic_risk_budget"], []),
    (dict(forecast_alarm=True), [], []), (dict(forecast_alarm=True, basis="point_margin"), ["forecast_alarm_resolved"], []), (dict(forecast_alarm=True, basis="point_margin", scenario_only=True), [], []),
    (dict(t95=None), ["t95_missing"], ["t95"]), (dict(t95=None, scenario_only=True), [], ["t95"]), (dict(t95=361.0), ["t95"], []), (dict(t95_fresh="stale"), ["t95:not_fresh"], []), (dict(t95_fresh="stale", manual=True), [], []),
    (dict(bound=50.0), ["cetane"], []), (dict(bound=50.0, additive_pct=0.25), [], []), (dict(usable=False), ["cetane:sample_too_old"], []), (dict(bound=None), ["cetane_missing"], ["cetane"]), (dict(severity=None), ["load_severity"], []),
    (BLEND, [], []), (dict(BLEND, dT=1.0), ["stored_blend_controls"], []), (dict(BLEND, blend_sulfur=11.0), ["blend_sulfur_hard_limit", "blend_sulfur_target"], []), (dict(BLEND, blend_t95=361.0, blend_cetane=50.0), ["blend_t95_target", "blend_cetane_target"], []),
    (dict(BLEND, stock_met=False), ["blend_stock"], []), (dict(BLEND, stock_met=None), ["blend_stock_missing"], ["blend_stock"]), (dict(BLEND, stock_met=None, scenario_only=True), [], ["blend_stock"]), (dict(BLEND, additive_assessed=False), ["additive_sulfur_assessed"], []),
    (dict(BLEND, arrives=True, dT=1.0, arriving_share=0.5, guard=9.9), [], []), (dict(BLEND, arrives=True, arriving_share=0.5, guard=10.2), ["blend_forecast_guard"], []), (dict(BLEND, arrives=True, arriving_share=0.5), ["blend_forecast_guard"], []),
    (dict(BLEND, arrives=True, arriving_share=0.5, guard=10.2, additive_pct=50.0), [], []), (dict(BLEND, t95=None, bound=None, risk_passed=False), [], [])]


def test_gate_names_every_failed_and_every_unassessed_check(spark):
    types = {str: "string", float: "double", bool: "boolean"}
    known = dict(FIELDS, intermediate_max=0.0, blend_sulfur=0.0, blend_t95=0.0, blend_cetane=0.0, stock_met=True, additive_assessed=True, guard=0.0)
    rows = [(i, *(FIELDS | c).values()) for i, (c, _, _) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "n int, " + ", ".join(f"{k} {types[type(v)]}" for k, v in known.items()))
    read = lambda v, fresh: F.struct(v.alias("value"), fresh.alias("freshness"), F.lit("").alias("flags"), F.lit(5).alias("available"))
    d = d.withColumn("t95_quality", F.struct("manual", F.col("t95").alias("value"))).withColumn("cetane_quality", F.struct("manual", F.col("bound").alias("value"), F.col("bound").alias("lower_bound"), "usable"))
    d = d.withColumn("t95", read(F.col("t95"), F.col("t95_fresh"))).withColumn("cetane", read(F.col("bound"), F.lit("stale"))).withColumn("moment", F.lit(5)).withColumn("data_reasons", F.array().cast("array<string>"))
    for r in V.assessed_gate(d).collect():
        change, reasons, unassessed = CASES[r.n]
        assert (r.reasons, r.unassessed, r.passed) == (reasons, unassessed, not reasons), change
        assert {c.name for c in r.checks if c.passed is None} == set(unassessed) and "step_limit" in {c.name for c in r.checks}
    late = V.assessed_gate(d.filter("n = 0").withColumn("data_reasons", F.array(F.lit("state:shutdown")))).first()
    assert late.reasons == ["state:shutdown"] and not late.passed


def test_selection_of_one_to_twenty_known_metrics(spark):
    from tidemark.sources import catalog as G
    known = spark.createDataFrame([(f"m{i}",) for i in range(30)], "metric_id string")
    rows = [("twenty", i, f" m{i % 20}") for i in range(40)] + [("many", i, f"m{i}") for i in range(21)] + [("blank", 0, " "), ("blank", 1, None), ("odd", 0, "m1"), ("odd", 1, "x")]
    got = {r.request: (r.n, r.unknown, r.refused) for r in G.selection_verdict(known, spark.createDataFrame(rows, "request string, position int, metric_id string")).collect()}
    assert got == {"twenty": (20, 0, None), "many": (21, 0, "too_many"), "blank": (0, 0, "empty"), "odd": (2, 1, "unknown_metric")}
