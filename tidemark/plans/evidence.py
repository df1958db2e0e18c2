"""Evidence, reasons and the assessed gate for every moment of the regular grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import decide as K
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import features as X
from ..operators import quality as Q
from ..operators.stage import staged
from .adapter import ANALYSER, LAB, SECOND_ANALYSER, VALID, obs, ts_text
from .decide import MOM, PROB, move_sql, policy
from .evaluate import DRIFT
from .features import ANALYSERS, CONTROL_MAP, D, M, anchor_sql, staged_series
from .registry import REGISTRY, query
from .series import round_all

ROLES = V.Roles(lab=V.Role(LAB, "lims"), analysers={"pa": V.Role(ANALYSER, "pak"), "qa": V.Role(SECOND_ANALYSER, "pak")},
                controls={k: V.Role(m, "kip") for k, m in CONTROL_MAP.items()}, t95=V.Role("lab.t95", "lims"), cetane=V.Role("lab.cetane", "lims"),
                pressure_drop=V.Role("ev.signup", "kip"), soft=V.Role("ev.error", "kip"))
CONFLICT = 12.0  # readings are six times the product's unit
NUMBER = 30 * M
TIE = 1.37e-11  # products that lie between two roundings fall to the same side in both engines


def observations(spark, sf):
    """The observations and two laboratory properties derived from them."""
    d = obs(spark, sf).select("metric_id", "t", "value", "flags", "source_row")
    t95 = d.filter("metric_id = 'ev.signup'").select(F.lit("lab.t95").alias("metric_id"), "t", (340 + F.col("value") * 0.3).alias("value"), "flags", "source_row")
    cetane = d.filter(F.col("metric_id") == LAB).select(F.lit("lab.cetane").alias("metric_id"), "t", (46 + F.col("value") / 10).alias("value"), "flags", "source_row")
    return d.unionByName(t95).unionByName(cetane)


def number(key="moment"):
    return F.pmod((F.col(key) / NUMBER).cast("long"), F.lit(1000))


def evidence(spark, sf):
    s, l = staged_series(spark, sf)
    grid = X.origin_grid(s)
    moments = grid.select(F.col("origin").alias("moment"))
    read = V.readings_at(moments, observations(spark, sf), ROLES.all())
    anchor = staged(X.lab_anchor(grid, l, s, ANALYSERS).withColumnRenamed("origin", "moment"))
    drift = E.drift_sigma_at(grid, l.select("t", (46 + F.col("value") / 10).alias("value")), min_gap_days=0.02, width=D).withColumnRenamed("origin", "moment")
    # The portable model: half the adjusted analyser, half the level, in logarithms.
    read = staged(read)
    near = read.select("moment", "pa").join(anchor, "moment").filter("level IS NOT NULL")
    now = F.exp(0.5 * C.floored_ln(F.col("pa.value") + F.col("offset_pa")) + 0.5 * C.floored_ln("level"))
    forecast = near.select("moment", now.alias("nowcast"), F.when(now.isNotNull(), "ok").otherwise("abstain").alias("status"),
                           ((F.col("pairs_pa") >= 3) & (F.col("pa.freshness") == "fresh")).alias("supported"), (now > 60).alias("alarm"))
    i = number()
    manual = moments.select("moment", F.when(i % 10 == 4, 35.0 + i % 20).alias("manual_sulfur"), F.when(i % 12 == 5, 350.0).alias("manual_t95"), F.when(i % 15 == 6, 52.0).alias("manual_cetane"))
    return V.quality_evidence(read, ROLES, anchor, drift, forecast, manual, conflict_above=CONFLICT)


def role_sql(n, r):
    lag = C.LAB_DELAY_MINUTES * M if r.source == "lims" else 0
    cols = f"""{n}.v AS {n}_v, {n}.t AS {n}_t, {n}.flags AS {n}_f, {n}.v - {n}.prior AS {n}_d, (o.origin - {n}.t) / {M}.0 AS {n}_age, CASE WHEN {n}.t IS NULL THEN 'missing' WHEN (o.origin - {n}.t) / {M}.0 <= {C.FRESHNESS_MINUTES[r.source]} THEN 'fresh' ELSE 'stale' END AS {n}_fr"""
    return cols, f"ASOF LEFT JOIN (SELECT * FROM rl WHERE metric_id = '{r.metric}') {n} ON o.origin >= {n}.t + {lag}"


# Two readings lie behind names that SQL takes for its own.
PARTS = {f"r_{n}": role_sql(f"r_{n}", r) for n, r in ROLES.all().items()}
EVIDENCE = DRIFT + anchor_sql(45 * D) + f""", rx AS (SELECT metric_id, timestamp, value, flags, source_row FROM obs UNION ALL SELECT 'lab.t95', timestamp, 340 + value * 0.3, flags, source_row FROM obs WHERE metric_id = 'ev.signup'
     UNION ALL SELECT 'lab.cetane', timestamp, 46 + value / 10, flags, source_row FROM obs WHERE metric_id = '{LAB}'),
   ro AS (SELECT metric_id, epoch_us(timestamp) AS t, source_row, flags, CASE WHEN {VALID} THEN value END AS v FROM rx), rp AS (SELECT *, lag(v) OVER (PARTITION BY metric_id ORDER BY t, source_row) AS prior FROM ro),
   rl AS (SELECT * FROM rp QUALIFY row_number() OVER (PARTITION BY metric_id, t ORDER BY source_row DESC) = 1),
   rd AS (SELECT o.origin, {', '.join(c for c, _ in PARTS.values())} FROM o {' '.join(j for _, j in PARTS.values())}),
   v1 AS (SELECT rd.*, level, offset_pa, offset_qa, pairs_pa, pairs_qa, CASE WHEN pairs > 0 THEN sigma / 10 ELSE sigma END AS sigma, pairs AS drift_pairs, (rd.origin // {NUMBER}) % 1000 AS i,
     CASE WHEN r_pa_v IS NOT NULL AND offset_pa IS NOT NULL THEN exp(0.5 * ln(greatest(r_pa_v + offset_pa, 0.3)) + 0.5 * ln(greatest(level, 0.3))) END AS nowcast FROM rd JOIN anchor USING (origin) JOIN z USING (origin)),
   v2 AS (SELECT *, CASE WHEN i % 10 = 4 THEN 35.0 + i % 20 END AS ms, CASE WHEN i % 12 = 5 THEN 350.0 END AS mt95, CASE WHEN i % 15 = 6 THEN 52.0 END AS mcet, CASE WHEN level IS NULL THEN NULL WHEN nowcast IS NOT NULL THEN 'ok' ELSE 'abstain' END AS status,
     level IS NOT NULL AND pairs_pa >= 3 AND r_pa_fr = 'fresh' AS supported, coalesce(nowcast > 60, FALSE) AS alarm,
     CASE WHEN r_lab_v IS NOT NULL THEN 'lab' WHEN r_pa_v IS NOT NULL AND (r_qa_v IS NULL OR (r_pa_f = '', r_pa_fr = 'fresh', r_pa_t) >= (r_qa_f = '', r_qa_fr = 'fresh', r_qa_t)) THEN 'pa' WHEN r_qa_v IS NOT NULL THEN 'qa' WHEN r_soft_v IS NOT NULL THEN 'soft' END AS pick,
     r_pa_v IS NOT NULL AND r_qa_v IS NOT NULL AND r_pa_fr = 'fresh' AND r_qa_fr = 'fresh' AND r_pa_f = '' AND r_qa_f = '' AS both_ok FROM v1),
   v3 AS (SELECT *, ms IS NOT NULL AS by_hand, CASE WHEN ms IS NOT NULL THEN 'manual' WHEN coalesce(status = 'ok', FALSE) AND supported THEN 'nowcast' ELSE pick END AS src, coalesce(mt95, r_t95_v) AS t95q, coalesce(mcet, r_cetane_v) AS cetq,
     CASE WHEN mcet IS NOT NULL THEN 0.0 ELSE (origin - r_cetane_t) / {D}.0 END AS cet_age, coalesce(mcet, r_cetane_v - 1.2816 * sigma * sqrt(greatest((origin - r_cetane_t) / {D}.0, 0))) AS cet_low, mcet IS NOT NULL OR coalesce((origin - r_cetane_t) / {D}.0 <= 60, FALSE) AS cet_ok,
     CASE WHEN both_ok THEN coalesce(abs((r_pa_v + offset_pa) - (r_qa_v + offset_qa)), abs(r_pa_v - r_qa_v)) END AS diff, CASE WHEN both_ok THEN CASE WHEN offset_pa IS NOT NULL AND offset_qa IS NOT NULL THEN 'anchored' ELSE 'raw' END END AS diff_basis FROM v2),
   v4 AS (SELECT *, CASE src WHEN 'manual' THEN ms WHEN 'nowcast' THEN nowcast WHEN 'lab' THEN r_lab_v WHEN 'pa' THEN r_pa_v WHEN 'qa' THEN r_qa_v WHEN 'soft' THEN r_soft_v END AS baseline,
     CASE src WHEN 'nowcast' THEN 'fresh' WHEN 'lab' THEN r_lab_fr WHEN 'pa' THEN r_pa_fr WHEN 'qa' THEN r_qa_fr WHEN 'soft' THEN r_soft_fr END AS base_fr, CASE src WHEN 'nowcast' THEN '' WHEN 'lab' THEN r_lab_f WHEN 'pa' THEN r_pa_f WHEN 'qa' THEN r_qa_f WHEN 'soft' THEN r_soft_f END AS base_f, coalesce(diff > {CONFLICT}, FALSE) AS conflict FROM v3),
   ev AS (SELECT *, concat_ws('|', CASE WHEN base_fr = 'stale' THEN 'stale_baseline' END, CASE WHEN r_T_v IS NULL AND r_F_v IS NULL AND r_P_v IS NULL THEN 'no_controls' END, CASE WHEN status IS NULL THEN 'no_forecast' END, CASE WHEN by_hand THEN 'manual_baseline' END,
     CASE WHEN status = 'abstain' THEN 'forecast_abstains' END, CASE WHEN alarm THEN 'forecast_alarm' END, CASE WHEN mcet IS NULL AND r_cetane_v IS NOT NULL AND r_cetane_fr <> 'fresh' AND cet_ok THEN 'aged_cetane_sample' END) AS warnings FROM v4)
"""


@query("quality_evidence", "K19 K2 K3 M35 M9", EVIDENCE + f"""SELECT {ts_text('make_timestamp(origin)')} AS moment, src AS baseline_source, round(baseline, 6) AS baseline, base_fr AS baseline_freshness, status AS forecast_status, round(nowcast, 6) AS nowcast,
   round(r_T_v, 6) AS "T", r_T_fr AS "T_freshness", round(t95q, 6) AS t95, round(cetq, 6) AS cetane, round(cet_age, 6) AS cetane_age_days, round(cet_low, 6) AS cetane_lower_bound, CAST(drift_pairs AS BIGINT) AS drift_pairs,
   round(r_pa_age, 6) AS pa_age_minutes, round(r_pa_v + offset_pa, 6) AS pa_adjusted, CAST(pairs_pa AS BIGINT) AS pa_pairs, round(r_qa_v + offset_qa, 6) AS qa_adjusted, round(diff, 6) AS difference, CASE WHEN both_ok THEN round(abs(r_pa_v - r_qa_v), 6) END AS raw_difference, conflict, diff_basis AS basis,
   round(r_pressure_drop_v, 6) AS pressure_drop, round(r_pressure_drop_d, 6) AS pressure_drop_change, warnings FROM ev""")
def _(spark, sf):
    d = evidence(spark, sf)
    return round_all(d.select(
        C.from_micros("moment").alias("moment"), "baseline_source", "baseline", F.col("baseline_reading.freshness").alias("baseline_freshness"), "forecast_status", "nowcast",
        F.col("T.value").alias("T"), F.col("T.freshness").alias("T_freshness"), F.col("t95_quality.value").alias("t95"), F.col("cetane_quality.value").alias("cetane"), F.col("cetane_quality.age_days").alias("cetane_age_days"),
        F.col("cetane_quality.lower_bound").alias("cetane_lower_bound"), F.col("drift_pairs").cast("long").alias("drift_pairs"), F.col("analyser_pa.age_minutes").alias("pa_age_minutes"), F.col("analyser_pa.adjusted").alias("pa_adjusted"),
        F.col("analyser_pa.pairs").cast("long").alias("pa_pairs"), F.col("analyser_qa.adjusted").alias("qa_adjusted"), F.col("comparison.difference").alias("difference"), F.col("comparison.raw_difference").alias("raw_difference"),
        F.col("comparison.conflict").alias("conflict"), F.col("comparison.basis").alias("basis"), F.col("pressure_drop.value").alias("pressure_drop"), F.col("pressure_drop.delta").alias("pressure_drop_change"), F.array_join("warnings", "|").alias("warnings")))


# --- the gate over that evidence ------------------------------------------------------------------

KNOTS = ((0, 1.1), (60, 1.3), (120, 1.2), (180, 1.25))  # upper level of what arrives, as multiples of the nowcast


def gate_moments(spark, sf):
    d = evidence(spark, sf)
    scale = {"T": 330 + F.col("T.value") / 5, "F": 150 + F.col("F.value") / 2, "P": 4 + F.col("P.value") / 400}
    m = staged(d.select("*", number().alias("i"), (F.col("baseline") / 6).alias("base"), *[x.alias(f"_{k}") for k, x in scale.items()]))
    ref = m.agg(*[x for k in "TFP" for x in (F.avg(f"_{k}").alias(f"mean_{k}"), F.stddev_pop(f"_{k}").alias(f"std_{k}"))])
    m = V.data_reasons(m.join(F.broadcast(ref)), ROLES, Q.operating_state("_F", "mean_F", 0.1, 0.9))  # one row
    blend = REGISTRY["recipe_balance"].plan(spark, sf).filter("valid_recipe").select(
        F.col("recipe").alias("_recipe"), ((F.col("sulfur") - 0.12) / 0.99).alias("stored"), (F.col("t95") + 25).alias("blend_t95"), F.col("cetane").alias("blend_cetane"), "stock_met")
    m = m.drop(*[r for r in ROLES.controls]).withColumnsRenamed({f"_{k}": k for k in "TFP"})
    m = m.withColumn("_recipe", F.when(F.col("i") % 4 == 3, F.col("i"))).join(blend, "_recipe", "left")
    knots = F.array(*[F.struct(F.lit(t).alias("minute"), (F.col("nowcast") / 6 * x).alias("upper")) for t, x in KNOTS])
    i = F.col("i")
    return m.select("*", F.col("stored").isNotNull().alias("blended"), (i % 3 != 0).alias("arrives"), F.when(i % 3 != 0, 0.3).otherwise(0.0).alias("arriving_share"), (i % 5 != 0).alias("additive_assessed"),
                    F.col("base").alias("baseline_level"), F.when(F.col("forecast_supported"), V.upper_envelope(knots, 30 + 30 * (i % 6))).alias("guard"),
                    F.when(F.col("stored").isNotNull(), 1.0).otherwise(i % 3 * 1.5).alias("additive_pct"), F.when(i % 7 == 0, 9.5).alias("intermediate_max"))


GATE = EVIDENCE + """, gm AS (SELECT origin AS moment, ev.*, baseline / 6 AS base, 330 + r_T_v / 5 AS T, 150 + r_F_v / 2 AS F, 4 + r_P_v / 400 AS P, NOT by_hand AND coalesce(status = 'ok', FALSE) AND supported AS usable FROM ev),
  ref AS (SELECT avg(T) AS mt, stddev_pop(T) AS st, avg(F) AS mf, stddev_pop(F) AS sf, avg(P) AS mp, stddev_pop(P) AS sp FROM gm),
  qf AS """ + MOM.split("qf AS ", 1)[1].split("\n")[0] + f"""
  rb AS ({REGISTRY['recipe_balance'].sql}),
  m AS (SELECT gm.*, ref.*, qf.*, CASE WHEN usable THEN 10 * exp(-q17) ELSE 10 - 2.25 END AS design, (rb.sulfur - 0.12) / 0.99 AS stored, rb.t95 + 25 AS bt95, rb.cetane AS bcet, rb.stock_met, i % 3 <> 0 AS arrives, CASE WHEN i % 3 <> 0 THEN 0.3 ELSE 0 END AS share, 30 + 30 * (i % 6) AS ends
    FROM gm JOIN ref ON TRUE JOIN qf ON TRUE LEFT JOIN rb ON rb.valid_recipe AND rb.recipe = gm.i AND gm.i % 4 = 3),
  a1 AS (SELECT *, least(6.0, greatest(base - design, 0) / 0.08) AS xt FROM m), a2 AS (SELECT *, greatest(0, greatest(base - design, 0) - 0.08 * xt) AS r1 FROM a1), a3 AS (SELECT *, least(0.2, r1 / 0.15) AS xp FROM a2), a4 AS (SELECT *, -least(10.0, greatest(0, r1 - 0.15 * xp) / 0.05) AS xf FROM a3),
  cd AS (SELECT *, 'hold' AS id, 0.0::DOUBLE AS dT, 0.0::DOUBLE AS dF, 0.0::DOUBLE AS dP FROM a4 UNION ALL SELECT *, 'conservative', xt * 0.5, xf * 0.5, xp * 0.5 FROM a4 UNION ALL SELECT *, 'automatic', xt, xf, xp FROM a4 UNION ALL SELECT *, 'lower_heat', -2, 0, 0 FROM a4 UNION ALL SELECT *, 'more_feed', 0, 2, 0 FROM a4 UNION ALL SELECT *, 'lower_pressure', 0, 0, -0.1 FROM a4),
  sc AS ({move_sql('cd')}), f1 AS (SELECT * EXCLUDE (product, g, probability), CASE WHEN base IS NOT NULL THEN product END AS final, stored IS NOT NULL AS blended, CASE WHEN stored IS NOT NULL THEN 1.0 ELSE i % 3 * 1.5 END AS pct FROM sc),
  f2 AS (SELECT *, CASE WHEN blended THEN ((1 - share) * stored + CASE WHEN share > 0 THEN share * final ELSE 0 END) * 0.99 + 0.12 END AS bs FROM f1), f3 AS (SELECT *, CASE WHEN blended THEN bs ELSE final * (1 - pct / 100) + 12 * pct / 100 END AS product FROM f2),
  f4 AS (SELECT *, ln(10.0) - ln(greatest(product, 0.001)) AS g FROM f3),
  f5 AS (SELECT *, CASE WHEN usable THEN {PROB} END AS probability, nowcast / 6 * CASE WHEN ends = 30 THEN 1.2 ELSE 1.3 END AS gu FROM f4),
  f6 AS (SELECT *, product IS NOT NULL AND CASE WHEN usable THEN probability <= 0.2 + 1e-9 ELSE product <= 8.5 + 1e-9 END AS rp, product IS NOT NULL AND CASE WHEN usable THEN probability <= 0.1 + 1e-9 ELSE product <= 7.75 + 1e-9 END AS wd, CASE WHEN supported AND status IS NOT NULL AND nowcast IS NOT NULL THEN gu END AS guard FROM f5),
  dr AS (SELECT *, concat_ws('|', CASE WHEN F / mf < 0.1 THEN 'state:shutdown' WHEN F / mf < 0.9 THEN 'state:transition' END, CASE WHEN baseline IS NULL THEN 'missing:sulfur_baseline' END,
     CASE WHEN NOT by_hand AND (src IS NULL OR baseline IS NULL) THEN 'baseline:no_finite_value' END, CASE WHEN NOT by_hand AND coalesce(base_fr <> 'fresh', TRUE) THEN 'baseline:not_fresh' END, CASE WHEN NOT by_hand AND base_f <> '' THEN 'baseline:unreliable' END, CASE WHEN NOT by_hand AND src IS NULL THEN 'baseline:unknown_time' END,
     """ + ", ".join(f"CASE WHEN r_{x}_v IS NULL THEN '{x}:no_finite_value' END, CASE WHEN r_{x}_fr <> 'fresh' THEN '{x}:not_fresh' END, CASE WHEN r_{x}_f <> '' THEN '{x}:unreliable' END, CASE WHEN r_{x}_t IS NULL THEN '{x}:unknown_time' END" for x in "TFP") + """,
     CASE WHEN NOT by_hand AND coalesce(status <> 'ok', TRUE) THEN 'forecast:unavailable' END, CASE WHEN NOT by_hand AND status = 'ok' AND NOT supported THEN 'forecast:path_unsupported' END, CASE WHEN NOT by_hand AND conflict THEN 'analysers:conflict' END) AS data FROM f6),
  ch AS (SELECT *, concat_ws('|', nullif(data, ''), CASE WHEN coalesce(product > 10, TRUE) THEN 'sulfur_hard_limit|sulfur_target' END, CASE WHEN i % 7 = 0 AND coalesce(final > 9.5, TRUE) THEN 'intermediate_limit' END,
     CASE WHEN blended AND NOT arrives AND (dT <> 0 OR dF <> 0 OR dP <> 0) THEN 'stored_blend_controls' END, CASE WHEN blended AND coalesce(bs > 10, TRUE) THEN 'blend_sulfur_hard_limit|blend_sulfur_target' END, CASE WHEN blended AND bt95 > 360 THEN 'blend_t95_target' END, CASE WHEN blended AND bcet < 51 THEN 'blend_cetane_target' END,
     CASE WHEN blended AND stock_met IS NULL AND NOT by_hand THEN 'blend_stock_missing' WHEN blended AND NOT stock_met THEN 'blend_stock' END, CASE WHEN blended AND i % 5 = 0 THEN 'additive_sulfur_assessed' END,
     CASE WHEN blended AND arrives AND NOT by_hand AND (guard IS NULL OR coalesce(bs + share * (greatest(guard, base, final) - final) * 0.99 > 10, TRUE)) THEN 'blend_forecast_guard' END,
     CASE WHEN NOT blended AND NOT rp THEN 'sulfur_risk_margin' END, CASE WHEN NOT blended AND id IN ('lower_heat', 'more_feed', 'lower_pressure') AND NOT wd THEN 'economic_risk_budget' END, CASE WHEN NOT blended AND NOT by_hand AND alarm AND NOT usable THEN 'forecast_alarm_resolved' END,
     CASE WHEN NOT blended AND mt95 IS NULL AND r_t95_v IS NOT NULL AND r_t95_fr <> 'fresh' THEN 't95:not_fresh' END, CASE WHEN NOT blended AND mt95 IS NULL AND r_t95_v IS NOT NULL AND r_t95_f <> '' THEN 't95:unreliable' END,
     CASE WHEN blended THEN NULL WHEN t95q IS NULL AND NOT by_hand THEN 't95_missing' WHEN t95q > 360 THEN 't95' END, CASE WHEN NOT blended AND mcet IS NULL AND r_cetane_v IS NOT NULL AND r_cetane_f <> '' THEN 'cetane:unreliable' END,
     CASE WHEN blended THEN NULL WHEN cetq IS NULL AND NOT by_hand THEN 'cetane_missing' WHEN cet_low + 4 * pct < 51 - 1e-9 THEN 'cetane' END, CASE WHEN coalesce(severity > 1, TRUE) OR T IS NULL OR F IS NULL OR P IS NULL THEN 'load_severity' END) AS reasons,
     concat_ws('|', CASE WHEN blended AND stock_met IS NULL THEN 'blend_stock' END, CASE WHEN NOT blended AND t95q IS NULL THEN 't95' END, CASE WHEN NOT blended AND cetq IS NULL THEN 'cetane' END) AS unassessed FROM dr)
"""


def gated(spark, sf):
    m, rule = gate_moments(spark, sf), policy(spark, sf)
    usable = ~F.col("scenario_only") & F.coalesce((F.col("forecast_status") == "ok") & F.col("forecast_supported"), F.lit(False))
    m = K.risk_policy(m.withColumn("usable", usable), rule, F.col("usable"), 1.5)
    d = K.scored(K.candidates(m, rule, F.col("design_level")), rule)
    d = d.withColumn("final", F.when(F.col("base").isNotNull(), F.col("product")))
    s = F.col("arriving_share")
    d = d.withColumn("blend_sulfur", F.when(F.col("blended"), ((1 - s) * F.col("stored") + F.when(s > 0, s * F.col("final")).otherwise(0.0)) * 0.99 + 0.12))
    f = F.col("additive_pct") / 100
    d = d.withColumn("product", F.when(F.col("blended"), F.col("blend_sulfur")).otherwise(F.col("final") * (1 - f) + 12 * f))
    return V.assessed_gate(K.risk_policy(d, rule, F.col("usable"), 1.5))


@query("assessed_gate", "K12 K4 K7", GATE + f"""SELECT {ts_text('make_timestamp(moment)')} AS moment, id, blended, round(product + {TIE}, 8) AS product, reasons, unassessed, reasons = '' AS passed FROM ch""")
def _(spark, sf):
    d = gated(spark, sf)
    return round_all(d.select(C.from_micros("moment").alias("moment"), "id", "blended", (F.col("product") + TIE).alias("product"), F.array_join("reasons", "|").alias("reasons"), F.array_join("unassessed", "|").alias("unassessed"), "passed"), 8)
