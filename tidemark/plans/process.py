"""Formulas, laboratory diagnostics, physics, resampling, step responses."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as X
from ..operators import process as P
from ..operators import series as S
from ..operators.stage import staged
from ..sources import formulas as FM
from .adapter import ANALYSER, AT, LAB, OBS, VALID, obs, table, ts_text
from .features import ANALYSERS, CONTROL_MAP, GRID, ORIGINS, asof_sql, clean, labs, mean_sql
from .registry import query, rounded
from .series import SNAP, freshness, round_all, us

M, H, D = C.MINUTE, C.HOUR, C.DAY
TAGS = {"T1": "ev.click", "F1": "ev.error", "F2": "ev.signup"}
TEXTS = {"sum": "791,2 + 0,5xT1 - F1/F2", "ratio": "F1/(F1+F2)", "plain": "0.25*T1 + 0.01*F1*(F2-T1)", "zero": "1.5 + T1/F1"}

WIDE = OBS + """, w AS (SELECT t, max(value) FILTER (WHERE metric_id = 'ev.click') AS T1, CASE WHEN max(value) FILTER (WHERE metric_id = 'ev.error') < 20 THEN 0 ELSE max(value) FILTER (WHERE metric_id = 'ev.error') END AS F1,
   max(value) FILTER (WHERE metric_id = 'ev.signup') AS F2 FROM clean WHERE metric_id IN ('ev.click', 'ev.error', 'ev.signup') GROUP BY t)"""


def tag_rows(spark, sf):
    w = clean(spark, sf).groupBy("t").agg(*[F.max(F.when(F.col("metric_id") == m, F.col("value"))).alias(n) for n, m in TAGS.items()])
    return w.filter("T1 IS NOT NULL OR F1 IS NOT NULL OR F2 IS NOT NULL").withColumn("F1", F.when(F.col("F1") < 20, 0.0).otherwise(F.col("F1")))


@query("formula_evaluation", "P4", WIDE + f""", v AS (SELECT t, 'sum' AS formula, CASE WHEN abs(F2) >= 1e-9 THEN 791.2 + 0.5 * T1 - F1 / F2 END AS value, T1 IS NULL OR F1 IS NULL OR F2 IS NULL AS miss FROM w
   UNION ALL SELECT t, 'ratio', CASE WHEN abs(F1 + F2) >= 1e-9 THEN F1 / (F1 + F2) END, F1 IS NULL OR F2 IS NULL FROM w UNION ALL SELECT t, 'plain', 0.25 * T1 + 0.01 * F1 * (F2 - T1), T1 IS NULL OR F1 IS NULL OR F2 IS NULL FROM w
   UNION ALL SELECT t, 'zero', CASE WHEN abs(F1) >= 1e-9 THEN 1.5 + T1 / F1 END, T1 IS NULL OR F1 IS NULL FROM w)
   SELECT {ts_text('make_timestamp(t)')} AS timestamp, formula, round(CASE WHEN NOT miss THEN value END, 6) AS value, CASE WHEN miss THEN 'missing_input' WHEN value IS NULL THEN 'zero_denominator' ELSE 'ok' END AS status FROM v""")
def _(spark, sf):
    cells = []
    for name, text in TEXTS.items():
        v, s = FM.evaluate(text)
        cells.append(F.struct(F.lit(name).alias("formula"), v.alias("value"), s.alias("status")))
    d = tag_rows(spark, sf).select(C.from_micros("t").alias("timestamp"), F.inline(F.array(*cells)))
    return round_all(d)


def registry_cells():
    """Every registry formula with its tags dealt to the three columns at hand: (id, text over T1, F1 and F2, mapping)."""
    for k, text in FM.FORMULAS.items():
        yield k, text, {t: ("T1", "F1", "F2")[i % 3] for i, t in enumerate(FM.tags(text))}


def registry_sql():
    parts = []
    for k, text, inputs in registry_cells():
        plain = re.sub(r"LIMS\.[A-Za-z0-9%.]+", lambda m: FM.tags(m[0])[0], text)
        body = re.sub(FM.TAG, lambda m: inputs[m[0]], re.sub(r"(?<![A-Za-z\d.])(\d+(?:\.\d+)?)(?![\d.])", r"\1::DOUBLE", plain))
        body = re.sub(r"/(\([^()]*\)|[A-Z]\d)", r"/ nullif(\1, 0)", body)
        parts.append(f"SELECT '{k}' AS formula, count({body}) AS n, count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NULL" for c in sorted(set(inputs.values()))) + f") AS missing, round(sum({body}), 3) AS total FROM w HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query("formula_registry_values", "P4", WIDE + " " + registry_sql())
def _(spark, sf):
    cells = []
    for k, text, inputs in registry_cells():
        v, s = FM.evaluate(text, inputs)
        cells.append(F.struct(F.lit(k).alias("formula"), v.alias("v"), s.alias("s")))
    return tag_rows(spark, sf).select(F.inline(F.array(*cells))).groupBy("formula").agg(
        F.count("v").alias("n"), F.count_if(F.col("s") == "missing_input").alias("missing"), rounded(F.sum("v"), 3).alias("total"))


@query("formula_status", "P5", GRID + f""", v AS (SELECT origin, 'f' || k AS formula, k = 3 AS unresolved, {asof_sql('ev.click', 'o.origin', 24 * H)} AS a, {asof_sql('ev.error', 'o.origin', 24 * H)} AS b, {asof_sql('ev.click', 'o.origin', 24 * H, 't')} AS ta, {asof_sql('ev.error', 'o.origin', 24 * H, 't')} AS tb FROM o, (VALUES (1), (2), (3)) x(k))
   SELECT formula, CASE WHEN unresolved THEN 'unresolved' WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN origin - ta > {30 * M} OR origin - tb > {30 * M} THEN 'stale' WHEN a > 250 OR b > 250 THEN 'diagnostic_only' ELSE 'ok' END AS status, count(*) AS moments FROM v GROUP BY 1, 2""")
def _(spark, sf):
    s = clean(spark, sf)
    f = X.lookup(X.origin_grid(s), s, {"a": ("ev.click", 0), "b": ("ev.error", 0)}, 24 * H, with_time=True)
    d = f.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    fresh = lambda t: F.when(F.col("origin") - F.col(t) <= 30 * M, "fresh").otherwise("stale")
    flag = lambda x: F.when(F.col(x) > 250, "suspect").otherwise("")
    status = P.formula_status(F.col("k") == 3, F.array("a", "b"), F.array(fresh("a_t"), fresh("b_t")), F.array(flag("a"), flag("b")))
    return d.groupBy(F.concat(F.lit("f"), F.col("k").cast("string")).alias("formula"), status.alias("status")).agg(F.count("*").alias("moments"))


@query("cetane_index", "P7 P14", """WITH r AS (SELECT l_orderkey % 50 AS g, 700 + l_quantity * 8 AS d, l_extendedprice / 150 AS t FROM lineitem), k AS (SELECT g, CASE WHEN d / 1000 BETWEEN 0.7 AND 1.0 AND t BETWEEN 100 AND 450 THEN 454.74 - 1641.416 * (d / 1000) + 774.74 * (d / 1000) * (d / 1000) - 0.554 * t + 97.803 * log10(t) * log10(t) END AS ci,
   CASE WHEN t BETWEEN 100 AND 450 THEN t END AS tt FROM r) SELECT g, count(*) AS n, count(ci) AS valid, round(avg(ci), 6) AS mean_index, round(avg(tt), 6) AS mean_t50 FROM k GROUP BY 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("g"), (700 + F.col("l_quantity") * 8).alias("d"), (F.col("l_extendedprice") / 150).alias("t"))
    ci = C.cetane_index("d", "t")
    return round_all(l.groupBy("g").agg(F.count("*").alias("n"), F.count(ci).alias("valid"), F.avg(ci).alias("mean_index"), F.avg(C.inside("t", 100, 450)).alias("mean_t50")))


@query("physics_features", "P9", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity - 5 AS a, l_extendedprice / 1000 - 10 AS b, l_discount AS c, l_quantity AS d FROM lineitem), k AS (SELECT CASE WHEN a > 0 THEN a + 273.15 END AS kelvin, CASE WHEN b > 0 THEN b END AS p, CASE WHEN c > 0 THEN c END AS f, CASE WHEN d > 0 THEN d END AS g, l_linenumber FROM r)
   SELECT l_linenumber, round(avg(1000 / kelvin), 9) AS inverse_kelvin, round(avg(ln(p)), 9) AS log_pressure, round(avg(ln(f)), 9) AS log_flow, round(avg(g / f), 6) AS gas_oil, round(avg(ln(g / f)), 9) AS log_gas_oil, count(kelvin) AS n FROM k GROUP BY 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_quantity") - 5).alias("a"), (F.col("l_extendedprice") / 1000 - 10).alias("b"), F.col("l_discount").alias("c"), F.col("l_quantity").alias("d"))
    p = P.physics("a", "b", "c", "d")
    digits = lambda k: 6 if k == "gas_oil" else 9
    return l.groupBy("l_linenumber").agg(*[rounded(F.avg(p[k]), digits(k)).alias(k) for k in ("inverse_kelvin", "log_pressure", "log_flow", "gas_oil", "log_gas_oil")], F.count(p["kelvin"]).alias("n"))


@query("balance_features", "P10", WIDE + f""" SELECT {ts_text('make_timestamp(t)')} AS timestamp, round(T1 - F2, 6) AS delta, round(T1 / nullif(F1, 0), 6) AS ratio, round(F2, 6) AS level FROM w""")
def _(spark, sf):
    b = P.balance({"delta": ("T1", "F2", "difference"), "ratio": ("T1", "F1", "ratio"), "level": ("F2", None, "value")})
    return round_all(tag_rows(spark, sf).select(C.from_micros("t").alias("timestamp"), *b))


@query("unit_conversion", "P13", """WITH u(unit, factor) AS (VALUES ('mass_pct', 10000.0), ('mg_kg', 1.0), ('g_kg', 1000.0)), r AS (SELECT ['mass_pct', 'mg_kg', 'g_kg', 'ppb'][1 + CAST(l_orderkey % 4 AS INTEGER)] AS unit, l_discount AS v FROM lineitem)
   SELECT r.unit, count(*) AS n, round(sum(v * factor), 4) AS total, any_value(factor) IS NOT NULL AS confirmed FROM r LEFT JOIN u USING (unit) GROUP BY 1""")
def _(spark, sf):
    u = spark.createDataFrame([("mass_pct", 10000.0), ("mg_kg", 1.0), ("g_kg", 1000.0)], "unit string, factor double")
    r = table(spark, sf, "lineitem").select(F.element_at(F.array(*[F.lit(x) for x in ("mass_pct", "mg_kg", "g_kg", "ppb")]), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("unit"), F.col("l_discount").alias("v"))
    g = r.groupBy("unit").agg(F.count("*").alias("n"), F.sum("v").alias("s")).join(u, "unit", "left")
    return g.select("unit", "n", rounded(F.col("s") * F.col("factor"), 4).alias("total"), F.col("factor").isNotNull().alias("confirmed"))


@query("non_finite_to_null", "P12", """SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0) AS finite, round(sum(CASE WHEN l_discount > 0 THEN ln(l_discount) END), 6) AS total FROM lineitem GROUP BY 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_discount") > 0, F.ln("l_discount")).when(F.col("l_linenumber") % 2 == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))).alias("x"))
    return l.groupBy("flag").agg(F.count("*").alias("n"), F.count(C.finite("x")).alias("finite"), rounded(F.sum(C.finite("x"))).alias("total"))


KIN = GRID + f""", f AS (SELECT origin, {asof_sql('ev.click', 'o.origin', 2 * H)} AS t1, {asof_sql('ev.error', 'o.origin', 2 * H)} AS f1, {asof_sql('ev.signup', 'o.origin', 2 * H)} AS p1, {asof_sql(ANALYSER, 'o.origin', 2 * H)} AS s1,
   (SELECT max(l.t) FROM lab l WHERE l.t + {240 * M} <= origin) AS lt FROM o), g AS (SELECT f.*, l.value AS last, {asof_sql('ev.click', 'f.lt', 2 * H)} AS t0, {asof_sql('ev.error', 'f.lt', 2 * H)} AS f0, {asof_sql('ev.signup', 'f.lt', 2 * H)} AS p0, {asof_sql(ANALYSER, 'f.lt', 2 * H)} AS s0 FROM f JOIN lab l ON l.t = f.lt),
   p AS (SELECT *, coalesce(last > 0 AND s0 > last AND t0 > 0 AND p0 > 0 AND f0 > 0 AND s1 > 0 AND t1 > 0 AND p1 > 0 AND f1 > 0, FALSE) AS ok FROM g, (VALUES (0), (30000), (60000), (90000)) e(energy), (VALUES (0.0), (0.5), (1.0)) q(ord))"""


@query("anchored_kinetics", "P11 J14", KIN + """ SELECT CAST(energy AS INTEGER) AS energy, CAST(ord AS DOUBLE) AS pressure_order, count(*) AS moments, count(*) FILTER (WHERE ok) AS anchored,
   round(avg(ln(0.3 + CASE WHEN ok THEN s1 * exp(-ln(s0 / last) * exp(greatest(-15, least(15, energy / 8.314 * (1 / (t0 + 273.15) - 1 / (t1 + 273.15))))) * pow(p1 / p0, ord) * (f0 / f1)) ELSE last END)), 6) AS mean_log FROM p GROUP BY 1, 2""")
def _(spark, sf):
    s = clean(spark, sf)
    names = {"t": ("ev.click", 0), "f": ("ev.error", 0), "p": ("ev.signup", 0), "s": (ANALYSER, 0)}
    o = X.origin_grid(s)
    now = X.lookup(o, s, names, 2 * H)
    lab = X.previous_lab(o, labs(spark, sf), max_age=3650 * D).filter("previous_lab IS NOT NULL")
    then = X.lookup(lab.select(F.col("lab_sample_t").alias("origin")), s, names, 2 * H).select(F.col("origin").alias("lab_sample_t"), *[F.col(k).alias(f"{k}0") for k in names])
    d = lab.join(now, "origin").join(then, "lab_sample_t")
    grid = F.array(*[F.struct(F.lit(e).alias("energy"), F.lit(q).alias("pressure_order")) for e in (0, 30000, 60000, 90000) for q in (0.0, 0.5, 1.0)])
    d = d.select("*", F.inline(grid))
    k = lambda x: F.when(F.col(x) > 0, F.col(x) + 273.15)
    y, ok = P.kinetic_prediction("previous_lab", "s0", k("t0"), "p0", "f0", "s", k("t"), "p", "f", F.col("energy"), F.col("pressure_order"))
    return round_all(d.groupBy("energy", "pressure_order").agg(F.count("*").alias("moments"), F.count_if(ok).alias("anchored"), F.avg(F.ln(0.3 + y)).alias("mean_log")))


SAMPLES = OBS + f""", r AS (SELECT metric_id, epoch_us(timestamp) AS t, value, flags, CASE WHEN source_row % 9 = 0 THEN NULL ELSE 'mg/kg' END AS unit FROM obs WHERE epoch_us(timestamp) <= epoch_us(TIMESTAMP '{AT}') - {240 * M}),
  g AS (SELECT metric_id, t, min(value) AS lo, max(value) AS hi, count(*) AS copies, bool_or(contains(flags, 'invalid')) AS bad, bool_or(contains(flags, 'suspect')) AS sus, min(unit) AS ul, count(unit) AS nu FROM r GROUP BY 1, 2),
  s AS (SELECT metric_id, t, row_number() OVER (PARTITION BY metric_id ORDER BY t DESC) AS rn, CASE WHEN lo = hi THEN lo END AS value, CASE WHEN nu = copies THEN ul END AS unit,
    concat_ws('|', CASE WHEN lo <> hi THEN 'conflict' END, CASE WHEN bad THEN 'invalid' END, CASE WHEN sus THEN 'suspect' END) AS flags, copies FROM g)"""


def samples(spark, sf):
    o = obs(spark, sf).withColumn("unit", F.when(F.col("source_row") % 9 != 0, "mg/kg"))
    return P.latest_samples(o, us(AT))


@query("latest_samples", "W2 W3", SAMPLES + f"""SELECT metric_id, {ts_text('make_timestamp(t)')} AS sampled, CAST(rn AS INTEGER) AS rn, value, unit, flags, copies,
   value IS NOT NULL AND flags = '' AND unit = 'mg/kg' IS TRUE AS valid, concat_ws('|', CASE WHEN value IS NULL OR flags <> '' THEN 'unreliable' END, CASE WHEN unit IS NULL THEN 'unit_not_confirmed' END, CASE WHEN (epoch_us(TIMESTAMP '{AT}') - t) / {M}.0 > 270 THEN 'stale' END) AS reasons
   FROM s WHERE rn <= 3""".replace("unit = 'mg/kg' IS TRUE", "coalesce(unit = 'mg/kg', FALSE)"))
def _(spark, sf):
    d = samples(spark, sf).withColumn("expected_unit", F.lit("mg/kg"))
    ok, why = P.usable_sample(us(AT), 270)
    return d.select("metric_id", C.from_micros("t").alias("sampled"), "rn", "value", "unit", "flags", "copies", ok.alias("valid"), F.array_join(why, "|").alias("reasons"))


@query("median_of_latest_samples", "W4", SAMPLES + f"""SELECT metric_id, bool_and(value IS NOT NULL AND flags = '') AS clean, epoch_us(TIMESTAMP '{AT}') - max(t) <= {48 * H} AS recent,
   round(CASE WHEN bool_and(value IS NOT NULL AND flags = '') AND epoch_us(TIMESTAMP '{AT}') - max(t) <= {48 * H} THEN quantile_cont(value, 0.5) END, 6) AS estimate FROM s WHERE rn <= 3 GROUP BY 1""")
def _(spark, sf):
    return round_all(P.median_of_latest(samples(spark, sf), us(AT)))


SLOTS = OBS + f""", sl AS (SELECT metric_id, t // {H} AS slot, arg_max(value, t) AS value FROM clean GROUP BY 1, 2)"""


@query("resampled_grid", "W20", OBS + f""", sl AS (SELECT metric_id, t // {10 * M} AS slot, arg_max(value, t) AS value FROM clean GROUP BY 1, 2), e AS (SELECT metric_id, min(slot) AS lo, max(slot) AS hi FROM sl GROUP BY 1),
   g AS (SELECT metric_id, unnest(range(lo, hi + 1)) AS slot FROM e) SELECT g.metric_id, g.slot, round(value, 6) AS value FROM g LEFT JOIN sl USING (metric_id, slot) WHERE g.slot % 3 = 0""")
def _(spark, sf):
    return round_all(P.every_nth(P.regular_grid(P.resample_last(clean(spark, sf))), 3))


def slot_table(spark, sf):
    r = P.resample_last(clean(spark, sf), H)
    names = {"s": ANALYSER, **CONTROL_MAP}
    w = r.groupBy("slot").agg(*[F.max(F.when(F.col("metric_id") == m, F.col("value"))).alias(n) for n, m in names.items()])
    return w.withColumn("s", C.floored_ln("s"))


SPECS = {"T": (40.0, False), "F": (60.0, True), "P": (40.0, False)}


def step_sql(merged):
    h, half, hours = 2, 1, 4
    base = SLOTS + f""", w AS (SELECT slot, CASE WHEN max(value) FILTER (WHERE metric_id = '{ANALYSER}') IS NOT NULL THEN ln(greatest(max(value) FILTER (WHERE metric_id = '{ANALYSER}'), 0.3)) END AS s, max(value) FILTER (WHERE metric_id = 'ev.click') AS T,
      max(value) FILTER (WHERE metric_id = 'ev.error') AS F, max(value) FILTER (WHERE metric_id = 'ev.signup') AS P FROM sl WHERE metric_id <> '{LAB}' OR TRUE GROUP BY 1),
      r AS (SELECT *, coalesce(T > 2 AND F > 2, FALSE) AS ok, CASE WHEN coalesce(T > 2 AND F > 2, FALSE) THEN s END AS x FROM w),
      d AS (SELECT a.*, a.T - b.T AS dT, CASE WHEN b.F <> 0 THEN (a.F / b.F - 1) * 100 END AS dF, a.P - b.P AS dP FROM r a LEFT JOIN r b ON b.slot = a.slot - {h}),
      c AS (SELECT 'T' AS control, slot, dT AS step FROM d WHERE abs(dT) >= 40 AND ok AND abs(dF) < 60 AND abs(dP) < 40 UNION ALL SELECT 'F', slot, dF FROM d WHERE abs(dF) >= 60 AND ok AND abs(dT) < 40 AND abs(dP) < 40
        UNION ALL SELECT 'P', slot, dP FROM d WHERE abs(dP) >= 40 AND ok AND abs(dT) < 40 AND abs(dF) < 60), lim AS (SELECT min(slot) AS lo, max(slot) AS hi FROM w)"""
    if merged:
        base += f""", m AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY control ORDER BY slot) <= {h} THEN 0 ELSE 1 END AS nw FROM c), m2 AS (SELECT *, sum(nw) OVER (PARTITION BY control ORDER BY slot) AS cl FROM m),
          ev AS (SELECT control, min(slot) AS fs, max(slot) AS ls, arg_max(step, (abs(step), -slot)) AS step FROM m2 GROUP BY control, cl)"""
    else:
        base += ", ev AS (SELECT control, slot AS fs, slot AS ls, step FROM c)"
    rk = ", ".join(f"(SELECT avg(x) FROM r WHERE slot BETWEEN ls + {k * h - half} AND ls + {k * h + half - 1}) AS r{k}" for k in range(1, hours + 1))
    return base + f""", q AS (SELECT ev.*, (SELECT avg(x) FROM r WHERE slot BETWEEN fs - {h} AND fs - 1) AS base, {rk} FROM ev, lim WHERE fs - {h} >= lo AND ls + {(hours + 1) * h - half} <= hi),
      z AS (SELECT control, {', '.join(f'(r{k} - base) / step AS h{k}' for k in range(1, hours + 1))} FROM q WHERE base IS NOT NULL AND step <> 0 AND {' AND '.join(f'r{k} IS NOT NULL' for k in range(1, hours + 1))}),
      y AS (SELECT control, count(*) AS events, {', '.join(f'quantile_cont(h{k}, 0.5) AS h{k}' for k in range(1, hours + 1))} FROM z GROUP BY 1), v AS (SELECT *, h2 + h3 + h4 - greatest(h2, h3, h4) - least(h2, h3, h4) AS coefficient FROM y)
      SELECT control, events, {', '.join(f'round(h{k}, 9) AS h{k}' for k in range(1, hours + 1))}, round(coefficient, 9) AS coefficient, CAST(CASE WHEN abs(h1) >= 0.8 * abs(coefficient) THEN 60 WHEN abs(h2) >= 0.8 * abs(coefficient) THEN 120 WHEN abs(h3) >= 0.8 * abs(coefficient) THEN 180 ELSE 60 END AS INTEGER) AS lag_minutes FROM v"""


def steps(spark, sf, merged):
    return P.step_events(slot_table(spark, sf), "s", SPECS, X.in_regime({"T": (2, None), "F": (2, None)}), 1.0, 4, 2, merged)


@query("step_response", "W16", step_sql(False))
def _(spark, sf):
    return round_all(P.response_summary(steps(spark, sf, False), 4), 9)


@query("step_response_merged", "W17", step_sql(True))
def _(spark, sf):
    return round_all(P.response_summary(steps(spark, sf, True), 4), 9)


@query("step_response_spread", "W17 A21")
def _(spark, sf):
    return round_all(P.response_bootstrap(steps(spark, sf, True), hours=4), 9)


# Soft-sensor backtest: formulas against candidate laboratory series.
BACK = OBS + f""", lab AS (SELECT metric_id, t, value FROM clean WHERE metric_id IN ('{LAB}', '{ANALYSER}')), i AS (SELECT lab.*, {asof_sql('ev.click', 'lab.t', 30 * M)} AS T1, {asof_sql('ev.error', 'lab.t', 30 * M)} AS F1, {asof_sql('ev.signup', 'lab.t', 30 * M)} AS F2,
   (SELECT arg_max(q.value, q.t) FROM clean q WHERE q.metric_id = '{LAB}' AND q.t + {240 * M} <= lab.t AND q.t + {240 * M} >= lab.t - {7 * D}) AS LX0 FROM lab),
   e AS (SELECT metric_id, 'a' AS formula, value AS y, 20 + 0.5 * T1 + 0.1 * F1 AS p FROM i UNION ALL SELECT metric_id, 'b', value, CASE WHEN abs(F1 + F2) >= 1e-9 THEN 80 * F1 / (F1 + F2) END FROM i UNION ALL SELECT metric_id, 'c', value, 5 + 0.9 * LX0 + 0.01 * F2 FROM i),
   k AS (SELECT * FROM e WHERE p IS NOT NULL), md AS (SELECT metric_id, formula, quantile_cont(p - y, 0.5) AS b, quantile_cont(y, 0.5) AS m FROM k GROUP BY 1, 2),
   r AS (SELECT metric_id, formula, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, avg(p - y) AS bias, corr(p, y) AS correlation, avg(abs(p - y - b)) AS mae_after_bias, avg(abs(y - m)) AS mae_constant FROM k JOIN md USING (metric_id, formula) GROUP BY 1, 2 HAVING count(*) >= 10)
   SELECT metric_id, formula, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(correlation, 6) AS correlation, round(mae_after_bias, 6) AS mae_after_bias, round(mae_constant, 6) AS mae_constant,
   row_number() OVER (PARTITION BY formula ORDER BY mae_after_bias, metric_id) = 1 AS best FROM r"""


@query("soft_sensor_backtest", "M30 A12 P4", BACK)
def _(spark, sf):
    from pyspark.sql import Window
    from ..operators.quantiles import quantiles
    from ..operators.timejoin import published_asof
    s = clean(spark, sf)
    targets = s.filter(F.col("metric_id").isin(LAB, ANALYSER)).select("metric_id", F.col("t").alias("origin"), "value")
    tags = X.lookup(targets, s, {"T1": ("ev.click", 0), "F1": ("ev.error", 0), "F2": ("ev.signup", 0)})
    lab = labs(spark, sf).withColumn("_k", F.lit(0))
    o = targets.select("origin").distinct().withColumn("_k", F.lit(0))
    lx = published_asof(o, lab, ["_k"], "origin", "t", ["value"], 240 * M, 7 * D + 240 * M).select("origin", F.col("lab.value").alias("LX0"))
    i = targets.join(tags, "origin").join(lx, "origin")
    texts = {"a": "20 + 0.5*T1 + 0.1*F1", "b": "80*F1/(F1+F2)", "c": "5 + 0.9*LIMS.X + 0.01*F2"}
    cells = F.array(*[F.struct(F.lit(k).alias("formula"), FM.evaluate(t)[0].alias("p")) for k, t in texts.items()])
    k = staged(i.select("metric_id", F.col("value").alias("y"), F.inline(cells)).filter("p IS NOT NULL").withColumn("e", F.col("p") - F.col("y")))
    key = ["metric_id", "formula"]
    k = k.join(quantiles(k, key, "e", [0.5], ["b"]), key).join(quantiles(k, key, "y", [0.5], ["m"]), key)
    r = k.groupBy(*key).agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.corr("p", "y").alias("correlation"),
                            F.avg(F.abs(F.col("e") - F.col("b"))).alias("mae_after_bias"), F.avg(F.abs(F.col("y") - F.col("m"))).alias("mae_constant")).filter("n >= 10")
    w = Window.partitionBy("formula").orderBy("mae_after_bias", "metric_id")
    return round_all(r.withColumn("best", F.row_number().over(w) == 1))
