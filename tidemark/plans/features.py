"""Time joins and past-only features at prediction moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as X
from ..operators import timejoin as TJ
from ..operators.history import bounded_history, in_ranges, runtime_sources
from ..operators.stage import staged
from .adapter import ANALYSER, LAB, OBS, SECOND_ANALYSER, from_events, obs, one_per_time, table, ts_text
from .registry import query, rounded
from .series import round_all

M, H, D = C.MINUTE, C.HOUR, C.DAY
ANALYSERS = {"qa": SECOND_ANALYSER, "pa": ANALYSER}
CONTROL_MAP = {"T": "ev.click", "F": "ev.error", "P": "ev.signup"}


def clean(spark, sf):
    """One valid reading per (metric, t): the analysis load."""
    return one_per_time(obs(spark, sf).filter(C.is_valid()))


def labs(spark, sf):
    return clean(spark, sf).filter(F.col("metric_id") == LAB).select("t", "value")


def lab_origins(spark, sf, horizon=0):
    return labs(spark, sf).select((F.col("t") - horizon).alias("origin"))


def asof_sql(metric, at, tol, what="value"):
    return f"(SELECT arg_max(c.{what}, c.t) FROM clean c WHERE c.metric_id = '{metric}' AND c.t <= {at} AND c.t >= {at} - {tol})"


def mean_sql(metric, at, lo, hi, k):
    return f"(SELECT CASE WHEN count(*) >= {k} THEN avg(c.value) END FROM clean c WHERE c.metric_id = '{metric}' AND c.t > {at} + ({lo}) AND c.t <= {at} + ({hi}))"


def ln_sql(x):
    return f"ln(greatest({x}, 0.3))"


def fln(x):
    """Floored log in SQL that keeps NULL (DuckDB's greatest skips NULLs)."""
    return f"CASE WHEN {x} IS NOT NULL THEN ln(greatest({x}, 0.3)) END"


ORIGINS = OBS + f", lab AS (SELECT t, value FROM clean WHERE metric_id = '{LAB}'), o AS (SELECT t AS origin FROM lab)"


@query("analysis_load", "S16 Q15 J8", OBS + """SELECT metric_id, count(*) AS n, round(sum(value), 4) AS total, CAST(sum(source_row) AS BIGINT) AS row_sum,
   CAST(count(DISTINCT t) AS BIGINT) AS times FROM clean WHERE metric_id IN ('ev.view', 'ev.purchase', 'ev.click') GROUP BY 1""")
def _(spark, sf):
    return clean(spark, sf).filter(F.col("metric_id").isin(ANALYSER, LAB, SECOND_ANALYSER)).groupBy("metric_id").agg(
        F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total"), F.sum("source_row").alias("row_sum"), F.count("t").alias("times"))


@query("asof_tolerance", "J1 J11", ORIGINS + f"""SELECT {ts_text('make_timestamp(origin)')} AS origin, m.metric_id, round(v, 6) AS value FROM o,
   (VALUES ('ev.view'), ('ev.click')) m(metric_id), LATERAL (SELECT arg_max(c.value, c.t) AS v FROM clean c
   WHERE c.metric_id = m.metric_id AND c.t <= origin AND c.t >= origin - {10 * M})""")
def _(spark, sf):
    left = lab_origins(spark, sf).withColumn("metric_id", F.explode(F.array(F.lit(ANALYSER), F.lit(SECOND_ANALYSER))))
    j = TJ.asof(left, clean(spark, sf), ["metric_id"], "origin", "t", ["value"], [], 10 * M)
    return j.select(C.from_micros("origin").alias("origin"), "metric_id", rounded(F.col("hit.value")).alias("value"))


@query("asof_unbounded", "J1", ORIGINS + f"""SELECT {ts_text('make_timestamp(origin)')} AS origin, round(arg_max(c.value, c.t), 6) AS value,
   CAST(max(c.t) AS BIGINT) AS t FROM o JOIN clean c ON c.metric_id = 'ev.view' AND c.t < origin GROUP BY origin""")
def _(spark, sf):
    left = lab_origins(spark, sf).withColumn("metric_id", F.lit(ANALYSER))
    j = TJ.asof(left, clean(spark, sf), ["metric_id"], "origin", "t", ["value"], strict=True, width=6 * H)
    return j.filter("hit is not null").select(C.from_micros("origin").alias("origin"), rounded(F.col("hit.value")).alias("value"), F.col("hit.t").alias("t"))


@query("published_lab_asof", "J2", OBS + f""", lab AS (SELECT t, value FROM clean WHERE metric_id = '{LAB}'),
   g AS (SELECT t AS origin FROM clean WHERE metric_id = 'ev.view'),
   j AS (SELECT origin, max(l.t) AS st, arg_max(l.value, l.t) AS v FROM g LEFT JOIN lab l ON l.t + {240 * M} <= origin GROUP BY 1)
   SELECT {ts_text('make_timestamp(origin)')} AS origin, {ts_text(f'CASE WHEN origin - st <= {5 * H} THEN make_timestamp(st) END')} AS sampled,
   {ts_text(f'CASE WHEN origin - st <= {5 * H} THEN make_timestamp(st + {240 * M}) END')} AS available, round(CASE WHEN origin - st <= {5 * H} THEN v END, 6) AS value FROM j""")
def _(spark, sf):
    o = clean(spark, sf).filter(F.col("metric_id") == ANALYSER).select(F.col("t").alias("origin"))
    j = X.previous_lab(o, labs(spark, sf), max_age=5 * H)
    return j.select(C.from_micros("origin").alias("origin"), C.from_micros("lab_sample_t").alias("sampled"),
                    C.from_micros("lab_available_t").alias("available"), rounded(F.col("previous_lab")).alias("value"))


HISTORY_LEVEL = 220  # the batch: samples far above the limit, whose inputs are to be looked into
HISTORY = runtime_sources([ANALYSER], ["ev.click", "ev.error", "ev.signup"], LAB)


@query("bounded_history", "S17", OBS + f""", o AS (SELECT DISTINCT t AS origin FROM clean WHERE metric_id = '{LAB}' AND value > {HISTORY_LEVEL}),
   w AS (""" + " UNION ALL ".join(f"""SELECT '{n}' AS source, metric_id, t, value, (SELECT min(origin) FROM o WHERE origin >= t + {s.delay} AND origin - t {'<=' if s.closed else '<'} {s.age}) AS first_origin
     FROM clean WHERE metric_id IN ({', '.join(f"'{m}'" for m in s.metrics)})""" + (f" AND value >= {s.lowest}" if s.lowest is not None else "") for n, s in HISTORY.items()) + f""")
   SELECT source, metric_id, {ts_text('make_timestamp(t)')} AS timestamp, round(value, 6) AS value, {ts_text('make_timestamp(first_origin)')} AS first_origin FROM w WHERE first_origin IS NOT NULL""")
def _(spark, sf):
    batch = labs(spark, sf).filter(F.col("value") > HISTORY_LEVEL).select(F.col("t").alias("origin"))
    # Observation times are whole minutes, stored ones are not.
    read = lambda ranges: from_events(table(spark, sf, "events").filter(in_ranges("ts", ranges, M - 1)))
    d = bounded_history(read, batch, HISTORY)
    return d.select("source", "metric_id", C.from_micros("t").alias("timestamp"), rounded(F.col("value")).alias("value"), C.from_micros("first_origin").alias("first_origin"))


@query("order_ship_publication", "J2", """WITH ship AS (SELECT l_suppkey, o_orderdate, max(l_shipdate) AS shipped, max(o_totalprice) AS price
     FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
   SELECT l_suppkey AS supplier, count(*) AS samples, round(sum(price), 2) AS total, CAST(sum(date_diff('day', o_orderdate, shipped)) AS BIGINT) AS delay_days FROM ship GROUP BY 1""")
def _(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_shipdate")
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    s = j.groupBy("l_suppkey", "o_orderdate").agg(F.max("l_shipdate").alias("shipped"), F.max("o_totalprice").alias("price"))
    return s.groupBy(F.col("l_suppkey").alias("supplier")).agg(
        F.count("*").alias("samples"), rounded(F.sum("price"), 2).alias("total"), F.sum(F.datediff("shipped", "o_orderdate")).cast("long").alias("delay_days"))


@query("analyser_around_sample", "J5", ORIGINS + f"""SELECT {ts_text('make_timestamp(origin)')} AS sampled,
   round({mean_sql(ANALYSER, 'origin', -30 * M, 30 * M, 2)}, 6) AS pa_level, round({mean_sql(SECOND_ANALYSER, 'origin', -30 * M, 30 * M, 2)}, 6) AS qa_level FROM o""")
def _(spark, sf):
    d = X.centred_mean(lab_origins(spark, sf), clean(spark, sf), ANALYSERS)
    return round_all(d.select(C.from_micros("origin").alias("sampled"), "pa_level", "qa_level"))


@query("rolling_means", "W5", ORIGINS + f"""SELECT {ts_text('make_timestamp(origin)')} AS origin, round({mean_sql(ANALYSER, 'origin', -H, 0, 3)}, 9) AS p_1h,
   round({mean_sql(ANALYSER, 'origin', -6 * H, 0, 18)}, 9) AS p_6h, round({mean_sql(ANALYSER, 'origin', -24 * H, 0, 36)}, 9) AS p_24h FROM o""")
def _(spark, sf):
    d = X.rolling(lab_origins(spark, sf), clean(spark, sf), {"p": ANALYSER}, {"1h": (-H, 0, 3), "6h": (-6 * H, 0, 18), "24h": (-24 * H, 0, 36)}, width=H)
    return round_all(d.withColumn("origin", C.from_micros("origin")), 9)


@query("change_over_hours", "W6 P8", ORIGINS + f"""SELECT {ts_text('make_timestamp(origin)')} AS origin,
   round({asof_sql('ev.error', 'origin', 30 * M)} - {asof_sql('ev.error', f'(origin - {H})', 30 * M)}, 6) AS d_1h,
   round({fln(asof_sql('ev.error', 'origin', 30 * M))} - {fln(asof_sql('ev.error', f'(origin - {3 * H})', 30 * M))}, 6) AS dln_3h FROM o""")
def _(spark, sf):
    d = X.lookup(lab_origins(spark, sf), clean(spark, sf), {"now": ("ev.error", 0), "h1": ("ev.error", H), "h3": ("ev.error", 3 * H)})
    return round_all(d.select(C.from_micros("origin").alias("origin"), (F.col("now") - F.col("h1")).alias("d_1h"),
                              (C.floored_ln("now") - C.floored_ln("h3")).alias("dln_3h")))


@query("telemetry_features", "W7 J12", ORIGINS + f""", a AS (SELECT origin, {asof_sql('ev.click', 'origin', 30 * M)} AS T, {asof_sql('ev.error', 'origin', 30 * M)} AS F,
   {asof_sql('ev.click', 'origin', 30 * M, 't')} AS tt, {asof_sql('ev.error', 'origin', 30 * M, 't')} AS ft,
   {mean_sql('ev.click', 'origin', -H, 0, 1)} AS t1, {mean_sql('ev.error', 'origin', -H, 0, 1)} AS f1, {mean_sql('ev.click', 'origin', -6 * H, 0, 1)} AS t6, {mean_sql('ev.error', 'origin', -6 * H, 0, 1)} AS f6 FROM o)
   SELECT {ts_text('make_timestamp(origin)')} AS origin, round(T, 6) AS T, round(F, 6) AS F, round(CASE WHEN tt IS NOT NULL THEN t1 END, 6) AS T_mean_1h,
   round(CASE WHEN ft IS NOT NULL THEN f1 END, 6) AS F_mean_1h, round(CASE WHEN tt IS NOT NULL THEN t6 END, 6) AS T_mean_6h, round(CASE WHEN ft IS NOT NULL THEN f6 END, 6) AS F_mean_6h,
   {ts_text('make_timestamp(greatest(tt, ft))')} AS newest FROM a""")
def _(spark, sf):
    d = X.telemetry_features(lab_origins(spark, sf), clean(spark, sf), {"T": "ev.click", "F": "ev.error"})
    return round_all(d.withColumn("origin", C.from_micros("origin")).withColumn("newest", C.from_micros("newest_t")).drop("newest_t"))


@query("lagged_copies", "W15", ORIGINS + f"""SELECT {ts_text('make_timestamp(origin)')} AS origin, {', '.join(f"round({asof_sql('ev.signup', f'(origin - {k * M})', 30 * M)}, 6) AS lag_{k}" for k in (60, 120, 180))} FROM o""")
def _(spark, sf):
    d = X.lookup(lab_origins(spark, sf), clean(spark, sf), {f"lag_{k}": ("ev.signup", k * M) for k in (60, 120, 180)})
    return round_all(d.withColumn("origin", C.from_micros("origin")))


def anchor_sql(max_age, samples=10, level=5):
    return f""", lev AS (SELECT lab.t AS lt, lab.value AS lv, {mean_sql(SECOND_ANALYSER, 'lab.t', -30 * M, 30 * M, 2)} AS cq, {mean_sql(ANALYSER, 'lab.t', -30 * M, 30 * M, 2)} AS cp FROM lab),
   pub AS (SELECT o.origin, lev.*, row_number() OVER (PARTITION BY o.origin ORDER BY lt DESC) AS rn FROM (SELECT DISTINCT origin FROM o) o JOIN lev ON lt + {240 * M} <= origin AND lt >= origin - {max_age}),
   anc AS (SELECT origin, quantile_cont(lv, 0.5) FILTER (WHERE rn <= {level}) AS level, quantile_cont(lv - cq, 0.5) FILTER (WHERE rn <= {samples}) AS offset_qa,
     quantile_cont(lv - cp, 0.5) FILTER (WHERE rn <= {samples}) AS offset_pa, count(lv - cq) FILTER (WHERE rn <= {samples}) AS pairs_qa, count(lv - cp) FILTER (WHERE rn <= {samples}) AS pairs_pa FROM pub GROUP BY 1),
   anchor AS (SELECT o.origin, level, offset_qa, offset_pa, coalesce(pairs_qa, 0) AS pairs_qa, coalesce(pairs_pa, 0) AS pairs_pa FROM (SELECT DISTINCT origin FROM o) o LEFT JOIN anc USING (origin))"""


GRID = OBS + f""", lab AS (SELECT t, value FROM clean WHERE metric_id = '{LAB}'), e AS (SELECT min(t) AS lo, max(t) AS hi FROM clean),
   e2 AS (SELECT CAST(ceil(lo / {H}.0) AS BIGINT) * {H} + {D} AS lo, hi FROM e), o AS (SELECT unnest(range(lo, hi + 1, {30 * M})) AS origin FROM e2)"""


@query("origin_grid", "W21", GRID + f" SELECT {ts_text('make_timestamp(origin)')} AS origin FROM o")
def _(spark, sf):
    return X.origin_grid(clean(spark, sf)).select(C.from_micros("origin").alias("origin"))


@query("lab_anchor", "J6", GRID + anchor_sql(45 * D) + f""" SELECT {ts_text('make_timestamp(origin)')} AS origin, round(level, 6) AS level, round(offset_qa, 6) AS offset_qa,
   round(offset_pa, 6) AS offset_pa, pairs_qa, pairs_pa FROM anchor""")
def _(spark, sf):
    s, l = staged_series(spark, sf)
    d = X.lab_anchor(X.origin_grid(s), l, s, ANALYSERS)
    return round_all(d.withColumn("origin", C.from_micros("origin")).withColumn("pairs_qa", F.col("pairs_qa").cast("long")).withColumn("pairs_pa", F.col("pairs_pa").cast("long")))


FEATURES = GRID + anchor_sql(45 * D) + f""", base AS (SELECT a.*, {asof_sql(SECOND_ANALYSER, 'a.origin', 30 * M)} AS qa, {asof_sql(ANALYSER, 'a.origin', 30 * M)} AS pa,
   {mean_sql(SECOND_ANALYSER, 'a.origin', -H, 0, 3)} AS qa1, {mean_sql(ANALYSER, 'a.origin', -H, 0, 3)} AS pa1,
   {mean_sql(SECOND_ANALYSER, 'a.origin', -24 * H, 0, 36)} AS qa24, {mean_sql(ANALYSER, 'a.origin', -24 * H, 0, 36)} AS pa24,
   {asof_sql('ev.click', 'a.origin', 30 * M)} AS T, {asof_sql('ev.click', f'(a.origin - {H})', 30 * M)} AS T1, {asof_sql('ev.click', f'(a.origin - {3 * H})', 30 * M)} AS T3,
   {asof_sql('ev.error', 'a.origin', 30 * M)} AS F, {asof_sql('ev.error', f'(a.origin - {3 * H})', 30 * M)} AS F3,
   {asof_sql('ev.signup', 'a.origin', 30 * M)} AS P_, {asof_sql('ev.signup', f'(a.origin - {3 * H})', 30 * M)} AS P3,
   (SELECT arg_max(lab.value, lab.t) FROM lab WHERE lab.t + {240 * M} <= a.origin) AS pv, (SELECT max(lab.t) FROM lab WHERE lab.t + {240 * M} <= a.origin) AS pt FROM anchor a),
   feat AS (SELECT origin, {fln('qa + offset_qa')} AS ln_qa, {fln('qa1 + offset_qa')} AS ln_qa_1h, {fln('qa24 + offset_qa')} AS ln_qa_24h,
   {fln('pa + offset_pa')} AS ln_pa, {fln('pa1 + offset_pa')} AS ln_pa_1h, {fln('pa24 + offset_pa')} AS ln_pa_24h, {fln('level')} AS ln_level,
   CASE WHEN origin - pt <= {48 * H} THEN ln(greatest(pv, 0.3)) END AS ln_previous_lab, T - T1 AS dT_1h, T - T3 AS dT_3h, {fln('F')} - {fln('F3')} AS dlnF_3h, P_ - P3 AS dP_3h, T, F, P_ AS P,
   pairs_qa, pairs_pa, level, offset_qa, offset_pa, qa, pa, CASE WHEN origin - pt <= {48 * H} THEN pv END AS previous_lab FROM base)
"""
FEATURE_COLUMNS = ["ln_qa", "ln_qa_1h", "ln_pa", "ln_pa_1h", "ln_level", "ln_previous_lab", "ln_qa_24h", "ln_pa_24h", "dT_1h", "dT_3h", "dlnF_3h", "dP_3h", "T", "F", "P"]
MODEL_COLUMNS = FEATURE_COLUMNS[:6]


def staged_series(spark, sf):
    """The cleaned series as a written table (feature building reads it once per feature family) and its labs."""
    s = staged(clean(spark, sf))
    return s, s.filter(F.col("metric_id") == LAB).select("t", "value")


def feature_frame(spark, sf):
    s, l = staged_series(spark, sf)
    return X.anchored_features(X.origin_grid(s), s, l, ANALYSERS, CONTROL_MAP)


@query("anchored_features", "M1 M35", FEATURES + f"SELECT {ts_text('make_timestamp(origin)')} AS origin, {', '.join(f'round({x}, 6) AS {x}' for x in FEATURE_COLUMNS)}, pairs_qa, pairs_pa FROM feat")
def _(spark, sf):
    d = feature_frame(spark, sf)
    return round_all(d.select(C.from_micros("origin").alias("origin"), *FEATURE_COLUMNS, F.col("pairs_qa").cast("long").alias("pairs_qa"), F.col("pairs_pa").cast("long").alias("pairs_pa")))


DYN = GRID + f""", base AS (SELECT origin, {', '.join(f"{asof_sql(m, 'o.origin', 30 * M)} AS {n}0" for n, m in {**ANALYSERS, **CONTROL_MAP}.items())},
  {', '.join(f"{mean_sql(m, 'o.origin', -h * H, 0, k)} AS {n}_{h}" for n, m in ANALYSERS.items() for h, k in ((1, 3), (6, 18), (24, 36)))},
  {', '.join(f"{asof_sql(m, f'(o.origin - {h * H})', 30 * M)} AS {n}{h}" for n, m in CONTROL_MAP.items() for h in (1, 3, 6))} FROM o),
  dyn AS (SELECT origin, {', '.join(f"{fln(f'{n}0')} AS ln_{n}_raw, " + ', '.join(f"{fln(f'{n}_{h}')} AS ln_{n}_raw_{h}h" for h in (1, 6, 24)) for n in ANALYSERS)},
  {', '.join(f"T0 - T{h} AS dT_{h}h, {fln('F0')} - {fln(f'F{h}')} AS dlnF_{h}h, P0 - P{h} AS dP_{h}h" for h in (1, 3, 6))}, T0 AS T, F0 AS F, P0 AS P FROM base)
"""
DYN_COLUMNS = [x for n in ANALYSERS for x in (f"ln_{n}_raw", f"ln_{n}_raw_1h", f"ln_{n}_raw_6h", f"ln_{n}_raw_24h")] + [f"{k}_{h}h" for h in (1, 3, 6) for k in ("dT", "dlnF", "dP")] + ["T", "F", "P"]


@query("dynamics_features", "M2", DYN + f"SELECT {ts_text('make_timestamp(origin)')} AS origin, {', '.join(f'round({x}, 6) AS {x}' for x in DYN_COLUMNS)} FROM dyn")
def _(spark, sf):
    s, _ = staged_series(spark, sf)
    d = X.dynamics_features(X.origin_grid(s), s, ANALYSERS, CONTROL_MAP)
    return round_all(d.select(C.from_micros("origin").alias("origin"), *DYN_COLUMNS))


@query("future_level_target", "M3 J5", GRID + f""", b AS (SELECT origin, {mean_sql(ANALYSER, 'o.origin', 30 * M, 90 * M, 2)} AS y, {asof_sql(ANALYSER, 'o.origin', 30 * M)} AS now FROM o)
   SELECT {ts_text('make_timestamp(origin)')} AS origin, round({fln('y')} - {fln('now')}, 6) AS target FROM b""")
def _(spark, sf):
    s = clean(spark, sf)
    o = X.origin_grid(s)
    y = X.centred_mean(o, s, {"p": ANALYSER}, shift=60 * M)
    now = X.lookup(o, s, {"now": (ANALYSER, 0)})
    return round_all(y.join(now, "origin").select(C.from_micros("origin").alias("origin"), (C.floored_ln("p_level") - C.floored_ln("now")).alias("target")))


@query("analyser_cleaning", "Q14", OBS + f""", s AS (SELECT metric_id, timestamp, t, CASE WHEN value > 0 AND value < 150 THEN value END AS v FROM clean WHERE metric_id IN ('ev.view', 'ev.click')),
   a AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY metric_id ORDER BY t)) <= 25, FALSE) AS same FROM s),
   b AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY metric_id ORDER BY t) AS run FROM a),
   d AS (SELECT *, min(t) OVER (PARTITION BY metric_id, run) AS st FROM b)
   SELECT metric_id, {ts_text('timestamp')} AS timestamp, round(CASE WHEN same AND t - st >= {40 * M} THEN NULL ELSE v END, 6) AS value FROM d""")
def _(spark, sf):
    s = clean(spark, sf).filter(F.col("metric_id").isin(ANALYSER, SECOND_ANALYSER)).withColumn("flags", F.lit(""))
    d = X.clean_analyser(s, 0.0, 150.0, 25.0, 40 * M, width=6 * H)
    return d.select("metric_id", C.from_micros("t").alias("timestamp"), rounded(F.col("value")).alias("value"))


@query("quiet_future_path", "W13", GRID + f""", s AS (SELECT t, value AS x, t - lag(t) OVER (ORDER BY t) AS gap FROM clean WHERE metric_id = 'ev.click'),
   r AS (SELECT origin, (SELECT arg_max(c.x, c.t) FROM s c WHERE c.t <= origin AND c.t >= origin - {45 * M}) AS ref FROM o),
   w AS (SELECT r.origin, ref, max(x) AS hi, min(x) AS lo, count(x) AS n, max(gap) AS g, max(t) AS lt FROM r LEFT JOIN s ON t > r.origin AND t <= r.origin + {60 * M} GROUP BY 1, 2)
   SELECT {ts_text('make_timestamp(origin)')} AS origin, coalesce(ref IS NOT NULL AND n > 0 AND greatest(hi - ref, ref - lo) < 60 AND g <= {45 * M} AND origin + {60 * M} - lt <= {45 * M}, FALSE) AS quiet FROM w""")
def _(spark, sf):
    s = clean(spark, sf)
    d = X.quiet_path(X.origin_grid(s), s, "ev.click", 60 * M, 60.0, max_gap=45 * M)
    return d.withColumn("origin", C.from_micros("origin"))


@query("lab_history_window", "W12 W11", GRID + f""", pub AS (SELECT t + {240 * M} AS p, value FROM lab), x AS (SELECT o.origin, pub.*, row_number() OVER (PARTITION BY o.origin ORDER BY p DESC) AS rn
     FROM o LEFT JOIN pub ON p <= o.origin AND p > o.origin - {7 * D})
   SELECT {ts_text('make_timestamp(origin)')} AS origin, round(quantile_cont(value, 0.5) FILTER (WHERE rn <= 3), 6) AS lab_median3, round(quantile_cont(value, 0.5), 6) AS lab_median_window,
   count(value) AS lab_count_window, round(max(value) FILTER (WHERE rn = 1) - max(value) FILTER (WHERE rn = 2), 6) AS lab_delta FROM x GROUP BY origin""")
def _(spark, sf):
    d = X.lab_window(X.origin_grid(clean(spark, sf)), labs(spark, sf))
    return round_all(d.withColumn("origin", C.from_micros("origin")))


@query("rolling_median_samples", "W11", OBS + f"""SELECT metric_id, {ts_text('timestamp')} AS timestamp, round(median(value) OVER (PARTITION BY metric_id ORDER BY t ROWS 2 PRECEDING), 6) AS median3 FROM clean""")
def _(spark, sf):
    from ..operators.ordered import trailing
    d = trailing(clean(spark, sf), ["metric_id"], "t", [], ["value"], 3, 6 * H)
    return d.select("metric_id", C.from_micros("t").alias("timestamp"), rounded(C.median_of(F.transform("recent", lambda x: x.value))).alias("median3"))


@query("regime_mask", "Q20", DYN + """SELECT coalesce(T > 5 AND T < 200 AND F > 3 AND P > 2, FALSE) AS normal, count(*) AS n FROM dyn GROUP BY 1""")
def _(spark, sf):
    s = clean(spark, sf)
    d = X.lookup(X.origin_grid(s), s, {k: (m, 0) for k, m in CONTROL_MAP.items()})
    return d.groupBy(X.in_regime({"T": (5, 200), "F": (3, None), "P": (2, None)}).alias("normal")).agg(F.count("*").alias("n"))
