"""Evaluation queries over prediction-shaped rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate as E
from ..operators import features as X
from .adapter import AFTER_AT, AT, LAB, OBS, table, ts_text, obs
from .features import ANALYSERS, CONTROL_MAP, FEATURE_COLUMNS, FEATURES, GRID, ORIGINS, asof_sql, clean, labs, staged_series
from .registry import query, rounded
from .series import round_all, us

M, H, D = C.MINUTE, C.HOUR, C.DAY

# Line items as regression rows: actual and predicted price per flag and year.
REG = """WITH r AS (SELECT l_returnflag AS model, CAST(year(l_shipdate) AS INTEGER) AS year, l_shipdate, l_extendedprice / 1000 AS y,
    CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN NULL ELSE l_quantity * (1 + l_discount) + l_tax * 10 END AS p FROM lineitem)
"""


def reg(spark, sf):
    l = table(spark, sf, "lineitem")
    p = F.when((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "N"), F.lit(None).cast("double")).otherwise(F.col("l_quantity") * (1 + F.col("l_discount")) + F.col("l_tax") * 10)
    return l.select(F.col("l_returnflag").alias("model"), F.year("l_shipdate").alias("year"), "l_shipdate", (F.col("l_extendedprice") / 1000).alias("y"), p.alias("p"))


# Orders as probability rows: event = expensive order, score in [0, 1).
PROB = """WITH r AS (SELECT o_orderpriority AS model, o_orderkey, o_orderdate, o_totalprice > 350000 AS event, ((o_orderkey * 37 + o_custkey) % 997) / 997.0::DOUBLE AS score,
    ((o_custkey * 11 + o_orderkey) % 499) / 499.0::DOUBLE AS other FROM orders)
"""


def event():
    return F.col("event")


def prob(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(F.col("o_orderpriority").alias("model"), "o_orderkey", "o_orderdate", (F.col("o_totalprice") > 350000).alias("event"), (((k * 37 + c) % 997) / 997.0).alias("score"),
                    (((c * 11 + k) % 499) / 499.0).alias("other"))


def metric_sql(group, source, thr, cond="TRUE"):
    return f"""SELECT {group}, count(*) AS n, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(quantile_cont(abs(p - y), 0.5), 6) AS median_absolute_error, round(avg(p - y), 6) AS bias,
  round(corr(y, p), 6) AS correlation, count(*) FILTER (WHERE y > {thr}) AS actual_above, count(*) FILTER (WHERE p > {thr}) AS predicted_above,
  round(count(*) FILTER (WHERE y > {thr} AND p > {thr}) / nullif(count(*) FILTER (WHERE p > {thr}), 0), 6) AS precision, round(count(*) FILTER (WHERE y > {thr} AND p > {thr}) / nullif(count(*) FILTER (WHERE y > {thr}), 0), 6) AS recall,
  round(count(*) FILTER (WHERE y <= {thr} AND p > {thr}) / greatest(1, count(*) FILTER (WHERE y <= {thr})), 6) AS false_alarm_rate FROM {source} WHERE y IS NOT NULL AND p IS NOT NULL AND {cond} GROUP BY ALL"""


@query("regression_metrics", "A12", REG + metric_sql("model, year", "r", 30))
def _(spark, sf):
    return round_all(E.regression_metrics(reg(spark, sf), ["model", "year"], "y", "p", 30.0))


@query("full_denominator_metrics", "A12", REG + """SELECT model, count(*) AS n, count(*) - count(p) AS nonfinite, round(CASE WHEN count(p) = count(*) THEN avg(abs(p - y)) END, 6) AS mae,
   CASE WHEN count(p) = count(*) THEN 'ok' ELSE 'numerical_failure_on_full_denominator' END AS status FROM r GROUP BY 1""")
def _(spark, sf):
    d = reg(spark, sf).withColumn("p", F.coalesce("p", F.lit(float("nan"))))
    return round_all(E.finite_metrics(d, ["model"], "y", "p"))


SCORES = PROB + """, n AS (SELECT *, count(*) OVER (PARTITION BY model, score) AS ties, rank() OVER (PARTITION BY model ORDER BY score) AS rk FROM r),
  ar AS (SELECT *, rk + (ties - 1) / 2.0 AS arank FROM n)"""


@query("probability_metrics", "A13 W19", SCORES + """, u AS (SELECT model, sum(arank) FILTER (WHERE event) AS s, count(*) FILTER (WHERE event) AS p, count(*) FILTER (WHERE NOT event) AS q FROM ar GROUP BY 1),
   b AS (SELECT model, count(*) AS n, avg(event::INT) AS base, avg((score - event::INT) * (score - event::INT)) AS brier, count(*) FILTER (WHERE score >= 0.3) AS alarms, count(*) FILTER (WHERE event AND score >= 0.3) AS tp,
     count(*) FILTER (WHERE NOT event AND score >= 0.3) AS fp FROM r GROUP BY 1)
   SELECT b.model, n, round(base, 6) AS base_rate, round(brier, 6) AS brier, round(base * (1 - base), 6) AS brier_climatology, round(1 - brier / (base * (1 - base)), 6) AS brier_skill,
     round((s - p * (p + 1) / 2.0) / (p * q), 6) AS auc, alarms, round(tp / p, 6) AS recall, round(tp / alarms, 6) AS precision, round(fp / q, 6) AS false_alarm_rate FROM b JOIN u USING (model)""")
def _(spark, sf):
    return round_all(E.probability_metrics(prob(spark, sf), ["model"], event(), "score", 0.3))


@query("label_score_metrics", "A13", """WITH r AS (SELECT source, quality = 1 AS event, (n_chars % 97) / 97.0 AS score FROM labels JOIN documents USING (doc_id)), n AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0 AS ar FROM r),
   g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE event) AS p, count(*) FILTER (WHERE NOT event) AS q, sum(ar) FILTER (WHERE event) AS s, avg((score - event::INT) * (score - event::INT)) AS brier FROM n GROUP BY 1)
   SELECT source, n, round(brier, 6) AS brier, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2.0) / (p * q) END, 6) AS auc FROM g""")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    d = d.select("source", (F.col("quality") == 1).alias("event"), ((F.col("n_chars") % 97) / 97.0).alias("score"))
    return round_all(E.probability_metrics(d, ["source"], event(), "score", 0.3).select("source", "n", "brier", "auc"))


@query("average_ranks", "W19", SCORES + " SELECT model, round(score, 6) AS score, any_value(ties) AS ties, any_value(arank) AS rank FROM ar GROUP BY ALL")
def _(spark, sf):
    return E.average_ranks(E.score_table(prob(spark, sf), ["model"], event(), "score"), ["model"]).withColumn("score", rounded(F.col("score")))


@query("cost_metrics", "A14", PROB + """SELECT model, count(*) AS n, count(*) FILTER (WHERE event AND score >= 0.4) AS tp, count(*) FILTER (WHERE NOT event AND score >= 0.4) AS fp, count(*) FILTER (WHERE event AND score < 0.4) AS fn,
   count(*) FILTER (WHERE NOT event AND score < 0.4) AS tn, round(count(*) FILTER (WHERE event AND score >= 0.4) / count(*) FILTER (WHERE event), 6) AS recall, round(count(*) FILTER (WHERE event AND score >= 0.4) / count(*) FILTER (WHERE score >= 0.4), 6) AS precision,
   round(count(*) FILTER (WHERE NOT event AND score >= 0.4) / count(*) FILTER (WHERE NOT event), 6) AS false_alarm_rate, round(count(*) FILTER (WHERE score >= 0.4) / count(*), 6) AS alarm_share,
   CAST(10 * count(*) FILTER (WHERE event AND score < 0.4) + count(*) FILTER (WHERE NOT event AND score >= 0.4) AS DOUBLE) AS total_cost,
   round((10 * count(*) FILTER (WHERE event AND score < 0.4) + count(*) FILTER (WHERE NOT event AND score >= 0.4)) / count(*) * 100, 6) AS cost_per_100 FROM r GROUP BY 1""")
def _(spark, sf):
    return round_all(E.cost_metrics(prob(spark, sf), ["model"], event(), F.col("score") >= 0.4, F.lit(10)))


DECISIONS = PROB + """, t AS (SELECT DISTINCT model, score AS threshold FROM r UNION ALL SELECT DISTINCT model, 9.0 FROM r),
  g AS (SELECT model, score, count(*) FILTER (WHERE event) AS pos, count(*) FILTER (WHERE NOT event) AS neg FROM r GROUP BY 1, 2),
  c AS (SELECT model, score AS threshold, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS q FROM g),
  d AS (SELECT * FROM c UNION ALL SELECT DISTINCT model, 9.0, 0, 0, p, q FROM c)"""


def decisions(spark, sf):
    return E.alarm_decisions(E.score_table(prob(spark, sf), ["model"], event(), "score"), ["model"])


def finite_threshold(df):
    return df.withColumn("threshold", F.when(F.col("threshold") < 9.0, F.round("threshold", 6)).otherwise(9.0))


@query("cheapest_threshold", "A15", DECISIONS + """, x AS (SELECT model, CAST(r AS DOUBLE) AS ratio, threshold, r * (p - tp) + fp AS cost, tp, fp, p - tp AS fn FROM d, (VALUES (1), (2), (5), (10), (20), (50)) v(r))
   SELECT model, ratio, round(threshold, 6) AS threshold, CAST(cost AS DOUBLE) AS cost, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn FROM x
   QUALIFY row_number() OVER (PARTITION BY model, ratio ORDER BY cost, fn, fp, threshold DESC) = 1""")
def _(spark, sf):
    return finite_threshold(E.cheapest_threshold(decisions(spark, sf), ["model"], [1, 2, 5, 10, 20, 50]))


@query("capped_threshold", "A16", DECISIONS + """, x AS (SELECT model, threshold, tp / greatest(1, p) AS recall, tp / greatest(1, tp + fp) AS precision, fp / greatest(1, q) AS fpr FROM d)
   SELECT model, round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(precision, 6) AS precision, round(fpr, 6) AS fpr FROM x WHERE fpr <= 0.2 QUALIFY row_number() OVER (PARTITION BY model ORDER BY recall DESC, precision DESC, threshold DESC) = 1""")
def _(spark, sf):
    return round_all(finite_threshold(E.capped_threshold(decisions(spark, sf), ["model"], 0.2)))


@query("best_alarm_level", "A17", PROB + """, g AS (SELECT model, v.g, 2.0 * count(*) FILTER (WHERE event AND score >= v.g) / nullif(count(*) FILTER (WHERE event) + count(*) FILTER (WHERE score >= v.g), 0) AS f1
   FROM r, (VALUES (0.2), (0.25), (0.3), (0.35), (0.4), (0.5)) v(g) GROUP BY 1, 2) SELECT model, CAST(g AS DOUBLE) AS alarm_probability, round(coalesce(f1, 0), 6) AS f1 FROM g QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, g) = 1""")
def _(spark, sf):
    return round_all(E.best_f1(prob(spark, sf), ["model"], event(), "score", [0.2, 0.25, 0.3, 0.35, 0.4, 0.5]))


@query("residual_quantile_function", "A18", REG + """SELECT model, CAST(k AS DOUBLE) / 100 AS probability, round(quantile_cont(y - p, 0.01), 9) AS quantile FROM r, range(1, 2) t(k) WHERE p IS NOT NULL GROUP BY 1, 2""" + "".join(
    f" UNION ALL SELECT model, {k}.0 / 100, round(quantile_cont(y - p, {k / 100}), 9) FROM r WHERE p IS NOT NULL GROUP BY 1" for k in range(2, 100)))
def _(spark, sf):
    return round_all(E.residual_quantiles(reg(spark, sf).withColumn("e", F.col("y") - F.col("p")), ["model"], "e"), 9)


@query("residual_bound", "A19", REG + """, n AS (SELECT model, year, y - p AS e, row_number() OVER (PARTITION BY model, year ORDER BY y - p) AS rn, count(*) OVER (PARTITION BY model, year) AS n FROM r WHERE p IS NOT NULL)
   SELECT model, year, any_value(n) AS n, round(max(e) FILTER (WHERE rn = least(n, CAST(ceil((n + 1) * 0.9) AS BIGINT)) AND n >= 30), 6) AS bound FROM n GROUP BY 1, 2""")
def _(spark, sf):
    return round_all(E.residual_bound(reg(spark, sf).withColumn("e", F.col("y") - F.col("p")), ["model", "year"], "e"))


DRIFT = GRID + f""", s AS (SELECT t, value, t - lag(t) OVER (ORDER BY t) AS gap, value - lag(value) OVER (ORDER BY t) AS step FROM lab), k AS (SELECT t, step * step / (gap / {D}.0) AS rate FROM s WHERE gap >= 0.02 * {D}),
   day AS (SELECT DISTINCT origin - origin % {D} AS d FROM o), sg AS (SELECT d, count(rate) AS n, avg(rate) AS m FROM day LEFT JOIN k ON k.t <= d - {240 * M} GROUP BY 1),
   z AS (SELECT o.origin, CASE WHEN n >= 8 THEN n ELSE 0 END AS pairs, CASE WHEN n >= 8 THEN sqrt(m) ELSE 0.311 END AS sigma FROM o JOIN sg ON sg.d = o.origin - o.origin % {D})"""


@query("drift_sigma", "A20", DRIFT + f" SELECT {ts_text('make_timestamp(origin)')} AS origin, pairs, round(sigma, 6) AS sigma FROM z")
def _(spark, sf):
    d = E.drift_sigma_at(X.origin_grid(clean(spark, sf)), labs(spark, sf), min_gap_days=0.02, width=D)
    return round_all(d.withColumn("origin", C.from_micros("origin")).withColumn("pairs", F.col("pairs").cast("long")))


@query("aged_lower_bound", "A20", DRIFT + f""", a AS (SELECT z.*, (SELECT max(l.t) FROM lab l WHERE l.t + {240 * M} <= z.origin) AS pt FROM z)
   SELECT {ts_text('make_timestamp(a.origin)')} AS origin, round((a.origin - pt) / {D}.0, 6) AS age_days, round(l.value - 1.2816 * sigma * sqrt(greatest((a.origin - pt) / {D}.0, 0)), 6) AS lower_bound, (a.origin - pt) / {D}.0 <= 60 AS usable
   FROM a LEFT JOIN lab l ON l.t = a.pt""")
def _(spark, sf):
    o = X.origin_grid(clean(spark, sf))
    s = E.drift_sigma_at(o, labs(spark, sf), min_gap_days=0.02, width=D)
    p = X.previous_lab(o, labs(spark, sf), max_age=3650 * D)
    age = (F.col("origin") - F.col("lab_sample_t")) / D
    j = s.join(p, "origin").withColumn("age_days", age)
    return round_all(j.select(C.from_micros("origin").alias("origin"), "age_days", E.aged_lower_bound("previous_lab", "age_days", "sigma").alias("lower_bound"), (F.col("age_days") <= 60).alias("usable")))


@query("block_bootstrap_interval", "A21", REG + """, f AS (SELECT model, epoch_us(l_shipdate) AS t, abs(p - y) - abs(y - 25) AS d FROM r WHERE p IS NOT NULL), b0 AS (SELECT model, CAST(floor(t / (28 * 86400000000.0)) AS BIGINT) AS k, sum(d) AS s, count(*) AS c FROM f GROUP BY 1, 2),
   b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY k) - 1 AS i FROM b0), n AS (SELECT model, count(*) AS blocks, sum(s) / sum(c) AS mean_delta FROM b GROUP BY 1),
   dr AS (SELECT model, blocks, d.range AS draw, unnest(range(1, blocks + 1)) AS slot FROM n, range(1, 2001) d),
   ix AS (SELECT model, draw, ('0x' || substr(md5(concat_ws('|', model, draw, slot)), 1, 15))::BIGINT % blocks AS i FROM dr),
   x AS (SELECT model, draw, sum(s) / sum(c) AS x FROM ix JOIN b USING (model, i) GROUP BY 1, 2)
   SELECT model, any_value(blocks) AS blocks, round(any_value(mean_delta), 6) AS mean_delta, round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high FROM x JOIN n USING (model) GROUP BY 1""")
def _(spark, sf):
    d = reg(spark, sf).filter("p IS NOT NULL").select("model", C.micros("l_shipdate").alias("t"), (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("y") - 25)).alias("d"))
    return round_all(E.block_bootstrap(d, ["model"], "t", "d", 28, 2000))


# Candidate predictions keyed (origin, horizon), three candidates per order.
CAND = """WITH base AS (SELECT o_orderkey AS origin, CAST(o_orderkey % 4 * 60 AS INTEGER) AS horizon, CAST(year(o_orderdate) AS INTEGER) AS period, o_orderdate, o_totalprice / 1000 AS target, o_orderstatus AS st, o_custkey AS ck FROM orders),
  cand AS (SELECT origin, horizon, period, o_orderdate, target, 'naive' AS candidate, CASE WHEN origin % 7 = 0 THEN NULL ELSE (ck % 500)::DOUBLE END AS prediction FROM base
    UNION ALL SELECT origin, horizon, period, o_orderdate, target, 'ridge', (origin % 500)::DOUBLE FROM base WHERE origin % 11 <> 0
    UNION ALL SELECT origin, horizon, period, o_orderdate, target, 'boost', CASE WHEN st = 'P' THEN NULL ELSE ((origin + ck) % 500)::DOUBLE END FROM base),
  cs AS (SELECT *, CASE WHEN prediction IS NOT NULL THEN 'ok' ELSE 'abstain' END AS status, CASE WHEN prediction IS NOT NULL THEN '' WHEN candidate = 'naive' THEN 'no_lab|stale' ELSE 'outside_support' END AS reasons FROM cand)
"""
CANDIDATES = ["naive", "ridge", "boost"]


def cands(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mk = lambda name, p, keep=F.lit(True): F.when(keep, F.struct(F.lit(name).alias("candidate"), p.cast("double").alias("prediction")))
    rows = F.array_compact(F.array(mk("naive", F.when(k % 7 != 0, c % 500)), mk("ridge", k % 500, k % 11 != 0), mk("boost", F.when(F.col("o_orderstatus") != "P", (k + c) % 500))))
    d = o.select(k.alias("origin"), (k % 4 * 60).cast("int").alias("horizon"), F.year("o_orderdate").alias("period"), "o_orderdate", (F.col("o_totalprice") / 1000).alias("target"), F.inline(rows))
    ok = F.col("prediction").isNotNull()
    return d.withColumn("status", F.when(ok, "ok").otherwise("abstain")).withColumn(
        "reasons", F.when(ok, "").when(F.col("candidate") == "naive", "no_lab|stale").otherwise("outside_support"))


def paired(spark, sf):
    """One row per (origin, horizon) with every candidate beside each other: a single grouped pivot."""
    d = cands(spark, sf)
    pick = [F.max(F.when(F.col("candidate") == n, F.col("prediction"))).alias(n) for n in CANDIDATES]
    ok = [F.max(F.when((F.col("candidate") == n) & (F.col("status") == "ok"), True).otherwise(False)).alias(f"{n}_ok") for n in CANDIDATES]
    g = d.groupBy("origin", "horizon", "period").agg(F.min("target").alias("target"), F.max("target").alias("_hi"), *pick, *ok)
    return g.withColumn("mismatch", F.col("target") != F.col("_hi")).drop("_hi").withColumn("common", F.col("naive_ok") & F.col("ridge_ok") & F.col("boost_ok"))


PAIRED = CAND + """, pv AS (SELECT origin, horizon, period, min(target) AS target, min(target) <> max(target) AS mismatch, max(prediction) FILTER (WHERE candidate = 'naive') AS naive, max(prediction) FILTER (WHERE candidate = 'ridge') AS ridge, max(prediction) FILTER (WHERE candidate = 'boost') AS boost,
   bool_or(candidate = 'naive' AND status = 'ok') AS n_ok, bool_or(candidate = 'ridge' AND status = 'ok') AS r_ok, bool_or(candidate = 'boost' AND status = 'ok') AS b_ok FROM cs GROUP BY 1, 2, 3)"""


@query("paired_candidates", "J7 U2 U3", PAIRED + """ SELECT horizon, period, count(*) AS rows, count(*) FILTER (WHERE n_ok AND r_ok AND b_ok) AS common_rows, count(*) FILTER (WHERE mismatch) AS mismatches,
   round(avg(abs(naive - target)) FILTER (WHERE n_ok AND r_ok AND b_ok), 6) AS naive_mae, round(avg(abs(ridge - target)) FILTER (WHERE n_ok AND r_ok AND b_ok), 6) AS ridge_mae, round(avg(abs(boost - target)) FILTER (WHERE n_ok AND r_ok AND b_ok), 6) AS boost_mae FROM pv GROUP BY 1, 2""")
def _(spark, sf):
    p = paired(spark, sf)
    mae = [F.avg(F.when(F.col("common"), F.abs(F.col(n) - F.col("target")))).alias(f"{n}_mae") for n in CANDIDATES]
    return round_all(p.groupBy("horizon", "period").agg(F.count("*").alias("rows"), F.count_if("common").alias("common_rows"), F.count_if("mismatch").alias("mismatches"), *mae))


@query("coverage_by_candidate", "A22", CAND + """SELECT candidate, period, horizon, count(*) AS rows, count(*) FILTER (WHERE status = 'ok') AS accepted, count(*) FILTER (WHERE status <> 'ok' AND target > 350) AS abstained_above,
   round(count(*) FILTER (WHERE status = 'ok') / count(*), 6) AS coverage FROM cs GROUP BY GROUPING SETS ((candidate, period, horizon), (candidate, period), (candidate))""")
def _(spark, sf):
    return round_all(E.coverage_table(cands(spark, sf), "candidate", "period", "horizon", F.col("status") == "ok", F.col("target") > 350))


@query("abstention_reasons", "A23", CAND + """SELECT candidate, period, reason, count(*) AS rows FROM (SELECT candidate, period, unnest(string_split(CASE WHEN reasons = '' THEN 'unspecified' ELSE reasons END, '|')) AS reason FROM cs WHERE status <> 'ok') GROUP BY 1, 2, 3""")
def _(spark, sf):
    return E.reason_counts(cands(spark, sf).filter("status <> 'ok'"), ["candidate", "period"], "reasons")


@query("paired_outcomes", "J13", PAIRED + """ SELECT period, count(*) FILTER (WHERE n_ok AND b_ok) AS both_ok, count(*) FILTER (WHERE n_ok AND NOT b_ok) AS only_first, count(*) FILTER (WHERE NOT n_ok AND b_ok) AS only_second, count(*) FILTER (WHERE NOT n_ok AND NOT b_ok) AS neither FROM pv GROUP BY 1""")
def _(spark, sf):
    a, b = F.col("naive_ok"), F.col("boost_ok")
    return paired(spark, sf).groupBy("period").agg(F.count_if(a & b).alias("both_ok"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


@query("baseline_substitution", "M28 M29", PAIRED + """ SELECT horizon, count(*) AS n, round(avg(CASE WHEN naive IS NULL THEN 1.0 ELSE 0.0 END), 6) AS substituted_share, round(avg(abs(coalesce(naive, ridge, 250) - target)), 6) AS mae,
   count(*) FILTER (WHERE greatest(naive, boost) > 350) AS guarded_alarms FROM pv GROUP BY 1""")
def _(spark, sf):
    filled = F.coalesce("naive", "ridge", F.lit(250.0))
    return round_all(paired(spark, sf).groupBy("horizon").agg(F.count("*").alias("n"), F.avg(F.col("naive").isNull().cast("double")).alias("substituted_share"), F.avg(F.abs(filled - F.col("target"))).alias("mae"),
                                                             F.count_if(F.greatest("naive", "boost") > 350).alias("guarded_alarms")))


@query("promotion_rule", "M25", PAIRED + """, m AS (SELECT horizon, avg(abs(ridge - target)) AS a, avg(abs(naive - target)) AS b, avg((ridge - target) * (ridge - target)) AS s, avg((naive - target) * (naive - target)) AS q, count(*) AS n FROM pv WHERE n_ok AND r_ok AND b_ok GROUP BY 1),
   c AS (SELECT horizon, a < 1.02 * b AS passed FROM m UNION ALL SELECT horizon, s <= q + 200 FROM m UNION ALL SELECT horizon, a < b FROM m WHERE horizon <= 60)
   SELECT horizon, bool_and(passed) AS passed, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed FROM c GROUP BY 1""")
def _(spark, sf):
    p = paired(spark, sf).filter("common")
    e = lambda n: F.col(n) - F.col("target")
    m = p.groupBy("horizon").agg(F.avg(F.abs(e("ridge"))).alias("a"), F.avg(F.abs(e("naive"))).alias("b"), F.avg(e("ridge") * e("ridge")).alias("s"), F.avg(e("naive") * e("naive")).alias("q"))
    checks = F.array_compact(F.array(F.col("a") < 1.02 * F.col("b"), F.col("s") <= F.col("q") + 200, F.when(F.col("horizon") <= 60, F.col("a") < F.col("b"))))
    return E.promotion_checks(m.select("horizon", F.explode(checks).alias("passed")), ["horizon"])


@query("interval_coverage", "A35", REG + """SELECT model, year, round(avg(CASE WHEN y BETWEEN p - 12 AND p + 15 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg((p + 15) - (p - 12)), 6) AS width FROM r WHERE p IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    d = reg(spark, sf).filter("p IS NOT NULL")
    return round_all(d.groupBy("model", "year").agg(F.avg(F.col("y").between(F.col("p") - 12, F.col("p") + 15).cast("double")).alias("coverage"), F.avg((F.col("p") + 15) - (F.col("p") - 12)).alias("width")))


FRESH = """WITH r AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS model, c_nationkey % 3 AS class, c_custkey % 73 AS a1, c_custkey % 13 AS a2, c_custkey % 5 = 0 AS rec FROM customer),
  f AS (SELECT *, CASE WHEN a1 > 2 AND NOT rec THEN TRUE ELSE FALSE END AS s1, CASE WHEN a2 > 2 AND NOT rec THEN TRUE ELSE FALSE END AS s2, NOT rec AND class = 1 AS o FROM r),
  g AS (SELECT *, NOT rec AND (s1 OR s2) AND NOT o AS only_stale, CASE WHEN a1 <= 2 THEN '<=2d' WHEN a1 <= 7 THEN '2-7d' WHEN a1 <= 30 THEN '7-30d' WHEN a1 <= 60 THEN '30-60d' ELSE '>60d' END AS age FROM f)
"""


@query("freshness_sensitivity", "A24", FRESH + """SELECT model, age, count(*) AS origins, count(*) FILTER (WHERE rec) AS recommended, round(avg(rec::INT), 6) AS coverage, count(*) FILTER (WHERE only_stale) AS blocked_only_stale,
   count(*) FILTER (WHERE rec OR (only_stale AND (NOT s1 OR a1 <= 60) AND (NOT s2 OR a2 <= 7))) AS relaxed FROM g GROUP BY 1, 2""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    d = c.select(F.when(k % 2 == 0, "A").otherwise("B").alias("model"), (F.col("c_nationkey") % 3).alias("class"), (k % 73).alias("a1"), (k % 13).alias("a2"), (k % 5 == 0).alias("rec"))
    why = C.reasons((~F.col("rec") & (F.col("a1") > 2), "cetane: stale"), (~F.col("rec") & (F.col("a2") > 2), "t95: stale"), (~F.col("rec") & (F.col("class") == 1), "regime"))
    d = d.withColumn("why", why)
    stale = F.forall("why", lambda x: x.endswith(": stale")) & (F.size("why") > 0)
    within = (~F.array_contains("why", "cetane: stale") | (F.col("a1") <= 60)) & (~F.array_contains("why", "t95: stale") | (F.col("a2") <= 7))
    age = F.when(F.col("a1") <= 2, "<=2d").when(F.col("a1") <= 7, "2-7d").when(F.col("a1") <= 30, "7-30d").when(F.col("a1") <= 60, "30-60d").otherwise(">60d")
    return round_all(d.groupBy("model", age.alias("age")).agg(
        F.count("*").alias("origins"), F.count_if("rec").alias("recommended"), F.avg(F.col("rec").cast("double")).alias("coverage"), F.count_if(~F.col("rec") & stale).alias("blocked_only_stale"),
        F.count_if(F.col("rec") | (~F.col("rec") & stale & within)).alias("relaxed")))


RULES = [("shutdown", "shutdown_or_transition"), ("stale", "stale_telemetry"), ("flag", "flagged_telemetry"), ("forecast", "no_forecast")]
CAUSE = """WITH r AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'unit in shutdown, stale' WHEN 1 THEN 'T6 stale' WHEN 2 THEN 'flagged input' WHEN 3 THEN 'no forecast' WHEN 4 THEN 'other' ELSE '' END AS reason, o_totalprice / 100000 AS loss, o_custkey % 5 AS best FROM orders),
  c AS (SELECT *, CASE WHEN reason = '' THEN 'recommendation' WHEN contains(reason, 'shutdown') THEN 'shutdown_or_transition' WHEN contains(reason, 'stale') THEN 'stale_telemetry' WHEN contains(reason, 'flag') THEN 'flagged_telemetry' WHEN contains(reason, 'forecast') THEN 'no_forecast' ELSE 'data_gate_other' END AS cause FROM r)
"""


@query("refusal_causes", "A32", CAUSE + "SELECT cause, count(*) AS moments, count(*) FILTER (WHERE cause = 'recommendation' AND loss - best > 0.03) AS cheaper_move, round(max(loss - best) FILTER (WHERE cause = 'recommendation'), 6) AS max_gap FROM c GROUP BY 1")
def _(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey") % 6
    why = F.when(k == 0, "unit in shutdown, stale").when(k == 1, "T6 stale").when(k == 2, "flagged input").when(k == 3, "no forecast").when(k == 4, "other").otherwise("")
    d = o.select(why.alias("reason"), (F.col("o_totalprice") / 100000 - F.col("o_custkey") % 5).alias("gap"))
    d = d.withColumn("cause", F.when(F.col("reason") == "", "recommendation").otherwise(E.classify("reason", RULES, "data_gate_other")))
    rec = F.col("cause") == "recommendation"
    return round_all(d.groupBy("cause").agg(F.count("*").alias("moments"), F.count_if(rec & (F.col("gap") > 0.03)).alias("cheaper_move"), F.max(F.when(rec, F.col("gap"))).alias("max_gap")))


@query("backtest_summary", "A33", CAND + """SELECT candidate, horizon, count(*) AS samples, count(*) FILTER (WHERE status = 'ok') AS forecast_ok, round(avg((status = 'ok')::INT), 6) AS coverage, count(*) FILTER (WHERE target > 350) AS actual_above, count(*) FILTER (WHERE target > 350 AND status <> 'ok') AS above_when_abstained,
   round(count(*) FILTER (WHERE target > 350 AND prediction > 350) / nullif(count(*) FILTER (WHERE target > 350 AND status = 'ok'), 0), 6) AS alarm_recall, round(avg(CASE WHEN target BETWEEN prediction * 0.5 AND prediction * 1.5 THEN 1.0 ELSE 0.0 END) FILTER (WHERE status = 'ok'), 6) AS interval_coverage,
   count(*) FILTER (WHERE status = 'ok' AND prediction <= 350 AND target > 350) AS above_after_hold FROM cs GROUP BY 1, 2""")
def _(spark, sf):
    d = cands(spark, sf)
    ok, bad, alarm = F.col("status") == "ok", F.col("target") > 350, F.col("prediction") > 350
    return round_all(d.groupBy("candidate", "horizon").agg(
        F.count("*").alias("samples"), F.count_if(ok).alias("forecast_ok"), F.avg(ok.cast("double")).alias("coverage"), F.count_if(bad).alias("actual_above"), F.count_if(bad & ~ok).alias("above_when_abstained"),
        (F.count_if(bad & alarm) / F.nullif(F.count_if(bad & ok), F.lit(0))).alias("alarm_recall"),
        F.avg(F.when(ok, F.col("target").between(F.col("prediction") * 0.5, F.col("prediction") * 1.5).cast("double"))).alias("interval_coverage"),
        F.count_if(ok & ~alarm & bad).alias("above_after_hold")))


FOLDS = [("A", "2024-01-05 00:00:00", "2024-01-12 00:00:00"), ("B", "2024-01-12 00:00:00", "2024-01-20 00:00:00"), ("C", "2024-01-20 00:00:00", "2024-01-28 00:00:00")]


@query("fold_crossing_report", "A34", GRID + """, f(fold, a, b) AS (VALUES """ + ", ".join(f"('{n}', epoch_us(TIMESTAMP '{a}'), epoch_us(TIMESTAMP '{b}'))" for n, a, b in FOLDS) + f"""), h(h) AS (VALUES (60::BIGINT), (120::BIGINT), (180::BIGINT))
   SELECT fold, CAST(h AS INTEGER) AS horizon, count(*) AS origin_only, count(*) FILTER (WHERE origin + (h + 30) * {M} < b) AS kept, count(*) FILTER (WHERE origin + (h + 30) * {M} >= b) AS removed FROM o, f, h WHERE origin >= a AND origin < b GROUP BY 1, 2""")
def _(spark, sf):
    fold = F.array_compact(F.array(*[F.when((F.col("origin") >= us(a)) & (F.col("origin") < us(b)), F.struct(F.lit(n).alias("fold"), F.lit(us(b)).alias("b"))) for n, a, b in FOLDS]))
    d = X.origin_grid(clean(spark, sf)).select("origin", F.inline(fold)).withColumn("horizon", F.explode(F.array(F.lit(60), F.lit(120), F.lit(180))))
    end = F.col("origin") + (F.col("horizon") + 30).cast("long") * M
    return d.groupBy("fold", "horizon").agg(F.count("*").alias("origin_only"), F.count_if(end < F.col("b")).alias("kept"), F.count_if(end >= F.col("b")).alias("removed"))


@query("delayed_error_correction", "W18", ORIGINS + f""", s AS (SELECT t, t - {180 * M} AS origin, value AS y, avg(value) OVER (ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS p FROM lab),
   e AS (SELECT t + {240 * M} AS pub, y - p AS err FROM s WHERE p IS NOT NULL), m AS (SELECT s.t, count(err) AS n, quantile_cont(err, 0.5) AS med FROM s LEFT JOIN e ON pub <= s.origin AND pub > s.origin - {D} GROUP BY 1)
   SELECT {ts_text('make_timestamp(s.t)')} AS sampled, round(CASE WHEN p IS NULL THEN 0 ELSE greatest(0, p + CASE WHEN n >= 3 THEN 0.5 * med ELSE 0 END) END, 6) AS corrected FROM s JOIN m USING (t)""")
def _(spark, sf):
    from ..operators.ordered import trailing
    l = labs(spark, sf).withColumn("_g", F.lit(0))
    d = trailing(l, ["_g"], "t", [], ["value"], 6, D).select("t", F.col("value").alias("y"), "recent")
    past = F.transform(F.slice("recent", 1, F.size("recent") - 1), lambda x: x.value)
    p = F.when(F.size("recent") > 1, F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / F.size(past))
    d = d.select("t", "y", p.alias("p")).withColumn("origin", F.col("t") - 180 * M)
    return round_all(E.delayed_correction(d, "t", "y", "p", 1, 0.5).select(C.from_micros("t").alias("sampled"), "corrected"))


POLICIES = {"cheap": "score >= 1.0 / (1 + ratio)", "fixed": "score >= 0.3", "other": "other >= 1.0 / (1 + ratio)", "always": "TRUE", "never": "FALSE"}


@query("alarm_policy_audit", "M23 J14 A14", PROB + """, x AS (SELECT r.*, strftime(o_orderdate, '%Y') AS period, CAST(v.ratio AS INTEGER) AS ratio FROM r, (VALUES (1), (2), (5), (10), (20), (50)) v(ratio)), y AS ("""
       + " UNION ALL ".join(f"SELECT *, '{k}' AS policy, {v} AS alarm FROM x" for k, v in POLICIES.items()) + """)
   SELECT period, ratio, policy, count(*) AS n, count(*) FILTER (WHERE event AND alarm) AS tp, count(*) FILTER (WHERE NOT event AND alarm) AS fp, count(*) FILTER (WHERE event AND NOT alarm) AS fn, CAST(ratio * count(*) FILTER (WHERE event AND NOT alarm) + count(*) FILTER (WHERE NOT event AND alarm) AS DOUBLE) AS total_cost FROM y GROUP BY 1, 2, 3""")
def _(spark, sf):
    d = prob(spark, sf).withColumn("period", F.date_format("o_orderdate", "yyyy"))
    # One aggregated row per period, then the policy x ratio table is unfolded from it.
    alarms = {}
    for r in (1, 2, 5, 10, 20, 50):
        alarms |= {("cheap", r): F.col("score") >= 1.0 / (1 + r), ("fixed", r): F.col("score") >= 0.3, ("other", r): F.col("other") >= 1.0 / (1 + r), ("always", r): F.lit(True), ("never", r): F.lit(False)}
    aggs = [e for (k, r), a in alarms.items() for e in (F.count_if(event() & a).alias(f"tp_{k}_{r}"), F.count_if(~event() & a).alias(f"fp_{k}_{r}"))]
    g = d.groupBy("period").agg(F.count("*").alias("n"), F.count_if(event()).alias("pos"), *aggs)
    cells = F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(k).alias("policy"), F.col(f"tp_{k}_{r}").alias("tp"), F.col(f"fp_{k}_{r}").alias("fp")) for k, r in alarms])
    t = g.select("period", "n", "pos", F.inline(cells)).withColumn("fn", F.col("pos") - F.col("tp")).drop("pos")
    return t.withColumn("total_cost", (F.col("ratio") * F.col("fn") + F.col("fp")).cast("double"))


@query("model_version_asof", "J10", """WITH v(version, fit_end) AS (VALUES ('m1', TIMESTAMP '1996-01-01'), ('m2', TIMESTAMP '1998-01-01'), ('m3', TIMESTAMP '2000-06-01'))
   SELECT version, count(*) AS origins FROM (SELECT o_orderkey, (SELECT arg_max(version, fit_end) FROM v WHERE fit_end <= o_orderdate) AS version FROM orders) GROUP BY 1""")
def _(spark, sf):
    from ..operators.timejoin import asof
    o = table(spark, sf, "orders").select(F.lit(0).alias("_k"), "o_orderkey", C.micros("o_orderdate").alias("origin"))
    v = spark.createDataFrame([("m1", us("1996-01-01 00:00:00")), ("m2", us("1998-01-01 00:00:00")), ("m3", us("2000-06-01 00:00:00"))], "version string, fit_end long").withColumn("_k", F.lit(0))
    return asof(o, v, ["_k"], "origin", "fit_end", ["version"], width=30 * D).groupBy(F.col("hit.version").alias("version")).agg(F.count("*").alias("origins"))


@query("leakage_checks", "M26", GRID + f""", j AS (SELECT origin, (SELECT max(l.t) FROM lab l WHERE l.t + {240 * M} <= origin) AS st, {asof_sql(ANALYSERS['qa'], 'o.origin', 30 * M, 't')} AS seen FROM o) SELECT count(*) AS rows, count(*) FILTER (WHERE st + {240 * M} > origin) AS published_after_origin, count(*) FILTER (WHERE st > origin) AS sampled_after_origin, count(*) FILTER (WHERE seen > origin) AS future_reading FROM j""")
def _(spark, sf):
    s = clean(spark, sf)
    o = X.origin_grid(s)
    p = X.previous_lab(o, labs(spark, sf), max_age=3650 * D)
    t = X.lookup(o, s, {"a": (list(ANALYSERS.values())[0], 0)}, with_time=True)
    d = p.join(t, "origin")
    return E.leakage_checks(d, {"published_after_origin": F.col("lab_available_t") > F.col("origin"), "sampled_after_origin": F.col("lab_sample_t") > F.col("origin"), "future_reading": F.col("a_t") > F.col("origin")})


# The features again, from nothing but the events before the cut.
PREFIX = FEATURES.replace("FROM events)", f"FROM events WHERE ts < TIMESTAMP '{AFTER_AT}')").replace("max(t) AS hi FROM clean", f"epoch_us(TIMESTAMP '{AT}') AS hi FROM clean")


@query("prefix_parity", "M27", f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {' OR '.join(f"(a.{x} IS NULL) <> (b.{x} IS NULL) OR coalesce(abs(a.{x} - b.{x}) > 1e-9, FALSE)" for x in FEATURE_COLUMNS)}) AS differing
   FROM ({FEATURES} SELECT * FROM feat WHERE origin <= epoch_us(TIMESTAMP '{AT}')) a FULL JOIN ({PREFIX} SELECT * FROM feat) b USING (origin)""")
def _(spark, sf):
    cut = us(AT)
    s, l = staged_series(spark, sf)
    o = X.origin_grid(s).filter(F.col("origin") <= cut)
    full = X.anchored_features(o, s, l, ANALYSERS, CONTROL_MAP)
    seen = X.anchored_features(o, s.filter(F.col("t") <= cut), l.filter(F.col("t") <= cut), ANALYSERS, CONTROL_MAP)
    return E.frame_difference(full, seen, "origin", FEATURE_COLUMNS)
