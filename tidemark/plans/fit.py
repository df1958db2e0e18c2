"""Support statistics, ridge and convex fits, risk functions, walk-forward procedures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import fit as M_
from ..operators import risk as R
from ..operators.stage import per_key, staged
from .adapter import LAB, OBS, table, ts_text
from .evaluate import REG, reg
from .features import ANALYSERS, CONTROL_MAP, FEATURE_COLUMNS, GRID, MODEL_COLUMNS, ORIGINS, anchor_sql, clean, labs, mean_sql, staged_series
from .registry import query, rounded
from .series import round_all, us

M, H, D = C.MINUTE, C.HOUR, C.DAY
XS = ["quantity", "discount", "tax"]

LINES = """WITH r AS (SELECT l_returnflag AS model, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity, l_discount AS discount, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax, ln(l_extendedprice) AS y,
   l_shipdate, l_orderkey, l_linenumber FROM lineitem), long AS (SELECT model, 'quantity' AS column_, quantity AS v FROM r UNION ALL SELECT model, 'discount', discount FROM r UNION ALL SELECT model, 'tax', tax FROM r),
   q AS (SELECT model, column_, count(*) AS n, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.995) AS hi FROM long GROUP BY 1, 2),
   s0 AS (SELECT long.model, long.column_, any_value(n) AS n, any_value(median) AS median, avg(coalesce(v, median)) AS mean, stddev_pop(coalesce(v, median)) AS sd, any_value(lo) AS lo, any_value(hi) AS hi FROM long JOIN q USING (model, column_) GROUP BY 1, 2),
   s AS (SELECT *, CASE WHEN sd > 0 THEN sd ELSE 1 END AS scale FROM s0)
"""


def lines(spark, sf):
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return l.select(F.col("l_returnflag").alias("model"), F.when(n != 7, F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"), F.when(n != 3, F.col("l_tax")).alias("tax"),
                    F.ln("l_extendedprice").alias("y"), "l_shipdate", "l_orderkey", "l_linenumber")


@query("support_bounds", "M5", LINES + """SELECT model, column_ AS "column", n, round(median, 9) AS median, round(mean, 9) AS mean, round(scale, 9) AS scale, round(lo - 0.1 * greatest(hi - lo, scale), 9) AS lower, round(hi + 0.1 * greatest(hi - lo, scale), 9) AS upper FROM s""")
def _(spark, sf):
    return round_all(M_.support(lines(spark, sf), ["model"], XS), 9)


@query("gram_matrix", "M6", LINES + """SELECT model, count(*) AS n, round(sum(coalesce(quantity, 25) * discount), 4) AS x01, round(sum(discount * discount), 6) AS x11, round(sum(discount * y), 4) AS xy1, round(sum(y * y), 4) AS yy FROM r GROUP BY 1""")
def _(spark, sf):
    d = lines(spark, sf).withColumn("quantity", F.coalesce("quantity", F.lit(25.0)))
    g = M_.gram(d, ["model"], ["quantity", "discount"], "y")
    return g.select("model", "n", rounded(F.col("xx")[4], 4).alias("x01"), rounded(F.col("xx")[5], 6).alias("x11"), rounded(F.col("xy")[2], 4).alias("xy1"), rounded(F.col("yy"), 4).alias("yy"))


@query("ridge_one_feature", "M6 M9", LINES + """, z AS (SELECT r.model, (coalesce(quantity, median) - mean) / scale AS z, y FROM r JOIN s ON s.model = r.model AND s.column_ = 'quantity'),
   b AS (SELECT model, (sum(z * y) - sum(z) * sum(y) / count(*)) / (sum(z * z) - sum(z) * sum(z) / count(*) + 100) AS b1, sum(y) AS sy, sum(z) AS sz, count(*) AS n FROM z GROUP BY 1)
   SELECT model, round((sy - b1 * sz) / n, 6) AS intercept, round(b1, 6) AS slope FROM b""")
def _(spark, sf):
    _, coef = M_.fit_ridge(lines(spark, sf), ["model"], ["quantity"], "y", [100.0])
    return round_all(coef.select("model", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope")))


@query("ridge_coefficients", "M6")
def _(spark, sf):
    _, coef = M_.fit_ridge(lines(spark, sf), ["model"], XS, "y", [1.0, 100.0])
    return round_all(coef.select("model", "alpha", *[F.col("coef")[i].alias(n) for i, n in enumerate(["intercept", *XS])]), 4)


CUTS = ["1997-01-01 00:00:00", "1998-06-01 00:00:00", "2000-01-01 00:00:00"]


@query("temporal_folds", "M8", """WITH f(fold, a, b) AS (VALUES ('f1', TIMESTAMP '1997-01-01', TIMESTAMP '1998-06-01'), ('f2', TIMESTAMP '1998-06-01', TIMESTAMP '2000-01-01'), ('final', TIMESTAMP '2000-01-01', TIMESTAMP '2100-01-01'))
   SELECT fold, count(*) FILTER (WHERE l_shipdate < a) AS fit_rows, count(*) FILTER (WHERE o_orderdate >= a AND l_shipdate < b) AS score_rows, count(*) FILTER (WHERE l_shipdate < a AND o_orderdate >= a AND l_shipdate < b) AS overlap
   FROM lineitem JOIN orders ON o_orderkey = l_orderkey, f GROUP BY 1""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", C.micros("l_shipdate").alias("available"))
    o = table(spark, sf, "orders").select("o_orderkey", C.micros("o_orderdate").alias("origin"))
    d = l.join(o, l.l_orderkey == o.o_orderkey)
    ends = [us(x) for x in CUTS[1:]] + [us("2100-01-01 00:00:00")]
    aggs, cells = [], []
    for i, (a, b) in enumerate(zip([us(x) for x in CUTS], ends)):
        fit = F.col("available") < a
        score = (F.col("origin") >= a) & (F.col("available") < b)
        aggs += [F.count_if(fit).alias(f"a{i}"), F.count_if(score).alias(f"b{i}"), F.count_if(fit & score).alias(f"c{i}")]
        cells.append(F.struct(F.lit(["f1", "f2", "final"][i]).alias("fold"), F.col(f"a{i}").alias("fit_rows"), F.col(f"b{i}").alias("score_rows"), F.col(f"c{i}").alias("overlap")))
    return d.agg(*aggs).select(F.inline(F.array(*cells)))


def dated(spark, sf):
    """Line items with an origin (ship date) and a publication 30 days later."""
    d = lines(spark, sf)
    return d.withColumn("origin", C.micros("l_shipdate")).withColumn("available", F.col("origin") + 30 * D)


@query("alpha_selection", "M7")
def _(spark, sf):
    d = dated(spark, sf)
    cuts = [us(x) for x in CUTS]
    train = d.withColumn("fold", F.explode(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: F.col("available") < c)))
    wide, coef = M_.fit_ridge(train, ["fold"], XS, "y", M_.ALPHAS)
    score = d.withColumn("fold", F.array_max(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: c <= F.col("origin")))).filter("fold IS NOT NULL")
    p = M_.predict(score, wide, coef, ["fold"], XS)
    return round_all(M_.select_alpha(p, ["model"], "fold", F.abs(F.col("y") - F.col("prediction"))), 6)


@query("walk_forward", "M8")
def _(spark, sf):
    p = M_.walk_forward(dated(spark, sf), XS, "y", "origin", "available", [us(x) for x in CUTS], us("2002-01-01 00:00:00"), preregistered=100.0)
    return round_all(p.groupBy("cutoff", "alpha", "basis").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae")), 6)


@query("lab_walk_forward", "M1")
def _(spark, sf):
    s, l = staged_series(spark, sf)
    o = l.select((F.col("t") - 60 * M).alias("origin"))
    f = X.anchored_features(o, s, l, ANALYSERS, CONTROL_MAP)
    frame = f.join(l.select((F.col("t") - 60 * M).alias("origin"), C.floored_ln("value").alias("y"), (F.col("t") + 240 * M).alias("available")), "origin")
    frame = staged(frame)
    cuts = [us(f"2024-01-{d} 00:00:00") for d in ("10", "17", "24")]
    p = M_.walk_forward(frame, MODEL_COLUMNS, "y", "origin", "available", cuts, us("2024-01-31 00:00:00"))
    return round_all(p.groupBy("cutoff", "alpha", "basis").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("log_mae")), 4)


@query("prequential_median", "M20", OBS + f""", lab AS (SELECT t, value FROM clean WHERE metric_id = '{LAB}'), w AS (SELECT unnest(range(epoch_us(TIMESTAMP '2024-01-08'), epoch_us(TIMESTAMP '2024-01-30'), {7 * D})) AS cutoff)
   , m AS (SELECT cutoff, count(*) AS train_rows, quantile_cont(value, 0.5) AS median FROM w JOIN lab ON t + {240 * M} < cutoff GROUP BY 1)
   SELECT {ts_text('make_timestamp(cutoff)')} AS cutoff, any_value(train_rows) AS train_rows, round(any_value(median), 6) AS median, count(*) AS rows, round(avg(abs(value - median)), 6) AS mae FROM m JOIN lab ON lab.t >= cutoff AND lab.t < cutoff + {7 * D} GROUP BY m.cutoff""")
def _(spark, sf):
    from ..operators.quantiles import quantiles
    l = labs(spark, sf)
    cuts = F.sequence(F.lit(us("2024-01-08 00:00:00")), F.lit(us("2024-01-30 00:00:00") - 1), F.lit(7 * D))
    train = l.withColumn("cutoff", F.explode(F.filter(cuts, lambda c: F.col("t") + 240 * M < c)))
    m = quantiles(train, ["cutoff"], "value", [0.5], ["median"]).join(train.groupBy("cutoff").agg(F.count("*").alias("train_rows")), "cutoff")
    score = l.withColumn("cutoff", F.explode(F.filter(cuts, lambda c: (F.col("t") >= c) & (F.col("t") < c + 7 * D))))
    g = score.join(m, "cutoff").groupBy("cutoff").agg(F.max("train_rows").alias("train_rows"), F.max("median").alias("median"), F.count("*").alias("rows"), F.avg(F.abs(F.col("value") - F.col("median"))).alias("mae"))
    return round_all(g.withColumn("cutoff", C.from_micros("cutoff")))


@query("huber_ridge", "M13")
def _(spark, sf):
    _, coef = M_.huber_ridge(lines(spark, sf), ["model"], XS, "y", 10.0)
    return round_all(coef.select("model", "alpha", *[F.col("coef")[i].alias(n) for i, n in enumerate(["intercept", *XS])]), 4)


CONVEX = """WITH r AS (SELECT l_returnflag AS model, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS a, l_extendedprice / 4000 AS b, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount * 250 END AS c, l_quantity * 0.6 + l_extendedprice / 10000 AS y FROM lineitem),
   g AS (SELECT i.range AS i, j.range AS j, 20 - i.range - j.range AS k FROM range(21) i, range(21) j WHERE i.range + j.range <= 20), w AS (SELECT i / 20.0 AS wa, j / 20.0 AS wb, k / 20.0 AS wc, row_number() OVER (ORDER BY i, j) - 1 AS id FROM g),
   p AS (SELECT model, id, y - CASE WHEN (CASE WHEN a IS NULL THEN 0 ELSE wa END) + wb + (CASE WHEN c IS NULL THEN 0 ELSE wc END) > 0 THEN (coalesce(a, 0) * wa + b * wb + coalesce(c, 0) * wc) / ((CASE WHEN a IS NULL THEN 0 ELSE wa END) + wb + (CASE WHEN c IS NULL THEN 0 ELSE wc END))
      ELSE (coalesce(a, 0) + b + coalesce(c, 0)) / (1 + (a IS NOT NULL)::INT + (c IS NOT NULL)::INT) END AS res FROM r, w), m AS (SELECT model, id, quantile_cont(res, 0.5) AS bias FROM p GROUP BY 1, 2),
   s AS (SELECT p.model, p.id, any_value(bias) AS bias, avg(abs(res - bias)) AS mae FROM p JOIN m ON m.model = p.model AND m.id = p.id GROUP BY 1, 2), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(mae, 12), id) = 1)
   SELECT model, wa::DOUBLE AS wa, wb::DOUBLE AS wb, wc::DOUBLE AS wc, round(bias, 6) AS bias, round(mae, 6) AS fit_mae FROM best JOIN w USING (id)"""


@query("convex_combination", "M14", CONVEX)
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    d = l.select(F.col("l_returnflag").alias("model"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("a"), (F.col("l_extendedprice") / 4000).alias("b"),
                 F.when(F.col("l_linenumber") != 2, F.col("l_discount") * 250).alias("c"), (F.col("l_quantity") * 0.6 + F.col("l_extendedprice") / 10000).alias("y"))
    f = M_.fit_convex(d, ["model"], ["a", "b", "c"], "y")
    return round_all(f.select("model", *[F.col("weights")[i].alias(n) for i, n in enumerate(["wa", "wb", "wc"])], "bias", "fit_mae"))


GATE = LINES + """, u AS (SELECT r.*, sq.median AS mq, (quantity - sq.mean) / sq.scale AS zq, (discount - sd.mean) / sd.scale AS zd, (tax - st.mean) / st.scale AS zt,
     coalesce(quantity < sq.lo + 5 OR quantity > sq.hi - 5, FALSE) AS oq, coalesce(discount < sd.lo OR discount > sd.hi - 0.005, FALSE) AS od, coalesce(tax < st.lo OR tax > st.hi - 0.005, FALSE) AS ot,
     (quantity IS NOT NULL)::INT + (discount IS NOT NULL)::INT + (tax IS NOT NULL)::INT AS known FROM r JOIN s sq ON sq.model = r.model AND sq.column_ = 'quantity' JOIN s sd ON sd.model = r.model AND sd.column_ = 'discount' JOIN s st ON st.model = r.model AND st.column_ = 'tax'),
   k AS (SELECT model, concat_ws('|', CASE WHEN quantity IS NULL THEN 'no_evidence' END, CASE WHEN tax IS NULL THEN 'no_control_telemetry' END, CASE WHEN 1 - known / 3.0 > 0.34 THEN 'too_many_missing_features' END,
     CASE WHEN ot OR (oq::INT + od::INT + ot::INT) / greatest(1, known) > 0.20 OR greatest(abs(zq), abs(zd), abs(zt)) > 8 THEN 'outside_training_support' END) AS reasons, oq::INT + od::INT + ot::INT AS ood FROM u)"""


@query("applicability_gate", "M4", GATE + " SELECT model, reasons AS abstain_reasons, CASE WHEN reasons = '' THEN 'ok' ELSE 'abstain' END AS status, count(*) AS rows, CAST(sum(ood) AS BIGINT) AS ood FROM k GROUP BY 1, 2")
def _(spark, sf):
    d = lines(spark, sf)
    s = M_.support(d, ["model"], XS, margin=0.0)
    s = s.withColumn("lower", F.when(F.col("column") == "quantity", F.col("lower") + 5).otherwise(F.col("lower"))).withColumn("upper", F.when(F.col("column") == "quantity", F.col("upper") - 5).otherwise(F.col("upper") - 0.005))
    g = X.applicability(d.join(per_key(M_.support_wide(s, ["model"], XS)), "model"), None, XS, ["quantity"], ["tax"])
    ood = sum((F.coalesce((F.col(x) < F.col(f"lower_{x}")) | (F.col(x) > F.col(f"upper_{x}")), F.lit(False)).cast("int") for x in XS), F.lit(0))
    return g.groupBy("model", "abstain_reasons", "status").agg(F.count("*").alias("rows"), F.sum(ood).alias("ood"))


RISK = REG + """, e AS (SELECT model, ln(y) - ln(p) AS r FROM r WHERE p > 0 AND y > 0), q AS (""" + " UNION ALL ".join(f"SELECT model, {k / 100} AS probability, quantile_cont(r, {k / 100}) AS quantile FROM e GROUP BY 1" for k in range(1, 100)) + """),
   nx AS (SELECT *, lead(probability) OVER (PARTITION BY model ORDER BY probability) AS np, lead(quantile) OVER (PARTITION BY model ORDER BY probability) AS nq, min(quantile) OVER (PARTITION BY model) AS qmin, max(quantile) OVER (PARTITION BY model) AS qmax FROM q),
   m AS (SELECT DISTINCT model, ln(l_quantity) AS pr, ln(30.0) - ln(l_quantity) AS gap FROM (SELECT l_returnflag AS model, l_quantity FROM lineitem)),
   x AS (SELECT m.model, m.pr, CASE WHEN gap <= qmin THEN 0.99 WHEN gap >= qmax THEN 0.01 ELSE 1 - (probability + (np - probability) * (gap - quantile) / (nq - quantile)) END AS prob FROM m JOIN nx ON nx.model = m.model AND ((gap <= qmin AND probability = 0.01) OR (gap >= qmax AND probability = 0.99) OR (gap > qmin AND gap < qmax AND quantile <= gap AND gap < nq))),
   iv AS (SELECT model, max(quantile) FILTER (WHERE probability = 0.1) AS lo, max(quantile) FILTER (WHERE probability = 0.9) AS hi, max(quantile) FILTER (WHERE probability = 0.8) AS q80, max(quantile) FILTER (WHERE probability = 0.5) AS mid FROM q GROUP BY 1)"""
LEVELS = [k / 100 for k in range(1, 100)]


def risk_functions(spark, sf):
    e = reg(spark, sf).filter("p > 0 AND y > 0").select("model", (F.ln("y") - F.ln("p")).alias("r"))
    return R.as_arrays(E.residual_quantiles(e, ["model"], "r", LEVELS), ["model"])


@query("exceedance_probability", "M11 K7", RISK + " SELECT x.model, round(pr, 6) AS ln_prediction, round(prob, 6) AS probability, round(exp(pr + lo), 6) AS lower, round(exp(pr + hi), 6) AS upper, round(30 * exp(-q80), 6) AS safe_level FROM x JOIN iv USING (model)")
def _(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.ln("l_quantity").alias("pr")).distinct()
    d = m.join(risk_functions(spark, sf), "model")
    lo, hi = R.interval("pr")
    return round_all(d.select("model", F.col("pr").alias("ln_prediction"), R.exceedance_probability("pr", F.lit(30.0).cast("double") * 0 + F.ln(F.lit(30.0))).alias("probability"), F.exp(lo).alias("lower"), F.exp(hi).alias("upper"),
                              R.safe_level(30.0, F.lit(0.2)).alias("safe_level")))


@query("widened_quantiles", "M12", RISK + ", sg AS (SELECT model, stddev_pop(r) AS s FROM e GROUP BY 1) SELECT q.model, CAST(probability AS DOUBLE) AS probability, round(mid + (quantile - mid) * sqrt(1 + (0.3 / s) * (0.3 / s)), 6) AS quantile FROM q JOIN iv USING (model) JOIN sg USING (model)")
def _(spark, sf):
    e = reg(spark, sf).filter("p > 0 AND y > 0").groupBy("model").agg(F.stddev_pop(F.ln("y") - F.ln("p")).alias("s"))
    d = risk_functions(spark, sf).join(e, "model").select("model", F.arrays_zip(F.col("probs").alias("p"), R.widened("quants", "s", F.lit(0.3)).alias("q")).alias("z"))
    return round_all(d.select("model", F.explode("z").alias("z")).select("model", F.col("z.p").alias("probability"), F.col("z.q").alias("quantile")))


@query("horizon_interpolation", "M10", """WITH o AS (SELECT o_orderkey, o_custkey % 181 AS h, ln(o_totalprice) AS p0, ln(o_totalprice) * 0.98 AS p60, ln(o_totalprice) * 0.97 AS p120, ln(o_totalprice) + 0.1 AS p180 FROM orders)
   SELECT o_orderkey, CAST(h AS INTEGER) AS horizon, round(CASE WHEN h < 60 THEN p0 + (p60 - p0) * h / 60.0 WHEN h < 120 THEN p60 + (p120 - p60) * (h - 60) / 60.0 ELSE p120 + (p180 - p120) * (h - 120) / 60.0 END, 6) AS ln_prediction FROM o""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    p = F.ln("o_totalprice")
    d = o.select("o_orderkey", (F.col("o_custkey") % 181).cast("int").alias("horizon"), F.array(p, p * 0.98, p * 0.97, p + 0.1).alias("v"))
    hs = F.array(*[F.lit(float(h)) for h in (0, 60, 120, 180)])
    return round_all(d.select("o_orderkey", "horizon", R.at_horizon(F.col("horizon").cast("double"), hs, "v").alias("ln_prediction")))


@query("horizon_support", "M34", """WITH o AS (SELECT o_custkey % 181 AS h, o_orderkey % 5 <> 0 AS s0, o_orderkey % 7 <> 0 AS s60, o_orderkey % 11 <> 0 AS s120, o_orderkey % 13 <> 0 AS s180 FROM orders)
   SELECT CASE WHEN h = 0 THEN s0 WHEN h < 60 THEN s0 AND s60 WHEN h = 60 THEN s60 WHEN h < 120 THEN s60 AND s120 WHEN h = 120 THEN s120 WHEN h < 180 THEN s120 AND s180 ELSE s180 END AS supported,
   s0 AND (h <= 0 OR s60) AND (h <= 60 OR s120) AND (h <= 120 OR s180) AS path_supported, count(*) AS n FROM o GROUP BY 1, 2""")
def _(spark, sf):
    k = F.col("o_orderkey")
    st = F.array(*[F.when(k % m != 0, "ok").otherwise("abstain") for m in (5, 7, 11, 13)])
    d = table(spark, sf, "orders").select((F.col("o_custkey") % 181).cast("int").alias("h"), st.alias("st"), F.array(*[F.lit(x) for x in (0, 60, 120, 180)]).alias("hs"))
    return d.groupBy((R.horizon_status(F.col("st"), F.col("hs"), "h") == "ok").alias("supported"), R.path_support(F.col("st"), F.col("hs"), "h").alias("path_supported")).agg(F.count("*").alias("n"))


@query("robust_anomaly", "M17")
def _(spark, sf):
    d = lines(spark, sf).select("model", "quantity", "discount", F.coalesce("tax", F.lit(0.04)).alias("tax"))
    m = per_key(M_.robust_model(d, ["model"], XS))
    total, parts = M_.mahalanobis(XS)
    s = d.dropna(subset=XS).join(m, "model").select("model", total.alias("d2"), *[p.alias(f"part_{x}") for x, p in zip(XS, parts)])
    from ..operators.quantiles import quantiles
    t = per_key(quantiles(s, ["model"], "d2", [0.95, 0.99], ["attention", "high"]))
    g = s.join(t, "model").groupBy("model").agg(F.count("*").alias("rows"), F.max("attention").alias("attention"), F.max("high").alias("high"), F.count_if(F.col("d2") > F.col("high")).alias("n_high"),
                                              F.avg("d2").alias("mean_d2"), *[F.avg(f"part_{x}").alias(f"mean_{x}") for x in XS])
    return round_all(g, 4)


@query("mahalanobis_given_matrix", "M17", """SELECT l_returnflag AS model, count(*) AS n, round(avg(4 * (l_quantity / 50 - 0.5) * (l_quantity / 50 - 0.5) + 2 * 0.5 * (l_quantity / 50 - 0.5) * (l_discount - 0.05) + 9 * (l_discount - 0.05) * (l_discount - 0.05)), 9) AS mean_d2 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_quantity") / 50).alias("a"), F.col("l_discount").alias("b"))
    d = d.withColumn("location", F.array(F.lit(0.5), F.lit(0.05))).withColumn("precision", F.array(F.lit(4.0), F.lit(0.5), F.lit(0.5), F.lit(9.0)))
    return d.groupBy("model").agg(F.count("*").alias("n"), rounded(F.avg(M_.mahalanobis(["a", "b"])[0]), 9).alias("mean_d2"))


@query("logistic_risk", "M8")
def _(spark, sf):
    d = lines(spark, sf).select("model", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in XS], (F.col("y") > 10.5).cast("double").alias("event"), (C.micros("l_shipdate") < us("1999-01-01 00:00:00")).alias("fit"))
    wide = per_key(M_.support_wide(M_.support(d.withColumn("k", F.lit(0)), ["k"], XS), ["k"], XS))
    z = M_.standardized(d.withColumn("k", F.lit(0)), wide, ["k"], XS)
    zs = [f"z_{x}" for x in XS]
    train, test = z.filter("fit"), z.filter("not fit")
    out = None
    for c in (0.01, 1.0):
        m = M_.logistic(train, zs, "event", c)
        p = M_.logistic_probability(m, test, zs)
        r = p.agg(F.count("*").alias("n"), F.avg((F.col("probability") - F.col("event")) * (F.col("probability") - F.col("event"))).alias("brier"), F.avg("event").alias("base")).withColumn("C", F.lit(c))
        out = r if out is None else out.unionByName(r)
    return round_all(out.withColumn("promoted", F.col("brier") <= 0.98 * F.col("base") * (1 - F.col("base"))), 4)


@query("challenger_models", "M19")
def _(spark, sf):
    d = lines(spark, sf).select(*[F.coalesce(x, F.lit(0.0)).alias(x) for x in XS], "y", C.micros("l_shipdate").alias("t"))
    train, test = d.filter(F.col("t") < us("1999-01-01 00:00:00")), d.filter(F.col("t") >= us("1999-01-01 00:00:00"))
    base = train.agg(F.percentile("y", F.lit(0.5)).alias("median"))
    s = M_.score_challengers(M_.challengers(train, XS, "y"), test, XS).join(F.broadcast(base))  # one row
    names = ["huber", "forest", "boost", "median"]
    one = s.agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col("y") - F.col(x))).alias(x) for x in names])
    return round_all(one.unpivot(["n"], names, "model", "mae"), 3)


@query("calibration_memory", "M21", ORIGINS + anchor_sql(45 * D, 20, 10).replace("level, offset_qa", "level, offset_qa") + f""", ps AS (SELECT origin, lv, lv - cp AS d, rn FROM pub), c AS (SELECT a.a, l.l FROM (VALUES (3), (5), (10), (20)) a(a), (VALUES (3), (5), (10)) l(l)),
   z AS (SELECT c.a, c.l, ps.origin, quantile_cont(lv, 0.5) FILTER (WHERE rn <= l) AS lev, quantile_cont(d, 0.5) FILTER (WHERE rn <= a) AS off FROM ps, c GROUP BY 1, 2, 3)
   SELECT CAST(a AS INTEGER) AS anchor_samples, CAST(l AS INTEGER) AS level_samples, count(*) AS origins, count(off) AS with_offset, round(avg(abs(lev - lab.value)), 6) AS level_mae, round(avg(off), 6) AS mean_offset FROM z JOIN lab ON lab.t = z.origin GROUP BY 1, 2""")
def _(spark, sf):
    l = labs(spark, sf)
    h = X.lab_history(l, clean(spark, sf), {"pa": ANALYSERS["pa"]}, 20)
    a = X.anchor_at(l.select(F.col("t").alias("origin")), h, 240 * M, 45 * D).filter(F.size("recent") > 0)
    d = a.join(l.select(F.col("t").alias("origin"), "value"), "origin")
    cells = F.array(*[F.struct(F.lit(i).alias("anchor_samples"), F.lit(j).alias("level_samples"), C.median_of(F.transform(X.last_n(F.col("recent"), j), lambda x: x.value)).alias("lev"),
                               C.median_of(F.transform(X.last_n(F.col("recent"), i), lambda x: x.diff_pa)).alias("off")) for i in (3, 5, 10, 20) for j in (3, 5, 10)])
    g = d.select("value", F.inline(cells)).groupBy("anchor_samples", "level_samples")
    return round_all(g.agg(F.count("*").alias("origins"), F.count("off").alias("with_offset"), F.avg(F.abs(F.col("lev") - F.col("value"))).alias("level_mae"), F.avg("off").alias("mean_offset")))


@query("stage_inputs", "M33", """WITH r AS (SELECT l_returnflag AS model, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE ln(l_quantity) END AS raw_now, CASE WHEN l_linenumber IN (2, 7) THEN NULL ELSE l_discount END AS a, CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE l_tax END AS b, l_extendedprice / 100000 AS offset_ FROM lineitem),
   k AS (SELECT *, raw_now IS NULL OR ((raw_now IS NULL)::INT + (a IS NULL)::INT + (b IS NULL)::INT) / 3.0 > 0.34 AS fb FROM r)
   SELECT model, l_linenumber, fb AS fallback, count(*) AS n, round(avg(CASE WHEN raw_now IS NOT NULL THEN ln(greatest(exp(raw_now + CASE WHEN fb THEN 0 ELSE 0.1 * coalesce(a, 0.05) - 0.2 * coalesce(b, 0.04) END) + offset_, 0.3)) END), 6) AS ln_pred FROM k GROUP BY 1, 2, 3""")
def _(spark, sf):
    n = F.col("l_linenumber")
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), "l_linenumber", F.when(n != 7, F.ln("l_quantity")).alias("raw_now"), F.when(~n.isin(2, 7), F.col("l_discount")).alias("a"),
                                            F.when(~n.isin(2, 3), F.col("l_tax")).alias("b"), (F.col("l_extendedprice") / 100000).alias("off"))
    missing = sum((F.col(x).isNull().cast("int") for x in ("raw_now", "a", "b")), F.lit(0)) / 3
    fb = F.col("raw_now").isNull() | (missing > 0.34)
    delta = F.when(fb, 0.0).otherwise(0.1 * F.coalesce("a", F.lit(0.05)) - 0.2 * F.coalesce("b", F.lit(0.04)))
    y = C.floored_ln(F.exp(F.col("raw_now") + delta) + F.col("off"))
    return round_all(d.groupBy("model", "l_linenumber", fb.alias("fallback")).agg(F.count("*").alias("n"), F.avg(y).alias("ln_pred")))


@query("implied_gains", "M32", """WITH c AS (SELECT l_returnflag AS model, regr_slope(l_extendedprice, l_quantity) AS q, regr_slope(l_extendedprice, l_discount) AS d1, regr_slope(l_extendedprice, l_tax) AS d2, stddev_pop(l_quantity) AS sq, stddev_pop(l_discount) AS s1, stddev_pop(l_tax) AS s2 FROM lineitem GROUP BY 1)
   SELECT model, 'quantity' AS control, round(q / sq, 4) AS gain, sign(q / sq) = 1 AS agrees FROM c UNION ALL SELECT model, 'rate', round((d1 / s1 + d2 / s2) * 0.01, 4), sign(d1 / s1 + d2 / s2) = 1 FROM c""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    c = l.groupBy(F.col("l_returnflag").alias("model")).agg(*[e for x in ("l_quantity", "l_discount", "l_tax") for e in (F.regr_slope("l_extendedprice", x).alias(x), F.stddev_pop(x).alias(f"s_{x}"))])
    coef = c.select("model", F.inline(F.array(
        F.struct(F.lit("quantity").alias("control"), (F.col("l_quantity") / F.col("s_l_quantity")).alias("g")), F.struct(F.lit("rate").alias("control"), (F.col("l_discount") / F.col("s_l_discount") * 0.01).alias("g")),
        F.struct(F.lit("rate").alias("control"), (F.col("l_tax") / F.col("s_l_tax") * 0.01).alias("g")))))
    return coef.groupBy("model", "control").agg(F.sum("g").alias("s")).select("model", "control", rounded(F.col("s"), 4).alias("gain"), (F.signum("s") == 1).alias("agrees"))


@query("portable_scoring", "M9", """WITH c AS (SELECT l_returnflag AS model, regr_slope(ln(l_extendedprice), l_quantity) AS b, regr_intercept(ln(l_extendedprice), l_quantity) AS a FROM lineitem GROUP BY 1), k AS (SELECT l_returnflag AS model, l_linenumber, CASE WHEN l_linenumber = 7 THEN 25 ELSE l_quantity END AS x FROM lineitem)
   SELECT model, l_linenumber, count(*) AS n, round(avg(a + b * x), 6) AS ln_prediction, round(avg(ln(greatest(a + b * x, 0.3))), 6) AS log_output, round(avg(exp(a + b * x) - 1), 4) AS expm1_output FROM k JOIN c USING (model) GROUP BY 1, 2""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    c = l.groupBy(F.col("l_returnflag").alias("model")).agg(F.array(F.regr_intercept(F.ln("l_extendedprice"), "l_quantity"), F.regr_slope(F.ln("l_extendedprice"), "l_quantity")).alias("coef"))
    k = l.select(F.col("l_returnflag").alias("model"), "l_linenumber", F.coalesce(F.when(F.col("l_linenumber") != 7, F.col("l_quantity")), F.lit(25.0)).alias("x"))
    y = M_.linear(["x"])
    g = k.join(c, "model").groupBy("model", "l_linenumber").agg(F.count("*").alias("n"), F.avg(y).alias("ln_prediction"), F.avg(C.floored_ln(y)).alias("log_output"), F.avg(F.expm1(y)).alias("e"))
    return g.select("model", "l_linenumber", "n", rounded(F.col("ln_prediction")).alias("ln_prediction"), rounded(F.col("log_output")).alias("log_output"), rounded(F.col("e"), 4).alias("expm1_output"))


@query("quality_target_audit", "M24", ORIGINS + f""", s AS (SELECT t, value AS y, (SELECT max(l.t) FROM lab l WHERE l.t + {240 * M} <= s0.t) AS pt FROM lab s0), m3 AS (SELECT t, median(value) OVER (ORDER BY t ROWS 2 PRECEDING) AS m FROM lab),
   p AS (SELECT s.t, s.y, CASE WHEN s.t - pt <= {48 * H} THEN l.value END AS previous, CASE WHEN s.t - pt <= {48 * H} THEN m3.m END AS median3 FROM s LEFT JOIN lab l ON l.t = pt LEFT JOIN m3 ON m3.t = pt),
   u AS (SELECT 'previous' AS method, y, previous AS p, previous IS NOT NULL AND median3 IS NOT NULL AS common FROM p UNION ALL SELECT 'median3', y, median3, previous IS NOT NULL AND median3 IS NOT NULL FROM p UNION ALL SELECT 'constant', y, 35.0, previous IS NOT NULL AND median3 IS NOT NULL FROM p)
   SELECT method, count(p) AS native_n, round(avg(abs(p - y)), 6) AS native_mae, count(p) FILTER (WHERE common) AS common_n, round(avg(abs(p - y)) FILTER (WHERE common), 6) AS common_mae, count(*) FILTER (WHERE y > 100 AND p > 100) AS detected, count(*) FILTER (WHERE y > 100 AND p <= 100) AS missed FROM u GROUP BY 1""")
def _(spark, sf):
    from ..operators.ordered import trailing
    l = labs(spark, sf)
    h = trailing(l.withColumn("_k", F.lit(0)), ["_k"], "t", [], ["value"], 3).select("t", F.struct(F.col("value"), C.median_of(F.transform("recent", lambda x: x.value)).alias("m")).alias("value"))
    from ..operators.timejoin import published_asof
    o = l.select(F.col("t").alias("origin"), F.col("value").alias("y"), F.lit(0).alias("_k"))
    p = published_asof(o, h.withColumn("_k", F.lit(0)), ["_k"], "origin", "t", ["value"], 240 * M, 48 * H)
    d = p.select("y", F.col("lab.value.value").alias("previous"), F.col("lab.value.m").alias("median3"), F.lit(35.0).alias("constant"))
    d = d.withColumn("common", F.col("previous").isNotNull() & F.col("median3").isNotNull())
    u = d.unpivot(["y", "common"], ["previous", "median3", "constant"], "method", "p")
    e = F.abs(F.col("p") - F.col("y"))
    return round_all(u.groupBy("method").agg(F.count("p").alias("native_n"), F.avg(e).alias("native_mae"), F.count(F.when(F.col("common"), F.col("p"))).alias("common_n"), F.avg(F.when(F.col("common"), e)).alias("common_mae"),
                                             F.count_if((F.col("y") > 100) & (F.col("p") > 100)).alias("detected"), F.count_if((F.col("y") > 100) & (F.col("p") <= 100)).alias("missed")))
