"""Refits over many windows: nested walk-forward, monthly refits, feature families, training filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import features as X
from ..operators import risk as R
from ..operators import walkforward as W
from ..operators.fit import ALPHAS
from ..operators.stage import staged
from .adapter import ANALYSER
from .features import ANALYSERS, CONTROL_MAP, DYN_COLUMNS, FEATURE_COLUMNS, staged_series
from .fit import XS, dated
from .registry import query
from .series import round_all, us

M, H, D = C.MINUTE, C.HOUR, C.DAY
WEEKS = [us(f"2024-01-{d} 00:00:00") for d in ("08", "15", "22")]
CLOSE = us("2024-01-31 00:00:00")


def lab_frame(spark, sf, horizon: int = 60 * M):
    """One row per laboratory result: features an hour before the sample, log result, publication four hours after it."""
    s, l = staged_series(spark, sf)
    o = l.select((F.col("t") - horizon).alias("origin"))
    labels = l.select((F.col("t") - horizon).alias("origin"), C.floored_ln("value").alias("y"), (F.col("t") + 240 * M).alias("available"))
    return staged(X.anchored_features(o, s, l, ANALYSERS, CONTROL_MAP).join(labels, "origin"))


@query("nested_walk_forward", "M16")
def _(spark, sf):
    p = W.nested_walk_forward(lab_frame(spark, sf), FEATURE_COLUMNS, "y", "origin", "available", "ln_previous_lab", WEEKS, CLOSE)
    low, high = R.interval("prediction")
    p = p.withColumn("inside", F.when(F.col("quants").isNotNull() & F.col("prediction").isNotNull(), F.col("y").between(low, high).cast("double")))
    p = p.withColumn("risk", F.when(F.col("quants").isNotNull() & F.col("prediction").isNotNull(), R.exceedance_probability("prediction", F.lit(4.605170185988092))))
    g = p.groupBy("cutoff", "alpha", "basis", "path", "status").agg(F.count("*").alias("rows"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("log_mae"), F.avg("inside").alias("coverage_80"), F.avg("risk").alias("mean_risk"))
    return round_all(g.withColumn("cutoff", C.from_micros("cutoff")), 4)


MONTHS = [us(f"{y}-{m:02}-01 00:00:00") for y in (1998, 1999) for m in range(1, 13)]
SPANS = {"all": None, "365d": 365 * D}


@query("monthly_refit", "M20", f"""WITH r AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS x, ln(l_extendedprice) AS y, epoch_us(l_shipdate) AS origin, epoch_us(l_shipdate) + {30 * D} AS available FROM lineitem),
   cut AS (SELECT epoch_us(m) AS cutoff FROM (SELECT unnest(range(TIMESTAMP '1998-01-01', TIMESTAMP '2000-01-01', INTERVAL 1 MONTH)) AS m)),
   w AS (SELECT 'all' AS span, cutoff, -{2**62} AS a FROM cut UNION ALL SELECT '365d', cutoff, cutoff - {365 * D} FROM cut),
   tr AS (SELECT span, cutoff, x, y FROM w JOIN r ON available < cutoff AND available >= a),
   q AS (SELECT span, cutoff, count(*) AS n, quantile_cont(x, 0.5) AS med, quantile_cont(y, 0.5) AS ymed FROM tr GROUP BY 1, 2),
   s AS (SELECT tr.span, tr.cutoff, avg(coalesce(x, med)) AS mean, stddev_pop(coalesce(x, med)) AS sd FROM tr JOIN q USING (span, cutoff) GROUP BY 1, 2),
   z AS (SELECT span, cutoff, (coalesce(x, med) - mean) / sd AS z, y FROM tr JOIN q USING (span, cutoff) JOIN s USING (span, cutoff)),
   b AS (SELECT span, cutoff, avg(y) AS b0, sum(z * y) / (sum(z * z) + 100) AS b1 FROM z GROUP BY 1, 2),
   sc AS (SELECT x, y, (SELECT max(cutoff) FROM cut WHERE cutoff <= origin) AS cutoff FROM r WHERE origin >= epoch_us(TIMESTAMP '1998-01-01') AND origin < epoch_us(TIMESTAMP '2000-01-01'))
   SELECT span, strftime(make_timestamp(cutoff), '%Y-%m-%d %H:%M:%S') AS cutoff, any_value(n) AS train_rows, count(*) AS rows, round(avg(abs(y - (b0 + b1 * (coalesce(x, med) - mean) / sd))), 6) AS mae, round(avg(abs(y - ymed)), 6) AS median_mae
   FROM sc JOIN q USING (cutoff) JOIN s USING (span, cutoff) JOIN b USING (span, cutoff) GROUP BY span, cutoff""")
def _(spark, sf):
    p = W.prequential(dated(spark, sf).select("quantity", "y", "origin", "available"), ["quantity"], "y", "origin", "available", MONTHS, us("2000-01-01 00:00:00"), SPANS, 100.0)
    g = p.groupBy("span", "cutoff").agg(F.max("train_rows").alias("train_rows"), F.count("*").alias("rows"), F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("mae"), F.avg(F.abs(F.col("y") - F.col("median"))).alias("median_mae"))
    return round_all(g.withColumn("cutoff", C.from_micros("cutoff")))


CORE = ["ln_level", "ln_previous_lab", "T", "F", "P"]
FAMILIES = {"core": CORE, "analysers": [*CORE, "ln_qa", "ln_qa_1h", "ln_pa", "ln_pa_1h"], "moves": [*CORE, "ln_qa", "ln_qa_1h", "ln_pa", "ln_pa_1h", "dT_1h", "dT_3h", "dlnF_3h", "dP_3h"], "everything": FEATURE_COLUMNS}


@query("family_ablation", "M31")
def _(spark, sf):
    d = W.family_ablation(lab_frame(spark, sf), FAMILIES, "y", "origin", "available", us("2024-01-16 00:00:00"), CLOSE, 3000.0, CORE, "ln_previous_lab")
    return round_all(d, 6)


@query("stage1_selection", "M15")
def _(spark, sf):
    s, _ = staged_series(spark, sf)
    o, horizon = staged(X.origin_grid(s)), 60 * M
    d = X.dynamics_features(o, s, ANALYSERS, CONTROL_MAP).join(X.centred_mean(o, s, {"p": ANALYSER}, shift=horizon).select("origin", "p_level"), "origin")
    d = d.join(X.quiet_path(o, s, "ev.click", horizon + 30 * M, 120.0, max_gap=90 * M), "origin").withColumn("available", F.col("origin") + horizon + 30 * M)
    d = staged(d.withColumn("y", C.floored_ln("p_level") - F.col("ln_pa_raw")))
    folds = list(zip(WEEKS[:-1], WEEKS[1:]))
    out = W.select_filter(d, DYN_COLUMNS, "y", "ln_pa_raw", "origin", "available", "quiet", folds, WEEKS[-1], ALPHAS[:8])
    return round_all(out, 4)


CHALLENGERS = {"core": CORE, "analysers": FAMILIES["analysers"], "everything": FEATURE_COLUMNS}


@query("challenger_protocol", "M22")
def _(spark, sf):
    periods = [(WEEKS[0], WEEKS[1]), (WEEKS[1], WEEKS[2]), (WEEKS[2], CLOSE)]
    alphas = [30.0, 300.0, 3000.0, 30000.0]  # 12 candidates; the four core ones are incumbents
    d = W.challenge(lab_frame(spark, sf), CHALLENGERS, alphas, [("core", a) for a in alphas], "y", "origin", "available", periods)
    return round_all(d, 4)


@query("anomaly_out_of_sample", "M17")
def _(spark, sf):
    d = dated(spark, sf).select("model", "quantity", "discount", F.coalesce("tax", F.lit(0.04)).alias("tax"), "origin")
    folds = [(us(f"{y}-01-01 00:00:00"), us(f"{y + 1}-01-01 00:00:00")) for y in (1996, 1997, 1998, 1999)]
    models, evidence = W.anomaly_model(d, ["model"], XS, "origin", folds, us("2000-01-01 00:00:00"))
    c = W.anomaly_class(d, models, ["model"], XS).groupBy("model").agg(F.count("*").alias("rows"), *[F.count_if(F.col("anomaly") == k).alias(k + "_rows") for k in ("normal", "attention", "high")])
    folds = evidence.groupBy("model").agg(F.count("*").alias("folds"), F.sum("rows").alias("scored"), F.max("q99").alias("largest_q99"))
    return round_all(models.select("model", "train_rows", "attention", "high", "basis").join(folds, "model").join(c, "model"), 4)


@query("logistic_protocol", "M18")
def _(spark, sf):
    from ..operators.logistic import risk_protocol
    d = risk_protocol(lab_frame(spark, sf), FEATURE_COLUMNS, "y", 4.605170185988092, "origin", "available", [(WEEKS[0], WEEKS[1]), (WEEKS[1], WEEKS[2])])
    return round_all(d, 4)
