"""Forecast evaluation: regression and probability metrics, alarm thresholds, bootstrap intervals, audits.

Every table here is grouped by caller-given keys (model, horizon, period ...).  Scores are first collapsed to
distinct values, and orderings along a score run over value chunks, so one model with most of the rows does not
end up in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .ordered import neighbour, running, value_chunks
from .quantiles import PER_RANGE, quantile_rows, quantiles
from .timejoin import asof, range_frame

NEVER = float("inf")


def _share(a, b) -> Column:
    return F.when(b > 0, a / b)


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str, p: str, threshold: float, per_range: int = PER_RANGE) -> DataFrame:
    """n, MAE, RMSE, median AE, bias, correlation and exceedance counts over finite pairs."""
    d = df.select(*keys, C.finite(y).alias("_y"), C.finite(p).alias("_p")).filter("_y IS NOT NULL AND _p IS NOT NULL")
    d = d.withColumn("_e", F.col("_p") - F.col("_y")).withColumn("_a", F.abs("_e"))
    bad, alarm = F.col("_y") > threshold, F.col("_p") > threshold
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_a").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_e").alias("bias"),
        F.when((F.count("*") > 2) & (F.stddev_pop("_p") > 0) & (F.stddev_pop("_y") > 0), F.corr("_y", "_p")).alias("correlation"),
        F.count_if(bad).alias("actual_above"), F.count_if(alarm).alias("predicted_above"),
        F.count_if(bad & alarm).alias("tp"), F.count_if(~bad & alarm).alias("fp"), F.count_if(bad & ~alarm).alias("fn"))
    med = quantiles(d, keys, "_a", [0.5], ["median_absolute_error"], per_range)
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return g.join(med, list(keys)).select(
        *keys, "n", "mae", "rmse", "median_absolute_error", "bias", "correlation", "actual_above", "predicted_above",
        _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"),
        (fp / F.greatest(F.lit(1), n - F.col("actual_above"))).alias("false_alarm_rate"))


def finite_metrics(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    """MAE over the full denominator: a group with any non-finite prediction reports the failures and no MAE."""
    ok = C.finite(p).isNotNull()
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~ok).alias("nonfinite"), F.avg(F.abs(C.finite(p) - F.col(y))).alias("mae"))
    return g.withColumn("mae", F.when(F.col("nonfinite") == 0, F.col("mae"))).withColumn(
        "status", F.when(F.col("nonfinite") == 0, "ok").otherwise("numerical_failure_on_full_denominator"))


def score_table(df: DataFrame, keys: Sequence[str], event: Column, score: str, pieces: int = 64) -> DataFrame:
    """Distinct scores per key with pos/neg counts, counts at or below, and key totals."""
    t = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(event).alias("pos"), F.count_if(~event).alias("neg"))
    t = running(value_chunks(t, keys, "score", pieces), keys, ["score"], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})
    total = t.groupBy(*keys).agg(F.sum("pos").alias("pos_all"), F.sum("neg").alias("neg_all"))
    return t.join(total, list(keys))


def auc(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank AUC with ties counted half, from the distinct-score table."""
    won = F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2)
    g = scores.groupBy(*keys).agg(F.sum(won).alias("u"), F.max("pos_all").alias("p"), F.max("neg_all").alias("q"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u") / (F.col("p").cast("double") * F.col("q"))).alias("auc"))


def probability_metrics(df: DataFrame, keys: Sequence[str], event: Column, score: str, alarm_at: float) -> DataFrame:
    """Brier score, climatology, skill, AUC and alarm counts at a fixed probability."""
    d = df.withColumn("_d", event.cast("double")).filter(F.col(score).isNotNull())
    hit, alarm = event, F.col(score) >= alarm_at
    g = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_d").alias("base_rate"), F.avg((F.col(score) - F.col("_d")) * (F.col(score) - F.col("_d"))).alias("brier"),
        F.count_if(alarm).alias("alarms"), F.count_if(hit & alarm).alias("tp"), F.count_if(~hit & alarm).alias("fp"), F.count_if(hit & ~alarm).alias("fn"))
    ref = F.col("base_rate") * (1 - F.col("base_rate"))
    g = g.join(auc(score_table(d, keys, event, score), keys), list(keys))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*keys, "n", "base_rate", "brier", ref.alias("brier_climatology"), F.when(ref > 0, 1 - F.col("brier") / ref).alias("brier_skill"), "auc", "alarms",
                    _share(tp, tp + fn).alias("recall"), _share(tp, tp + fp).alias("precision"), (fp / F.greatest(F.lit(1), F.col("n") - tp - fn)).alias("false_alarm_rate"))


def average_ranks(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tie-averaged 1-based rank of every distinct score."""
    size = F.col("pos") + F.col("neg")
    upto = F.col("pos_upto") + F.col("neg_upto")
    return scores.select(*keys, "score", size.alias("ties"), (upto - (size - 1) / 2).alias("rank"))


def cost_metrics(df: DataFrame, keys: Sequence[str], event: Column, alarm: Column, ratio: Column) -> DataFrame:
    """Confusion counts and asymmetric cost (missed event = ratio, false alarm = 1)."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(event & alarm).alias("tp"), F.count_if(~event & alarm).alias("fp"),
                              F.count_if(event & ~alarm).alias("fn"), F.count_if(~event & ~alarm).alias("tn"))
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    cost = ratio * fn + fp
    return g.select("*", _share(tp, tp + fn).alias("recall"), _share(tp, tp + fp).alias("precision"), _share(fp, fp + tn).alias("false_alarm_rate"),
                    ((tp + fp) / n).alias("alarm_share"), cost.cast("double").alias("total_cost"), (cost / n * 100).alias("cost_per_100"))


def alarm_decisions(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct decision ``score >= threshold`` with its tp, fp, fn, tn; threshold infinity = never alarm."""
    d = scores.select(*keys, F.col("score").alias("threshold"),
                      (F.col("pos_all") - F.col("pos_upto") + F.col("pos")).alias("tp"), (F.col("neg_all") - F.col("neg_upto") + F.col("neg")).alias("fp"), "pos_all", "neg_all")
    none = scores.groupBy(*keys).agg(F.max("pos_all").alias("pos_all"), F.max("neg_all").alias("neg_all")).select(
        *keys, F.lit(NEVER).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "pos_all", "neg_all")
    return d.unionByName(none).withColumn("fn", F.col("pos_all") - F.col("tp")).withColumn("tn", F.col("neg_all") - F.col("fp"))


def cheapest_threshold(decisions: DataFrame, keys: Sequence[str], ratios: Sequence[float]) -> DataFrame:
    """Least-cost decision per key and ratio; ties go to fewer misses, fewer false alarms, higher threshold."""
    d = decisions.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    key = F.struct((F.col("ratio") * F.col("fn") + F.col("fp")).alias("cost"), F.col("fn"), F.col("fp"), (-F.col("threshold")).alias("_t"), F.col("tp"))
    b = d.groupBy(*keys, "ratio").agg(F.min(key).alias("b"))
    return b.select(*keys, "ratio", (-F.col("b._t")).alias("threshold"), F.col("b.cost").alias("cost"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"), F.col("b.fn").alias("fn"))


def capped_threshold(decisions: DataFrame, keys: Sequence[str], max_fpr: float) -> DataFrame:
    """Highest recall, then precision, then threshold among decisions within the false-alarm cap."""
    one = lambda a, b: a / F.greatest(F.lit(1), b)
    d = decisions.withColumn("fpr", one(F.col("fp"), F.col("neg_all"))).filter(F.col("fpr") <= max_fpr)
    best = F.struct(one(F.col("tp"), F.col("pos_all")).alias("recall"), one(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.col("threshold"), F.col("fpr"))
    return d.groupBy(*keys).agg(F.max(best).alias("b")).select(*keys, "b.*")


def best_f1(df: DataFrame, keys: Sequence[str], event: Column, score: str, grid: Sequence[float]) -> DataFrame:
    """F1 at each grid level and the first best level, from one aggregation."""
    aggs = []
    for i, g in enumerate(grid):
        a = F.col(score) >= g
        aggs += [F.count_if(event & a).alias(f"tp{i}"), F.count_if(~event & a).alias(f"fp{i}")]
    t = df.groupBy(*keys).agg(F.count_if(event).alias("pos"), *aggs)
    f1 = [F.coalesce(2 * F.col(f"tp{i}") / F.nullif(F.col("pos") + F.col(f"tp{i}") + F.col(f"fp{i}"), F.lit(0)), F.lit(0.0)) for i in range(len(grid))]
    t = t.select(*keys, F.array(*[F.struct(x.alias("f1"), F.lit(-g).alias("neg")) for x, g in zip(f1, grid)]).alias("a"))
    return t.select(*keys, (-F.array_max("a")["neg"]).alias("alarm_probability"), F.array_max("a")["f1"].alias("f1"))


def residual_quantiles(df: DataFrame, keys: Sequence[str], residual: str, levels: Sequence[float] = tuple(i / 100 for i in range(1, 100)),
                       per_range: int = PER_RANGE) -> DataFrame:
    """Empirical quantile function: one row per key and probability."""
    return quantile_rows(df, keys, residual, levels, per_range)


def residual_bound(df: DataFrame, keys: Sequence[str], residual: str, confidence: float = 0.9, min_n: int = 30) -> DataFrame:
    """One-sided finite-sample bound: the ceil((n + 1) * confidence)-th smallest residual, NULL for few rows."""
    v = df.filter(F.col(residual).isNotNull()).groupBy(*keys, F.col(residual).alias("v")).agg(F.count("*").alias("c"))
    v = running(value_chunks(v, keys, "v"), keys, ["v"], {"upto": F.col("c")})
    total = v.groupBy(*keys).agg(F.sum("c").alias("n"))
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1) * confidence))
    hit = (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)
    return v.join(total, list(keys)).groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(hit & (F.col("n") >= min_n), F.col("v"))).alias("bound"))


# --- laboratory drift ----------------------------------------------------------------

DEFAULT_SIGMA = 0.311  # fixed fallback per sqrt(day)
Z90 = 1.2816


def drift_steps(labs: DataFrame, min_gap_days: float = 0.5, width: int = 30 * C.DAY) -> DataFrame:
    """Squared change per day between consecutive samples far enough apart (key ``_k``, time ``t``)."""
    d = neighbour(labs.select(F.lit(0).alias("_k"), "t", "value"), ["_k"], "t", [], ["value"], width, "prev").filter("prev IS NOT NULL")
    gap = (F.col("t") - F.col("prev.t")) / C.DAY
    step = F.col("value") - F.col("prev.value")
    return d.select("_k", "t", gap.alias("gap_days"), F.when(gap >= min_gap_days, step * step / gap).alias("rate"), F.col("_chunk"))


def drift_sigma_at(origins: DataFrame, labs: DataFrame, delay: int = C.LAB_DELAY_MINUTES * C.MINUTE, min_gap_days: float = 0.5,
                   min_pairs: int = 8, default: float = DEFAULT_SIGMA, width: int = 30 * C.DAY) -> DataFrame:
    """Drift per sqrt(day) known at the start of each origin's day, from samples published by then."""
    steps = running(drift_steps(labs, min_gap_days, width), ["_k"], ["t"], {"s": F.coalesce("rate", F.lit(0.0)), "k": F.col("rate").isNotNull().cast("long")})
    o = origins.select("origin").distinct().withColumn("_k", F.lit(0)).withColumn("_at", F.col("origin") - F.pmod("origin", F.lit(C.DAY)) - F.lit(delay))
    j = asof(o, steps.select("_k", "t", "s", "k"), ["_k"], "_at", "t", ["s", "k"], [], None, width, "h")
    n = F.coalesce(F.col("h.k"), F.lit(0))
    return j.select("origin", F.when(n >= min_pairs, n).otherwise(0).alias("pairs"), F.when(n >= min_pairs, F.sqrt(F.col("h.s") / n)).otherwise(default).alias("sigma"))


def aged_lower_bound(value, age_days, sigma) -> Column:
    return C.c(value) - Z90 * C.c(sigma) * F.sqrt(F.greatest(C.c(age_days), F.lit(0.0)))


# --- block bootstrap -------------------------------------------------------------------


def block_bootstrap(df: DataFrame, keys: Sequence[str], t: str, delta: str, block_days: int = 7, draws: int = 2000,
                    probs: Sequence[float] = (0.025, 0.975)) -> DataFrame:
    """Mean of ``delta`` and its calendar-block bootstrap interval (ratio of resampled sums).

    Rows are reduced to one (sum, count) per block first; the draws run over that small table.  Block choice is a
    hash of (key, draw, slot), so a draw can be replayed anywhere.
    """
    b = df.groupBy(*keys, C.bucket(t, block_days * C.DAY).alias("block")).agg(F.sum(delta).alias("s"), F.count(delta).alias("c"))
    w = Window.partitionBy(*keys).orderBy("block")
    b = b.withColumn("i", (F.row_number().over(w) - 1).cast("long")).drop("block")
    total = b.groupBy(*keys).agg(F.count("*").alias("blocks"), (F.sum("s") / F.sum("c")).alias("mean_delta"))
    d = total.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    d = d.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))))
    d = d.withColumn("i", C.drawn(F.col("blocks"), *keys, "draw", "slot"))
    s = d.join(b, [*keys, "i"]).groupBy(*keys, "draw").agg((F.sum("s") / F.sum("c")).alias("x"))
    return total.join(quantiles(s, keys, "x", list(probs), ["ci_low", "ci_high"]), list(keys))


# --- audits ---------------------------------------------------------------------------


def coverage_table(df: DataFrame, candidate: str, period: str, horizon: str, accepted: Column, exceed: Column) -> DataFrame:
    """Rows, accepted, coverage and abstained exceedances per candidate x period x horizon and pooled over each."""
    g = df.groupingSets([[candidate, period, horizon], [candidate, period], [candidate]], candidate, period, horizon).agg(
        F.count("*").alias("rows"), F.count_if(accepted).alias("accepted"), F.count_if(~accepted & exceed).alias("abstained_above"))
    return g.withColumn("coverage", F.col("accepted") / F.col("rows"))


def reason_counts(df: DataFrame, keys: Sequence[str], reasons: str) -> DataFrame:
    r = F.explode(F.split(F.coalesce(F.nullif(reasons, F.lit("")), F.lit("unspecified")), r"\|"))
    return df.select(*keys, r.alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("rows"))


def classify(text: Column | str, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """First rule whose keyword occurs in the text."""
    out = F.lit(other)
    for word, label in reversed(rules):
        out = F.when(F.contains(C.c(text), F.lit(word)), label).otherwise(out)
    return out


def delayed_correction(df: DataFrame, sample: str, y: str, p: str, days: int, strength: float, delay: int = C.LAB_DELAY_MINUTES * C.MINUTE,
                       min_errors: int = 3) -> DataFrame:
    """``p`` plus strength x median of own errors published within the last days before each origin (>= min_errors)."""
    d = df.withColumn("_k", F.lit(0))
    err = d.select("_k", (F.col(sample) + delay).alias("_pub"), (F.col(y) - F.col(p)).alias("_e")).filter("_e IS NOT NULL")
    m = range_frame(d, err, ["_k"], "origin", "_pub", ["_e"], -days * C.DAY, 0, {"_n": F.count("_e"), "_m": F.percentile("_e", F.lit(0.5))})
    shift = F.when(F.col("_n") >= min_errors, strength * F.col("_m")).otherwise(0.0)
    return d.join(m, ["_k", "origin"], "left").withColumn("corrected", F.greatest(F.lit(0.0), F.col(p) + shift)).drop("_k", "_n", "_m")


def promotion_checks(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(F.bool_and("passed").alias("passed"), F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"))


def leakage_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Number of rows violating each rule; a sound frame has only zeros."""
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in checks.items()])


def frame_difference(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows of the two frames that differ (null-safe) beyond the tolerance, and the rows compared."""
    j = a.select(key, *columns).join(b.select(key, *[F.col(x).alias(f"_{x}") for x in columns]), key, "full_outer")
    bad = F.lit(False)
    for x in columns:
        u, v = F.col(x), F.col(f"_{x}")
        bad = bad | (u.isNull() != v.isNull()) | F.coalesce(F.abs(u - v) > tolerance, F.lit(False))
    return j.agg(F.count("*").alias("rows"), F.count_if(bad).alias("differing"))
