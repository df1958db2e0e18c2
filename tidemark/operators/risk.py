"""Residual quantile functions applied to predictions: probabilities, intervals, levels, horizon blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def interp(x: Column | str, xs: Column | str, ys: Column | str) -> Column:
    """Linear interpolation over two parallel sorted arrays, clamped at both ends."""
    x, xs, ys = C.c(x), C.c(xs), C.c(ys)
    n = F.size(xs)
    i = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1 = F.get(xs, i - 1), F.get(xs, i)
    y0, y1 = F.get(ys, i - 1), F.get(ys, i)
    return F.when(i == 0, F.get(ys, F.lit(0))).when(i >= n, F.get(ys, n - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def as_arrays(table: DataFrame, keys=()) -> DataFrame:
    """(probability, quantile) rows to one row per key with two sorted arrays; the table has 99 rows per key."""
    a = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("probability", "quantile"))).alias("_a"))
    return a.select(*keys, F.col("_a.probability").alias("probs"), F.col("_a.quantile").alias("quants"))


def exceedance_probability(prediction, limit, probs="probs", quants="quants") -> Column:
    """P(actual > limit) when actual = prediction + residual; clamped to the outermost known probabilities."""
    gap = C.c(limit) - C.c(prediction)
    p, q = C.c(probs), C.c(quants)
    first, last = F.get(q, F.lit(0)), F.element_at(q, -1)
    return (F.when(gap <= first, 1 - F.get(p, F.lit(0))).when(gap >= last, 1 - F.element_at(p, -1)).otherwise(1 - interp(gap, q, p)))


def interval(prediction, low: float = 0.1, high: float = 0.9, probs="probs", quants="quants") -> tuple[Column, Column]:
    return C.c(prediction) + interp(F.lit(low), probs, quants), C.c(prediction) + interp(F.lit(high), probs, quants)


def safe_level(limit: float, probability, probs="probs", quants="quants") -> Column:
    """Level whose exceedance probability equals the given one (log residuals)."""
    return F.lit(limit) * F.exp(-interp(1 - C.c(probability), probs, quants))


def widened(quants, sigma, extra, probs="probs") -> Column:
    """Quantiles stretched around their median by an independent extra spread."""
    q, s, e = C.c(quants), C.c(sigma), C.c(extra)
    factor = F.sqrt(1 + (e / s) * (e / s))
    mid = interp(F.lit(0.5), probs, q)
    return F.when((e > 0) & (s > 0), F.transform(q, lambda v: mid + (v - mid) * factor)).otherwise(q)


def at_horizon(horizon, horizons, values) -> Column:
    """Value at any horizon, linear between the fitted ones."""
    return interp(horizon, horizons, values)


def blend_quantiles(weight, lower, upper) -> Column:
    w = C.c(weight)
    return F.zip_with(C.c(lower), C.c(upper), lambda a, b: (1 - w) * a + w * b)


def path_support(statuses: Column, horizons: Column, horizon) -> Column:
    """Whether every fitted horizon up to the one that closes the requested horizon is supported."""
    end = F.array_min(F.filter(horizons, lambda h: h >= C.c(horizon)))
    need = F.filter(F.arrays_zip(statuses.alias("s"), horizons.alias("h")), lambda x: x.h <= end)
    return F.forall(need, lambda x: x.s == "ok")


def horizon_status(statuses: Column, horizons: Column, horizon) -> Column:
    """ok only when both neighbouring fitted horizons are supported."""
    h = C.c(horizon)
    lo, hi = F.array_max(F.filter(horizons, lambda x: x <= h)), F.array_min(F.filter(horizons, lambda x: x >= h))
    near = F.filter(F.arrays_zip(statuses.alias("s"), horizons.alias("h")), lambda x: (x.h == lo) | (x.h == hi))
    return F.when(F.forall(near, lambda x: x.s == "ok"), "ok").otherwise("abstain")
