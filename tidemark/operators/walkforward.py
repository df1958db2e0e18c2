"""Refits over many training windows from moments accumulated over time.

Rows are reduced once to one moment matrix per time cell, the cells lying between all window bounds; a window's matrix is the sum of
its cells.  A missing value enters as 0 with an indicator beside it, so a window's own medians, means and deviations are put in
afterwards, by a linear map of its matrix: every window, penalty and feature family is solved exactly as if refitted on its rows.
Medians and support bounds of all windows come from values counted once per cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .fit import ALPHAS
from .quantiles import BLOCK_BITS, PER_RANGE, counted_quantiles, window_counted_quantiles
from .stage import per_key, staged

BEGIN = -(2**62)  # start of a window over all history
MODEL = "window long, family string, alpha double, n long, intercept double, slopes array<double>, median array<double>, mean array<double>, scale array<double>, lower array<double>, upper array<double>"


def cells(windows: Sequence[tuple[int, int]]) -> list[int]:
    """Every bound of the [start, end) windows, in order."""
    return sorted({x for w in windows for x in w})


def cell_of(t: Column | str, edges: Sequence[int]) -> Column:
    """How many edges lie at or before t: rows of window [a, b) have cells index(a) + 1 .. index(b)."""
    def upto(low, high):  # halved, so that a row is compared a few times and not with every edge
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(C.c(t) >= F.lit(int(edges[middle])).cast("long"), upto(middle + 1, high)).otherwise(upto(low, middle))

    return upto(0, len(edges))


def cell_moments(rows: DataFrame, columns: Sequence[str], y: str, shifts: Mapping[str, float]) -> DataFrame:
    """(cell, pos, value, n) of the upper triangle of sum v v', v = (1, values or 0, missing marks, y); values and y less their shifts."""
    p = len(columns)
    upper = np.triu_indices(2 * p + 2)
    shift = np.array([shifts[x] for x in columns])

    def partial(batches):
        total: dict[int, list] = {}
        for pdf in batches:
            x = pdf[list(columns)].to_numpy(dtype=float) - shift
            gone = ~np.isfinite(x)
            v = np.column_stack([np.ones(len(x)), np.where(gone, 0.0, x), gone, pdf[y].to_numpy(dtype=float) - shifts[y]])
            for cell in np.unique(pdf["cell"]):
                own = v[(pdf["cell"] == cell).to_numpy()]
                now = total.setdefault(int(cell), [0, 0.0])
                now[0] += len(own)
                now[1] = now[1] + (own.T @ own)[upper]
        for cell, (n, m) in total.items():
            yield pd.DataFrame({"cell": cell, "pos": np.arange(len(m)), "value": m, "n": n})

    d = rows.select("cell", *[F.col(x).cast("double").alias(x) for x in [*columns, y]])
    return d.mapInPandas(partial, "cell int, pos int, value double, n long").groupBy("cell", "pos").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def window_moments(moments: DataFrame, windows: Sequence[tuple[int, int]], edges: Sequence[int]) -> DataFrame:
    """(window, n, moments array): the sum over each window's cells."""
    def inside(w):
        return (F.col("cell") > edges.index(w[0])) & (F.col("cell") <= edges.index(w[1]))

    sums = moments.groupBy("pos").agg(*[F.sum(F.when(inside(w), F.col(c))).alias(f"{c}{k}") for k, w in enumerate(windows) for c in ("value", "n")])
    each = F.array(*[F.struct(F.lit(k).cast("long").alias("window"), F.col(f"value{k}").alias("value"), F.col(f"n{k}").alias("n")) for k in range(len(windows))])
    long = sums.select("pos", F.inline(each)).filter("n > 0")
    return long.groupBy("window").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("moments"))


def window_quantiles(rows: DataFrame, columns: Sequence[str], windows: Sequence[tuple[int, int]], edges: Sequence[int], probs: Sequence[float],
                     names: Sequence[str], block_bits: int = BLOCK_BITS) -> DataFrame:
    """(window, column, names...): exact quantiles per window from counts by (column, value, cell)."""
    long = rows.select("cell", F.inline(F.array(*[F.struct(F.lit(x).alias("column"), C.finite(F.col(x).cast("double")).alias("_v")) for x in columns])))
    counted = long.filter("_v IS NOT NULL").groupBy("column", "_v", "cell").agg(F.count("*").alias("_c"))
    return window_counted_quantiles(counted, ["column"], "cell", [(edges.index(a), edges.index(b)) for a, b in windows], probs, names, block_bits)


def solved(g: np.ndarray, median: np.ndarray, chosen: Sequence[int], alphas: Sequence[float]) -> tuple:
    """Mean, deviation, and per alpha intercept and slopes (of standardised columns, 0 outside `chosen`), all in shifted units."""
    p, n = len(median), g[0, 0]
    fill = np.zeros((p + 2, 2 * p + 2))  # (1, filled values, y) from (1, values or 0, marks, y)
    fill[0, 0] = fill[-1, -1] = 1.0
    fill[1:p + 1, 1:p + 1], fill[1:p + 1, p + 1:2 * p + 1] = np.eye(p), np.diag(median)
    f = fill @ g @ fill.T
    mean, square = f[0, 1:p + 1] / n, np.diag(f)[1:p + 1] / n
    spread = np.maximum(square - mean * mean, 0.0)
    scale = np.where(spread > 1e-13 * np.maximum(square, 1e-300), np.sqrt(spread), 1.0)
    z = np.zeros((p + 2, p + 2))
    z[0, 0] = z[-1, -1] = 1.0
    z[1:p + 1, 0], z[1:p + 1, 1:p + 1] = -mean / scale, np.diag(1 / scale)
    f = z @ f @ z.T
    own, out = [0, *[i + 1 for i in chosen]], []
    for a in alphas:
        penalty = np.eye(len(own)) * a
        penalty[0, 0] = 0.0
        b = np.linalg.solve(f[np.ix_(own, own)] + penalty, f[own, -1])
        slopes = np.zeros(p)
        slopes[list(chosen)] = b[1:]
        out.append((b[0], slopes))
    return mean, scale, out


def fit_windows(frame: DataFrame, columns: Sequence[str], y: str, when: str, windows: Sequence[tuple[int, int]], alphas: Sequence[float] = ALPHAS,
                families: Mapping[str, Sequence[str]] | None = None, margin: float = 0.10, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Ridge models (MODEL) of every window, feature family and alpha; window k is trained on rows with start <= ``when`` < end and a known y.

    Columns are filled with the window's medians (0 without any value) and standardised with its means and deviations. Windows
    without rows have no model. The windows and families are the caller's lists; a family names some of the columns.
    """
    columns, families = list(columns), {k: list(v) for k, v in (families or {"all": columns}).items()}
    edges = cells(windows)
    rows = frame.filter(C.finite(F.col(y).cast("double")).isNotNull()).withColumn("cell", cell_of(when, edges)).filter(f"cell > 0 AND cell < {len(edges)}")
    sums = rows.agg(*[F.avg(C.finite(F.col(x).cast("double"))).alias(x) for x in [*columns, y]]).first()
    shifts = {x: float(sums[x] or 0.0) for x in [*columns, y]}
    m = window_moments(cell_moments(rows, columns, y, shifts), windows, edges)
    q = window_quantiles(rows, columns, windows, edges, [0.005, 0.5, 0.995], ["lo", "median", "hi"], block_bits)
    q = q.groupBy("window").agg(F.map_from_entries(F.collect_list(F.struct("column", F.array("lo", "median", "hi")))).alias("q"))
    size, shift = 2 * len(columns) + 2, np.array([shifts[x] for x in columns])
    upper, levels = np.triu_indices(size), [float(a) for a in alphas]
    names = [f.split(" ")[0] for f in MODEL.split(", ")]

    def solve(batches):
        for pdf in batches:
            out = []
            for window, n, moments, q in zip(pdf["window"], pdf["n"], pdf["moments"], pdf["q"]):
                g = np.zeros((size, size))
                g[upper] = np.asarray(moments, dtype=float)
                g = g + np.triu(g, 1).T
                known = dict(q) if q is not None else {}
                lo, median, hi = np.array([known.get(x, [0.0] * 3) for x in columns], dtype=float).T
                for family, own in families.items():
                    mean, scale, fits = solved(g, median - shift, [columns.index(x) for x in own], levels)
                    room = margin * np.maximum(hi - lo, scale)
                    here = np.array([x in known for x in columns])
                    low, high = (np.where(here, v, 0.0).tolist() for v in (lo - room, hi + room))
                    for a, (b0, slopes) in zip(levels, fits):
                        out.append((window, family, a, n, b0 + shifts[y], slopes.tolist(), median.tolist(), (mean + shift).tolist(), scale.tolist(), low, high))
            yield pd.DataFrame(out, columns=names)

    return m.join(q, "window", "left").mapInPandas(solve, MODEL)


def features_array(columns: Sequence[str]) -> Column:
    return F.array(*[C.finite(F.col(x).cast("double")) for x in columns])


def with_models(rows: DataFrame, models: DataFrame, window: str, columns: Sequence[str]) -> DataFrame:
    """rows with _models: the sorted models (family, alpha, prediction, outside) of their window; rows without a model have null."""
    per = models.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("family", "alpha", "intercept", "slopes", "median", "mean", "scale", "lower", "upper"))).alias("_m"))
    per = per_key(per)
    d = rows.withColumn("_x", features_array(columns)).join(per.withColumnRenamed("window", window), window, "left")

    def one(m):
        z = F.transform(F.col("_x"), lambda v, i: (F.coalesce(v, m["median"][i]) - m["mean"][i]) / m["scale"][i])
        value = F.aggregate(F.transform(z, lambda v, i: m["slopes"][i] * v), m["intercept"], lambda s, v: s + v)
        beyond = F.size(F.filter(F.transform(F.col("_x"), lambda v, i: F.coalesce((v < m["lower"][i]) | (v > m["upper"][i]), F.lit(False))), lambda b: b))
        return F.struct(m["family"].alias("family"), m["alpha"].alias("alpha"), value.alias("prediction"), beyond.alias("outside"), F.array_max(F.transform(z, lambda v: F.abs(v))).alias("far"))

    return d.withColumn("_models", F.transform("_m", one)).drop("_m")


def known_share(columns: Sequence[str]) -> Column:
    return F.size(F.filter("_x", lambda v: v.isNotNull())) / F.lit(float(len(columns)))


LEVELS = [k / 100 for k in range(1, 100)]


def nested_walk_forward(frame: DataFrame, columns: Sequence[str], y: str, origin: str, available: str, persistence: str, cutoffs: Sequence[int], end: int,
                        alphas: Sequence[float] = ALPHAS, preregistered: float = 30.0, max_missing: float = 0.34, max_outside: float = 0.20, max_far: float = 8.0,
                        levels: Sequence[float] = tuple(LEVELS), per_range: int = PER_RANGE) -> DataFrame:
    """Every row with an origin in [first cutoff, end), predicted as at the latest cutoff before its origin.

    Nothing published at or after a cutoff enters its model set. Fold k runs from cutoff k to the next. A cutoff's alpha has the least
    mean over the earlier folds of the fold's mean error, each fold predicted by the models of its own start, on rows it serves by
    model and whose label was out before the fold's end; the first cutoff, and any without such a row, takes the
    preregistered one. Support bounds are the cutoff's own. A row whose ``persistence`` is known but whose features are too sparse, or
    whose cutoff has no model, is served by ``persistence`` plus the cutoff's median residual of it; rows outside the support abstain.
    Residual quantiles of a cutoff come only from what the earlier cutoffs' chosen models predicted, per path.

    Adds cutoff, alpha, basis, path, status, prediction, probs and quants (of the path; null before any earlier fold).
    """
    cutoffs = sorted(int(c) for c in cutoffs)
    windows, closing = [(BEGIN, c) for c in cutoffs], [*cutoffs[1:], int(end)]
    models = staged(fit_windows(frame, columns, y, available, windows, alphas))
    # the median residual of persistence before each cutoff
    edges = cells(windows)
    labelled = frame.withColumn("cell", cell_of(available, edges)).withColumn("_r", F.col(y) - F.col(persistence))
    bias = window_quantiles(labelled, ["_r"], windows, edges, [0.5], ["bias"]).select(F.col("window").alias("fold"), "bias")
    cuts = F.array(*[F.lit(c).cast("long") for c in cutoffs])
    d = frame.filter((F.col(origin) >= cutoffs[0]) & (F.col(origin) < int(end))).withColumn("fold", (F.size(F.filter(cuts, lambda c: c <= F.col(origin))) - 1).cast("long"))
    d = with_models(d, models, "fold", columns).join(bias, "fold", "left")
    sparse = (known_share(columns) < 1 - max_missing) | F.col("_models").isNull()
    d = d.withColumn("path", F.when(sparse, "persistence").otherwise("model"))
    # the label was out before the fold's end, so every later cutoff may use it
    d = d.withColumn("_closed", F.col(y).isNotNull() & (F.col(available) < F.element_at(F.array(*[F.lit(c).cast("long") for c in closing]), (F.col("fold") + 1).cast("int"))))
    d = staged(d)
    errors = d.filter("_closed AND path = 'model'").select("fold", F.col(y).alias("_y"), F.inline("_models")).groupBy("fold", "alpha").agg(F.avg(F.abs(F.col("_y") - F.col("prediction"))).alias("e"))
    later = F.sequence(F.col("fold") + 1, F.lit(len(cutoffs) - 1).cast("long"))
    after = errors.filter(F.col("fold") < len(cutoffs) - 1).select(F.explode(later).alias("fold"), "alpha", "e")
    chosen = after.groupBy("fold", "alpha").agg(F.avg("e").alias("e")).groupBy("fold").agg(F.min(F.struct("e", "alpha"))["alpha"].alias("_alpha"))
    d = d.join(chosen, "fold", "left").withColumn("alpha", F.coalesce("_alpha", F.lit(float(preregistered))))
    d = d.withColumn("basis", F.when(F.col("_alpha").isNull(), "preregistered").otherwise("earlier_folds"))
    own = F.get(F.filter("_models", lambda m: m["alpha"] == F.col("alpha")), F.lit(0))
    d = d.withColumn("_own", own).withColumn("_known", F.greatest(F.lit(1), F.size(F.filter("_x", lambda v: v.isNotNull()))))
    outside = (F.col("path") == "model") & ((F.col("_own.outside") / F.col("_known") > max_outside) | (F.col("_own.far") > max_far))
    value = F.when(F.col("path") == "model", F.col("_own.prediction")).otherwise(F.col(persistence) + F.coalesce("bias", F.lit(0.0)))
    d = d.withColumn("status", F.when(outside | value.isNull(), "abstain").otherwise("ok")).withColumn("prediction", F.when(F.col("status") == "ok", value))
    d = staged(d.withColumn("cutoff", F.element_at(cuts, (F.col("fold") + 1).cast("int"))).drop("_alpha", "_models", "_x", "_own", "_known", "bias"))
    # residuals of earlier outer predictions, counted per fold and then handed to all later cutoffs
    r = d.filter("_closed AND status = 'ok'").filter(F.col("fold") < len(cutoffs) - 1).select("path", "fold", (F.col(y) - F.col("prediction")).alias("_v"))
    counted = r.groupBy("path", "_v", "fold").agg(F.count("*").alias("_c")).select("path", "_v", "_c", F.explode(later).alias("fold")).groupBy("path", "fold", "_v").agg(F.sum("_c").alias("_c"))
    q = counted_quantiles(counted, ["path", "fold"], list(levels), [f"q{i}" for i in range(len(levels))], per_range)
    q = q.select("path", "fold", F.array(*[F.lit(float(x)) for x in levels]).alias("probs"), F.array(*[f"q{i}" for i in range(len(levels))]).alias("quants"))
    return d.join(q, ["path", "fold"], "left").drop("_closed", "fold")


def monthly_windows(cutoffs: Sequence[int], spans: Mapping[str, int | None]) -> list[tuple[str, int, int, int]]:
    """(label, cutoff, start, end) of the refit at each cutoff over each span of history (None: all of it)."""
    return [(label, int(c), BEGIN if span is None else int(c) - int(span), int(c)) for label, span in spans.items() for c in cutoffs]


def prequential(frame: DataFrame, columns: Sequence[str], y: str, origin: str, available: str, cutoffs: Sequence[int], end: int, spans: Mapping[str, int | None],
                alpha: float, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Rows with an origin in [first cutoff, end) and a known label, per span: ridge and median of the rows published before the
    latest cutoff, not earlier than the span. Adds span, cutoff, train_rows, prediction, median (null without training rows)."""
    cutoffs = sorted(int(c) for c in cutoffs)
    named = monthly_windows(cutoffs, spans)
    windows = [(a, b) for *_, a, b in named]
    models = staged(fit_windows(frame, columns, y, available, windows, [alpha], block_bits=block_bits))
    edges = cells(windows)
    labelled = frame.withColumn("cell", cell_of(available, edges))
    medians = window_quantiles(labelled, [y], windows, edges, [0.5], ["label_median"], block_bits).select("window", F.col("label_median"))
    beside = per_key(models.select("window", F.col("n").alias("train_rows")).join(medians, "window", "full"))
    cuts = F.array(*[F.lit(c).cast("long") for c in cutoffs])
    d = frame.filter((F.col(origin) >= cutoffs[0]) & (F.col(origin) < int(end)) & F.col(y).isNotNull())
    place = F.size(F.filter(cuts, lambda c: c <= F.col(origin))) - 1
    each = F.array(*[F.struct(F.lit(label).alias("span"), (F.lit(k * len(cutoffs)) + place).cast("long").alias("window")) for k, label in enumerate(spans)])
    d = d.withColumn("cutoff", F.element_at(cuts, place + 1)).select("*", F.inline(each))
    d = with_models(d, models, "window", columns).join(beside, "window", "left")
    return d.withColumn("prediction", F.get("_models", F.lit(0))["prediction"]).withColumnRenamed("label_median", "median").drop("_models", "_x", "window")


def family_ablation(frame: DataFrame, families: Mapping[str, Sequence[str]], y: str, origin: str, available: str, start: int, end: int, alpha: float, core: Sequence[str],
                    previous: str, least_core: float = 0.8) -> DataFrame:
    """Per family: errors of the ridge trained on labels out before ``start``, on rows with an origin in [start, end) whose label was out before
    ``end``: on all of them, and on the common mask (enough core features and the previous value known), beside the previous value's error.

    One matrix over all columns serves every family; a family is a sub-block of it.
    """
    columns = list(dict.fromkeys(x for own in families.values() for x in own))
    models = staged(fit_windows(frame, columns, y, available, [(BEGIN, int(start))], [alpha], families))
    d = frame.filter((F.col(origin) >= int(start)) & (F.col(available) < int(end)) & F.col(y).isNotNull()).withColumn("window", F.lit(0).cast("long"))
    share = reduce(lambda a, b: a + b, [C.finite(F.col(x).cast("double")).isNotNull().cast("int") for x in core]) / F.lit(float(len(core)))
    d = d.withColumn("_common", (share >= least_core) & F.col(previous).isNotNull())
    e = with_models(d, models, "window", columns).select(F.col(y).alias("_y"), F.col(previous).alias("_p"), "_common", F.inline("_models"))
    error, naive = F.abs(F.col("_y") - F.col("prediction")), F.abs(F.col("_y") - F.col("_p"))
    out = e.groupBy("family").agg(F.count("*").alias("n"), F.avg(error).alias("mae"), F.count_if("_common").alias("common_n"), F.avg(F.when(F.col("_common"), error)).alias("common_mae"),
                                  F.avg(F.when(F.col("_common"), naive)).alias("previous_mae"))
    sizes = F.create_map(*[F.lit(v) for k, own in families.items() for v in (k, len(own))])
    return out.withColumn("features", sizes[F.col("family")])


def select_filter(frame: DataFrame, columns: Sequence[str], y: str, base: str, origin: str, available: str, quiet: str, folds: Sequence[tuple[int, int]], cutoff: int,
                  alphas: Sequence[float] = ALPHAS, least_quiet: float = 0.10, tolerance: float = 1.05, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Training filter ("all" rows or only "quiet" ones) and alpha for a cutoff, from folds that end at or before it.

    Each (filter, alpha) is fitted before each fold's start and scored on the fold's rows (their label window wholly inside), all and quiet
    ones, by the error of exp(base + value). One row per (filter, alpha): mean_mae_all, mean_mae_quiet (means over folds), quiet_fraction
    of the rows before the cutoff, best (of its filter: least mae_all for "all", least mae_quiet for "quiet") and chosen. The best
    quiet model is chosen if quiet rows are frequent enough, it is no worse than the best other on quiet rows and at most `tolerance`
    times as bad on all rows; else the best "all" model is. Ties go to the smaller alpha. No rows if no fold can be scored.
    """
    if any(b > cutoff for _, b in folds):
        raise ValueError("a fold ends after the cutoff")
    d = frame.filter(C.finite(F.col(y).cast("double")).isNotNull() & C.finite(F.col(base).cast("double")).isNotNull())
    windows = [(BEGIN, int(a)) for a, _ in folds]
    by = {"all": d, "quiet": d.filter(quiet)}
    models = reduce(DataFrame.union, [fit_windows(rows, columns, y, available, windows, alphas, {name: columns}, block_bits=block_bits) for name, rows in by.items()])
    fold = F.array_max(F.filter(F.array(*[F.struct(F.lit(int(a)).cast("long").alias("a"), F.lit(int(b)).cast("long").alias("b"), F.lit(k).cast("long").alias("k")) for k, (a, b) in enumerate(folds)]),
                                lambda f: (F.col(origin) >= f["a"]) & (F.col(origin) < f["b"]) & (F.col(available) < f["b"])))["k"]
    rows = with_models(d.withColumn("fold", fold).filter("fold IS NOT NULL"), staged(models), "fold", columns)
    e = rows.select("fold", F.col(quiet).alias("_quiet"), F.col(base).alias("_b"), F.col(y).alias("_y"), F.inline("_models"))
    error = F.abs(F.exp(F.col("_b") + F.col("_y")) - F.exp(F.col("_b") + F.col("prediction")))
    per = e.groupBy("fold", "family", "alpha").agg(F.avg(error).alias("all"), F.avg(F.when(F.col("_quiet"), error)).alias("quiet"))
    scores = per.groupBy(F.col("family").alias("training_filter"), "alpha").agg(F.avg("all").alias("mean_mae_all"), F.avg("quiet").alias("mean_mae_quiet"))
    before = d.filter(F.col(available) < int(cutoff)).agg(F.coalesce(F.avg(F.col(quiet).cast("double")), F.lit(0.0)).alias("quiet_fraction"))
    # 2 x alphas rows from here on
    own = F.when(F.col("training_filter") == "all", F.col("mean_mae_all")).otherwise(F.col("mean_mae_quiet"))
    scores = scores.join(F.broadcast(before)).withColumn("_own", own)
    per_filter = scores.filter("_own IS NOT NULL").groupBy("training_filter").agg(F.min(F.struct("_own", "alpha", "mean_mae_all", "mean_mae_quiet", "quiet_fraction")).alias("b"))
    a, q = (F.max(F.when(F.col("training_filter") == name, F.col("b"))) for name in ("all", "quiet"))
    both = per_filter.agg(a.alias("a"), q.alias("q"))
    rule = (F.col("q.quiet_fraction") >= least_quiet) & (F.col("q.mean_mae_quiet") <= F.col("a.mean_mae_quiet")) & (F.col("q.mean_mae_all") <= tolerance * F.col("a.mean_mae_all"))
    both = both.select(F.col("a.alpha").alias("_a"), F.col("q.alpha").alias("_q"), F.when(F.coalesce(rule, F.lit(False)), "quiet").otherwise("all").alias("_pick"))
    out = scores.join(F.broadcast(both))
    best = F.coalesce(F.col("alpha") == F.when(F.col("training_filter") == "all", F.col("_a")).otherwise(F.col("_q")), F.lit(False))
    return out.withColumn("best", best).withColumn("chosen", F.col("best") & (F.col("training_filter") == F.col("_pick"))).drop("_own", "_a", "_q", "_pick")


def challenge(frame: DataFrame, families: Mapping[str, Sequence[str]], alphas: Sequence[float], incumbents: Sequence[tuple[str, float]], y: str, origin: str, available: str,
              periods: Sequence[tuple[int, int]], max_missing: float = 0.34, max_outside: float = 0.20, max_far: float = 8.0, gain: float = 0.98, rmse_room: float = 1.05,
              per_range: int = PER_RANGE) -> DataFrame:
    """A frozen choice carried through three disjoint periods; y is a log value, errors are of its exp.

    Candidates are (family, alpha). Each period is predicted by models of the labels out before its start, on rows whose label was out before
    its end. The first period selects: the winner has the least error on accepted rows, the incumbent the least log error among
    `incumbents`. The second confirms: the winner is promoted if its error is at most `gain` and its root mean square
    at most `rmse_room` times the incumbent's there; residual quantiles are taken there, too. The third is only reported.
    One row per (period, candidate): n, accepted, mae, rmse, log_mae, winner, incumbent, selected, and for the
    selected one in the third period coverage_80 of its interval.
    """
    from .quantiles import quantiles

    (a0, b0), (a1, b1), (a2, b2) = [(int(a), int(b)) for a, b in periods]
    if not a0 < b0 <= a1 < b1 <= a2 < b2:
        raise ValueError("periods overlap or are out of order")
    columns = list(dict.fromkeys(x for own in families.values() for x in own))
    models = staged(fit_windows(frame, columns, y, available, [(BEGIN, a) for a, _ in periods], alphas, families))
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(k).cast("long").alias("k")) for k, (a, b) in enumerate(periods)])
    inside = F.filter(spans, lambda s: (F.col(origin) >= s["a"]) & (F.col(origin) < s["b"]) & (F.col(available) < s["b"]))
    d = frame.filter(C.finite(F.col(y).cast("double")).isNotNull()).withColumn("period", F.get(inside, F.lit(0))["k"]).filter("period IS NOT NULL")
    d = with_models(d, models, "period", columns)
    known = F.size(F.filter("_x", lambda v: v.isNotNull()))
    d = d.withColumn("_enough", known_share(columns) >= 1 - max_missing).withColumn("_known", F.greatest(F.lit(1), known))
    e = staged(d.select("period", F.col(y).alias("_y"), "_enough", "_known", F.inline("_models")))
    fine = F.col("_enough") & (F.col("outside") / F.col("_known") <= max_outside) & (F.col("far") <= max_far)
    error = F.when(fine, F.exp("_y") - F.exp("prediction"))
    stats = staged(e.groupBy("period", "family", "alpha").agg(
        F.count("*").alias("n"), F.count_if(fine).alias("accepted"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.when(fine, F.abs(F.col("_y") - F.col("prediction")))).alias("log_mae")))
    # 2 x candidates rows; the third period's are not read before the choice is made
    seen = {(r.period, r.family, r.alpha): r for r in stats.filter("period < 2 AND mae IS NOT NULL").collect()}
    first = [k for k in seen if k[0] == 0]
    if not first:
        raise ValueError("no candidate can be scored in the first period")
    order = {name: k for k, name in enumerate(families)}
    winner = min(first, key=lambda k: (seen[k].mae, order[k[1]], k[2]))[1:]
    held = [k for k in first if (k[1], k[2]) in {(f, float(a)) for f, a in incumbents}]
    incumbent = min(held, key=lambda k: (seen[k].log_mae, order[k[1]], k[2]))[1:] if held else winner
    w, b = seen.get((1, *winner)), seen.get((1, *incumbent))
    promoted = w is not None and b is not None and w.mae <= gain * b.mae and w.rmse <= rmse_room * b.rmse
    chosen = winner if promoted else incumbent
    is_one = lambda c: (F.col("family") == c[0]) & (F.col("alpha") == c[1])
    own = e.filter(is_one(chosen) & fine)
    q = quantiles(own.filter("period = 1").select("period", (F.col("_y") - F.col("prediction")).alias("r")), ["period"], "r", [0.1, 0.9], ["lo", "hi"], per_range).select("lo", "hi")
    gap = F.col("_y") - F.col("prediction")
    coverage = own.filter("period = 2").join(F.broadcast(q)).agg(F.avg(gap.between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage_80"))  # one row each
    out = stats.join(F.broadcast(coverage))
    return out.withColumn("coverage_80", F.when((F.col("period") == 2) & is_one(chosen), F.col("coverage_80"))).withColumn("winner", is_one(winner)).withColumn(
        "incumbent", is_one(incumbent)).withColumn("selected", is_one(chosen))


def anomaly_model(df: DataFrame, keys: Sequence[str], columns: Sequence[str], when: str, folds: Sequence[tuple[int, int]], end: int, least_fit: int = 200,
                  least_score: int = 50, per_range: int = PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """(models, evidence) of a robust distance whose thresholds come from rows that were not fitted.

    models, per key with at least least_fit complete rows before ``end``: location, precision and scale of the trimmed core of those rows,
    train_rows, attention and high (the 95 % and 99 % quantiles of the squared distance), basis. For each fold ending by
    ``end`` with enough rows, a model of the complete rows before its start scores the fold's rows; the thresholds are
    quantiles of all these distances together, or of the training rows' own where no fold serves. evidence holds (fold, rows, q95, q99).
    """
    from .fit import mahalanobis, robust_model
    from .quantiles import quantiles

    keys, columns = list(keys), list(columns)
    complete = staged(df.select(*keys, F.col(when).alias("_t"), *[C.finite(F.col(x).cast("double")).alias(x) for x in columns]).dropna(subset=columns).filter(F.col("_t") < int(end)))
    spans = [(k, int(a), int(b)) for k, (a, b) in enumerate(folds) if b <= end]
    whole = len(folds)  # the number of the model of all rows
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a")) for k, a, _ in [*spans, (whole, int(end), None)]])
    fit = complete.withColumn("fold", F.explode(F.transform(F.filter(table, lambda s: F.col("_t") < s["a"]), lambda s: s["k"])))
    sizes = fit.groupBy(*keys, "fold").agg(F.count("*").alias("train_rows")).filter(F.col("train_rows") >= least_fit)
    models = per_key(robust_model(fit, [*keys, "fold"], columns).drop("rows").join(sizes, [*keys, "fold"]))
    held = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, a, b in spans or [(-1, 0, 0)]])
    scored = complete.withColumn("fold", F.explode(F.transform(F.filter(held, lambda s: (F.col("_t") >= s["a"]) & (F.col("_t") < s["b"])), lambda s: s["k"])))
    d2 = mahalanobis(columns)[0]
    out = staged(scored.join(models, [*keys, "fold"]).select(*keys, "fold", d2.alias("d2")))
    served = per_key(out.groupBy(*keys, "fold").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_score))
    out = out.join(served.drop("rows"), [*keys, "fold"])
    evidence = served.join(quantiles(out, [*keys, "fold"], "d2", [0.95, 0.99], ["q95", "q99"], per_range), [*keys, "fold"])
    final = models.filter(F.col("fold") == whole).drop("fold")
    own = complete.join(final, keys).select(*keys, d2.alias("d2"))
    levels = quantiles(out, keys, "d2", [0.95, 0.99], ["attention", "high"], per_range)
    inside = quantiles(own, keys, "d2", [0.95, 0.99], ["_attention", "_high"], per_range)
    final = final.join(levels, keys, "left").join(inside, keys)
    basis = F.when(F.col("high").isNull(), "in_sample").otherwise("out_of_sample")
    final = final.withColumn("basis", basis).withColumn("attention", F.coalesce("attention", "_attention")).withColumn("high", F.coalesce("high", "_high")).drop("_attention", "_high")
    return per_key(final), staged(evidence)


def anomaly_class(df: DataFrame, models: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with d2, part_x (each column's share of it) and anomaly: normal, attention or high; null where a column is unknown."""
    from .fit import mahalanobis

    d = df.join(models.select(*keys, "location", "precision", "attention", "high"), list(keys), "left")
    total, parts = mahalanobis([f"_c_{x}" for x in columns])
    d = d.withColumns({f"_c_{x}": C.finite(F.col(x).cast("double")) for x in columns}).withColumn("d2", total)
    d = d.withColumns({f"part_{x}": p for x, p in zip(columns, parts)})
    kind = F.when(F.col("d2") > F.col("high"), "high").when(F.col("d2") > F.col("attention"), "attention").when(F.col("d2").isNotNull(), "normal")
    return d.withColumn("anomaly", kind).drop("location", "precision", "attention", "high", *[f"_c_{x}" for x in columns])
