"""Fitting by distributed sufficient statistics.

The data is scanned by Spark and reduced to moments (medians, means, a Gram matrix per model key); only those
few hundred numbers are solved with numpy, inside a task.  One plan fits every horizon, fold and cutoff.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .quantiles import PER_RANGE, bracketed_quantile, narrowed_quantile, quantiles
from .stage import per_key, staged

ALPHAS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0, 3000.0, 10000.0, 100000.0)


def unfolded(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(x).alias("column"), C.finite(F.col(x).cast("double")).alias("value")) for x in columns])))


def support(df: DataFrame, keys: Sequence[str], columns: Sequence[str], low: float = 0.005, high: float = 0.995, margin: float = 0.10,
            per_range: int = PER_RANGE) -> DataFrame:
    """Per key and column: median, mean and population deviation after median fill, and widened support bounds."""
    long = unfolded(df, keys, columns)
    key = [*keys, "column"]
    m = long.groupBy(*key).agg(F.count("*").alias("_n"), F.count("value").alias("_k"), F.avg("value").alias("_mu"), F.var_pop("value").alias("_var"))
    q = quantiles(long, key, "value", [low, 0.5, high], ["lo", "median", "hi"], per_range)
    s = m.join(q, key, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    n, k, mu, med = F.col("_n"), F.col("_k"), F.coalesce("_mu", F.lit(0.0)), F.col("median")
    mean = (k * mu + (n - k) * med) / n
    s = s.withColumn("mean", mean)
    spread = (k * (F.coalesce("_var", F.lit(0.0)) + (mu - F.col("mean")) * (mu - F.col("mean"))) + (n - k) * (med - F.col("mean")) * (med - F.col("mean"))) / n
    s = s.withColumn("scale", F.when(spread > 0, F.sqrt(spread)).otherwise(1.0))
    room = margin * F.greatest(F.col("hi") - F.col("lo"), F.col("scale"))
    return s.select(*key, F.col("_n").alias("n"), "median", "mean", "scale", F.coalesce(F.col("lo") - room, F.lit(0.0)).alias("lower"), F.coalesce(F.col("hi") + room, F.lit(0.0)).alias("upper"))


def support_wide(s: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key: ``median_x, mean_x, scale_x, lower_x, upper_x`` for every column."""
    return s.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == x, F.col(f))).alias(f"{f}_{x}") for x in columns for f in ("median", "mean", "scale", "lower", "upper")])


def standardized(df: DataFrame, wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``z_x`` with the key's own medians, means and deviations."""
    d = df.join(wide, list(keys))
    return d.select(*df.columns, *[((F.coalesce(C.finite(F.col(x).cast("double")), F.col(f"median_{x}")) - F.col(f"mean_{x}")) / F.col(f"scale_{x}")).alias(f"z_{x}") for x in columns])


def gram(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, weight: Column | None = None) -> DataFrame:
    """Upper triangle of X'WX (with a leading ones column), X'Wy, y'Wy and the row count, in one aggregation."""
    w = F.lit(1.0) if weight is None else weight
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    tri = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(w * cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i, j in tri],
        *[F.sum(w * cols[i] * F.col(y)).alias(f"xy_{i}") for i in range(len(cols))], F.sum(w * F.col(y) * F.col(y)).alias("yy"))
    return g.select(*keys, "n", F.array(*[f"xx_{i}_{j}" for i, j in tri]).alias("xx"), F.array(*[f"xy_{i}" for i in range(len(cols))]).alias("xy"), "yy")


def ridge(grams: DataFrame, keys: Sequence[str], p: int, alphas: Sequence[float]) -> DataFrame:
    """Coefficients (intercept first, not penalised) per key and alpha: solve (X'X + alpha I) b = X'y."""
    schema = T.StructType([grams.schema[k] for k in keys] + [T.StructField("alpha", T.DoubleType()), T.StructField("coef", T.ArrayType(T.DoubleType()))])
    size, levels = p + 1, [float(a) for a in alphas]

    def solve(batches):
        upper = np.triu_indices(size)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                full = np.zeros((size, size))
                full[upper] = np.asarray(r.xx, dtype=float)
                full = full + np.triu(full, 1).T
                for a in levels:
                    penalty = np.eye(size) * a
                    penalty[0, 0] = 0.0
                    b = np.linalg.solve(full + penalty, np.asarray(r.xy, dtype=float))
                    rows.append([getattr(r, k) for k in keys] + [a, b.tolist()])
            yield pd.DataFrame(rows, columns=[*keys, "alpha", "coef"])

    return grams.select(*keys, "xx", "xy").mapInPandas(solve, schema)


def linear(zs: Sequence[str], coef: str = "coef") -> Column:
    out = F.col(coef)[0]
    for i, z in enumerate(zs):
        out = out + F.col(coef)[i + 1] * F.col(z)
    return out


def fit_ridge(train: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str, alphas: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """(wide support, coefficients) for every key of the training rows."""
    wide = per_key(support_wide(support(train, keys, columns), keys, columns))
    z = [f"z_{x}" for x in columns]
    return wide, per_key(ridge(gram(standardized(train, wide, keys, columns), keys, z, y), keys, len(columns), alphas))


def predict(df: DataFrame, wide: DataFrame, coefs: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str = "prediction") -> DataFrame:
    """Rows x alphas with the linear prediction."""
    d = standardized(df, wide, keys, columns).join(coefs, list(keys))
    return d.withColumn(out, linear([f"z_{x}" for x in columns])).drop("coef", *[f"z_{x}" for x in columns])


def select_alpha(scored: DataFrame, keys: Sequence[str], fold: str, error: Column) -> DataFrame:
    """Alpha with the least mean of per-fold mean errors (ties: smaller alpha). ``scored`` holds rows x alphas."""
    per = scored.groupBy(*keys, fold, "alpha").agg(F.avg(error).alias("e"))
    mean = per.groupBy(*keys, "alpha").agg(F.avg("e").alias("e"))
    return mean.groupBy(*keys).agg(F.min(F.struct("e", "alpha")).alias("b")).select(*keys, F.col("b.alpha").alias("alpha"), F.col("b.e").alias("fold_error"))


def huber_ridge(train: DataFrame, keys: Sequence[str], columns: Sequence[str], y: str, alpha: float, delta: float = 0.2, iterations: int = 30,
                tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """Ridge with Huber weights by reweighted passes over the cached standardised rows; a pass returns p + 1 numbers per key."""
    spark = train.sparkSession
    wide, coefs = fit_ridge(train, keys, columns, y, [alpha])
    zs = [f"z_{x}" for x in columns]
    rows = standardized(train, wide, keys, columns).select(*keys, F.col(y).alias("_y"), *zs).persist()
    schema = coefs.schema
    try:
        now = {tuple(r[k] for k in keys): list(r["coef"]) for r in coefs.collect()}
        for _ in range(iterations):
            # as many rows as the driver holds already; unhinted, every pass would shuffle the rows by key
            table = spark.createDataFrame([(*k, float(alpha), v) for k, v in now.items()], schema)
            d = rows.join(F.broadcast(table), list(keys)).withColumn("_r", F.abs(F.col("_y") - linear(zs)))
            weight = F.when(F.col("_r") <= delta, 1.0).otherwise(delta / F.greatest(F.col("_r"), F.lit(1e-12)))
            new = {tuple(r[k] for k in keys): list(r["coef"]) for r in ridge(gram(d, keys, zs, "_y", weight), keys, len(columns), [alpha]).collect()}
            moved = max(abs(a - b) for k in new for a, b in zip(new[k], now[k]))
            now = new
            if moved < tolerance:
                break
    finally:
        rows.unpersist()
    return wide, spark.createDataFrame([(*k, float(alpha), v) for k, v in now.items()], schema)


# --- convex combination ------------------------------------------------------------------

GRID_CELLS = 200_000  # keys x weight vectors whose numbers the driver holds
BLOCK_ROWS, BLOCK_WEIGHTS = 2_048, 32  # residuals worked on at a time
RUN = 256  # sorted residuals of a block that hand on their middle one
SHARES = (0.04, 0.008, 0.0015)  # of the rows, aimed at between the median and its cuts


def simplex(k: int, step: float) -> list[tuple[float, ...]]:
    n = round(1 / step)
    return [(*[c / n for c in combo], (n - sum(combo)) / n) for combo in itertools.product(range(n + 1), repeat=k - 1) if sum(combo) <= n]


def convex_value(inputs: Sequence[str], weights: Sequence[Column]) -> Column:
    """Weighted mean over known inputs; equal weights when every weighted input is missing."""
    zero = F.lit(0.0)
    known = [C.finite(x).isNotNull() for x in inputs]
    mass = sum((F.when(k, w).otherwise(zero) for k, w in zip(known, weights)), zero)
    total = sum((F.when(k, F.col(x) * w).otherwise(zero) for k, x, w in zip(known, inputs, weights)), zero)
    count = sum((k.cast("int") for k in known), F.lit(0))
    plain = sum((F.when(k, F.col(x)).otherwise(zero) for k, x in zip(known, inputs)), zero)
    return F.when(mass > 0, total / mass).when(count > 0, plain / count)


def fit_convex(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], y: str, step: float = 0.05, per_range: int = PER_RANGE, most: int = GRID_CELLS) -> DataFrame:
    """Weights on the simplex grid with the least mean absolute error after removing the median residual.

    Every row meets every weight vector in each of four passes; a row goes to Python once a pass, its residuals stay there, and only counts,
    sums and the residuals close to a median come back. Rows with a NULL key are left out.
    """
    keys, grid = list(keys), simplex(len(inputs), step)
    xs = [f"_x{i}" for i in range(len(inputs))]
    d = df.select(*keys, F.col(y).cast("double").alias("_y"), *[C.finite(F.col(c).cast("double")).alias(x) for c, x in zip(inputs, xs)])
    d = d.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, "_y"]]) & F.coalesce(*xs).isNotNull())
    groups = staged(d.groupBy(*keys).agg(F.count("*").alias("_rows")))
    many = groups.limit(most // len(grid) + 1).count() * len(grid) > most
    score = exploded_scores(d, keys, xs, grid, per_range) if many else grid_scores(d, groups, keys, xs, grid, per_range)
    # Scores equal to within rounding count as ties and go to the earlier weight vector.
    best = score.groupBy(*keys).agg(F.min(F.struct(F.round("mae", 12).alias("m"), "w", "bias", "mae")).alias("b"))
    weights = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in ws]) for ws in grid]), F.col("b.w") + 1)
    return best.select(*keys, weights.alias("weights"), F.col("b.bias").alias("bias"), F.col("b.mae").alias("fit_mae"))


def exploded_scores(d: DataFrame, keys: Sequence[str], xs: Sequence[str], grid: Sequence[Sequence[float]], per_range: int) -> DataFrame:
    """(keys, w, mae, bias) for any number of keys: residuals for all grid weights come out of one expression per row."""
    # Filled inputs and marks once a row: a weight then costs a few products, and the whole grid compiles.
    marks = [f"_k{i}" for i in range(len(xs))]
    d = d.select(*keys, "_y", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in xs], *[F.col(x).isNotNull().cast("double").alias(m) for x, m in zip(xs, marks)])
    added = lambda parts: sum(parts, F.lit(0.0))
    d = d.withColumn("_plain", added(F.col(x) for x in xs) / added(F.col(m) for m in marks))
    cells = F.array(*[F.col("_y") - F.when(mass > 0, added(F.col(x) * float(w) for x, w in zip(xs, ws)) / mass).otherwise(F.col("_plain"))
                      for ws in grid for mass in [added(F.col(m) * float(w) for m, w in zip(marks, ws))]])
    long = d.select(*keys, F.posexplode(cells).alias("w", "r"))
    bias = per_key(narrowed_quantile(long, [*keys, "w"], "r", 0.5, "bias", per_range))
    return long.join(bias, [*keys, "w"]).groupBy(*keys, "w").agg(F.avg(F.abs(F.col("r") - F.col("bias"))).alias("mae"), F.first("bias").alias("bias"))


def residual_blocks(pdf: pd.DataFrame, xs: Sequence[str], grid: np.ndarray):
    """(group, first weight vector, residuals by weight vector and row) in blocks that stay in a core's cache; the next block overwrites the last.

    The rows of a block know the same inputs, so a weight vector has one mass there.
    """
    ids, y = pdf["_id"].to_numpy(), pdf["_y"].to_numpy(dtype=float)
    x = np.stack([pdf[c].to_numpy(dtype=float) for c in xs])
    kind = (~np.isnan(x)).T @ (1 << np.arange(len(xs)))
    order = np.lexsort((kind, ids))
    ids, kind, x, y = ids[order], kind[order], x[:, order], y[order]
    cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(ids)]
    one, two = np.empty((2, BLOCK_WEIGHTS * BLOCK_ROWS))
    for w in range(0, len(grid), BLOCK_WEIGHTS):
        for start, end in zip(cuts, cuts[1:]):
            known = [i for i in range(len(xs)) if start < end and kind[start] >> i & 1]
            ws = grid[w:w + BLOCK_WEIGHTS, known]
            mass = sum(ws.T)
            for lo in range(start, end, BLOCK_ROWS):
                part = slice(lo, min(end, lo + BLOCK_ROWS))
                total, more = (b[:len(ws) * (part.stop - lo)].reshape(len(ws), -1) for b in (one, two))
                np.multiply(ws[:, :1], x[known[0], part], out=total)
                for i in range(1, len(known)):
                    total += np.multiply(ws[:, i, None], x[known[i], part], out=more)
                np.divide(total, np.where(mass > 0, mass, 1.0)[:, None], out=total)
                np.subtract(y[part], total, out=total)
                if (mass <= 0).any():
                    total[mass <= 0] = y[part] - sum(x[i, part] for i in known) / len(known)
                yield int(ids[start]), w, total


def up_to(r: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where the residuals of each weight vector are at most its cut; NaN is the largest value, as in Spark."""
    return (r <= cut[:, None]) | np.isnan(cut)[:, None]


def grid_scores(d: DataFrame, groups: DataFrame, keys: Sequence[str], xs: Sequence[str], grid: Sequence[Sequence[float]], per_range: int) -> DataFrame:
    """(keys, w, mae, bias). The driver holds a few numbers per key and weight vector: cuts around the median, counts, medians.

    Cuts come from the middles of short runs of each batch's sorted residuals. All rows are then counted against the cuts, and the closest pair
    that holds the median's ranks is taken; where none does, that side is left open. So the cuts never change a result.
    """
    table = np.asarray(grid, dtype=float)
    named = staged(groups.coalesce(1).withColumn("_id", F.monotonically_increasing_id()))
    sizes = np.array([r["_rows"] for r in named.select("_id", "_rows").orderBy("_id").collect()], dtype="int64")
    rows = d.join(F.broadcast(named.select(*keys, "_id")), list(keys)).select("_id", "_y", *xs)
    shape = (len(sizes), len(table))

    def middles(batches):
        for pdf in batches:
            out = []
            for (k, w), parts in itertools.groupby(residual_blocks(pdf, xs, table), key=lambda b: b[:2]):
                r = np.concatenate([b[2].copy() for b in parts], axis=1)
                r.sort(axis=1)
                runs = max(1, round(r.shape[1] / RUN))
                m = r[:, (2 * np.arange(runs) + 1) * r.shape[1] // (2 * runs)]
                out.append(pd.DataFrame({"_id": k, "w": np.repeat(np.arange(w, w + len(m)), m.shape[1]), "v": m.ravel()}))
            if out:
                yield pd.concat(out)

    probs = [*[0.5 - x for x in SHARES], *[0.5 + x for x in reversed(SHARES)]]
    found = rows.mapInPandas(middles, "_id long, w int, v double").groupBy("_id", "w").agg(F.percentile_approx("v", probs, 5_000).alias("e")).collect()
    cuts = np.empty((*shape, len(probs)))
    for r in found:
        cuts[r["_id"], r["w"]] = r["e"]

    def counted(batches):
        held = {}
        for pdf in batches:
            for k, w, r in residual_blocks(pdf, xs, table):
                n = held.setdefault(k, np.zeros((len(probs), len(table)), dtype="int64"))
                for i in range(len(probs)):
                    n[i, w:w + len(r)] += np.count_nonzero(up_to(r, cuts[k, w:w + len(r), i]), axis=1)
        for k, n in held.items():
            yield pd.DataFrame({"_id": k, "w": np.arange(len(table)), **{f"n{i}": n[i] for i in range(len(probs))}})

    ns = [f"n{i}" for i in range(len(probs))]
    upto = np.empty((*shape, len(probs)), dtype="int64")
    for r in rows.mapInPandas(counted, f"_id long, w int, {', '.join(f'{n} long' for n in ns)}").groupBy("_id", "w").agg(*[F.sum(n).alias(n) for n in ns]).collect():
        upto[r["_id"], r["w"]] = [r[n] for n in ns]

    last = (sizes - 1)[:, None]
    low, high = np.full(shape, np.nan), np.full(shape, np.nan)  # NaN: that side is open
    skip = np.zeros(shape, dtype="int64")
    for i in range(len(probs)):
        fits = (upto[:, :, i] <= last // 2) & (upto[:, :, i] >= skip)
        low, skip = np.where(fits, cuts[:, :, i], low), np.where(fits, upto[:, :, i], skip)
        j = len(probs) - 1 - i
        high = np.where(upto[:, :, j] > (last + 1) // 2, cuts[:, :, j], high)
    closed = skip > 0

    def inside(batches):
        for pdf in batches:
            out = []
            for k, w, r in residual_blocks(pdf, xs, table):
                at = slice(w, w + len(r))
                keep = up_to(r, high[k, at]) & ~(up_to(r, low[k, at]) & closed[k, at][:, None])
                n = np.count_nonzero(keep, axis=1)
                v, c, i = r[keep], np.ones(n.sum(), dtype="int64"), np.repeat(np.arange(len(r)), n)
                if len(v) > r.size // 20:  # many rows may share few values
                    some = np.flatnonzero(n)
                    u = [np.unique(r[j][keep[j]], return_counts=True) for j in some]
                    v, c, i = np.concatenate([a for a, _ in u]), np.concatenate([b for _, b in u]), np.repeat(some, [len(a) for a, _ in u])
                out.append(pd.DataFrame({"_id": k, "w": w + i, "_rows": sizes[k], "_skip": skip[k, w + i], "_v": v, "_c": c}))
            if out:
                yield pd.concat(out)

    own = ["_id", "w", "_rows", "_skip"]
    near = staged(rows.mapInPandas(inside, "_id long, w int, _rows long, _skip long, _v double, _c long").groupBy(*own, "_v").agg(F.sum("_c").alias("_c")))
    bias = staged(bracketed_quantile(near, ["_id", "w"], 0.5, "bias", per_range))
    mid = np.empty(shape)
    for r in bias.collect():
        mid[r["_id"], r["w"]] = r["bias"]

    def distances(batches):
        held = {}
        for pdf in batches:
            for k, w, r in residual_blocks(pdf, xs, table):
                s = held.setdefault(k, np.zeros(len(table)))
                s[w:w + len(r)] += np.abs(r - mid[k, w:w + len(r)][:, None]).sum(axis=1)
        for k, s in held.items():
            yield pd.DataFrame({"_id": k, "w": np.arange(len(table)), "s": s})

    sums = rows.mapInPandas(distances, "_id long, w int, s double").groupBy("_id", "w").agg(F.sum("s").alias("s"))
    return sums.join(bias, ["_id", "w"]).join(F.broadcast(named), "_id").select(*keys, "w", (F.col("s") / F.col("_rows")).alias("mae"), "bias")


# --- robust anomaly distance ----------------------------------------------------------------


def robust_core(df: DataFrame, keys: Sequence[str], columns: Sequence[str], cut: float = 3.0, per_range: int = PER_RANGE) -> DataFrame:
    """Rows whose every feature lies within ``cut`` scaled MADs of the median."""
    complete = df.dropna(subset=list(columns))
    long = unfolded(complete, keys, columns)
    key = [*keys, "column"]
    med = per_key(quantiles(long, key, "value", [0.5], ["med"], per_range))
    mad = quantiles(long.join(med, key).withColumn("dev", F.abs(F.col("value") - F.col("med"))), key, "dev", [0.5], ["mad"], per_range)
    s = med.join(mad, key).withColumn("mad", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).otherwise(1.0))
    wide = per_key(s.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == x, F.col(f))).alias(f"{f}_{x}") for x in columns for f in ("med", "mad")]))
    d = complete.join(wide, list(keys))
    near = F.lit(True)
    for x in columns:
        near = near & (F.abs(F.col(x) - F.col(f"med_{x}")) / F.col(f"mad_{x}") < cut)
    return d.filter(near).select(*df.columns)


def robust_model(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Location and precision (flattened) of the trimmed core per key."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    core = robust_core(df, keys, columns)
    g = core.groupBy(*keys).agg(F.count("*").alias("rows"), F.array(*[F.avg(x) for x in columns]).alias("location"),
                                F.array(*[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).alias("cov"))
    schema = T.StructType([*g.schema.fields[:-1], T.StructField("precision", T.ArrayType(T.DoubleType())), T.StructField("scale", T.ArrayType(T.DoubleType()))])

    def invert(batches):
        upper = np.triu_indices(p)
        for pdf in batches:
            prec, scale = [], []
            for cov in pdf["cov"]:
                full = np.zeros((p, p))
                full[upper] = np.asarray(cov, dtype=float)
                full = full + np.triu(full, 1).T
                full = full + np.eye(p) * 1e-9 * np.trace(full) / p
                prec.append(np.linalg.inv(full).ravel().tolist())
                scale.append(np.sqrt(np.diag(full)).tolist())
            yield pdf.drop(columns="cov").assign(precision=prec, scale=scale)

    return g.mapInPandas(invert, schema)


def mahalanobis(columns: Sequence[str], location: str = "location", precision: str = "precision") -> tuple[Column, list[Column]]:
    """Squared distance and the additive contribution of every feature."""
    p = len(columns)
    d = [F.col(x) - F.col(location)[i] for i, x in enumerate(columns)]
    parts = []
    for i in range(p):
        inner = F.lit(0.0)
        for j in range(p):
            inner = inner + F.col(precision)[i * p + j] * d[j]
        parts.append(d[i] * inner)
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return total, parts


# --- nested walk-forward -----------------------------------------------------------------------


def walk_forward(frame: DataFrame, columns: Sequence[str], y: str, origin: str, available: str, cutoffs: Sequence[int], end: int,
                 alphas: Sequence[float] = ALPHAS, preregistered: float = 30.0) -> DataFrame:
    """Predictions for every origin by the model of the latest cutoff before it.

    The model of a cutoff is fitted on labels published before it, and its alpha is the one with the least error on
    the *earlier* periods only (the preregistered one for the first cutoff).  All cutoffs are keys of one plan.
    """
    spark = frame.sparkSession
    edges = [*cutoffs, end]
    cuts = F.array(*[F.lit(x).cast("long") for x in cutoffs])
    train = frame.withColumn("cutoff", F.explode(F.filter(cuts, lambda c: F.col(available) < c)))
    wide, coefs = fit_ridge(train.filter(F.col(y).isNotNull()), ["cutoff"], columns, y, alphas)
    period = F.array_max(F.filter(cuts, lambda c: c <= F.col(origin)))
    score = frame.withColumn("cutoff", period).filter(F.col("cutoff").isNotNull() & (F.col(origin) < end))
    p = predict(score, wide, coefs, ["cutoff"], columns)
    follow = F.create_map(*[F.lit(x).cast("long") for i in range(len(cutoffs)) for x in (edges[i], edges[i + 1])])
    closed = p.filter((F.col(available) < follow[F.col("cutoff")]) & F.col(y).isNotNull())
    per = closed.groupBy("cutoff", "alpha").agg(F.avg(F.abs(F.col(y) - F.col("prediction"))).alias("e"))
    # Each period's error serves the cutoffs that come after the period has ended.
    later = per.withColumn("target_cutoff", F.explode(F.filter(cuts, lambda c: c >= follow[F.col("cutoff")])))
    mean = later.groupBy("target_cutoff", "alpha").agg(F.avg("e").alias("e"))
    chosen = mean.groupBy("target_cutoff").agg(F.min(F.struct("e", "alpha")).alias("b")).select(F.col("target_cutoff").alias("cutoff"), F.col("b.alpha").alias("_alpha"))
    out = p.join(chosen, "cutoff", "left").filter(F.col("alpha") == F.coalesce("_alpha", F.lit(float(preregistered))))
    return out.withColumn("basis", F.when(F.col("_alpha").isNull(), "preregistered").otherwise("earlier_folds")).drop("_alpha")


# --- challengers with the built-in library ----------------------------------------------------------


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def logistic(train: DataFrame, columns: Sequence[str], event: str, c: float):
    """Logistic model with inverse regularisation strength ``c`` on already standardised columns."""
    from pyspark.ml.classification import LogisticRegression
    rows = assembled(train, columns)
    n = max(1, rows.count())
    return LogisticRegression(featuresCol="features", labelCol=event, standardization=False, regParam=1.0 / (c * n), maxIter=200).fit(rows)


def logistic_probability(model, df: DataFrame, columns: Sequence[str], out: str = "probability") -> DataFrame:
    b, w = float(model.intercept), [float(x) for x in model.coefficients]
    s = F.lit(b)
    for wi, x in zip(w, columns):
        s = s + F.lit(wi) * F.col(x)
    return df.withColumn(out, 1 / (1 + F.exp(-s)))


def challengers(train: DataFrame, columns: Sequence[str], y: str, seed: int = 42) -> dict:
    """Fitted challenger models by name: Huber linear, random forest, boosted trees."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    rows = assembled(train, columns).persist()
    try:
        return {
            "huber": LinearRegression(featuresCol="features", labelCol=y, loss="huber", maxIter=50, regParam=0.1).fit(rows),
            "forest": RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=10, maxDepth=4, seed=seed).fit(rows),
            "boost": GBTRegressor(featuresCol="features", labelCol=y, maxIter=10, maxDepth=3, seed=seed).fit(rows)}
    finally:
        rows.unpersist()


def score_challengers(models: Mapping, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    d = assembled(df, columns)
    for name, m in models.items():
        d = m.transform(d).withColumnRenamed("prediction", name)
    return d.drop("features")
