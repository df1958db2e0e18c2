"""Logistic exceedance risk by keyed Newton steps, and the rule that lets it replace the residual risk.

A pass over the staged rows adds up gradient and curvature of every key and every penalty at once; the few hundred sums are
solved inside a task and written as the next pass's coefficients.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from . import evaluate as E
from . import risk as R
from .fit import standardized, support, support_wide
from .quantiles import PER_RANGE, quantiles
from .stage import staged
from .walkforward import BEGIN, fit_windows, known_share, with_models

PENALTIES = (0.01, 0.1, 1.0, 10.0)


def _sums(keys: Sequence[str], size: int):
    upper = np.triu_indices(size)

    def partial(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(list(keys), sort=False) if keys else [((), pdf)]
            for key, own in groups:
                x = np.column_stack([np.ones(len(own)), np.stack(own["z"].to_numpy())])
                b, y = np.stack(own["coefs"].iloc[0]), own["event"].to_numpy(dtype=float)
                for k in range(len(b)):
                    p = 1 / (1 + np.exp(-np.clip(x @ b[k], -500, 500)))
                    parts = np.concatenate([((x * (p * (1 - p))[:, None]).T @ x)[upper], x.T @ (p - y)])
                    name = (*(key if isinstance(key, tuple) else (key,)), k)
                    total[name] = total.get(name, 0.0) + parts
        for name, parts in total.items():
            yield pd.DataFrame({**dict(zip([*keys, "c"], name)), "pos": np.arange(len(parts)), "value": parts})

    return partial


def logistic_path(train: DataFrame, keys: Sequence[str], columns: Sequence[str], event: str, penalties: Sequence[float] = PENALTIES, iterations: int = 50, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(wide support, coefs) per key: coefs is an array over the penalties of intercept and slopes on standardised columns.

    Minimises half the squared slopes plus C times the log loss, for every C in `penalties`; the intercept is free. Columns are
    filled with the key's medians and scaled by its means and deviations.
    """
    keys, columns, size, levels = list(keys), list(columns), len(columns) + 1, [float(c) for c in penalties]
    wide = staged(support_wide(support(train, keys, columns), keys, columns))
    z = standardized(train, wide, keys, columns)
    rows = staged(z.select(*keys, F.col(event).cast("double").alias("event"), F.array(*[f"z_{x}" for x in columns]).alias("z")).filter("event IS NOT NULL"))
    fields = [train.schema[k] for k in keys]
    coef = T.ArrayType(T.ArrayType(T.DoubleType()))
    sums_schema = T.StructType([*fields, T.StructField("c", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("value", T.DoubleType())])
    next_schema = T.StructType([*fields, T.StructField("coefs", coef), T.StructField("moved", T.DoubleType())])
    zero = F.array(*[F.array(*[F.lit(0.0)] * size)] * len(levels))
    now = staged(rows.select(*keys).distinct().withColumn("coefs", zero).withColumn("moved", F.lit(1.0)))
    upper = np.triu_indices(size)

    def step(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                old, parts, new = np.stack(r.coefs), np.stack(r.sums), []
                for c, b, s in zip(levels, old, parts):
                    h = np.zeros((size, size))
                    h[upper] = s[:len(upper[0])]
                    h = h + np.triu(h, 1).T
                    free = np.array([0.0] + [1.0 / c] * (size - 1))
                    move = np.linalg.lstsq(h + np.diag(free + 1e-12), s[len(upper[0]):] + free * b, rcond=None)[0]
                    largest = np.abs(move).max()
                    new.append(b - move * min(1.0, 4.0 / max(largest, 1e-300)))  # a far start can't overshoot
                out.append((*[getattr(r, k) for k in keys], [b.tolist() for b in new], float(np.abs(np.stack(new) - old).max())))
            yield pd.DataFrame(out, columns=[*keys, "coefs", "moved"])

    for _ in range(iterations):
        sums = rows.join(now.drop("moved"), keys).mapInPandas(_sums(keys, size), sums_schema).groupBy(*keys, "c", "pos").agg(F.sum("value").alias("value"))
        per = sums.groupBy(*keys, "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("s"))
        per = per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "s"))), lambda s: s["s"]).alias("sums"))
        now = staged(now.drop("moved").join(per, keys).mapInPandas(step, next_schema))
        if (now.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            break
    return wide, now.drop("moved")


def logistic_values(df: DataFrame, wide: DataFrame, coefs: DataFrame, keys: Sequence[str], columns: Sequence[str], out: str = "probabilities") -> DataFrame:
    """df with the probabilities of every penalty, in order; rows of keys without a model are left out."""
    d = standardized(df, wide, keys, columns).join(coefs, list(keys))
    z = F.array(F.lit(1.0), *[f"z_{x}" for x in columns])
    score = F.transform("coefs", lambda b: F.aggregate(F.zip_with(b, z, lambda a, v: a * v), F.lit(0.0), lambda s, v: s + v))
    return d.withColumn(out, F.transform(score, lambda s: 1 / (1 + F.exp(-s)))).drop("coefs", *[f"z_{x}" for x in columns])


def risk_protocol(frame: DataFrame, columns: Sequence[str], y: str, limit: float, origin: str, available: str, periods: Sequence[tuple[int, int]], penalties: Sequence[float] = PENALTIES,
                  alpha: float = 100.0, gain: float = 0.98, max_missing: float = 0.34, max_outside: float = 0.20, max_far: float = 8.0, per_range: int = PER_RANGE) -> DataFrame:
    """Whether a logistic model of y > limit may replace the risk read off ridge residuals; two disjoint periods.

    Models of a period see labels out before its start; scores are of accepted rows (support of the period's ridge) whose label was out before
    its end. The first period ranks the penalties by Brier score. On the second the best one is promoted if its Brier score is at most
    `gain` times the smaller of the prevalence's and the residual risk's, and its AUC is no worse than the residual risk's; that one uses
    the first period's ridge residuals. One row per penalty: brier_selection, chosen, and the confirmation's figures.
    """
    (a0, b0), (a1, b1) = [(int(a), int(b)) for a, b in periods]
    if not a0 < b0 <= a1 < b1:
        raise ValueError("periods overlap or are out of order")
    columns = list(columns)
    d = frame.filter(C.finite(F.col(y).cast("double")).isNotNull()).withColumn("_event", (F.col(y) > limit).cast("double"))
    starts = F.array(F.lit(a0).cast("long"), F.lit(a1).cast("long"))
    train = d.select(*columns, available, "_event", F.posexplode(starts).alias("window", "_a")).filter(F.col(available) < F.col("_a")).withColumn("window", F.col("window").cast("long"))
    wide, coefs = logistic_path(train, ["window"], columns, "_event", penalties)
    prevalence = train.groupBy("window").agg(F.avg("_event").alias("_rate"))
    ridge = staged(fit_windows(frame, columns, y, available, [(BEGIN, a0), (BEGIN, a1)], [alpha]))
    inside = lambda a, b: (F.col(origin) >= a) & (F.col(origin) < b) & (F.col(available) < b)
    rows = d.withColumn("window", F.when(inside(a0, b0), 0).when(inside(a1, b1), 1).cast("long")).filter("window IS NOT NULL")
    rows = with_models(rows, ridge, "window", columns).withColumn("_r", F.get("_models", F.lit(0)))
    known = F.greatest(F.lit(1), F.size(F.filter("_x", lambda v: v.isNotNull())))
    rows = rows.filter((known_share(columns) >= 1 - max_missing) & (F.col("_r.outside") / known <= max_outside) & (F.col("_r.far") <= max_far))
    rows = rows.select("window", "_event", F.col(y).alias("_y"), F.col("_r.prediction").alias("_p"), *columns)
    rows = staged(logistic_values(rows, wide, coefs, ["window"], columns).join(prevalence, "window").drop(*columns))
    square = lambda p: (p - F.col("_event")) * (p - F.col("_event"))
    # one row per penalty
    first = rows.filter("window = 0").select("_event", F.posexplode("probabilities").alias("c", "p")).groupBy("c").agg(F.count("*").alias("n_selection"), F.avg(square(F.col("p"))).alias("brier_selection"))
    first = staged(first)
    best = first.agg(F.min(F.struct("brier_selection", "c"))["c"].alias("_best"))
    q = quantiles(rows.filter("window = 0").select("window", (F.col("_y") - F.col("_p")).alias("r")), ["window"], "r", [k / 100 for k in range(1, 100)], [f"q{k}" for k in range(1, 100)], per_range)
    q = q.select(F.array(*[F.lit(k / 100) for k in range(1, 100)]).alias("probs"), F.array(*[f"q{k}" for k in range(1, 100)]).alias("quants"))
    second = rows.filter("window = 1").join(F.broadcast(best)).join(F.broadcast(q))  # one row each
    second = staged(second.select("_event", F.get("probabilities", F.col("_best")).alias("p"), "_rate", R.exceedance_probability("_p", F.lit(float(limit))).alias("residual")))
    sums = second.agg(F.count("*").alias("n_confirmation"), F.avg(square(F.col("p"))).alias("brier"), F.avg(square(F.col("_rate"))).alias("prevalence_brier"), F.avg(square(F.col("residual"))).alias("residual_brier"))
    k = second.withColumn("_k", F.lit(0))
    aucs = [E.auc(E.score_table(k, ["_k"], F.col("_event") > 0, s), ["_k"]).select(F.col("auc").alias(name)) for s, name in (("p", "auc"), ("residual", "residual_auc"))]
    one = sums.join(F.broadcast(aucs[0]), how="left").join(F.broadcast(aucs[1]), how="left").join(F.broadcast(best))
    promoted = (F.col("brier") <= gain * F.least("prevalence_brier", "residual_brier")) & (F.col("auc") >= F.col("residual_auc"))
    one = one.withColumn("promoted", F.coalesce(promoted, F.lit(False)))
    out = first.join(F.broadcast(one)).withColumn("penalty", F.element_at(F.array(*[F.lit(float(c)) for c in penalties]), F.col("c") + 1))
    return out.withColumn("chosen", F.col("c") == F.col("_best")).drop("c", "_best")
