"""Row tables beside small tables: the small side is sent, rows are neither broadcast nor dealt out by a handful of keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fit as M
from tidemark.operators import quantiles as Q
from tidemark.operators import walkforward as W
from tidemark.operators.stage import per_key, staged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_per_key_is_sent_while_small(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(k, float(k)) for k in range(3)], "k long, m double")
    assert "BroadcastHashJoin" in plan(rows.join(per_key(small), "k"))
    assert "SortMergeJoin" in plan(rows.join(per_key(small, 2), "k"))
    assert rows.join(per_key(small, 2), "k").agg(F.sum("m")).first()[0] == rows.join(per_key(small), "k").agg(F.sum("m")).first()[0] == 999.0


def test_trimmed_core_does_not_broadcast_rows_that_compress_well(spark):
    rows = staged(spark.range(60_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 7).cast("double").alias("x")))
    core = M.robust_core(rows, ["k"], ["x"])
    assert "BuildLeft" not in plan(core)
    assert core.count() == 60_000


def test_models_reach_the_rows_without_a_shuffle(spark):
    r = np.random.default_rng(5)
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(300) % 3, "x": r.normal(size=300), "y": r.normal(size=300)}))
    wide, coefs = M.fit_ridge(rows, ["k"], ["x"], "y", [1.0, 10.0])
    p = M.predict(rows, wide, coefs, ["k"], ["x"])
    assert "SortMergeJoin" not in plan(p) and p.count() == 600


def test_huber_passes_do_not_shuffle_rows(spark, monkeypatch):
    r, seen, gram = np.random.default_rng(6), [], M.gram
    rows = spark.createDataFrame(pd.DataFrame({"k": np.arange(300) % 3, "x": r.normal(size=300), "y": r.normal(size=300)}))
    monkeypatch.setattr(M, "gram", lambda d, *a: seen.append(plan(d)) or gram(d, *a))
    M.huber_ridge(rows, ["k"], ["x"], "y", 1.0, iterations=2)
    assert len(seen) == 3 and not any("SortMergeJoin" in x for x in seen)


@pytest.mark.parametrize("bits", [0, 3, 13])
def test_window_quantiles_for_any_blocks(spark, bits):
    r = np.random.default_rng(7)
    p = pd.DataFrame({"t": r.integers(0, 100, 900), "x": np.round(r.normal(size=900), 1), "z": np.where(r.random(900) < 0.9, 4.0, r.normal(size=900))})
    windows, probs = [(0, 100), (10, 30), (30, 90), (200, 300)], [0.005, 0.5, 0.995]
    edges = W.cells(windows)
    rows = spark.createDataFrame(p).withColumn("cell", W.cell_of("t", edges))
    got = {(q.window, q.column): (q.lo, q.median, q.hi) for q in W.window_quantiles(rows, ["x", "z"], windows, edges, probs, ["lo", "median", "hi"], bits).collect()}
    assert len(got) == 6
    for (w, c), values in got.items():
        own = p[(p.t >= windows[w][0]) & (p.t < windows[w][1])][c]
        assert values == pytest.approx(np.quantile(own, probs))


def test_cells_of_times(spark):
    edges = [-5, 0, 7, 9]
    rows = spark.createDataFrame([(None,), (-6,), (-5,), (-1,), (0,), (6,), (7,), (8,), (9,), (50,)], "t long")
    assert [x.cell for x in rows.select(W.cell_of("t", edges).alias("cell")).collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("accuracy", [3, 2_000])
def test_narrowed_quantile(spark, accuracy):
    r = np.random.default_rng(8)
    p = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [700, 601, 3]), "v": np.concatenate([r.normal(size=700), np.where(r.random(601) < 0.8, 2.0, r.normal(size=601)), [5.0, 1.0, 9.0]])})
    for prob in (0.0, 0.5, 0.9, 1.0):
        got = {x.k: x.q for x in Q.narrowed_quantile(spark.createDataFrame(p), ["k"], "v", prob, "q", accuracy=accuracy).collect()}
        assert got == pytest.approx({k: np.quantile(g.v, prob) for k, g in p.groupby("k")})
