"""Chunked operators equal the plain definitions, with a hot key and chunks far smaller than the data."""
import numpy as np
import pandas as pd
import pytest
from helpers import MIN, skewed
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import bucket
from tidemark.operators import ordered as O
from tidemark.operators import timejoin as T
from tidemark.operators.quantiles import quantile_rows, quantiles

W = 60 * MIN


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbour_and_trailing_match_plain_windows(spark, seed):
    d = spark.createDataFrame(skewed(seed))
    plain = Window.partitionBy("k").orderBy("t", "row")
    got = O.neighbour(d, ["k"], "t", ["row"], ["value"], W, "p").select("row", F.col("p.value").alias("v"))
    want = d.withColumn("v", F.lag("value").over(plain)).select("row", "v")
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect()))
    ahead = O.neighbour(d, ["k"], "t", ["row"], [], W, "n", ahead=True).select("row", F.col("n.t").alias("v"))
    assert set(map(tuple, ahead.collect())) == set(map(tuple, d.withColumn("v", F.lead("t").over(plain)).select("row", "v").collect()))
    got = O.trailing(d, ["k"], "t", ["row"], ["value"], 4, W).select("row", F.col("recent.value").alias("v"))
    want = d.withColumn("v", F.collect_list("value").over(plain.rowsBetween(-3, 0))).select("row", "v")
    assert {r.row: r.v for r in got.collect()} == {r.row: r.v for r in want.collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_islands_and_running_match_plain_windows(spark, seed):
    d = spark.createDataFrame(skewed(seed))
    got = O.islands(d, ["k"], "t", ["row"], F.col("prev.value") != F.col("value"), ["value"], W)
    p = skewed(seed).sort_values(["k", "t", "row"])
    run = p.groupby("k")["value"].transform(lambda v: v.ne(v.shift()).cumsum())
    want = dict(zip(p["row"], p.groupby(["k", run])["t"].transform("first")))
    assert {r["row"]: r["run_start"] for r in got.collect()} == want
    run = O.running(O.add_chunk(d, "t", W), ["k"], ["t", "row"], {"total": F.col("value")})
    want = dict(zip(p["row"], p.groupby("k")["value"].cumsum()))
    assert {r["row"]: r["total"] for r in run.collect()} == want


@pytest.mark.parametrize("seed,tolerance", [(5, None), (6, 20 * MIN), (7, 200 * MIN)])
def test_asof_matches_pandas(spark, seed, tolerance):
    left, right = skewed(seed, 300), skewed(seed + 50, 400, distinct_times=True)
    right = right.drop_duplicates(["k", "t"])
    j = T.asof(spark.createDataFrame(left.rename(columns={"t": "o"})[["k", "o", "row"]]), spark.createDataFrame(right), ["k"], "o", "t", ["value"], [], tolerance, W)
    got = {r["row"]: (None if r["hit"] is None else r["hit"]["value"]) for r in j.collect()}
    m = pd.merge_asof(left.sort_values("t"), right.sort_values("t")[["k", "t", "value"]], on="t", by="k", suffixes=("", "_r"), tolerance=tolerance)
    assert got == {int(r): (None if np.isnan(v) else v) for r, v in zip(m["row"], m["value_r"])}


def test_asof_ties_take_the_largest_order(spark):
    r = spark.createDataFrame([(0, 10, 1, 1.0), (0, 10, 3, 3.0), (0, 10, 2, 2.0)], "k int, t long, row int, value double")
    l = spark.createDataFrame([(0, 10), (0, 9)], "k int, o long")
    got = {x["o"]: x["hit"] and x["hit"]["value"] for x in T.asof(l, r, ["k"], "o", "t", ["value"], ["row"]).collect()}
    assert got == {10: 3.0, 9: None}
    got = {x["o"]: x["hit"] for x in T.asof(l, r, ["k"], "o", "t", ["value"], ["row"], strict=True).collect()}
    assert got == {10: None, 9: None}


@pytest.mark.parametrize("width", [10 * MIN, 10_000 * MIN])
def test_window_sums_are_half_open(spark, width):
    s = skewed(9, 500)
    o = pd.DataFrame({"k": [0, 0, 1, 2], "o": np.array([500, 501, 900, 2999]) * MIN})
    spans = {"back": (-60 * MIN, 0), "around": (-30 * MIN, 30 * MIN)}
    got = T.window_sums(spark.createDataFrame(o), spark.createDataFrame(s), ["k"], "o", "t", "value", spans, width).collect()
    assert len(got) == 4
    for r in got:
        for name, (lo, hi) in spans.items():
            part = s[(s.k == r["k"]) & (s.t > r["o"] + lo) & (s.t <= r["o"] + hi)]
            assert r[f"n_{name}"] == len(part) and abs(r[f"sum_{name}"] - part.value.sum()) < 1e-9


def test_range_frame(spark):
    s = skewed(11, 400)
    o = pd.DataFrame({"k": [0, 1], "o": np.array([777, 1500]) * MIN})
    got = T.range_frame(spark.createDataFrame(o), spark.createDataFrame(s), ["k"], "o", "t", ["value"], -90 * MIN, 30 * MIN, {"m": F.max("value"), "n": F.count("value")}, 20 * MIN)
    for r in got.collect():
        part = s[(s.k == r["k"]) & (s.t > r["o"] - 90 * MIN) & (s.t <= r["o"] + 30 * MIN)]
        assert r["n"] == len(part) and (r["m"] == part.value.max() if len(part) else r["m"] is None)


@pytest.mark.parametrize("width", [7 * MIN, 40 * MIN, 50 * MIN + 1, 10_000 * MIN])
@pytest.mark.parametrize("lo,hi", [(-90 * MIN, 30 * MIN), (0, 60 * MIN), (-MIN, 0), (-500 * MIN, -100 * MIN)])
def test_window_merge_equals_brute_force(spark, width, lo, hi):
    s = skewed(17, 500)
    s.loc[s.index % 9 == 0, "value"] = np.nan
    s["value"] = s["value"].astype(object).where(s["value"].notna(), None)
    rows = spark.createDataFrame([tuple(r) for r in s[["k", "t", "value"]].itertuples(index=False)], "k long, t long, value double")
    o = pd.DataFrame({"k": [i % 4 for i in range(60)], "o": (np.arange(60) * 53 + 3) * MIN})
    o = pd.concat([o, pd.DataFrame({"k": s.k[:20], "o": s.t[:20] - hi})]).drop_duplicates()
    got = T.window_merge(spark.createDataFrame(o), rows, ["k"], "o", "t", lo, hi, {
        "top": ("max", "value"), "low": ("min", "value"), "n": ("count", "value"), "total": ("sum", "value"), "last": ("max", "t")}, width).collect()
    assert len(got) == len(o)
    for r in got:
        part = s[(s.k == r["k"]) & (s.t > r["o"] + lo) & (s.t <= r["o"] + hi)]
        known = part.value.dropna().astype(float)
        assert r["n"] == len(known) and r["last"] == (part.t.max() if len(part) else None)
        assert (r["top"], r["low"], r["total"]) == ((known.max(), known.min(), known.sum()) if len(known) else (None, None, None))


@pytest.mark.parametrize("per_range", [20, 10**9])
def test_quantiles_exact_for_any_ranges(spark, per_range):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"k": np.repeat([0, 1, 2], [5000, 40, 7]), "v": np.r_[np.round(rng.normal(0, 3, 5000), 2), np.full(40, 7.5), np.arange(7.0)]})
    probs = [0, 0.01, 0.25, 0.5, 0.9, 0.99, 1]
    for r in quantiles(spark.createDataFrame(p), ["k"], "v", probs, per_range=per_range).collect():
        want = np.quantile(p[p.k == r["k"]].v, probs)
        assert np.allclose([r[f"q{i}"] for i in range(len(probs))], want, atol=1e-12)
    many = [i / 100 for i in range(1, 100)]
    rows = quantile_rows(spark.createDataFrame(p), ["k"], "v", many, per_range).toPandas()
    assert len(rows) == 3 * 99
    for k, part in rows.groupby("k"):
        assert np.allclose(part.sort_values("probability")["quantile"], np.quantile(p[p.k == k].v, many), atol=1e-12)


def test_bucket_floors_negative_times(spark):
    d = spark.createDataFrame([(-1,), (0,), (9,), (10,), (-10,), (-11,)], "t long")
    assert [r[0] for r in d.select(bucket("t", 10)).collect()] == [-1, 0, 0, 1, -1, -2]


def test_suggested_width_shrinks_with_density(spark):
    d = spark.createDataFrame(skewed(1, 600))
    assert O.suggest_width(d, ["k"], "t", rows_per_chunk=50) < O.suggest_width(d, ["k"], "t", rows_per_chunk=10**6)


def test_no_pairing_join_in_time_joins(spark):
    a, b = spark.createDataFrame(skewed(1)), spark.createDataFrame(skewed(2))
    j = T.asof(a.select("k", F.col("t").alias("o")), b, ["k"], "o", "t", ["value"], ["row"], 10 * MIN)
    plan = j._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
