"""Fits against numpy, thresholds and Pareto marks against brute force, gates and recipes by hand."""
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decide as K
from tidemark.operators import evaluate as E
from tidemark.operators import fit as M
from tidemark.operators import risk as R


def numpy_ridge(x, y, alpha):
    med = np.nanmedian(x, axis=0)
    x = np.where(np.isfinite(x), x, med)
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    d = np.column_stack([np.ones(len(z)), z])
    reg = np.eye(d.shape[1]) * alpha
    reg[0, 0] = 0
    return np.linalg.solve(d.T @ d + reg, d.T @ y)


def test_ridge_support_and_prediction_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 3, 9]
    y = x @ [1.0, -0.3, 4.0] + rng.normal(size=300)
    x[rng.random((300, 3)) < 0.05] = np.nan
    p = pd.DataFrame(x, columns=list("abc")).assign(y=y, g=np.where(np.arange(300) < 200, 0, 1))
    wide, coef = M.fit_ridge(spark.createDataFrame(p), ["g"], list("abc"), "y", [1.0, 50.0])
    for r in coef.collect():
        part = p[p.g == r.g]
        assert np.allclose(r.coef, numpy_ridge(part[list("abc")].to_numpy(), part.y.to_numpy(), r.alpha), atol=1e-8)
    s = wide.filter("g = 0").first()
    lo, hi = np.nanquantile(x[:200, 1], [0.005, 0.995])
    assert s["lower_b"] == pytest.approx(lo - 0.1 * max(hi - lo, s["scale_b"])) and s["median_b"] == pytest.approx(np.nanmedian(x[:200, 1]))
    h_wide, h = M.huber_ridge(spark.createDataFrame(p).fillna(0, ["a", "b", "c"]), ["g"], list("abc"), "y", 1.0, iterations=5)
    assert h.count() == 2 and all(np.isfinite(r.coef).all() for r in h.collect())


def test_convex_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = 0.5 * x[:, 0] + 0.5 * x[:, 2] + 0.3 + 0.01 * rng.normal(size=60)
    x[:5, 0] = np.nan
    p = pd.DataFrame(x, columns=list("abc")).assign(y=y, g=0)
    best = None
    for w in M.simplex(3, 0.25):
        w = np.array(w)
        ok = np.isfinite(x)
        mass = (ok * w).sum(1)
        pred = np.where(mass > 0, np.where(ok, x, 0) @ w / np.where(mass > 0, mass, 1), np.where(ok, x, 0).sum(1) / ok.sum(1))
        r = y - pred
        score = np.abs(r - np.median(r)).mean()
        best = min(best or (9, None), (score, tuple(w)))
    r = M.fit_convex(spark.createDataFrame(p), ["g"], list("abc"), "y", 0.25).first()
    assert tuple(r.weights) == best[1] and r.fit_mae == pytest.approx(best[0])


@pytest.mark.parametrize("most", [M.GRID_CELLS, 0])  # the driver holds the scores, or rows are exploded
def test_convex_over_the_whole_grid_matches_brute_force(spark, most):
    rng = np.random.default_rng(6)
    n = 700
    x = rng.normal(size=(n, 3)).round(1)
    y = 0.15 * x[:, 0] + 0.35 * x[:, 1] + 0.5 * x[:, 2] + np.where(rng.random(n) < 0.1, 1e6, 0.05) * rng.normal(size=n)
    x[rng.random((n, 3)) < 0.15] = np.nan
    x[0] = np.nan
    g = np.where(np.arange(n) < 660, "big", "small")
    rows = [(None if i == 1 else str(g[i]), *[None if np.isnan(v) else float(v) for v in x[i]], None if i == 2 else float(y[i])) for i in range(n)]
    want = {}
    for k in ("big", "small"):
        at = (g == k) & np.isfinite(x).any(1) & ~np.isin(np.arange(n), [1, 2])
        ok, best = np.isfinite(x[at]), None
        for w in map(np.array, M.simplex(3, 0.05)):
            mass = (ok * w).sum(1)
            r = y[at] - np.where(mass > 0, np.where(ok, x[at], 0) @ w / np.where(mass > 0, mass, 1), np.where(ok, x[at], 0).sum(1) / ok.sum(1))
            score = np.abs(r - np.median(r)).mean()
            if best is None or score < best[0] - 1e-9:
                best = (score, w, np.median(r))
        want[k] = best
    got = {r.g: r for r in M.fit_convex(spark.createDataFrame(rows, "g string, a double, b double, c double, y double"), ["g"], list("abc"), "y", most=most).collect()}
    assert set(got) == set(want)
    for k, (score, w, bias) in want.items():
        assert got[k].weights == pytest.approx(list(w)) and got[k].fit_mae == pytest.approx(score) and got[k].bias == pytest.approx(bias, abs=1e-9)


def test_convex_query_finds_weights_between_quarters(spark, tmp_path):
    from tidemark.plans import load
    rng = np.random.default_rng(2)
    n = 90
    p = pd.DataFrame({"l_returnflag": "A", "l_linenumber": (np.arange(n) % 7 + 1).astype("int32"), "l_quantity": rng.integers(1, 51, n).astype(float),
                      "l_extendedprice": rng.uniform(1e4, 1e5, n), "l_discount": rng.integers(0, 11, n) / 100})
    spark.createDataFrame(p).write.parquet(str(tmp_path / "lineitem.parquet"))
    r = load()["convex_combination"].plan(spark, str(tmp_path)).first()
    assert (r.wa, r.wb, r.wc) == (0.6, 0.4, 0.0)


def test_walk_forward_uses_only_the_past(spark):
    rng = np.random.default_rng(1)
    t = np.arange(400)
    p = pd.DataFrame({"origin": t, "available": t + 5, "a": rng.normal(size=400), "b": rng.normal(size=400)})
    p["y"] = 2 * p.a + rng.normal(size=400) * 0.1
    run = lambda d: M.walk_forward(spark.createDataFrame(d), ["a", "b"], "y", "origin", "available", [100, 200, 300], 400, (1.0, 1000.0), 1000.0).toPandas().set_index("origin").sort_index()
    one = run(p)
    assert one[one.cutoff == 100].basis.eq("preregistered").all() and one[one.cutoff == 200].alpha.eq(1.0).all()
    q = p.copy()
    q.loc[q.available >= 300, "y"] = 1e6
    two = run(q)
    pd.testing.assert_series_equal(one[one.index < 295].prediction, two[two.index < 295].prediction)
    pd.testing.assert_series_equal(one[one.cutoff == 300].prediction, two[two.cutoff == 300].prediction)


def test_thresholds_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"m": 0, "score": np.round(rng.random(80), 1), "event": rng.random(80) < 0.3})
    s = E.score_table(spark.createDataFrame(p), ["m"], F.col("event"), "score", 4)
    d = E.alarm_decisions(s, ["m"])
    for r in E.cheapest_threshold(d, ["m"], [1, 5, 20]).collect():
        options = []
        for t in [*sorted(p.score.unique()), np.inf]:
            a = p.score >= t
            fn, fp = int((p.event & ~a).sum()), int((~p.event & a).sum())
            options.append((r.ratio * fn + fp, fn, fp, -t))
        assert (r.cost, r.fn, r.fp, -r.threshold) == min(options)
    pos, neg = p[p.event].score.to_numpy(), p[~p.event].score.to_numpy()
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
    assert E.auc(s, ["m"]).first().auc == pytest.approx(auc)
    ranks = pd.Series(p.score).rank()
    got = {r.score: r["rank"] for r in E.average_ranks(s, ["m"]).collect()}
    assert got == dict(zip(p.score, ranks))


def test_residual_bound_and_risk(spark):
    v = np.arange(50.0)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "r": v}))
    assert E.residual_bound(d, ["k"], "r").first().bound == np.sort(v)[int(np.ceil(51 * 0.9)) - 1]
    assert E.residual_bound(d.limit(29), ["k"], "r").first().bound is None
    probs, quants = [0.1, 0.3, 0.5, 0.9], [-1.0, -0.2, 0.1, 0.8]
    x = spark.createDataFrame([(float(g),) for g in (-2, -1, -0.5, 0.1, 0.4, 0.8, 3)], "p double").withColumn("probs", F.array(*map(F.lit, probs))).withColumn("quants", F.array(*map(F.lit, quants)))
    want = [1 - np.interp(np.clip(-g, -1, 0.8), quants, probs) for g in (-2, -1, -0.5, 0.1, 0.4, 0.8, 3)]
    assert np.allclose([r[0] for r in x.select(R.exceedance_probability("p", F.lit(0.0))).collect()], want)
    pol = K.Policy(probs, quants)
    y = x.select((-F.col("p")).alias("gap"))
    assert np.allclose([r[0] for r in y.select(K.probability_above("gap", pol)).collect()], want)


def test_pareto(spark):
    rows = [("base", True, 0., 1., 1., 0.), ("equal", True, 0., 1., 1., 0.), ("worse", True, 0., 1.1, 1., .1), ("tradeoff", True, -.1, 1.2, 1., .1), ("unsafe", False, -9., 0., 0., 0.), ("partial", True, None, 0., 0., 0.)]
    d = spark.createDataFrame([(1, *r) for r in rows], "m int, id string, ok boolean, a double, b double, c double, d double")
    got = {r.id: (r.pareto, r.dominated_by) for r in K.pareto(d, "m", "id", list("abcd"), F.col("ok")).collect()}
    assert got["base"] == (True, []) and got["equal"] == (True, []) and got["tradeoff"] == (True, []) and got["unsafe"] == (None, None) and got["partial"] == (None, None)
    assert got["worse"] == (False, ["base", "equal"])


def test_grid_search_equals_brute_force(spark):
    pol = K.Policy([0.1, 0.5, 0.9], [-0.1, 0.0, 0.15])
    row = dict(moment=1, base=9.2, T=350.0, F=200.0, P=4.0, mean_T=348.0, std_T=3.0, mean_F=190.0, std_F=15.0, mean_P=4.0, std_P=0.2)
    r = K.grid_optima(spark.createDataFrame([row]), pol).first()
    best, n = {}, 0
    for t, f, p in itertools.product(range(-6, 7), range(-10, 11), range(-2, 3)):
        p = p * 0.1
        if not (t or f or p):
            continue
        s = max(0, 9.2 + max(-.08 * t, -.02 * t * 9.2) + max(.05 * f, .01 * f * 9.2) + max(-.15 * p, -.05 * p * 9.2))
        prob = 1 - np.interp(np.log(10) - np.log(s), pol.quants, pol.probs)
        sev = max(0, (350 + t - 348) / 3, (4 + p - 4) / .2, (200 * (1 + f / 100) - 190) / 15) / 12
        eff = abs(t) / 10 + abs(f) / 10 + abs(p) / 2
        loss = .5 * -f / 100 / .1 + (.1 * t / 10 + .05 * p / 2 + .1 * f / 10) + .25 * sev + .05 * eff + .25 * prob / .2
        fix = t >= 0 and f <= 0 and p >= 0
        if prob <= .2 + 1e-9 and s <= 10 and sev <= 1 and (fix or prob <= .1 + 1e-9):
            n += 1
            best[fix] = min(best.get(fix, (9e9,)), (round(loss, 9), round(eff, 4), t, f, round(p, 1)))
    assert r.admissible == n
    assert (r.corrective_dT, r.corrective_dF, round(r.corrective_dP, 1)) == best[True][2:] and r.corrective_loss == pytest.approx(best[True][0])
    assert (r.economic_dT, r.economic_dF, round(r.economic_dP, 1)) == best[False][2:]


def test_recipe_and_additive(spark):
    d = spark.createDataFrame([(1, 60.0, 8.0, 350.0, 50.0, 1.0, 10.0, 20.0), (1, 40.0, 12.0, 340.0, 55.0, 2.0, 10.0, None), (2, 50.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 100.0, 5.0, 300.0, 52.0, 1.0, 10.0, 2.0)],
                              "k int, share double, sulfur double, t95 double, cetane double, cost double, required double, stock double")
    r = {x.k: x for x in K.blend(d, "k").collect()}
    assert r[1].sulfur == pytest.approx(9.6) and r[1].t95 == pytest.approx(346) and r[1].stock_met is None
    assert r[2].valid_recipe is False and r[2].sulfur is None and r[3].stock_met is False
    dose = spark.createDataFrame([(50.0,), (51.0,), (50.9,), (None,)], "b double").select(K.required_additive("b"))
    assert [x[0] for x in dose.collect()] == [0.25, 0.0, 0.05, None]


def test_batch_mean_clips_at_zero(spark):
    d = spark.createDataFrame([(1, 0.0, -1.0), (1, 10.0, 1.0), (1, 20.0, 1.0)], "k int, t double, v double")
    assert K.batch_mean(d, "k", "t", "v").first()["mean"] == pytest.approx((2.5 + 10) / 20)


def test_hysteresis_and_evidence(spark):
    c = spark.createDataFrame([(1, "hold", 0.10, 0.0, 9.0, True), (1, "x", 0.08, 0.2, 8.0, True), (2, "hold", 0.10, 0.0, 9.0, True), (2, "x", 0.01, 0.2, 8.0, True), (3, "x", 0.5, 0.2, 8.0, False)],
                              "m int, id string, loss double, effort double, product double, feasible boolean")
    assert {r.m: r.selected for r in K.select_candidate(c, "m").collect()} == {1: "hold", 2: "x", 3: None}
    e = spark.createDataFrame([(5.0, "fresh", "", 1, 2), (None, "stale", "flatline", 3, 2), (5.0, "fresh", "", None, 2)], "v double, f string, g string, a int, at int")
    got = [r[0] for r in e.select(K.evidence_failures("v", "f", "g", "a", "at")).collect()]
    assert got == [[], ["no_finite_value", "not_fresh", "unreliable", "not_yet_available"], ["unknown_time"]]


@pytest.mark.parametrize("blocks", [30, 90, 365])
def test_bootstrap_spread_is_that_of_a_resample(spark, blocks):
    day = 86_400_000_000
    v = [float((7 * i * i + 3 * i) % 101) for i in range(blocks)]
    d = spark.createDataFrame([(0, i * 7 * day, x) for i, x in enumerate(v)], "k int, t long, d double")
    r = E.block_bootstrap(d, ["k"], "t", "d", 7, 4000, (0.1586553, 0.8413447)).first()
    assert abs((r.ci_high - r.ci_low) / 2 / (np.std(v) / blocks ** 0.5) - 1) < 0.06
    assert abs(r.mean_delta - np.mean(v)) < 1e-9


def test_bootstrap_is_replayable(spark):
    d = spark.createDataFrame([(0, i * 86_400_000_000, float(i % 7)) for i in range(200)], "k int, t long, d double")
    a, b = (E.block_bootstrap(d, ["k"], "t", "d", 7, 100).first() for _ in range(2))
    assert a == b and a.ci_low <= a.mean_delta <= a.ci_high


@pytest.mark.parametrize("query, module, operator, names", [
    ("huber_ridge", "fit", "huber_ridge", ["delta", "iterations", "tolerance"]), ("walk_forward", "fit", "walk_forward", ["alphas"]),
    ("lab_walk_forward", "fit", "walk_forward", ["alphas"]), ("step_response_spread", "process", "response_bootstrap", ["draws"])])
def test_queries_without_sql_run_the_operators_full_job(spark, monkeypatch, query, module, operator, names):
    import importlib
    import inspect

    from tidemark.plans import load
    plan = load()[query].plan
    ops = importlib.import_module(f"tidemark.operators.{module}")
    signature = inspect.signature(getattr(ops, operator))

    class Called(Exception):
        pass

    def stop(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called({n: bound.arguments[n] for n in names})

    monkeypatch.setattr(ops, operator, stop)
    with pytest.raises(Called) as call:
        plan(spark, "/root/testdata/sf0.001")
    assert call.value.args[0] == {n: signature.parameters[n].default for n in names}


def test_risk_policy_levels_and_point_margin(spark):
    probs = [k / 100 for k in range(5, 100, 5)]
    pol = K.Policy(probs, list(np.linspace(-0.4, 0.5, len(probs)) ** 3))
    assert pol.level(0.2) == pytest.approx(10 * np.exp(-np.interp(0.8, probs, pol.quants))) and pol.level(0.001) == pytest.approx(10 * np.exp(-pol.quants[-1]))
    d = spark.createDataFrame([(x, u, m) for x in np.linspace(0, 14, 60).tolist() + [10.0, 9.0, 8.5] for u in (True, False, None) for m in (1.0, 0.0, 2.5)], "product double, usable boolean, margin double")
    for r in K.risk_policy(d, pol, F.col("usable"), F.col("margin")).collect():
        if r.usable:
            p = 1 - np.interp(np.log(10) - np.log(max(r["product"], 1e-3)), pol.quants, probs)
            assert r.basis == "residual_quantiles" and r.probability == pytest.approx(p, abs=1e-9)
            assert r.safe_level == pytest.approx(pol.level(0.2)) and r.design_level == pytest.approx(pol.level(0.1))
            if abs(p - 0.2) > 1e-6 and abs(p - 0.1) > 1e-6:
                assert (r.risk_passed, r.within_design) == (p <= 0.2, p <= 0.1)
        else:
            assert r.basis == "point_margin" and r.probability is None and (r.safe_level, r.design_level) == (10 - r.margin, 10 - 1.5 * r.margin)
            assert (r.risk_passed, r.within_design) == (r["product"] <= r.safe_level + 1e-9, r["product"] <= r.design_level + 1e-9)


def test_audit_skips_moments_without_data(spark):
    decided = spark.createDataFrame([(1, "hold", 0.5, []), (2, None, None, []), (3, "hold", 0.1, ["stale"]), (4, "hold", 0.2, [])], "moment long, selected string, selected_loss double, data_reasons array<string>")
    best = spark.createDataFrame([(1, 7, 0.4, 0.3), (2, 1, 0.9, None), (3, 5, 0.0, 0.0)], "moment long, admissible long, corrective_loss double, economic_loss double")
    got = {r.moment: (r.admissible, r.oracle_loss, r.oracle_kind, r.given_away) for r in K.audit(decided, best, "moment").collect()}
    assert got == {1: (7, 0.3, "economic", pytest.approx(0.2)), 2: (1, 0.9, "corrective", None), 3: (None, None, None, None), 4: (None, None, None, None)}


def test_leakage_and_prefix_checks_find_planted_rows(spark):
    d = spark.createDataFrame([(1, 5, 4), (2, 5, 6), (3, 5, None)], "id long, origin long, seen long")
    assert tuple(E.leakage_checks(d, {"future": F.col("seen") > F.col("origin")}).first()) == (3, 1)
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "origin long, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.1), (3, 3.0)], "origin long, x double")
    assert tuple(E.frame_difference(a, b, "origin", ["x"]).first()) == (3, 2)
