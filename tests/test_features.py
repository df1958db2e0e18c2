"""Causality: nothing after an origin may change a feature; cleaning a prefix equals the prefix of cleaning."""
import numpy as np
import pandas as pd
import pytest
from helpers import MIN
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import features as X
from tidemark.operators import process as P
from tidemark.operators import history as H
from tidemark.sources import formulas as FM

AN, CT = {"q": "q21", "pk": "pak"}, {"T": "T6", "F": "F9", "P": "P13"}
DAY = 24 * 60


def plant(days=4, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(0, days * DAY, 10)
    parts = [pd.DataFrame({"metric_id": m, "t": t * MIN, "value": lvl + s * rng.standard_normal(len(t))}) for m, lvl, s in (("q21", 8, .3), ("pak", 7, .3), ("T6", 350, 1), ("F9", 200, 3), ("P13", 4, .05))]
    lt = np.arange(60, days * DAY, 720)
    labs = pd.DataFrame({"t": lt * MIN, "value": 9 + 0.2 * rng.standard_normal(len(lt))})
    return pd.concat(parts, ignore_index=True), labs


def frame(spark, s, labs, origins):
    o = spark.createDataFrame([(int(x * MIN),) for x in origins], "origin long")
    d = X.anchored_features(o, spark.createDataFrame(s), spark.createDataFrame(labs), AN, CT, width=6 * 60 * MIN).toPandas()
    return d.set_index("origin").sort_index().astype(float)


def test_future_never_changes_features_and_values_are_right(spark):
    s, labs = plant()
    origins = [2 * DAY + 3, 3 * DAY + 245]
    full = frame(spark, s, labs, origins)
    cut = origins[-1] * MIN
    s2, l2 = s.copy(), labs.copy()
    s2.loc[s2.t > cut, "value"] = 99.0
    l2.loc[l2.t + 240 * MIN > cut, "value"] = 99.0
    pd.testing.assert_frame_equal(full.loc[[cut]], frame(spark, s2, l2, origins).loc[[cut]])
    seen = labs[labs.t + 240 * MIN <= cut]
    assert full.loc[cut, "level"] == pytest.approx(np.median(seen.value.iloc[-5:]))
    q = s[s.metric_id == "q21"]
    centre = [q[(q.t > t - 30 * MIN) & (q.t <= t + 30 * MIN)].value.mean() for t in seen.t]
    assert full.loc[cut, "offset_q"] == pytest.approx(np.median((seen.value - centre).iloc[-10:]))
    hour = q[(q.t > cut - 60 * MIN) & (q.t <= cut)].value.mean()
    assert full.loc[cut, "ln_q_1h"] == pytest.approx(np.log(hour + full.loc[cut, "offset_q"]))
    assert full.loc[cut, "previous_lab"] == seen.value.iloc[-1]


def test_cleaning_a_prefix_equals_the_prefix(spark):
    v = [5.0] * 3 + [5.005] * 8 + [9.0, 0.0, 9.0] + [150.0] + [7.0] * 9
    d = pd.DataFrame({"metric_id": "q", "t": np.arange(len(v)) * 10 * MIN, "value": v, "flags": ""})
    whole = X.clean_analyser(spark.createDataFrame(d), width=40 * MIN).toPandas().sort_values("t").value.tolist()
    # the plateau (tolerance 0.01) counts from the sixth ten-minute step on
    assert [x == x for x in whole[:11]] == [True] * 6 + [False] * 5 and whole[12] != whole[12] and whole[14] != whole[14]
    for n in (8, 16, 20):
        part = X.clean_analyser(spark.createDataFrame(d.head(n)), width=40 * MIN).toPandas().sort_values("t").value.tolist()
        assert [None if a != a else a for a in part] == [None if a != a else a for a in whole[:n]]


def test_quiet_path(spark):
    def quiet(values, limit=6.0, horizon=60):
        s = spark.createDataFrame([("c", i * 10 * MIN, float(x)) for i, x in enumerate(values) if x is not None], "metric_id string, t long, value double")
        return X.quiet_path(spark.createDataFrame([(60 * MIN,)], "origin long"), s, "c", horizon * MIN, limit).first().quiet

    flat = [350.0] * 13
    assert quiet(flat) and not quiet(flat[:9] + [360.0] + flat[10:]) and not quiet(flat[:12] + [356.0])
    assert quiet([300.0] * 6 + [350.0] * 7)  # a step before the origin is history
    assert not quiet(flat[:8] + [None] * 4 + flat[12:]) and not quiet(flat[:9])


def test_formulas(spark):
    d = spark.createDataFrame([(100.0, 10.0, 2.0), (100.0, 10.0, 0.0), (None, 10.0, 2.0)], "T1 double, F1 double, F2 double")
    v, s = FM.evaluate("791,2 + 0,5xT1 − F1/F2")
    assert [tuple(r) for r in d.select(v, s).collect()] == [(836.2, "ok"), (None, "zero_denominator"), (None, "missing_input")]
    for bad in ("T1; drop", "exp(T1)", "T1 ** F1 if F2", "__import__", "F1 F2", "F1**2", "(F1", "F1)", "F1+", "", "2F1", "1.2.3", "F1 AS F2", "F1/()"):
        with pytest.raises(ValueError):
            FM.evaluate(bad)
    for text, want in {"T1/((F1+F2)*2)": 100 / 24, "T1/(F1/(F2+1))": 30.0, "1e3*F1 - -F2": 10002.0, "8/F2/2": 2.0, "2-3-4": -5.0}.items():
        assert d.limit(1).select(FM.evaluate(text)[0]).first()[0] == pytest.approx(want)
    nested = d.select(FM.evaluate("T1/(F1/F2)")[1], FM.evaluate("T1/((F1-10)*F2)")[1]).collect()
    assert [tuple(r) for r in nested] == [("ok", "zero_denominator"), ("zero_denominator", "zero_denominator"), ("missing_input", "missing_input")]
    for text in FM.FORMULAS.values():
        FM.evaluate(text)
    values = {"F9": 100.0, "P13": 4.0, "T6": 350.0}
    row = spark.createDataFrame([tuple(values.values())], list(values))
    assert row.select(FM.evaluate(FM.FORMULAS["24-2000:GODT:T50"])[0]).first()[0] == pytest.approx(44.625 + 10.0224 * 4 + 6.981 + 0.471 * 350)


def test_step_response_recovers_sign_and_lag(spark):
    n = 400
    T = np.full(n, 350.0)
    for k in range(40, n - 60, 80):
        T[k:] += 4.0
    s = np.full(n, 2.0)
    for i in range(n):
        s[i] -= 0.02 * (T[max(0, i - 9)] - 350.0)
    d = spark.createDataFrame(pd.DataFrame({"slot": np.arange(n), "s": s, "T": T, "F": 200.0, "P": 4.0}))
    for merged in (False, True):
        e = P.step_events(d, "s", {"T": (3.0, False), "F": (8.0, True), "P": (0.15, False)}, X.in_regime({"T": (320, 500)}), merged=merged)
        r = P.response_summary(e).filter("control = 'T'").first()
        assert r.events == (4 if merged else 24) and r.coefficient == pytest.approx(-0.02, abs=2e-3)


def history_case():
    rng = np.random.default_rng(3)
    o = np.unique(rng.choice(60 * 24, 25)) * C.HOUR
    rows = pd.DataFrame({"metric_id": rng.choice(["a", "c", "lab", "other"], 900), "t": rng.integers(-200, 60 * 24 + 50, 900) * C.HOUR, "value": rng.normal(1, 1, 900)})
    rows["flags"], rows["source_row"] = np.where(rng.random(900) < 0.1, "invalid", ""), np.arange(900)
    sources = {"analysers": H.Source(["a"], 20 * C.HOUR), "controls": H.Source(["c"], 3 * C.HOUR), "labs": H.Source(["lab"], 30 * C.HOUR, 4 * C.HOUR, True, 0.0)}
    return o, rows, sources


@pytest.mark.parametrize("pieces", [1, 3, 64])
def test_bounded_history_equals_a_load_per_origin(spark, pieces):
    o, rows, sources = history_case()
    d = spark.createDataFrame(rows)
    asked = []

    def read(ranges):
        asked.append(ranges)
        assert len(ranges) <= pieces and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        return d.filter(" OR ".join(f"t BETWEEN {a} AND {b}" for a, b in ranges))

    batch = spark.createDataFrame([(int(x),) for x in [*o, *o[:3]]] + [(None,)], "origin long")
    got = {(r.source, r.metric_id, r.t): (r.value, r.first_origin) for r in H.bounded_history(read, batch, sources, pieces=pieces).collect()}
    want = {}
    for name, s in sources.items():
        ok = rows[rows.metric_id.isin(s.metrics) & (rows["flags"] == "") & (rows.value >= (-9 if s.lowest is None else s.lowest))]
        for r in ok.sort_values("source_row").itertuples():
            seen = [x for x in o if r.t + s.delay <= x and (x - r.t <= s.age if s.closed else x - r.t < s.age)]
            if seen:
                want[name, r.metric_id, r.t] = (r.value, min(seen))
    assert got == want and len(want) > 50
    exact = H.read_ranges(batch, "origin", 3 * C.HOUR)
    covered = sum(b - a for a, b in exact)
    assert covered < sum(b - a for a, b in H.read_ranges(batch, "origin", 3 * C.HOUR, pieces=2))


def test_bounded_history_without_origins(spark):
    _, rows, sources = history_case()
    empty = spark.createDataFrame([], "origin long")
    assert H.read_ranges(empty, "origin", C.DAY) == []
    d = spark.createDataFrame(rows)
    assert H.bounded_history(lambda ranges: d.filter(H.in_ranges("x", ranges)), empty, sources).count() == 0


def test_history_ranges_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT timestampadd(HOUR, id, TIMESTAMP_NTZ'2024-01-01') AS ts, id FROM range(1000)").write.parquet(path)
    at = lambda h: 1704067200 * C.SECOND + h * C.HOUR
    d = spark.read.parquet(path).filter(H.in_ranges("ts", [(at(3), at(5)), (at(100), at(101))]))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = d._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0]
    assert pushed.count("GreaterThanOrEqual") == 2 and pushed.count("LessThanOrEqual") == 2
    assert sorted(r.id for r in d.collect()) == [3, 4, 5, 100, 101]
