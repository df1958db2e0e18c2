"""Logistic paths and the promotion rule against numpy."""
import numpy as np
import pandas as pd
import pytest

from test_walkforward import COLUMNS, accepted, frame, refit, table
from tidemark.operators import logistic as L


def newton(x, y, c):
    """Plain Newton steps for half the squared slopes plus c times the log loss."""
    d = np.column_stack([np.ones(len(x)), x])
    b, free = np.zeros(d.shape[1]), np.array([0.0] + [1 / c] * x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-d @ b))
        move = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(free + 1e-12), d.T @ (p - y) + free * b)
        b = b - move * min(1, 4 / np.abs(move).max())
        if np.abs(move).max() < 1e-12:
            break
    grad = d.T @ (1 / (1 + np.exp(-d @ b)) - y) + free * b
    assert np.abs(grad).max() < 1e-6
    return b


def scaled(train, q):
    med = np.nanmedian(train, axis=0)
    t = np.where(np.isfinite(train), train, med)
    sd = np.where(t.std(0) > 0, t.std(0), 1.0)
    return (t - t.mean(0)) / sd, (np.where(np.isfinite(q), q, med) - t.mean(0)) / sd


def test_paths_equal_newton_per_key(spark):
    p = frame(21).assign(k=lambda d: np.where(d.row % 4 == 0, "x", "y"))
    p["e"] = np.where(p.y.notna(), (p.y > 2.0).astype(float), np.nan)
    d = table(spark, p[["a", "b", "c", "row", "y", "origin", "available", "previous"]]).join(spark.createDataFrame(p[["row", "k", "e"]].replace({np.nan: None}), "row long, k string, e double"), "row")
    d = d.filter("e IS NOT NULL")
    wide, coefs = L.logistic_path(d, ["k"], COLUMNS, "e", [0.01, 1.0, 10.0])
    got = {r.k: r.coefs for r in coefs.collect()}
    probs = {r.row: r.probabilities for r in L.logistic_values(d, wide, coefs, ["k"], COLUMNS).collect()}
    for k in ("x", "y"):
        own = p[(p.k == k) & p.e.notna()]
        z, _ = scaled(own[COLUMNS].to_numpy(float), own[COLUMNS].to_numpy(float))
        for i, c in enumerate([0.01, 1.0, 10.0]):
            b = newton(z, own.e.to_numpy(), c)
            assert np.allclose(got[k][i], b, atol=1e-7)
            want = 1 / (1 + np.exp(-np.column_stack([np.ones(len(z)), z]) @ b))
            assert np.allclose([probs[r][i] for r in own.row], want, atol=1e-8)


@pytest.mark.parametrize("seed", [22, 23])
def test_protocol_equals_numpy_and_keeps_the_periods_apart(spark, seed):
    p, limit, periods, cs = frame(seed), 2.5, [(350, 600), (600, 950)], [0.01, 1.0]
    got = {r.penalty: r for r in L.risk_protocol(table(spark, p), COLUMNS, "y", limit, "origin", "available", periods, cs).collect()}
    parts = []
    for a, b in periods:
        train = p[(p.available < a) & p.y.notna()]
        val = p[(p.origin >= a) & (p.origin < b) & (p.available < b) & p.y.notna()]
        x, t = val[COLUMNS].to_numpy(float), train[COLUMNS].to_numpy(float)
        ridge = refit(t, train.y.to_numpy(), 100.0)(x)
        ok = accepted(ridge, x)
        z, q = scaled(t, x)
        logit = {c: 1 / (1 + np.exp(-np.column_stack([np.ones(len(q)), q]) @ newton(z, (train.y > limit).to_numpy(float), c)))[ok] for c in cs}
        parts.append((val.y.to_numpy()[ok], ridge[0][ok], logit, (train.y > limit).mean()))
    (y0, r0, l0, _), (y1, r1, l1, rate) = parts
    brier = {c: ((l0[c] - (y0 > limit)) ** 2).mean() for c in cs}
    best, e1 = min(cs, key=lambda c: brier[c]), (y1 > limit).astype(float)
    levels = np.arange(1, 100) / 100
    q = np.quantile(y0 - r0, levels)
    residual = 1 - np.interp(limit - r1, q, levels)
    auc = lambda s: np.mean([(a > b) + 0.5 * (a == b) for a in s[e1 == 1] for b in s[e1 == 0]])
    figures = [((v - e1) ** 2).mean() for v in (l1[best], rate, residual)]
    promoted = figures[0] <= 0.98 * min(figures[1:]) and auc(l1[best]) >= auc(residual)
    for c, r in got.items():
        assert r.brier_selection == pytest.approx(brier[c], abs=1e-8) and r.chosen == (c == best) and r.n_confirmation == len(y1)
        assert np.allclose([r.brier, r.prevalence_brier, r.residual_brier], figures, atol=1e-7)
        assert r.auc == pytest.approx(auc(l1[best])) and r.residual_auc == pytest.approx(auc(residual)) and r.promoted == promoted
