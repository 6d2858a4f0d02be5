"""Autoregressions with lagged errors, bands of tree ensembles and forecasts by class against plain versions."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from chronoloom.models import arma
from chronoloom.models import forecast as models
from chronoloom.series import Panel

P = Panel("k")
DAY = datetime.date(2020, 1, 1)


def simulated(n, phi, ma, mean=0.0, seed=0):
    random = np.random.default_rng(seed)
    e, y = random.normal(size=n + 200), np.zeros(n + 200)
    for t in range(1, n + 200):
        y[t] = phi * y[t - 1] + e[t] + ma * e[t - 1]
    return y[200:] + mean


def plain_errors(y, x, coef, p, q, skip):
    e = np.zeros(len(y))
    for t in range(skip, len(y)):
        line = [1.0, *x[t], *[y[t - k] for k in range(1, p + 1)], *[e[t - k] if t >= k else 0.0 for k in range(1, q + 1)]]
        e[t] = y[t] - float(np.dot(coef, line))
    return e


def table(spark, series, extra=None):
    rows = [(k, DAY + datetime.timedelta(days=i), float(v)) for k, s in series.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "k string, ds date, y double")


def test_recovers_arma():
    n = 2000
    y, known = arma.aligned([simulated(n, 0.6, 0.4, 30.0, s) for s in range(6)])
    coef, sse, e, used = arma.fit(y, known, np.zeros((6, n, 0)), 1, 1)
    phi_error = np.sqrt((1 - 0.36) * (1 + 0.24) ** 2 / (n * (1.0) ** 2))  # of ARMA(1, 1), by its information matrix
    ma_error = np.sqrt((1 - 0.16) * (1 + 0.24) ** 2 / (n * (1.0) ** 2))
    assert (np.abs(coef[:, 1] - 0.6) < 3 * phi_error).all() and (np.abs(coef[:, 2] - 0.4) < 3 * ma_error).all()
    assert abs(coef[:, 1].mean() - 0.6) < 2 * phi_error and abs(coef[:, 2].mean() - 0.4) < 2 * ma_error
    assert np.allclose(coef[:, 0] / (1 - coef[:, 1]), 30, atol=0.5) and np.allclose(sse, (e**2).sum(1))


@pytest.mark.parametrize(("p", "q", "r"), [(1, 1, 0), (2, 2, 1), (0, 1, 2), (3, 0, 1)])
def test_fit_is_a_least_sum_of_squares(p, q, r):
    random = np.random.default_rng(p + 10 * q)
    series = [simulated(n, 0.5, 0.3, 5.0, n) * 40 for n in (120, 200)]
    y, known = arma.aligned(series)
    x = np.zeros((2, 200, r))
    given = [random.normal(size=(len(s), r)) * 9 for s in series]
    for row, g in enumerate(given):
        x[row, 200 - len(g) :] = g
        y[row, 200 - len(g) :] += g.sum(1)
    coef, sse, e, used = arma.fit(y, known, x, p, q, 3)
    for row, g in enumerate(given):
        own = y[row, known[row]]
        plain = plain_errors(own, g, coef[row], p, q, 3)
        assert np.allclose(e[row, known[row]], plain, atol=1e-6) and sse[row] == pytest.approx((plain**2).sum(), rel=1e-6)
        for j in range(coef.shape[1]):  # no coefficient alone does better
            for d in (-1e-3, 1e-3):
                other = coef[row].copy()
                other[j] += d * max(abs(other[j]), 0.01)
                assert (plain_errors(own, g, other, p, q, 3) ** 2).sum() >= sse[row] * (1 - 1e-5)


def test_undifferenced_and_searched():
    coef = np.array([2.0, 0.5, 0.3])  # constant, a lag, a lagged error, of first differences
    assert np.allclose(arma.undifferenced(coef, 0, 1, 1, 4, 2), [2.0, 1.5, -0.5, 0, 0, 0.3, 0])
    series = [np.cumsum(simulated(400, 0.0, 0.6, 0.0, s)) for s in range(5)]
    orders = sorted([(p, q) for p in range(3) for q in range(2)], key=sum)
    found = arma.searched([*series, np.zeros(2)], [], orders, None, 2)
    assert [f[1][1] for f in found[:5]].count(1) >= 4 and found[5][0] is None
    for s, f in zip(series, found, strict=False):
        p, d, q = f[1]
        y, known = arma.aligned([np.diff(s, d)])
        scores = {o: float(arma.aicc(*[v for v in (arma.fit(y, known, np.zeros((1, y.shape[1], 0)), *o, 2)[1], (np.cumsum(known, 1) > 2).sum(1))], 1 + sum(o))[0]) for o in orders}
        assert scores[p, q] == min(scores.values())


@pytest.mark.parametrize(("model", "options"), [("arima_univariate", {"p": 2, "d": 1, "q": 1}), ("autoarima_univariate", {"p": 2, "q": 1})])
def test_forecasts_follow_the_recursion(spark, model, options):
    series = {"a": np.cumsum(simulated(150, 0.4, 0.5, 0.2, 1)) + 100, "b": simulated(90, 0.7, 0.0, 50.0, 2), "c": np.arange(4.0)}
    found = models.forecast(table(spark, series), P, model, 3, options).collect()
    for k in ("a", "b"):
        orders = [(2, 1)] if model == "arima_univariate" else sorted([(p, q) for p in range(3) for q in range(2)], key=sum)
        coef, order, resid, shocks = arma.searched([series[k]], [], orders, options.get("d"), options.get("d", 2))[0]
        lags = len(coef) - 2
        y, e = list(series[k]), list(shocks[::-1])
        for r in sorted((r for r in found if r["k"] == k), key=lambda r: r["ds"]):
            nxt = coef[0] + sum(c * v for c, v in zip(coef[1 : 1 + lags], y[::-1], strict=False)) + coef[-1] * e[-1]
            y.append(nxt)
            e.append(0.0)
            assert r["predictions"] == pytest.approx(nxt, rel=1e-9) and r["error"] is None
    assert [r["error"] is not None for r in found if r["k"] == "c"] == [True]


def test_forest_bands_cover(spark):
    """Half of what comes lies in the middle half of the band, with noise that grows with the level."""
    random = np.random.default_rng(5)
    series = {}
    for k in range(60):
        level = 20 + 60 * (k % 3)
        series[f"s{k}"] = level + random.normal(size=71) * level / 10
    df = table(spark, {k: v[:70] for k, v in series.items()})
    for model in ("random_forest", "lgbm"):
        found = models.forecast(df, P, model, 1, {"lags": 3, "trees": 8, "depth": 3}, samples=80).collect()
        inside = [r["lower_quantile_0.25"] <= series[r["k"]][70] <= r["upper_quantile_0.75"] for r in found]
        assert len(inside) == 60 and 0.3 < np.mean(inside) < 0.7
        width = lambda m: np.median([r["upper_quantile_0.75"] - r["lower_quantile_0.25"] for r in found if int(r["k"][1:]) % 3 == m])
        assert width(2) > 1.5 * width(0)


def test_a_class_without_a_model_is_an_error(spark):
    series = {"a": np.arange(30.0), "b": np.arange(30.0) % 5, "c": np.ones(30), "d": np.ones(30)}
    df = table(spark, series)
    classes = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, classification string")
    plans = {"x": {"model": "theta"}, "y": {"model": "croston"}, "z": {"model": "theta"}}
    found = {(r["k"], r["ds"]): r["predictions"] for r in models.forecast_by_class(df, P, classes, plans, 2).collect()}
    assert {k for k, _ in found} == {"a", "b", "c"} and len(found) == 6
    alone = {(r["k"], r["ds"]): r["predictions"] for r in models.forecast(df.where("k in ('a', 'c')"), P, "theta", 2).collect()}
    assert all(found[k] == v for k, v in alone.items())
    with pytest.raises(Exception, match="no model for class z"):
        models.forecast_by_class(df, P, classes, {k: v for k, v in plans.items() if k != "z"}, 2).collect()
