"""The state space against a dense Gaussian; its forecasts and bands."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from chronoloom import errors
from chronoloom.models import forecast as models
from chronoloom.models import statespace
from chronoloom.operators import clean
from chronoloom.series import Panel

P = Panel("k")
DAY = datetime.date(2020, 1, 1)


def dense(n, q, r):
    """Mean-0 covariance of the states (2 n) of all times, by the model's definition."""
    blocks = [[None] * n for _ in range(n)]
    p = statespace.PRIOR * np.eye(2)
    for s in range(n):
        if s:
            p = statespace.MOVE @ p @ statespace.MOVE.T + np.diag(q)
        c = p
        for t in range(s, n):
            blocks[t][s], blocks[s][t] = c, c.T
            c = statespace.MOVE @ c
    return np.block(blocks)


@pytest.mark.parametrize("missing", [[], [3, 4, 9]])
def test_filter_and_smoother_are_the_dense_gaussian(missing):
    random = np.random.default_rng(1)
    n, q, r = 12, np.array([0.3, 0.05]), 0.7
    y = np.cumsum(random.normal(size=n))
    known = ~np.isin(np.arange(n), missing)
    f = statespace.filtered((y * known)[None], known[None], q[None], np.array([r]))
    a, p, cross = (v[0] for v in statespace.smoothed(f))
    full = dense(n, q, r)
    see = np.zeros((known.sum(), 2 * n))
    see[np.arange(known.sum()), 2 * np.flatnonzero(known)] = 1
    inner = see @ full @ see.T + r * np.eye(known.sum())
    gain = full @ see.T @ np.linalg.inv(inner)
    mean, cov = gain @ y[known], full - gain @ see @ full
    assert np.allclose(a.ravel(), mean, atol=1e-4)
    for t in range(n):
        assert np.allclose(p[t], cov[2 * t : 2 * t + 2, 2 * t : 2 * t + 2], atol=1e-4)
        if t:
            assert np.allclose(cross[t], cov[2 * t : 2 * t + 2, 2 * t - 2 : 2 * t], atol=1e-4)
    sign, size = np.linalg.slogdet(2 * np.pi * inner)
    assert f["likelihood"][0] == pytest.approx(-0.5 * (size + y[known] @ np.linalg.solve(inner, y[known])), rel=1e-8)


def test_rounds_gain_and_find_variances():
    random = np.random.default_rng(3)
    n = 600
    slope = np.cumsum(random.normal(size=(4, n)) * 0.02, 1)
    level = np.cumsum(slope + random.normal(size=(4, n)) * 0.3, 1)
    y = level + random.normal(size=(4, n))
    known = np.ones((4, n), bool)
    known[1, :200] = False  # a shorter series in the batch
    before = -np.inf
    for rounds in (1, 5, 20, 60):
        q, r, f = statespace.estimated(y * known, known, rounds)
        assert (f["likelihood"] >= before - 1e-6).all()
        before = f["likelihood"]
    assert np.allclose(r, 1.0, atol=0.3) and np.allclose(q[:, 0], 0.09, atol=0.09)
    alone, _, _ = statespace.estimated(y[1:2, 200:], known[1:2, 200:], 60)
    assert np.allclose(alone[0], q[1], rtol=1e-6)


def test_forecasts_with_a_slope(spark):
    random = np.random.default_rng(4)
    rows = [("line", DAY + datetime.timedelta(days=i), None if i in (5, 6) else 3.0 * i + random.normal() * 0.1) for i in range(60)]
    rows += [("noise", DAY + datetime.timedelta(days=i), float(random.normal(100, 5))) for i in range(200)] + [("short", DAY, 1.0)] + [("gap", DAY + datetime.timedelta(days=2 * i), 1.0 * i) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    found = models.forecast(df, P, "kalman", 3, {"slope": True}, samples=10, lower=0.1, upper=0.9).collect()
    line = sorted((r for r in found if r["k"] == "line"), key=lambda r: r["ds"])
    assert [r["predictions"] for r in line] == pytest.approx([180, 183, 186], abs=1) and line[0]["ds"] == DAY + datetime.timedelta(days=60)
    noise = next(r for r in found if r["k"] == "noise")
    assert 8 < noise["upper_quantile_0.9"] - noise["lower_quantile_0.1"] < 20
    assert {r["k"] for r in found if r["error"]} == {"short", "gap"}
    with pytest.raises(errors.CovariateError):
        models.forecast(df, P, "kalman", 1, {"slope": True}, df)


def test_a_misspelt_interpolation_is_an_error(spark):
    df = spark.createDataFrame([("a", DAY, 1.0)], "k string, ds date, y double")
    with pytest.raises(errors.OptionError):
        clean.interpolated(df, P, "lineer")
    assert clean.interpolated(df, P, "cubic").count() == 1
