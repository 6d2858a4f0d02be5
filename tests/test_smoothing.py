"""The penalised smoother against a dense least-squares solve."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.functions import features, smoothing
from chronoloom.series import Panel

DAY = datetime.date(2022, 5, 1)


@pytest.fixture(scope="module")
def table():
    """A wave with noise, a line, gaps, one value, two, nulls alone, a null key."""
    r = np.random.default_rng(3)
    out = {"wave": 1e4 + 50 * np.sin(np.arange(300) / 40) + r.normal(0, 9, 300), "line": 3.0 * np.arange(60) - 7, "gaps": np.where(r.random(80) < 0.3, np.nan, r.normal(5, 2, 80)), "one": np.array([4.0]), "two": np.array([4.0, 6.0]), "none": np.full(6, np.nan), None: r.normal(0, 1, 50)}
    return out


@pytest.fixture(scope="module")
def frame(spark, table):
    rows = [(k, DAY + datetime.timedelta(days=i), None if np.isnan(v) else float(v)) for k, values in table.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ds date, y double").repartition(3)


def design(n, pieces):
    """Cubic B-splines at n places, by the recurrence over knots."""
    u = np.arange(n) * pieces / max(n - 1, 1)
    knots = np.arange(-3, pieces + 4).astype(float)
    b = ((u[:, None] >= knots[:-1]) & (u[:, None] < knots[1:])).astype(float)
    b[u == pieces] = 0
    b[u == pieces, pieces + 2] = 1  # the last place ends the last piece
    for d in range(1, 4):
        b = (u[:, None] - knots[: -d - 1]) / d * b[:, :-1] + (knots[d + 1 :] - u[:, None]) / d * b[:, 1:]
    return b


def curve(values, pieces, penalty):
    known = ~np.isnan(values)
    b = design(len(values), pieces)
    d = np.sqrt(penalty) * np.diff(np.eye(pieces + 3), 2, axis=0)
    mean = values[known].mean()
    c = np.linalg.lstsq(np.vstack((b[known], d)), np.concatenate((values[known] - mean, np.zeros(len(d)))), rcond=None)[0]
    return mean + b @ c


@pytest.mark.parametrize("block", [0, 50])
@pytest.mark.parametrize(("pieces", "penalty"), [(10, 2.5), (4, 0.1), (1, 1.0)])
def test_dense_solve(frame, table, block, pieces, penalty):
    out = {}
    for r in smoothing.smoothed(frame, Panel("k", block=block), pieces, penalty).orderBy("ds").collect():
        out.setdefault(r["k"], []).append(r["trend"])
    for k, values in table.items():
        if k == "none":
            assert out[k] == [None] * 6
        else:
            np.testing.assert_allclose(out[k], curve(values, pieces, penalty), rtol=1e-8, atol=1e-8, err_msg=str(k))


def test_chosen_penalty(frame, table):
    out = smoothing.smoothed(frame, Panel("k"))
    got = {k: [r["trend"] for r in out.where(F.col("k") == k).orderBy("ds").collect()] for k in ("wave", "line")}
    np.testing.assert_allclose(got["line"], table["line"], atol=1e-6)
    true = 1e4 + 50 * np.sin(np.arange(300) / 40)
    assert np.abs(got["wave"] - true).mean() < 3  # a third of the noise

    def score(penalty):
        b, y = design(300, 10), table["wave"]
        d = np.diff(np.eye(13), 2, axis=0)
        hat = b @ np.linalg.solve(b.T @ b + penalty * d.T @ d, b.T)
        return 300 * ((y - hat @ y) ** 2).sum() / (300 - np.trace(hat)) ** 2

    best = min((30 * g for g in smoothing.GRID), key=score)
    np.testing.assert_allclose(got["wave"], curve(table["wave"], 10, best), rtol=1e-8)


def test_features(frame):
    out = {r["k"]: r for r in features.featurized(frame.where("k in ('wave', 'line')"), Panel("k"), smoother="spline").collect()}
    assert out["line"]["trend"] > 0.999999 and 0.5 < out["wave"]["trend"] < 1
    assert abs(out["line"]["curvature"]) < 1e-4 < out["line"]["linearity"]
    for bad in ({"smoother": "none"}, {"width": 1}):
        with pytest.raises(OptionError):
            features.featurized(frame, Panel("k"), **bad)
    with pytest.raises(OptionError):
        smoothing.smoothed(frame, Panel("k"), 0)
