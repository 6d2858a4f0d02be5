"""Interpolation with its limits against pandas, and the cubic spline against a dense solve."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from chronoloom.errors import OptionError
from chronoloom.operators import clean
from chronoloom.series import Panel

DAY = datetime.date(2021, 3, 1)
PLAIN, BLOCKED = Panel("k"), Panel("k", block=40)


@pytest.fixture(scope="module")
def table():
    """Series with leading and trailing nulls, long gaps, two values, one, none, and a null key."""
    r, out = random.Random(8), []
    for k, n, share in (("long", 300, 0.5), ("gaps", 60, 0.8), ("full", 20, 0.0), ("pair", 9, None), (None, 30, 0.4), ("none", 5, 1.0)):
        for i in range(n):
            known = i in (3, 6) if share is None else r.random() >= share and (k != "long" or 7 <= i < 290)
            out.append((k, DAY + datetime.timedelta(days=i), round(r.gauss(10, 4), 3) if known else None))
    return out


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table, "k string, ds date, y double").repartition(3)


def by_key(rows):
    out = {}
    for k, t, y in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        out.setdefault(k, []).append(np.nan if y is None else y)
    return out


@pytest.mark.parametrize("panel", [PLAIN, BLOCKED], ids=["plain", "blocks"])
@pytest.mark.parametrize(("limit", "direction", "area"), [(None, "backward", None), (2, "both", None), (None, "both", "outside"), (3, "forward", "inside"), (1, "backward", "outside"), (None, None, None)])
def test_limits_as_in_pandas(frame, table, panel, limit, direction, area):
    out = by_key(clean.interpolated(frame, panel, "linear", limit, direction, area).collect())
    for k, values in by_key(table).items():
        plain = pd.Series(values, dtype=float).interpolate("linear", limit=limit, limit_direction=direction or "forward", limit_area=area)
        np.testing.assert_allclose(out[k], plain, rtol=1e-12, err_msg=str(k))


def dense(x, y, at):
    """The spline as one system of equations: values, slopes and bends meet, and the third derivative at the outer inner knots."""
    n = len(x) - 1
    rows, right = [], []

    def row(value, *parts):
        r = np.zeros(4 * n)
        for piece, terms in parts:
            r[4 * piece : 4 * piece + 4] += terms
        rows.append(r)
        right.append(value)

    for p in range(n):
        h = x[p + 1] - x[p]
        row(y[p], (p, [1, 0, 0, 0]))
        row(y[p + 1], (p, [1, h, h * h, h**3]))
        if p + 1 < n:
            row(0, (p, [0, 1, 2 * h, 3 * h * h]), (p + 1, [0, -1, 0, 0]))
            row(0, (p, [0, 0, 2, 6 * h]), (p + 1, [0, 0, -2, 0]))
    row(0, (0, [0, 0, 0, 1]), (1, [0, 0, 0, -1]))
    row(0, (n - 2, [0, 0, 0, 1]), (n - 1, [0, 0, 0, -1]))
    c = np.linalg.solve(np.array(rows), np.array(right)).reshape(n, 4)
    p = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 1)
    d = at - x[p]
    return c[p, 0] + d * (c[p, 1] + d * (c[p, 2] + d * c[p, 3]))


@pytest.mark.parametrize("panel", [PLAIN, BLOCKED], ids=["plain", "blocks"])
def test_spline_against_dense_solve(frame, table, panel):
    out = by_key(clean.interpolated(frame, panel, "cubic").collect())
    for k, values in by_key(table).items():
        v = np.array(values)
        x = np.flatnonzero(~np.isnan(v))
        plain = v.copy()
        if len(x):
            inner = np.arange(x[0], x[-1] + 1)
            plain[inner] = dense(x.astype(float), v[x], inner.astype(float)) if len(x) > 3 else np.interp(inner, x, v[x])
        np.testing.assert_allclose(out[k], plain, rtol=1e-8, atol=1e-8, err_msg=str(k))


def test_options(frame):
    for method, options in (("linear", {"limit_direction": "up"}), ("pad", {"limit_direction": "both"}), ("bfill", {"limit_direction": "forward"}), ("linear", {"limit_area": "edge"}), ("linear", {"limit": 0})):
        with pytest.raises(OptionError):
            clean.interpolated(frame, PLAIN, method, **options)
    cleansed = clean.cleansed(frame.where("k = 'gaps'"), PLAIN, "mean", "zero", {"method": "cubic", "limit_direction": "both", "limit": 2})
    assert cleansed.count() > 0
