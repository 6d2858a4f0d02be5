"""Reconciliation by a shrunk covariance over the tree against the dense formula."""

from __future__ import annotations

import datetime

import numpy as np
import pytest

from chronoloom.errors import OptionError
from chronoloom.operators.hierarchy import Hierarchy, intensity

PARENTS = {"item": "mid", "mid": "total"}
MID = {"a": "m1", "b": "m1", "c": "m2", "d": "m2", "e": "m2"}
CODES = [*MID, "m1|mid", "m2|mid", "total"]
SUMS = np.vstack((np.eye(5), [[1, 1, 0, 0, 0], [0, 0, 1, 1, 1], [1, 1, 1, 1, 1]]))
DAY = datetime.date(2023, 1, 1)


@pytest.fixture(scope="module")
def errors():
    """Correlated errors of two places; one node of the second does not err at all."""
    r, out = np.random.default_rng(5), {}
    for place in ("x", "y"):
        mix = r.normal(0, 1, (8, 8)) * np.arange(1, 9)
        out[place] = r.normal(2, 1, (40, 8)) @ mix
    out["y"][:, 3] = 1.0
    return out


@pytest.fixture(scope="module")
def ahead():
    r = np.random.default_rng(6)
    return {place: r.normal(100, 20, (3, 8)) for place in ("x", "y")}


def rows(spark, values, start, extra=()):
    out = [(p, DAY + datetime.timedelta(days=start + t), c, float(v)) for p, table in values.items() for t, line in enumerate(table) for c, v in zip(CODES, line, strict=True)]
    return spark.createDataFrame([*out, *extra], "local string, ds date, code string, y double").repartition(3)


def tree(spark, parents=PARENTS):
    return Hierarchy(spark.createDataFrame(list(MID.items()), "item string, mid string"), parents, "item", "local", "ds", "y")


def by_place(df):
    return {(r["local"], r["ds"], r["code"]): r["y"] for r in df.collect()}


def plain_intensity(z):
    t, n = z.shape
    noise = squares = 0.0
    for i in range(n):
        for j in range(n):
            if i != j and z[:, i].any() and z[:, j].any():
                w = z[:, i] * z[:, j]
                noise += t / (t - 1) ** 3 * ((w - w.mean()) ** 2).sum()
                squares += w.mean() ** 2
    return min(max(noise / squares, 0), 1)


@pytest.mark.parametrize("shrinkage", [None, 0.3, 1.0, 0.0])
def test_dense_formula(spark, errors, ahead, shrinkage):
    late = [("x", DAY + datetime.timedelta(days=90), "a", 5.0)]  # a time with the error of one node only
    out = by_place(tree(spark).reconciled(rows(spark, ahead, 100), "mint_shrink", rows(spark, errors, 0, late), shrinkage))
    assert len(out) == 2 * 3 * 8
    for place, e in errors.items():
        x = e - e.mean(0)
        variances = np.maximum((x**2).mean(0), 1e-12)
        z = x / np.sqrt(variances)
        share = max(plain_intensity(z) if shrinkage is None else shrinkage, 1e-4)
        inverse = np.linalg.inv(share * np.diag(variances) + (1 - share) * x.T @ x / len(x))
        fit = SUMS @ np.linalg.solve(SUMS.T @ inverse @ SUMS, SUMS.T @ inverse)
        for h, y in enumerate(ahead[place]):
            got = [out[place, DAY + datetime.timedelta(days=100 + h), c] for c in CODES]
            np.testing.assert_allclose(got, fit @ y, rtol=1e-6)
            np.testing.assert_allclose(SUMS @ got[:5], got, rtol=1e-8)


def test_intensity(errors):
    for e in errors.values():
        x = e - e.mean(0)
        z = x / np.sqrt(np.maximum((x**2).mean(0), 1e-12))
        assert abs(intensity(z @ z.T, (z**4).sum(), z.any(0).sum()) - plain_intensity(z)) < 1e-9
    noise = np.random.default_rng(1).normal(0, 1, (12, 30))
    z = (noise - noise.mean(0)) / noise.std(0)
    assert 0.5 < intensity(z @ z.T, (z**4).sum(), 30) <= 1 and intensity(np.ones((1, 1)), 1.0, 1) == 1.0


def test_one_matrix_where_levels_branch(spark, errors, ahead):
    """Levels side by side have no chain; then a local's matrix is dense, with the same shrinkage."""
    side = tree(spark, {"item": "total", "mid": "total"})
    assert side.chain() is None
    args = rows(spark, ahead, 100), "mint_shrink", rows(spark, errors, 0), 0.4
    got, plain = by_place(side.reconciled(*args)), by_place(tree(spark).reconciled(*args))
    assert got.keys() == plain.keys()
    for k in got:
        if k[0] == "x":
            assert abs(got[k] - plain[k]) < 1e-6 * abs(plain[k])


def test_options(spark, ahead):
    with pytest.raises(OptionError):
        tree(spark).reconciled(rows(spark, ahead, 100), "mint_shrink")
    with pytest.raises(OptionError):
        tree(spark).reconciled(rows(spark, ahead, 100), "ols", shrinkage=2.0)
