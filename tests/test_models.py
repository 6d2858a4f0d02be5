"""Estimators, covariates, options, reconciliation's front end, detectors and settings, on small panels."""

from __future__ import annotations

import datetime
import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom import settings
from chronoloom.errors import ColumnNamesError, CovariateNamesError, EstimatorError, FrameTypeError, FrequencyError, HierarchyError, LagsError, LengthError, OptionError, QuantilesError, SeriesError, StepsError
from chronoloom.functions import dates, features
from chronoloom.models.forecast import forecast, model_info
from chronoloom.models.regressor import regressed
from chronoloom.operators import clean, hierarchy, outliers
from chronoloom.series import Panel
from chronoloom.sources import as_frames, first_series

P = Panel("k")
DAY = datetime.date(2024, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


class Least:
    def fit(self, x, y):
        self.coef = np.linalg.lstsq(np.column_stack((np.ones(len(x)), x)), y, rcond=None)[0]

    def predict(self, x):
        return self.coef[0] + x @ self.coef[1:]


class Failing(Least):
    def fit(self, x, y):
        if y.max() > 900:
            raise RuntimeError("too large")
        super().fit(x, y)


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(3)
    rows = [("a", day(i), float(50 + i + 5 * np.sin(i) + r.normal())) for i in range(60)] + [("b", day(i), float(i % 7)) for i in range(40)]
    rows += [("gap", day(i), 1.0) for i in (0, 1, 3)] + [("null", day(i), None if i == 8 else float(i)) for i in range(12)] + [("short", day(0), 1.0)]
    return spark.createDataFrame(rows, "k string, ds date, y double")


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(day(i), float(i % 3), i % 2 == 0) for i in range(70)], "ds date, x double, odd boolean")


def by_key(df):
    out = {}
    for r in df.orderBy("k", "ds").collect():
        out.setdefault(r["k"], []).append(r)
    return out


def test_any_estimator(spark, panel, known):
    plain = by_key(forecast(panel, P, "regressor", 3, {"lags": 2}))
    mine = by_key(forecast(panel, P, "regressor", 3, {"lags": 2, "estimator": Least()}))
    for k in ("a", "b"):
        assert [r["ds"] for r in mine[k]] == [r["ds"] for r in plain[k]]
        assert np.allclose([r["predictions"] for r in mine[k]], [r["predictions"] for r in plain[k]])
    assert {k: mine[k][0]["error"] for k in ("gap", "null")} == {"gap": "series with gaps or duplicates", "null": "series with nulls"}
    both = by_key(regressed(panel, P, Least(), 2, 3, known, {"top": (max, 4)}, interval=(0.1, 0.9)))
    assert all(r["lower_quantile_0.1"] < r["predictions"] < r["upper_quantile_0.9"] for r in both["a"]) and len(both["a"]) == 3
    short = known.where(F.col("ds") <= day(61))
    assert by_key(regressed(panel, P, Least(), 2, 3, short))["a"][0]["error"].startswith("covariates")
    huge = panel.union(spark.createDataFrame([("c", day(i), 1000.0 + i) for i in range(20)], panel.schema))
    out = by_key(regressed(huge, P, Failing(), 2))
    assert out["c"][0]["type_error"] == "RuntimeError" and out["a"][0]["error"] is None


def test_wrong_options(panel, known):
    for error, call in (
        (LagsError, lambda: regressed(panel, P, Least(), 0)),
        (StepsError, lambda: regressed(panel, P, Least(), 2, 0)),
        (EstimatorError, lambda: regressed(panel, P, Least, 2)),
        (OptionError, lambda: regressed(panel, P, Least(), 5, rolling={"m": (np.mean, 3)})),
        (QuantilesError, lambda: regressed(panel, P, Least(), 2, interval=(0.9, 0.1))),
        (CovariateNamesError, lambda: regressed(panel, P, Least(), 2, covariates=known.drop("ds"))),
        (OptionError, lambda: forecast(panel, P, "arima", 1, {"p": 1, "zzz": 1})),
        (OptionError, lambda: forecast(panel, P, "theta", 1, {"season": 0})),
        (StepsError, lambda: forecast(panel, P, "theta", 0)),
        (OptionError, lambda: clean.cleansed(panel, P, interpolation={"axis2": 1})),
    ):
        with pytest.raises(error):
            call()


@pytest.mark.parametrize("model", ["random_forest", "lgbm", "kalman", "prophet", "regressor", "arima"])
def test_covariates(panel, known, model):
    assert model_info()[model]["covariates"]
    options = {"trees": 2, "depth": 2, "lags": 3} if model in ("random_forest", "lgbm") else {"p": 2} if model == "arima" else {"lags": 3} if model == "regressor" else {}
    numbers = known.select("ds", "x", F.col("odd").cast("int").alias("odd"))
    out = by_key(forecast(panel, P, model, 2, options, numbers))
    assert [r["ds"] for r in out["a"]] == [day(60), day(61)] and all(np.isfinite(r["predictions"]) for r in out["a"])
    assert all(out[k][0]["error"] for k in ("gap", "null", "short"))
    other = numbers.where(F.col("ds") != day(61)).union(numbers.where(F.col("ds") == day(69)))  # as many dates, not the right ones
    assert by_key(forecast(panel, P, model, 2, options, other))["a"][0]["error"] == "covariates do not cover the horizon"


def test_seasons_and_errors(spark):
    rows = [("s", day(i), 100.0 + 2 * i + (30.0, 0.0, -10.0, -20.0)[i % 4]) for i in range(48)]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    want = [100.0 + 2 * i + (30.0, 0.0, -10.0, -20.0)[i % 4] for i in range(48, 54)]
    for model in ("exponential_smoothing", "theta", "four_theta"):
        got = [r["predictions"] for r in by_key(forecast(df, P, model, 6, {"season": 4}))["s"]]
        assert np.allclose(got, want, atol=8), (model, got)
    r = np.random.default_rng(1)
    e = r.normal(size=3000)
    y = [float(e[i] + 0.8 * e[i - 1]) for i in range(1, 3000)]
    ma = spark.createDataFrame([("m", day(i), v) for i, v in enumerate(y)], "k string, ds date, y double")
    one = by_key(forecast(ma, P, "arima_univariate", 1, {"p": 1, "d": 0, "q": 2}))["m"][0]["predictions"]
    assert abs(one - 0.8 * e[-1]) < 0.35


def test_first_series(panel):
    assert {r["k"] for r in first_series(panel, P).collect()} == {"a"}
    with pytest.raises(SeriesError):
        forecast(panel.where("k <> 'a' and k <> 'b'"), P, "theta", dry_run=True)
    assert forecast(panel, P, "theta", dry_run=True).count() == 5
    assert as_frames(panel) is panel and as_frames([panel, [panel]]) == [panel, panel]
    with pytest.raises(FrameTypeError):
        as_frames([1])


def test_date_checks(spark):
    df = spark.createDataFrame([("a", day(i), 1.0) for i in range(60)], "k string, ds date, y double")
    assert dates.with_features(df, "ds", ["week", "dayofweek"], P).count() == 60
    with pytest.raises(LengthError):
        dates.with_features(df, "ds", ["month"], P)
    with pytest.raises(FrequencyError):
        dates.with_polar(df, "ds", ["hour"], P)
    with pytest.raises(FrequencyError):
        dates.checked(df, Panel("k", freq="7D"), ["dayofweek"])
    with pytest.raises(FrequencyError):
        dates.checked(df.where(F.col("ds") != day(5)), P, ["week"])
    with pytest.raises(OptionError):
        dates.checked(df, P, ["eon"])


def test_reconciliation_front_end(spark):
    tree = hierarchy.Hierarchy(spark.createDataFrame([("x", "g"), ("y", "g"), ("z", "h")], "item string, grp string"), {"item": "grp", "grp": "total"}, "item", "local", "ds", "y")
    base = {"x": 1.0, "y": 2.0, "z": 4.0, "g|grp": 3.5, "h|grp": 4.5, "total": 9.0}
    past = spark.createDataFrame([("l", day(i), c, v + i * i) for i in range(5) for c, v in base.items()], "local string, ds date, code string, y double")
    ahead = spark.createDataFrame([("l", day(i), c, v) for i in (5, 6) for c, v in base.items()], "local string, ds date, code string, predictions double")
    with pytest.raises(HierarchyError):
        tree.reconciliation(past, ahead.withColumn("ds", F.date_sub("ds", 3)))
    with pytest.raises(ColumnNamesError):
        tree.reconciliation(past.drop("ds"), ahead)
    codes = list(base)
    s = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 0, 1], [1, 1, 1]], float)
    errors = np.array([2 * i - 1.0 for i in range(1, 5)])
    for method, w in (("ols", np.ones(6)), ("wls_struct", s.sum(1)), ("wls_var", np.full(6, (errors**2).mean()))):
        inverse = np.diag(1 / w)
        want = s @ np.linalg.inv(s.T @ inverse @ s) @ s.T @ inverse @ np.array([base[c] for c in codes])
        got = {(r["code"] if r["code_type"] in ("item", "total") else f"{r['code']}|{r['code_type']}"): r["y"] for r in tree.reconciliation(past, ahead, method).where(F.col("ds") == day(5)).collect()}
        assert np.allclose([got[c] for c in codes], want), method
    assert tree.reconciliation(past, ahead, "mint_cov").count() == 12
    assert {r["code"] for r in tree.named(ahead.drop("code")).collect()} == {"total"}


def test_detectors(spark, panel):
    r = np.random.default_rng(2)
    y = np.cumsum(r.normal(size=300))
    y[150] += 30
    walk = spark.createDataFrame([("w", day(i), float(v)) for i, v in enumerate(y)], "k string, ds date, y double")
    found = {r["ds"] for r in outliers.residual(walk, P, 3.0, order=3, search=True, difference=True).where("inlier = -1").collect()}
    assert found & {day(150), day(151)}
    noise = spark.createDataFrame([("n", day(i), float(v)) for i, v in enumerate(r.normal(size=300))], "k string, ds date, y double")
    plain = spark.createDataFrame([("w", day(i), float(i + v)) for i, v in enumerate(np.cumsum(r.normal(size=300)))], "k string, ds date, y double")
    for lags in (0, 2):
        assert not outliers.stationary(plain, P, lags=lags).first()["stationary"] and outliers.stationary(noise, P, lags=lags).first()["stationary"]
    sales = spark.createDataFrame([("s", day(i), 10.0 + i % 3 + (500.0 if i == 40 else 0.0), 20.0) for i in range(80)], "k string, ds date, y double, amount double")
    fixed = {r["ds"]: r for r in outliers.corrected(sales, P, amount="amount").collect()}
    assert [d for d, r in fixed.items() if r["outlier"]] == [day(40)] and fixed[day(40)]["y"] < 100 and fixed[day(40)]["amount"] < 4 and fixed[day(3)]["amount"] == 20.0
    scaled = {r["ds"]: r for r in outliers.capped(sales, P, amount="amount").collect()}
    assert abs(scaled[day(40)]["amount"] - 20 * scaled[day(40)]["capped"] / 511) < 1e-9


def test_polynomials_of_any_degree(spark):
    df = spark.createDataFrame([("a", day(i), 0.0) for i in range(12)] + [("b", day(0), 0.0)], "k string, ds date, y double")
    rows = features.polynomials(df, P, 6).where("k = 'a'").orderBy("ds").collect()
    q = np.array([[r[f"p{d}"] for d in range(1, 7)] for r in rows])
    assert np.allclose(q.T @ q, np.eye(6)) and np.allclose(q.sum(0), 0)
    with pytest.raises(OptionError):
        features.polynomials(df, P, 0)


def test_settings_and_log(monkeypatch, tmp_path):
    monkeypatch.setenv("CHRONOLOOM_AS_JSON", "true")
    monkeypatch.setenv("CHRONOLOOM_FILE", str(tmp_path / "log"))
    found = settings.Settings.from_environment()
    assert found.as_json and found.level == "INFO"
    settings.log(settings.Settings("DEBUG", found.file, True))
    assert settings.traced(lambda x: x + 1)(1) == 2
    with pytest.raises(ZeroDivisionError):
        settings.traced(lambda: 1 / 0)()
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert lines[0]["seconds"] >= 0 and lines[1]["error"] == "ZeroDivisionError"
    for handler in logging.getLogger("chronoloom").handlers[:]:
        handler.close()
        logging.getLogger("chronoloom").removeHandler(handler)
