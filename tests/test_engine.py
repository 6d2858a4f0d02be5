"""Golden cases of the engine's operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoloom import errors
from chronoloom.functions import dates, lags, metrics
from chronoloom.models import forecast as models
from chronoloom.models.intervals import bootstrap_interval
from chronoloom.operators import clean, demand, hierarchy, outliers, rollup
from chronoloom.series import Panel
from chronoloom.sources import read_panel
from chronoloom.streaming import streamed

P = Panel("k")
DAY = dt.date(2024, 1, 1)


def series(spark, values, key="a", start=DAY, step=1):
    rows = [(key, start + dt.timedelta(days=i * step), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ds date, y double")


def values(df):
    return [r["y"] for r in df.orderBy("k", "ds").collect()]


def test_panel_errors(spark):
    with pytest.raises(errors.OptionError):
        Panel("k", freq="Q")
    df = series(spark, [1])
    with pytest.raises(errors.ColumnNamesError):
        Panel("nope").checked(df)
    with pytest.raises(errors.ColumnTypeError):
        Panel("k", target="k").checked(df)
    assert Panel("k", freq="0.5H").seconds == 1800 and Panel(["a", "b"]).keys == ("a", "b")


@pytest.mark.parametrize("how,want", [("sum", [6, 0, 0]), ("mean", [2, None, None]), ("median", [2, None, None]), ("mode", [1, None, None])])
def test_duplicates_and_calendar(spark, how, want):
    rows = [("a", DAY, v) for v in (1.0, 1.0, 4.0)] + [("a", DAY + dt.timedelta(2), None)]
    if how != "sum":
        rows[1] = ("a", DAY, 2.0 if how in ("mean", "median") else 1.0)
        rows[2] = ("a", DAY, 3.0 if how in ("mean", "median") else 4.0)
    out = values(clean.completed(clean.deduplicated(spark.createDataFrame(rows, "k string, ds date, y double"), P, how), P))
    # a day without rows is a gap; a day of nulls alone sums to 0
    assert out == ([6, None, 0] if how == "sum" else want)


@pytest.mark.parametrize("limit", [None, 1, 2, 5])
def test_interpolation_like_pandas(spark, limit):
    random = np.random.default_rng(3)
    for seed in range(4):
        y = np.where(random.random(25) < 0.5, np.nan, random.normal(size=25))
        y[random.integers(0, 25)] = 1.0
        want = pd.Series(y).interpolate(method="linear", limit=limit)
        got = values(clean.interpolated(series(spark, [None if v != v else v for v in y]), P, limit=limit))
        assert np.allclose(np.array(got, float), want, equal_nan=True), seed


def test_other_interpolations(spark):
    df = series(spark, [None, 1, None, None, 4, None])
    assert values(clean.interpolated(df, P, "pad")) == [None, 1, 1, 1, 4, 4]
    assert values(clean.interpolated(df, P, "bfill")) == [1, 1, 4, 4, 4, None]
    assert values(clean.interpolated(df, P, "nearest")) == [None, 1, 1, 4, 4, None]


def test_pads(spark):
    df = series(spark, [2, 3])
    back, ahead = str(DAY - dt.timedelta(2)), str(DAY + dt.timedelta(3))
    assert values(clean.padded(df, P, zero_back_to=back)) == [0, 0, 2, 3]
    assert values(clean.padded(df, P, repeat_back_to=back)) == [2, 2, 2, 3]
    assert values(clean.padded(df, P, repeat_forward_to=ahead)) == [2, 3, 3, 3]
    assert values(clean.padded(df, P, zero_back_to=ahead)) == [2, 3]
    assert values(clean.padded(series(spark, [5]), P, repeat_back_to=back, repeat_forward_to=ahead)) == [5] * 6
    with pytest.raises(errors.OptionError):
        clean.padded(df, P, zero_back_to=back, repeat_back_to=back)


def test_hourly(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 10), 1.0), ("a", dt.datetime(2024, 1, 1, 2, 50), 3.0)]
    df = spark.createDataFrame(rows, "k string, ds timestamp_ntz, y double")
    out = clean.cleansed(df, Panel("k", freq="H"), "sum", "mean", {"method": "linear"}).orderBy("ds").collect()
    assert [(r["ds"].hour, r["y"]) for r in out] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_outlier_takes_all_rows_of_its_time(spark):
    rows = [("a", DAY + dt.timedelta(i), float(i % 5)) for i in range(30)] + [("a", DAY + dt.timedelta(3), 1e6)]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    out = values(clean.cleansed(df, P, "sum", "zero", outlier="iqr"))
    assert out[3] == 0 and max(out) < 10


@pytest.mark.parametrize("method", sorted(outliers.METHODS))
def test_detectors_find_spikes(spark, method):
    random = np.random.default_rng(0)
    y = [*random.integers(0, 99, 100).tolist(), 10_000, 20_000]
    out = outliers.marked(series(spark, y), P, method).where("inlier = -1")
    found = [r["y"] for r in out.collect()]
    assert {10_000, 20_000} & set(found)
    if method in ("iqr", "modified_zscore"):
        assert sorted(found) == [10_000, 20_000]


def test_grubbs(spark):
    # critical values of published tables at 0.05, two-sided
    for n, want in ((10, 2.290), (30, 2.908), (100, 3.384)):
        random = np.random.default_rng(n)
        y = random.normal(size=n)
        row = outliers.grubbs(series(spark, y.tolist()), P).first()
        assert abs(row["critical"] - want) < 0.002 and math.isclose(row["statistic"], np.abs(y - y.mean()).max() / y.std(ddof=1), rel_tol=1e-9)
    assert outliers.grubbs(series(spark, [1, 2] * 20 + [500]), P).first()["outlier"]
    assert not outliers.grubbs(series(spark, [1, 1]), P).first()["outlier"]


def test_custom_rolling_predictor(spark):
    out = lags.lagged(series(spark, [1, 2, 4, 8, 16]), P, 2, {"spread": (lambda a: F.array_max(a) - F.array_min(a), 3)}).orderBy("ds").collect()
    assert [r["rolling_spread"] for r in out] == [3, 6]


def test_dbscan_clusters(spark):
    df = series(spark, [0, 0.5, 1, 10, 10.5, 11, 50])
    out = {r["y"]: r["cluster"] for r in outliers.dbscan(df, P, 1.0, 2).collect()}
    assert out == {0: 0, 0.5: 0, 1: 0, 10: 1, 10.5: 1, 11: 1, 50: -1}


def test_all_null_series(spark):
    df = series(spark, [1, 2]).union(series(spark, [None, None], "b"))
    with pytest.raises(Exception, match="series without values"):
        clean.cleansed(df, P).collect()
    assert {r["k"] for r in clean.cleansed(df, P, on_all_null="drop").collect()} == {"a"}


@pytest.mark.parametrize(
    "y,step,want",
    [([5] * 20, 1, "Smooth"), ([0] * 20, 1, "Zero"), ([1] * 10, 7, "Intermittent"), ([1] * 9 + [500], 7, "Lumpy"), ([1] * 19 + [500], 1, "Erratic"), ([3], 1, "Zero"), ([1, -1], 1, "Erratic")],
)
def test_demand(spark, y, step, want):
    assert demand.classified(series(spark, y, step=step), P).first()["classification"] == want


def test_weekly(spark):
    df = series(spark, range(100), start=dt.date(2022, 1, 1))  # a Saturday
    out = rollup.weekly(df, P).orderBy("ds").collect()
    assert out[0]["ds"] == dt.date(2021, 12, 27) and sum(r["y"] for r in out) == sum(range(100))
    for bad in (series(spark, [1, None] * 5), series(spark, [1] * 8, step=2), series(spark, [1] * 3)):
        with pytest.raises(Exception, match="series with"):
            rollup.weekly(bad, P).collect()
    with pytest.raises(errors.OptionError):
        rollup.weekly(df, P, "XXX")


def test_lags(spark):
    out = lags.lagged(series(spark, [1, 2, 3, 4, 5]), P, 3).orderBy("ds").collect()
    assert [tuple(r)[2:] for r in out] == [(4, 3, 2, 1), (5, 4, 3, 2)]
    with pytest.raises(errors.OptionError):
        lags.lagged(series(spark, [1]), P, 1.5)
    with pytest.raises(errors.OptionError):
        lags.lagged(series(spark, [1]), P, 3, {"mean": 2})
    cover = spark.createDataFrame([(DAY + dt.timedelta(i), i % 2 == 0) for i in range(4)], "ds date, B boolean")
    assert [r["B"] for r in lags.lagged(series(spark, [1, 2, 3, 4]), P, 2, covariates=cover).orderBy("ds").collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="without covariates"):
        lags.lagged(series(spark, [1, 2, 3, 4, 5]), P, 2, covariates=cover).collect()


def test_metrics_of_zeros(spark):
    df = series(spark, [0] * 10).withColumn("p", F.lit(0.0))
    row = metrics.evaluated(df, "y", "p", ["k"], "ds", "all").first().asDict()
    assert all(math.isclose(row[m], 1.0 if m == "mda" else 0.0, abs_tol=1e-12) for m in metrics.METRICS), row
    assert len(metrics.METRICS) == 31
    with pytest.raises(errors.OptionError):
        metrics.evaluated(df, "y", "p", ["k"], "ds", ["nope"])


def test_dates(spark):
    df = series(spark, [1] * 400)
    out = dates.with_polar(dates.with_features(df, "ds", ["month", "week", "dayofweek"]), "ds", ["month", "dayofmonth"]).collect()
    assert {r["month"] for r in out} == set(range(1, 13)) and {r["week"] for r in out} == {0, 1, 2} and {r["dayofweek"] for r in out} == set(range(7))
    assert all(abs(r["sin_month"] ** 2 + r["cos_month"] ** 2 - 1) < 1e-9 for r in out)
    with pytest.raises(errors.OptionError):
        dates.feature("nope", "ds")


def tree(spark):
    master = spark.createDataFrame([("i1", "a", "x"), ("i2", "a", "x"), ("i3", "b", "x"), ("i4", "c", "y")], "item string, h2 string, h1 string")
    return hierarchy.Hierarchy(master, {"item": "h2", "h2": "h1", "h1": "total"}, "item", "local", "ds", "y")


def test_hierarchy(spark):
    t = tree(spark)
    t.checked()
    edges = {r["child"]: r["parent"] for r in t.edges().collect()}
    assert edges == {"i1": "a|h2", "i2": "a|h2", "i3": "b|h2", "i4": "c|h2", "a|h2": "x|h1", "b|h2": "x|h1", "c|h2": "y|h1", "x|h1": "total", "y|h1": "total"}
    rows = [("l", DAY, i, v) for i, v in (("i1", 1.0), ("i2", 2.0), ("i3", 4.0), ("i4", 8.0), ("i9", 99.0))]
    out = {r["code"]: r["y"] for r in t.aggregated(spark.createDataFrame(rows, "local string, ds date, item string, y double")).collect()}
    assert out == {"i1": 1, "i2": 2, "i3": 4, "i4": 8, "a|h2": 3, "b|h2": 4, "c|h2": 8, "x|h1": 7, "y|h1": 8, "total": 15}
    assert {(r["code_type"], r["code"]) for r in t.decoded(spark.createDataFrame([("a|h2",), ("total",), ("i1",)], "code string")).collect()} == {("h2", "a"), ("total", "total"), ("item", "i1")}


@pytest.mark.parametrize("method", hierarchy.METHODS)
def test_reconciled_adds_up(spark, method):
    t = tree(spark)
    codes = ["i1", "i2", "i3", "i4", "a|h2", "b|h2", "c|h2", "x|h1", "y|h1", "total"]
    forecasts = spark.createDataFrame([("l", DAY, c, 10.0 + k) for k, c in enumerate(codes)], "local string, ds date, code string, y double")
    random = np.random.default_rng(1)
    past = spark.createDataFrame([("l", DAY - dt.timedelta(d + 1), c, float(random.normal())) for d in range(30) for c in codes], "local string, ds date, code string, y double")
    out = {r["code"]: r["y"] for r in t.reconciled(forecasts, method, past).collect()}
    assert math.isclose(out["a|h2"], out["i1"] + out["i2"], rel_tol=1e-6) and math.isclose(out["total"], sum(out[i] for i in codes[:4]), rel_tol=1e-6)


def test_two_levels_agree(spark):
    master = spark.createDataFrame([("a",), ("b",)], "item string")
    t = hierarchy.Hierarchy(master, {"item": "total"}, "item", "local", "ds", "y")
    f = spark.createDataFrame([("l", DAY, "a", 1.0), ("l", DAY, "b", 2.0), ("l", DAY, "total", 6.0)], "local string, ds date, code string, y double")
    one, two = ({r["code"]: round(r["y"], 9) for r in d.collect()} for d in (t.reconciled_two_levels(f), t.reconciled(f)))
    assert one == two == {"a": 2.0, "b": 3.0, "total": 5.0}


@pytest.mark.parametrize("model", [*models.UNIVARIATE, "regressor", "kalman", "prophet"])
def test_models(spark, model):
    y = [10 + 0.5 * i + 3 * math.sin(i) for i in range(120)]
    out = models.forecast(series(spark, y), P, model, 2).orderBy("ds").collect()
    assert [r["ds"] for r in out] == [DAY + dt.timedelta(120), DAY + dt.timedelta(121)]
    assert all(r["error"] is None and abs(r["predictions"] - 70) < 45 for r in out)


def test_regressor_recursion(spark):
    y = [1.0]
    for _ in range(30):
        y.append(0.5 * y[-1] + 2 + 0.01 * math.sin(len(y)))
    out = models.forecast(series(spark, y), P, "regressor", 3, {"lags": 1}).orderBy("ds").collect()
    x, z = np.array(y[:-1]), np.array(y[1:])
    b, a = np.polyfit(x, z, 1)
    want, last = [], y[-1]
    for _ in range(3):
        last = a + b * last
        want.append(last)
    assert np.allclose([r["predictions"] for r in out], want, rtol=1e-6)


def test_forecast_errors_and_bands(spark):
    df = series(spark, range(40)).union(series(spark, [1, 2], "short")).union(series(spark, [1, 2, 3, None], "nulls")).union(series(spark, [1] * 30, "gaps", step=2))
    out = models.forecast(df, P, "exponential_smoothing", 2, samples=10).collect()
    failed = {r["k"]: r["error"] for r in out if r["error"]}
    assert set(failed) == {"short", "nulls", "gaps"} and all(r["predictions"] is None for r in out if r["error"])
    good = [r for r in out if r["k"] == "a"]
    assert len(good) == 2 and all(r["lower_quantile_0.25"] <= r["upper_quantile_0.75"] for r in good)
    with pytest.raises(errors.NotProbabilisticModelError):
        models.forecast(df, P, "croston", samples=5)
    for bad in ({"model": "nope"}, {"model": "theta", "steps": 0}, {"model": "theta", "lower": 0.9, "upper": 0.1}):
        with pytest.raises(errors.OptionError):
            models.forecast(df, P, **bad)


def test_covariates_must_reach_the_horizon(spark):
    df = series(spark, [float(i % 7) for i in range(60)])
    cover = lambda n: spark.createDataFrame([(DAY + dt.timedelta(i), float(i % 7)) for i in range(n)], "ds date, w double")
    good = models.forecast(df, P, "regressor", 3, {"lags": 2}, cover(70)).collect()
    assert np.allclose([r["predictions"] for r in sorted(good, key=lambda r: r["ds"])], [60 % 7, 61 % 7, 62 % 7], atol=1e-6)
    assert models.forecast(df, P, "regressor", 3, {"lags": 2}, cover(61)).first()["error"] == "covariates do not cover the horizon"


def test_bootstrap_interval(spark):
    random = np.random.default_rng(2)
    y = [0.0]
    for _ in range(150):
        y.append(0.6 * y[-1] + random.normal())
    df = series(spark, y).union(series(spark, [1, 2], "short"))
    out = bootstrap_interval(df, P, 2, 3, 0.1, 0.9).orderBy("ds").collect()
    assert [r["ds"] for r in out] == [DAY + dt.timedelta(151 + h) for h in range(3)] and {r["k"] for r in out} == {"a"}
    point = {r["ds"]: r["predictions"] for r in models.forecast(df, P, "regressor", 3, {"lags": 2}).where("error is null").collect()}
    for r in out:
        assert math.isclose(r["predictions"], point[r["ds"]], rel_tol=1e-9)
        # residuals of noise with deviation 1, mixed with refits' mean errors, which are smaller
        assert r["lower_quantile_0.1"] < r["predictions"] < r["upper_quantile_0.9"] and 0.5 < r["upper_quantile_0.9"] - r["lower_quantile_0.1"] < 4


def test_source_and_stream(spark, tmp_path):
    series(spark, [1, 2, 3], "007").withColumn("other", F.lit(1)).write.csv(f"{tmp_path}/in", header=True)
    df = read_panel(spark, f"{tmp_path}/in", P, "csv", "k string, ds date, y double, other int")
    assert df.columns == ["k", "ds", "y"] and {r["k"] for r in df.collect()} == {"007"}
    with pytest.raises(errors.OptionError):
        read_panel(spark, f"{tmp_path}/in", P, "csv")
    stream = spark.readStream.schema("k string, ds date, y double, other int").csv(f"{tmp_path}/in", header=True)
    query = streamed(stream, Panel("k", freq="7D")).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("weeks").agg(F.sum("y"), F.sum("n")).first()[:] == (6.0, 3)
