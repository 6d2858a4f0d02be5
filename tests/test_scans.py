"""Operators on series in blocks give what plain windows give; exact quantiles, scans and halos against plain versions."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom import scans
from chronoloom.functions import lags, metrics
from chronoloom.operators import clean, outliers
from chronoloom.series import Panel

DAY = datetime.date(2020, 1, 1)
PLAIN, BLOCKED = Panel("k"), Panel("k", block=60)


@pytest.fixture(scope="module")
def series(spark, tmp_path_factory):
    """A hot series, short ones, a null key, nulls, gaps, one value alone, repeated values."""
    r = random.Random(4)
    rows = []
    for k, n in (("hot", 900), ("a", 70), ("b", 3), ("c", 1), (None, 40)):
        for i in range(n):
            if r.random() < 0.8 or n < 4:
                y = None if r.random() < 0.15 and n > 3 else float(r.choice([r.randint(0, 6), r.gauss(50, 30), r.gauss(50, 3) ** 3]))
                rows.append((k, DAY + datetime.timedelta(days=i if i < 600 else i + 300), y))
    r.shuffle(rows)
    path = str(tmp_path_factory.mktemp("series") / "rows")
    spark.createDataFrame(rows, "k string, ds date, y double").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def same(spark, a, b):
    assert a.columns == b.columns
    x, y = (sorted(([str(r[c]) if not isinstance(r[c], float) else round(r[c], 6) for c in a.columns] for r in t.collect()), key=str) for t in (a, b))
    assert x == y and x


@pytest.mark.parametrize("what", ["iqr", "modified_zscore", "rolling_window", "dbscan"])
def test_outliers_in_blocks(spark, series, what):
    f = outliers.METHODS[what]
    same(spark, f(series, PLAIN), f(series, BLOCKED))


def test_lags_in_blocks(spark, series):
    rolling = {"mean": 5, "max": 20, "own": (lambda v: F.get(v, F.lit(0)), 4)}
    same(spark, lags.lagged(series, PLAIN, 3, rolling), lags.lagged(series, BLOCKED, 3, rolling))


@pytest.mark.parametrize(("method", "limit"), [("linear", None), ("nearest", 2), ("cubic", None)])
def test_interpolation_in_blocks(spark, series, method, limit):
    same(spark, clean.interpolated(clean.completed(series, PLAIN), PLAIN, method, limit), clean.interpolated(clean.completed(series, BLOCKED), BLOCKED, method, limit))


def test_cleansing_in_blocks(spark, series):
    ends = {"repeat_forward_to": "2023-06-01", "zero_back_to": "2019-11-01"}
    same(spark, *[clean.cleansed(series, p, "sum", "median", {"method": "linear", "limit": 3}, "iqr", on_all_null="drop", **ends) for p in (PLAIN, BLOCKED)])


@pytest.mark.parametrize("seed", range(2))
def test_quantiles_are_exact(spark, seed):
    random_ = np.random.default_rng(seed)
    values = {"a": random_.normal(size=700), "b": np.repeat(3.0, 300), "c": np.exp(random_.normal(0, 20, 500)), "d": np.concatenate((np.repeat(1.0, 200), random_.normal(size=5), [1e300, -1e300])), "e": np.array([5.0]), "f": random_.integers(0, 4, 400).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("g", None)], "k string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.905, 1.0)
    found = {r["k"]: r["_q"] for r in scans.quantiles(df, ["k"], F.col("v"), shares, block=20).collect()}
    assert set(found) == set(values)
    for k, vs in values.items():
        assert found[k] == pytest.approx(list(np.quantile(vs, shares)), rel=1e-12, abs=1e-12)


def test_blocks_are_ordered_and_bounded(spark):
    random_ = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(v)) for v in np.exp(random_.normal(0, 30, 5000))] + [("b", 1.0)] * 3000 + [("c", 2.0)], "k string, v double")
    got = scans.dealt(df, ["k"], "v", 50).groupBy("k", "_block").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k", "_block").collect()
    a = [r for r in got if r["k"] == "a"]
    assert all(x["hi"] < y["lo"] for x, y in zip(a, a[1:], strict=False)) and max(r["n"] for r in a) <= 50 and sum(r["n"] for r in a) == 5000
    assert [r["n"] for r in got if r["k"] == "b"] == [3000] and [r["n"] for r in got if r["k"] == "c"] == [1]


def test_a_long_series_spreads_over_tasks(spark):
    """One series: at least eight blocks, so as many tasks, in each of the windows."""
    rows = spark.range(200_000).select(F.lit("k").alias("k"), (F.lit("2020-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ds"), F.when(F.col("id") % 7 != 3, F.sin(F.col("id") / 50.0) * 100).alias("y"))
    panel = Panel("k", freq="S", block=10_000)
    blocks = panel.blocks(rows)
    sizes = [r["count"] for r in blocks.rows.groupBy("_block").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 10_000
    plain = Panel("k", freq="S")
    for f in (lambda p: lags.lagged(rows, p, 3), lambda p: clean.interpolated(rows, p), lambda p: outliers.rolling_window(rows.where("y is not null"), p)):
        a, b = (f(p).agg(F.count(F.lit(1)), F.round(F.sum(F.col("y")), 3), F.round(F.sum(F.xxhash64("ds").cast("double") * F.coalesce(F.round("y", 6), F.lit(0.0)) / 1e18), 3)).first() for p in (plain, panel))
        assert a == b


def test_sizes_decide(spark, tmp_path):
    spark.createDataFrame([("a", DAY, 1.0)], "k string, ds date, y double").write.parquet(f"{tmp_path}/few")
    few = spark.read.parquet(f"{tmp_path}/few")
    assert scans.small(few) and not PLAIN.blocks(few).split and BLOCKED.blocks(few).split
    assert not scans.small(spark.range(100_000_000))


def test_times_keep_their_order(spark):
    """Also around a change of clocks, and for texts, whose order is their own."""
    times = ["2021-10-31 01:30:00", "2021-10-31 02:30:00", "2021-10-31 02:30:00.5", "2021-10-31 03:30:00", "1969-12-31 23:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string")
    for kind in ("timestamp_ntz", "timestamp", "date"):
        x = df.select(F.col("t").cast(kind).alias("t"))
        found = x.select("t", scans.seconds(F.col("t"), x.schema["t"].dataType).alias("s")).orderBy("t").toPandas()
        assert found["s"].is_monotonic_increasing and found["s"].nunique() == found["t"].nunique()
    assert df.select(scans.seconds(F.col("t"), df.schema["t"].dataType).alias("s")).distinct().count() == 1


def test_halo_reaches_over_small_blocks(spark):
    rows = spark.createDataFrame([("a", float(v), v) for v in [0, 1, 2, 500, 501, 900, 901, 902, 903, 1000]], "k string, v double, i int")
    blocks = scans.Blocks(rows, ["k"], F.col("v"), 2)
    found = blocks.haloed(["v"], 3, 2)
    true = rows.select("v", F.collect_list("v").over(Window.orderBy("v").rowsBetween(-3, 2)).alias("near")).toPandas().set_index("v")["near"].to_dict()
    w = blocks.local("v").rowsBetween(-3, 2)
    mine = found.withColumn("near", F.collect_list("v").over(w)).where("not _halo").toPandas().set_index("v")["near"].to_dict()
    assert {k: list(v) for k, v in mine.items()} == {k: list(v) for k, v in true.items()} and isinstance(pd.Series(mine), pd.Series)


def test_capping_and_correction_in_blocks(spark, series):
    same(spark, outliers.capped(series, PLAIN, 5), outliers.capped(series, BLOCKED, 5))
    wide = series.withColumn("amount", F.col("y") * 2)
    same(spark, outliers.corrected(wide, PLAIN, amount="amount"), outliers.corrected(wide, BLOCKED, amount="amount"))


@pytest.mark.parametrize("seed", range(4))
def test_isolation_tree_paths(seed):
    """Each value's path length is that of a walk down explicit nodes, cut by the same numbers."""
    random_ = np.random.default_rng(seed)
    values = np.sort(np.concatenate((random_.normal(size=40), np.repeat(0.5, 10), [9.0])))
    cuts, lengths = outliers.grown(values, 5, np.random.default_rng(7))
    draws = np.random.default_rng(7)

    def node(own, down):
        if down >= 5 or len(own) < 2 or own[0] == own[-1]:
            return ("leaf", down + float(outliers._usual(len(own))))
        cut = draws.uniform(own[0], own[-1])
        left = node(own[own <= cut], down + 1)
        return ("cut", cut, left, node(own[own > cut], down + 1))

    tree = node(values, 0)

    def walk(t, v):
        return t[1] if t[0] == "leaf" else walk(t[2] if v <= t[1] else t[3], v)

    for v in [*values, -99.0, 99.0, *cuts, *random_.normal(size=50)]:
        assert lengths[np.searchsorted(cuts, v, "left")] == pytest.approx(walk(tree, v))


def test_isolation_forest_by_ranges(spark):
    """The ranges mark the rows whose mean path over all trees scores the threshold; far values are among them, and layout changes nothing."""
    random_ = np.random.default_rng(2)
    rows = [("a", DAY + datetime.timedelta(days=i), float(v)) for i, v in enumerate(np.concatenate((random_.normal(50, 5, 400), [400.0, -300.0])))]
    rows += [("b", DAY, 1.0), ("c", DAY, None), (None, DAY, 2.0), (None, DAY, 2.0)] + [("d", DAY + datetime.timedelta(days=i), 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    found = outliers.isolation_forest(df, PLAIN).collect()
    assert len(found) == len(rows) and all(r["inlier"] == 1 for r in found if r["k"] != "a")
    marked = {r["y"] for r in found if r["inlier"] == -1}
    assert {400.0, -300.0} <= marked and len(marked) < 30
    pool = sorted(r[2] for r in rows if r[0] == "a")
    ranges = outliers.isolation_ranges(df.where("k = 'a'"), PLAIN, trees=20, sample=64).first()["ranges"]
    order = df.where("k = 'a'").select("y", (F.pmod(F.xxhash64("y", F.lit(1).cast("long"), F.lit(1)), F.lit(1 << 40))).alias("h")).orderBy("h", "y").toPandas()["y"].to_numpy()
    generator = np.random.default_rng(1)
    trees = [outliers.grown(np.sort(generator.choice(order, 64, replace=False)), 6, generator) for _ in range(20)]
    for v in [*pool, 100.0, 0.0]:
        depth = np.mean([lengths[np.searchsorted(cuts, v, "left")] for cuts, lengths in trees])
        inside = any((r["low"] is None or v > r["low"]) and (r["high"] is None or v <= r["high"]) for r in ranges)
        assert inside == (2.0 ** (-depth / float(outliers._usual(np.array(64)))) >= 0.6)
    again = outliers.isolation_forest(df.repartition(7), PLAIN).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_measures_in_blocks(spark, series):
    rows = series.withColumn("p", F.col("y") * 0.9 + 1)
    same(spark, *[metrics.evaluated(rows, "y", "p", ["k"], "ds", "all", 2, 3, b) for b in (None, 60)])


def test_joint_residuals_are_numpys(spark):
    """Lags by Akaike's criterion, distances by the residual covariance; blocks change nothing."""
    random_ = np.random.default_rng(6)
    n = 300
    v = np.zeros((n, 2))
    for t in range(2, n):
        v[t] = [[0.5, 0.2], [0.1, 0.3]] @ v[t - 1] + [[-0.3, 0.0], [0.2, -0.4]] @ v[t - 2] + random_.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]])
    v[150] += [4, -4]
    rows = [("a", DAY + datetime.timedelta(days=i), float(x), float(y), "z") for i, (x, y) in enumerate(v)] + [("b", DAY, 1.0, 2.0, "z"), ("b", DAY + datetime.timedelta(days=1), None, 2.0, "z")]
    df = spark.createDataFrame(rows, "k string, ds date, y double, u double, inverse_ string")
    found = outliers.joint_residual(df, PLAIN, ["y", "u"], 2.0, 4)
    top, scores = 4, []
    for k in range(1, top + 1):
        x = np.column_stack([np.ones(n - top), *[v[top - j : n - j] for j in range(1, k + 1)]])
        b = np.linalg.lstsq(x, v[top:], rcond=None)[0]
        e = v[top:] - x @ b
        scores.append((np.linalg.slogdet(e.T @ e / len(e))[1] + 2 * 4 * k / len(e), k, e, b))
    _, k, e, _ = min(scores, key=lambda s: s[0])
    d = np.einsum("ni,ij,nj->n", e, np.linalg.inv(e.T @ e / len(e)), e)
    want = {DAY + datetime.timedelta(days=int(i) + top) for i in np.flatnonzero(d >= d.mean() + 2 * d.std(ddof=1))}
    assert {r["ds"] for r in found.collect() if r["inlier"] == -1} == want and DAY + datetime.timedelta(days=150) in want and k == 2
    same(spark, found, outliers.joint_residual(df, BLOCKED, ["y", "u"], 2.0, 4))
