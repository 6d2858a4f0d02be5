"""Isolation forests of many series in step, and their pools, against the plain forest of one series."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import outliers
from chronoloom.series import Panel


def pools(seed: int) -> list[np.ndarray]:
    """Values of all sizes around powers of two and the sample: spread, rounded, tied, flat, with far ones, neighbouring doubles."""
    random_ = np.random.default_rng(seed)
    out = []
    for n in (1, 2, 3, 4, 5, 8, 9, 31, 32, 33, 47, 63, 64, 65, 90, 200):
        out += [random_.normal(size=n), random_.lognormal(3, 1, n).round(2), random_.integers(0, 3, n).astype(float), np.full(n, 2.5)]
        out += [np.append(random_.normal(size=n - 1), 1e9), np.append(np.zeros(n - 1), 5e-324)]
    return out


@pytest.mark.parametrize(("trees", "sample", "seed", "threshold"), [(50, 256, 1, 0.6), (20, 64, 1, 0.6), (9, 33, 4, 0.5), (5, 32, 2, 0.4)])
def test_forests_in_step_are_the_plain_ones(monkeypatch, trees, sample, seed, threshold):
    """All spans are the same to the bit, drawn samples and whole pools alike, and in pieces; series whose scores are no ties grow no tree alone."""
    some = pools(seed)
    plain = [outliers.isolation_spans(p, trees, sample, seed, threshold) for p in some]
    assert outliers.forests_spans(some, trees, sample, seed, threshold) == plain and sum(map(len, plain)) > len(some) // 2
    monkeypatch.setattr(outliers, "CUTS", 5000)
    assert outliers.forests_spans(some, trees, sample, seed, threshold) == plain
    monkeypatch.setattr(outliers, "isolation_spans", None)
    clear = [(p, s) for p, s in zip(some, plain, strict=True) if len(np.unique(p)) > 9]
    assert len(clear) > 15 and outliers.forests_spans([p for p, _ in clear], trees, sample, seed, threshold) == [s for _, s in clear]


def test_refused_numbers_and_ties_fall_back(monkeypatch):
    """Scores at the threshold but for rounding are settled by the plain forest; flat values score one half, exactly."""
    flat = np.full(12, 7.0)
    called = []
    plain = outliers.isolation_spans
    monkeypatch.setattr(outliers, "isolation_spans", lambda *a: called.append(a) or plain(*a))
    assert outliers.forests_spans([flat], 10, 8, 1, 0.5) == [plain(flat, 10, 8, 1, 0.5)] and len(called) == 1
    assert outliers.forests_spans([flat], 10, 8, 1, 0.6) == [[]] and len(called) == 1
    pool = np.random.default_rng(9).normal(size=600)  # the first choice of 600 with this seed takes a number twice
    assert outliers.forests_spans([pool], 3, 600, 47309, 0.6) == [plain(pool, 3, 600, 47309, 0.6)] and len(called) == 2
    assert outliers.forests_spans([pool], 3, 600, 47310, 0.6) == [plain(pool, 3, 600, 47310, 0.6)] and len(called) == 2


def test_series_of_any_size_in_spark(spark):
    """Rows are marked as the plain forest of each series' values marks them."""
    day, series = datetime.date(2024, 1, 1), {f"s{i}": p for i, p in enumerate(pools(3))}
    rows = [(k, day + datetime.timedelta(days=j), float(v)) for k, p in series.items() for j, v in enumerate(p)]
    found = outliers.isolation_forest(spark.createDataFrame(rows, "k string, ds date, y double"), Panel("k")).collect()
    spans = {k: outliers.isolation_spans(p, 50, 256, 1, 0.6) for k, p in series.items()}
    assert len(found) == len(rows) and {-1, 1} == {r["inlier"] for r in found}
    assert all((r["inlier"] == -1) == any(low < r["y"] <= high for low, high in spans[r["k"]]) for r in found)


def test_pools_of_long_series(spark, monkeypatch):
    """Equal values of a long series are told apart by number, in runs of any length; what fits a sample is a pool as it is."""
    day, random_ = datetime.date(2024, 1, 1), np.random.default_rng(5)
    series = {"a": random_.integers(0, 30, 700).astype(float), "b": np.append(np.full(500, 1.0), [50.0, -40.0, 1.5]), "c": random_.normal(size=40), None: random_.normal(size=300).round(1)}
    rows = [(k, day + datetime.timedelta(days=j), float(v)) for k, p in series.items() for j, v in enumerate(p)] + [("a", day, None)]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    monkeypatch.setattr(outliers, "TIES", 7)
    found = {r["k"]: [(-np.inf if s["low"] is None else s["low"], np.inf if s["high"] is None else s["high"]) for s in r["ranges"]] for r in outliers.isolation_ranges(df, Panel("k"), 20, 64, 0.6, 1, 400).collect()}
    assert set(found) == set(series)
    numbered = df.where("y is not null").select("k", "y", F.row_number().over(Window.partitionBy("k", "y").orderBy("ds")).cast("long").alias("j"))
    hashed = numbered.select("k", "y", (F.pmod(F.xxhash64("y", "j", F.lit(1)), F.lit(1 << 40)) / float(1 << 40)).alias("h")).toPandas()
    for k, values in series.items():
        own = hashed[hashed["k"].isna() if k is None else hashed["k"] == k].sort_values(["h", "y"])
        pool = own[own["h"] * len(values) < 400]["y"].to_numpy()
        assert found[k] == outliers.isolation_spans(pool, 20, 64, 1, 0.6)
    assert all(found[k] for k in ("c", None))
