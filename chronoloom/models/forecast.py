"""Forecasts of all series of a panel at once, as DataFrame expressions.

A series is one row with its values in order; fitting is a fold over them or
least squares from aggregated moments, and a forecast is a fold over the steps.
Smoothing parameters are searched by crossing series with a small grid and
keeping each series' best. Trees are trained once for all series, on lags.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import CovariateError, CovariateNamesError, NotProbabilisticModelError, OptionError, QuantilesError, SeriesError, StepsError
from chronoloom.models import arma, statespace
from chronoloom.models.linear import fitted
from chronoloom.models.regressor import regressed
from chronoloom.scans import quantiles, settled
from chronoloom.series import Panel
from chronoloom.sources import first_series

#: A model's next value and state: (state, step, error) -> (value, next state).
Advance = Callable[[Column, Column, Column], tuple[Column, Column]]
ALPHAS = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9]


def packed(df: DataFrame, panel: Panel) -> DataFrame:
    """keys, ys (values in order), n, last time, nulls, and whether the series is contiguous; one row a series, by one aggregation."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(panel.time).alias("t"), F.col(panel.target).alias("y"))))
    out = panel.checked(df).groupBy(*panel.keys).agg(rows.alias("_r"))
    times, first, last = F.transform("_r", lambda x: x["t"]), F.get("_r", F.lit(0))["t"], F.element_at("_r", -1)["t"]
    steps = F.datediff(last, first) / panel.days if panel.daily else (F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))) / panel.seconds
    regular = (steps + 1 == F.size("_r")) & (F.size(F.array_distinct(times)) == F.size("_r"))
    return out.select(*panel.keys, F.transform("_r", lambda x: x["y"]).alias("ys"), F.size("_r").alias("n"), last.alias("last"), F.size(F.filter("_r", lambda x: x["y"].isNull())).alias("nulls"), regular.alias("regular"))


def _grid(**values: list[float]) -> Column:
    """All combinations of the values, as an array of structs."""
    rows: list[dict[str, float]] = [{}]
    for name, options in values.items():
        rows = [r | {name: float(v)} for r in rows for v in options]
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def _best(df: DataFrame, grid: Column, fold: Callable[[Column, bool], Column], resid: bool) -> DataFrame:
    """Each series with the state of the grid's point of least ``sse`` (of equals the first): fold(point, resid) is a struct (state, sse, resid).

    All points are tried in the series' own row. Residuals are collected once, for the best point.
    """
    tried = F.array_min(F.transform(grid, lambda g, i: F.struct(fold(g, False)["sse"].alias("sse"), i.alias("i"), g.alias("g"))))
    kept = df.withColumn("_g", tried["g"]).withColumn("_f", fold(F.col("_g"), resid))
    return kept.select(*df.columns, F.col("_f.state").alias("state"), F.col("_f.resid").alias("resid"))


def _empty() -> Column:
    return F.array().cast("array<double>")


def _more(s: Column, e: Column, resid: bool) -> Column:
    return (F.concat(s["resid"], F.array(e)) if resid else s["resid"]).alias("resid")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, y: a + y) / F.size(values)


def exponential_smoothing(df: DataFrame, panel: Panel, alphas: list[float] | None = None, betas: list[float] | None = None, season: int = 1, gammas: list[float] | None = None, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """Additive trend smoothing, with additive seasons of ``season`` rows; weights by the least squared error of one step."""
    if season < 1:
        raise OptionError("season must be at least 1")
    grid = _grid(alpha=alphas or ALPHAS, beta=betas or [0.0, 0.05, 0.1, 0.3], gamma=(gammas or [0.05, 0.2, 0.5]) if season > 1 else [0.0])
    if season > 1:  # the first season's mean and places, and the drift to the second one's mean
        first, second = _mean(F.slice("ys", 1, season)), _mean(F.slice("ys", season + 1, season))
        df = df.withColumn("_l0", first).withColumn("_b0", (second - first) / season).withColumn("_s0", F.transform(F.slice("ys", 1, season), lambda y: y - F.col("_l0")))
        skip = season
    else:
        df = df.withColumn("_l0", F.get("ys", F.lit(0))).withColumn("_b0", F.get("ys", F.lit(1)) - F.get("ys", F.lit(0))).withColumn("_s0", F.array(F.lit(0.0)))
        skip = 1

    def moved(s: Column, g: Column, e: Column) -> list[Column]:
        wave = F.get(s["s"], F.lit(0))
        return [(s["l"] + s["b"] + g["alpha"] * e).alias("l"), (s["b"] + g["alpha"] * g["beta"] * e).alias("b"), F.concat(F.slice(s["s"], 2, season - 1), F.array(wave + g["gamma"] * e)).alias("s") if season > 1 else s["s"].alias("s")]

    def fold(g: Column, resid: bool) -> Column:
        start = F.struct(F.col("_l0").alias("l"), F.col("_b0").alias("b"), F.col("_s0").alias("s"), F.lit(0.0).alias("sse"), _empty().alias("resid"))

        def step(s: Column, y: Column) -> Column:
            e = y - s["l"] - s["b"] - F.get(s["s"], F.lit(0))
            return F.struct(*moved(s, g, e), (s["sse"] + e * e).alias("sse"), _more(s, e, resid))

        return F.aggregate(F.slice("ys", skip + 1, F.greatest(F.col("n") - skip, F.lit(0))), start, step, lambda s: F.struct(F.struct(s["l"].alias("l"), s["b"].alias("b"), s["s"].alias("s"), g["alpha"].alias("alpha"), g["beta"].alias("beta"), g["gamma"].alias("gamma")).alias("state"), s["sse"].alias("sse"), s["resid"].alias("resid")))

    def advance(s: Column, k: Column, e: Column) -> tuple[Column, Column]:
        return s["l"] + s["b"] + F.get(s["s"], F.lit(0)) + e, F.struct(*moved(s, s, e), s["alpha"].alias("alpha"), s["beta"].alias("beta"), s["gamma"].alias("gamma"))

    return _best(df, grid, fold, resid).drop("_l0", "_b0", "_s0"), advance, 2 * season + 1


def _trend(ys: str) -> tuple[Column, Column]:
    """(level at place 0, slope) of the least-squares line through the values."""
    n, mid = F.col("n").cast("double"), (F.col("n") - 1) / 2
    places = F.transform(ys, lambda y, i: (i - mid) * y)
    slope = F.coalesce(F.try_divide(F.aggregate(places, F.lit(0.0), lambda a, p: a + p), n * (n * n - 1) / 12), F.lit(0.0))
    return F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / n - slope * mid, slope


def theta(df: DataFrame, panel: Panel, thetas: list[float] | None = None, alphas: list[float] | None = None, season: int = 1, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """The trend line mixed with a smoothed line of ``theta`` times the curvature (2 unless several are searched).

    With ``season``, the mean distance of each place of a season from the trend is taken off first and put back.
    """
    if season < 1:
        raise OptionError("season must be at least 1")
    level, slope = _trend("ys")
    if season > 1:
        off = df.withColumn("_b", slope).withColumn("_a", level).withColumn("_d", F.transform("ys", lambda y, i: y - F.col("_a") - F.col("_b") * i))
        means = F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda j: _mean(F.filter("_d", lambda _, i: i % season == j)))
        df = off.withColumn("_w", means).withColumn("_w", F.transform("_w", lambda v: v - _mean(F.col("_w")))).withColumn("_ys", F.transform("ys", lambda y, i: y - F.get("_w", i % season))).drop("_a", "_b", "_d")
    else:
        df = df.withColumn("_w", F.array(F.lit(0.0))).withColumn("_ys", F.col("ys"))
    level, slope = _trend("_ys")
    n = F.col("n").cast("double")
    trended = df.withColumn("_b", slope).withColumn("_a", level)
    places = F.transform("_ys", lambda y, i: F.struct(i.cast("double").alias("i"), y.alias("y")))

    def fold(g: Column, resid: bool) -> Column:
        def bent(i: Column, y: Column) -> Column:
            return g["theta"] * y + (1 - g["theta"]) * (F.col("_a") + F.col("_b") * i)

        start = F.struct(bent(F.lit(0.0), F.get("_ys", F.lit(0))).alias("l"), F.lit(0.0).alias("sse"), _empty().alias("resid"))

        def step(s: Column, p: Column) -> Column:
            e = p["y"] - ((1 - 1 / g["theta"]) * (F.col("_a") + F.col("_b") * p["i"]) + s["l"] / g["theta"])
            return F.struct((s["l"] + g["alpha"] * (bent(p["i"], p["y"]) - s["l"])).alias("l"), (s["sse"] + e * e).alias("sse"), _more(s, e, resid))

        return F.aggregate(F.slice(places, 2, F.greatest(F.col("n") - 1, F.lit(0))), start, step, lambda s: F.struct(F.struct(s["l"].alias("l"), F.col("_a").alias("a"), F.col("_b").alias("b"), n.alias("n"), g["theta"].alias("theta"), F.col("_w").alias("w")).alias("state"), s["sse"].alias("sse"), s["resid"].alias("resid")))

    def advance(s: Column, k: Column, e: Column) -> tuple[Column, Column]:
        # the smoothed line goes on with its own drift, (1 - theta) times the trend's slope at 0
        line = s["a"] + s["b"] * (s["n"] - 1 + k)
        return (1 - 1 / s["theta"]) * line + s["l"] / s["theta"] + F.get(s["w"], ((s["n"] - 1 + k).cast("int") % season)) + e, s

    return _best(trended, _grid(theta=thetas or [2.0], alpha=alphas or ALPHAS), fold, resid).drop("_a", "_b", "_w", "_ys"), advance, max(3, 2 * season)


def four_theta(df: DataFrame, panel: Panel, season: int = 1, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """Theta with the curvature searched as well."""
    return theta(df, panel, thetas=[1.0, 1.5, 2.0, 3.0], season=season, resid=resid)


def croston(df: DataFrame, panel: Panel, alpha: float = 0.1, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """Smoothed demand size over smoothed interval, both from non-zero rows."""
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("p"), F.lit(1.0).alias("q"), _empty().alias("resid"))

    def step(s: Column, y: Column) -> Column:
        hit, new = y != 0, s["z"].isNull()
        z = F.when(hit, F.when(new, y).otherwise(s["z"] + alpha * (y - s["z"]))).otherwise(s["z"])
        p = F.when(hit, F.when(new, s["q"]).otherwise(s["p"] + alpha * (s["q"] - s["p"]))).otherwise(s["p"])
        rest = F.when(new, s["resid"]).otherwise(_more(s, y - F.try_divide(s["z"], s["p"]), resid)) if resid else s["resid"]
        return F.struct(z.alias("z"), p.alias("p"), F.when(hit, 1.0).otherwise(s["q"] + 1).alias("q"), rest.alias("resid"))

    out = df.withColumn("_s", F.aggregate("ys", start, step))
    state = F.struct(F.coalesce(F.try_divide(F.col("_s.z"), F.col("_s.p")), F.lit(0.0)).alias("rate"))
    return out.select(*df.columns, state.alias("state"), F.col("_s.resid").alias("resid")), lambda s, k, e: (s["rate"] + e, s), 1


def _line(coef: Column, x: Column, n: int) -> Column:
    """Intercept and slopes of ``coef`` at the values ``x``, an array of ``n``."""
    return F.get(coef, F.lit(0)) + F.aggregate(F.zip_with(F.slice(coef, 2, n), x, lambda c, v: c * v), F.lit(0.0), lambda a, v: a + v)


def _extra(covariates: DataFrame | None, panel: Panel) -> list[str]:
    return [c for c in covariates.columns if c not in (*panel.keys, panel.time)] if covariates is not None else []


def _with_covariates(rows: DataFrame, panel: Panel, covariates: DataFrame) -> DataFrame:
    """Rows with the covariates of their time (and of those keys that the covariates have), as doubles named ``_c_``."""
    shared = [c for c in (*panel.keys, panel.time) if c in covariates.columns]
    return rows.join(covariates.select(*shared, *[F.col(c).cast("double").alias(f"_c_{c}") for c in _extra(covariates, panel)]), shared, "left")


def _ahead(df: DataFrame, panel: Panel, covariates: DataFrame, steps: int) -> DataFrame:
    """``df`` (keys, last) with ``_future``: the covariates at each of the next ``steps`` times, null where one lacks.

    The times are made from each series' last one and joined, so other dates do not count.
    """
    times = df.select(*panel.keys, F.col("last").alias(panel.time), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_k"))
    times = _with_covariates(times.withColumn(panel.time, panel.moved(F.col("_k"))), panel, covariates)
    values = F.array(*[F.col(f"_c_{c}") for c in _extra(covariates, panel)])
    known = F.count(F.when(~F.exists(values, lambda v: v.isNull()), 1)) == steps
    future = times.groupBy(*panel.keys).agg(F.when(known, F.transform(F.array_sort(F.collect_list(F.struct("_k", values.alias("x")))), lambda r: r["x"])).alias("_future"))
    return df.join(future, list(panel.keys), "left")


def kalman(df: DataFrame, panel: Panel, rows: DataFrame, covariates: DataFrame | None = None, steps: int = 1, ratios: list[float] | None = None, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """Local level model, of what a regression on the covariates leaves; the ratio of level to noise variance by the concentrated likelihood."""
    extra = _extra(covariates, panel)
    if extra:
        made = _with_covariates(panel.checked(rows), panel, covariates)
        xs = F.array(*[F.col(f"_c_{c}") for c in extra])
        model = fitted(made, panel.keys, F.col(panel.target), [F.col(f"_c_{c}") for c in extra]).select(*panel.keys, "coef")
        left = made.join(model, list(panel.keys)).withColumn(panel.target, F.col(panel.target) - _line(F.col("coef"), xs, len(extra)))
        level = packed(left.select(*panel.keys, panel.time, panel.target), panel).select(*panel.keys, "ys").join(model, list(panel.keys))
        df = _ahead(df.drop("ys").join(level, list(panel.keys), "left"), panel, covariates, steps).withColumn("_off", F.transform("_future", lambda x: _line(F.col("coef"), x, len(extra))))
    else:
        df = df.withColumn("_off", _empty())

    def fold(g: Column, resid: bool) -> Column:
        start = F.struct(F.get("ys", F.lit(0)).alias("l"), F.lit(1.0).alias("p"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("logs"), _empty().alias("resid"))

        def step(s: Column, y: Column) -> Column:
            prior = s["p"] + g["ratio"]
            gain, e = prior / (prior + 1), y - s["l"]
            return F.struct((s["l"] + gain * e).alias("l"), (prior * (1 - gain)).alias("p"), (s["ss"] + e * e / (prior + 1)).alias("ss"), (s["logs"] + F.log(prior + 1)).alias("logs"), _more(s, e, resid))

        m = F.greatest(F.col("n") - 1, F.lit(1))
        return F.aggregate(F.slice("ys", 2, F.greatest(F.col("n") - 1, F.lit(0))), start, step, lambda s: F.struct(F.struct(s["l"].alias("l"), (s["p"] + g["ratio"]).alias("p"), g["ratio"].alias("ratio"), F.col("_off").alias("off")).alias("state"), (m * F.log(F.greatest(s["ss"] / m, F.lit(1e-300))) + s["logs"]).alias("sse"), s["resid"].alias("resid")))

    def advance(s: Column, k: Column, e: Column) -> tuple[Column, Column]:
        gain = s["p"] / (s["p"] + 1)
        y = s["l"] + e + (F.get(s["off"], k.cast("int") - 1) if extra else 0.0)
        return y, F.struct((s["l"] + gain * e).alias("l"), (s["p"] * (1 - gain) + s["ratio"]).alias("p"), s["ratio"].alias("ratio"), s["off"].alias("off"))

    return _best(df, _grid(ratio=ratios or [0.0, 0.001, 0.01, 0.1, 0.3, 1.0, 3.0, 10.0]), fold, resid), advance, 3 + len(extra)


def _level_and_slope(df: DataFrame, panel: Panel, steps: int, band: tuple[float, float] | None, rounds: int) -> DataFrame:
    """The state space of ``statespace``: nulls inside a series are times without a value; bands are normal, by the variance in closed form."""
    keys = list(panel.keys)

    @F.pandas_udf("array<struct<m:double,v:double>>")
    def ahead(ys: pd.Series) -> pd.Series:
        values = [np.asarray(v, float) for v in ys]
        width = max(map(len, values))
        y, known = np.zeros((len(values), width)), np.zeros((len(values), width), bool)
        for row, v in enumerate(values):
            known[row, width - len(v) :] = ~np.isnan(v)
            y[row, width - len(v) :] = np.nan_to_num(v)
        means, variances = statespace.ahead(y, known, steps, rounds)
        return pd.Series([[{"m": float(a), "v": float(b)} for a, b in zip(*r, strict=True)] for r in zip(means, variances, strict=True)])

    rows = packed(df, panel)
    few = F.col("n") - F.col("nulls") < 5
    bad = F.when(few, "series under 5 values").when(~F.col("regular"), "series with gaps or duplicates")
    rows = rows.withColumn("error", bad)
    last = F.lit(None).cast("string")
    out = rows.where("error is null").select(*keys, F.col("last").alias(panel.time), ahead("ys").alias("_p")).select(*keys, panel.time, F.posexplode_outer("_p").alias("_k", "_f"))
    out = out.withColumn(panel.time, panel.moved(F.col("_k") + 1)).withColumn("predictions", F.col("_f.m"))
    for name, share in zip(("lower", "upper"), band or (), strict=False):
        out = out.withColumn(f"{name}_quantile_{share}", F.col("_f.m") + NormalDist().inv_cdf(min(max(share, 1e-12), 1 - 1e-12)) * F.sqrt("_f.v"))
    failed = rows.where("error is not null").select(*keys, "error", F.lit("SeriesError").alias("type_error"))
    return out.drop("_k", "_f").withColumn("error", last).withColumn("type_error", last).unionByName(failed, allowMissingColumns=True)


def fast_fourier_transform(df: DataFrame, panel: Panel, frequencies: int = 10, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """A linear trend and the strongest ``frequencies`` waves of what it leaves."""

    @F.pandas_udf("a double, b double, n double, waves array<array<double>>")
    def waves(ys: pd.Series) -> pd.DataFrame:
        out = []
        for y in ys:
            y, t = np.asarray(y, float), np.arange(len(y))
            b, a = np.polyfit(t, y, 1) if len(y) > 1 else (0.0, float(y[0]))
            f = np.fft.rfft(y - a - b * t)
            top = np.argsort(-np.abs(f), kind="stable")[:frequencies]
            scale = np.where((top == 0) | (2 * top == len(y)), 1.0, 2.0) / len(y)
            out.append((a, b, float(len(y)), [[2 * np.pi * k / len(y), abs(f[k]) * s, float(np.angle(f[k]))] for k, s in zip(top.tolist(), scale, strict=True)]))
        return pd.DataFrame(out, columns=["a", "b", "n", "waves"])

    def at(s: Column, t: Column) -> Column:
        return F.aggregate(s["waves"], s["a"] + s["b"] * t, lambda x, w: x + w[1] * F.cos(w[0] * t + w[2]))

    out = df.withColumn("state", waves("ys"))
    return out.withColumn("resid", F.transform("ys", lambda y, i: y - at(F.col("state"), i.cast("double")))), lambda s, k, e: (at(s, s["n"] - 1 + k) + e, s), 2


def _autoregression(df: DataFrame, panel: Panel, rows: DataFrame, lags: int, difference: int, covariates: DataFrame | None, steps: int, resid: bool) -> tuple[DataFrame, Advance, int]:
    """Least squares on lags of the (differenced) values and on covariates, from windows and aggregations."""
    w = panel.ordered()
    base = panel.checked(rows).withColumn("_v", F.col(panel.target))
    for _ in range(difference):
        base = base.withColumn("_v", F.col("_v") - F.lag("_v", 1).over(w))
    extra = _extra(covariates, panel)
    made = base.select("*", *[F.lag("_v", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)])
    if extra:
        made = _with_covariates(made, panel, covariates)
    names = [*[f"_c_{c}" for c in extra], *[f"_l{k}" for k in range(1, lags + 1)]]
    model = fitted(made, panel.keys, F.col("_v"), [F.col(c) for c in names])
    values = F.array(*[F.col(c) for c in names])

    def dot(coef: Column, x: Column) -> Column:
        return _line(coef, x, len(names))

    out = df.join(model.select(*panel.keys, "coef", "aicc"), list(panel.keys), "left")
    if resid:
        left = made.join(model.select(*panel.keys, "coef"), list(panel.keys)).withColumn("_e", F.col("_v") - dot(F.col("coef"), values)).groupBy(*panel.keys).agg(F.collect_list("_e").alias("resid"))
        out = out.join(left, list(panel.keys), "left")
    else:  # a pass over the rows less
        out = out.withColumn("resid", _empty())
    out = _ahead(out, panel, covariates, steps) if extra else out.withColumn("_future", F.lit(None).cast("array<array<double>>"))
    # the last values of each difference, latest first
    series = F.col("ys")
    tails = []
    for _ in range(difference):
        tails.append(F.element_at(series, -1))
        series = F.zip_with(F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0))), F.slice(series, 1, F.greatest(F.size(series) - 1, F.lit(0))), lambda a, b: a - b)
    window = F.slice(F.reverse(series), 1, lags)
    tail = F.array(*tails) if tails else _empty()
    out = out.withColumn("state", F.when(F.col("coef").isNotNull() & (F.size("ys") >= lags + difference), F.struct(window.alias("w"), tail.alias("tail"), "coef", F.col("_future").alias("future"))))

    def advance(s: Column, k: Column, e: Column) -> tuple[Column, Column]:
        x = F.concat(F.get(s["future"], k.cast("int") - 1), s["w"]) if extra else s["w"]
        v = dot(s["coef"], x) + e
        y, tail = v, []
        for d in range(difference - 1, -1, -1):
            y = F.get(s["tail"], F.lit(d)) + y
            tail.insert(0, y)
        w = F.slice(F.concat(F.array(v), s["w"]), 1, lags)
        return y, F.struct(w.alias("w"), (F.array(*tail) if tail else _empty()).alias("tail"), s["coef"].alias("coef"), s["future"].alias("future"))

    return out, advance, lags + difference + 2


def _arma(df: DataFrame, panel: Panel, rows: DataFrame, orders: list[tuple[int, int]], d: int | None, covariates: DataFrame | None, steps: int) -> tuple[DataFrame, Advance, int]:
    """Autoregressions with lagged errors (and covariates) by conditional least squares; of several ``orders`` (p, q), and of differences without ``d``, the best by series.

    Series are batched in their packed rows; see ``arma``. The model is kept for
    the values themselves, whatever its differences.
    """
    extra, most = _extra(covariates, panel), 2 if d is None else d
    if extra:
        made = _with_covariates(panel.checked(rows), panel, covariates)
        own = F.struct(F.col(panel.time).alias("t"), F.array(*[F.col(f"_c_{c}") for c in extra]).alias("x"))
        past = made.groupBy(*panel.keys).agg(F.transform(F.array_sort(F.collect_list(own)), lambda v: v["x"]).alias("_xs"))
        df = _ahead(df.join(past, list(panel.keys), "left"), panel, covariates, steps)
    else:
        df = df.select("*", F.lit(None).cast("array<array<double>>").alias("_xs"), F.lit(None).cast("array<array<double>>").alias("_future"))
    lags, errors = max(p for p, _ in orders) + most, max(q for _, q in orders)

    @F.pandas_udf("coef array<double>, order array<int>, resid array<double>, shocks array<double>")
    def solve(ys: pd.Series, xs: pd.Series) -> pd.DataFrame:
        values = [np.asarray(v, float) for v in ys]
        given = [np.asarray([list(r) for r in v], float).reshape(-1, len(extra)) if v is not None else np.zeros((0, len(extra))) for v in xs] if extra else []
        good = [i for i, v in enumerate(values) if not np.isnan(v).any() and (not extra or len(given[i]) == len(v) and not np.isnan(given[i]).any())]
        out: list[tuple] = [(None, None, None, None)] * len(values)
        for i, found in zip(good, arma.searched([values[i] for i in good], [given[i] for i in good] if extra else [], orders, d, most) if good else [], strict=True):
            out[i] = found
        return pd.DataFrame(out, columns=["coef", "order", "resid", "shocks"])

    out = df.withColumn("_f", solve("ys", "_xs")).select("*", "_f.coef", "_f.order", F.col("_f.resid").alias("resid"), F.col("_f.shocks").alias("_m")).drop("_f", "_xs")
    state = F.struct(F.slice(F.reverse("ys"), 1, lags).alias("w"), F.col("_m").alias("m"), "coef", F.col("_future").alias("future")) if lags else F.struct(_empty().alias("w"), F.col("_m").alias("m"), "coef", F.col("_future").alias("future"))
    out = out.withColumn("state", F.when(F.col("coef").isNotNull() & (F.size("ys") >= lags), state))

    def advance(s: Column, k: Column, e: Column) -> tuple[Column, Column]:
        x = F.concat(F.get(s["future"], k.cast("int") - 1), s["w"], s["m"]) if extra else F.concat(s["w"], s["m"])
        y = _line(s["coef"], x, len(extra) + lags + errors) + e
        w, m = (F.slice(F.concat(F.array(v), s[c]), 1, n) if n else s[c] for v, c, n in ((y, "w", lags), (e, "m", errors)))
        return y, F.struct(w.alias("w"), m.alias("m"), s["coef"].alias("coef"), s["future"].alias("future"))

    return out, advance, lags + errors + len(extra) + 4


def prophet(df: DataFrame, panel: Panel, rows: DataFrame, covariates: DataFrame | None = None, steps: int = 1, changepoints: int = 5, yearly: int = 3, weekly: int = 2, resid: bool = False) -> tuple[DataFrame, Advance, int]:
    """A piecewise linear trend with yearly and weekly waves and covariates (holidays are such), by ridge regression on calendar features."""

    def features(day: Column, first: Column, span: Column) -> list[Column]:
        t = F.coalesce(F.try_divide(F.datediff(day, first).cast("double"), span), F.lit(0.0))
        out = [t, *[F.greatest(t - (j + 1) * 0.8 / (changepoints + 1), F.lit(0.0)) for j in range(changepoints)]]
        for period, order in ((365.25, yearly), (7.0, weekly)):
            for k in range(1, order + 1):
                angle = 2 * F.pi() * k * F.datediff(day, F.lit("2000-01-01").cast("date")) / period
                out += [F.sin(angle), F.cos(angle)]
        return out

    by = panel.by()
    base = panel.checked(rows).select("*", F.min(panel.time).over(by).alias("_first"), F.datediff(F.max(panel.time).over(by), F.min(panel.time).over(by)).cast("double").alias("_span"))
    extra = _extra(covariates, panel)
    xs = features(F.col(panel.time), F.col("_first"), F.col("_span"))
    if extra:
        base = _with_covariates(base, panel, covariates)
        xs = [*xs, *[F.col(f"_c_{c}") for c in extra]]
    model = fitted(base, panel.keys, F.col(panel.target), xs, ridge=0.01).select(*panel.keys, "coef")

    def value(coef: Column, x: list[Column]) -> Column:
        total = F.get(coef, F.lit(0))
        for k, c in enumerate(x):
            total = total + F.get(coef, F.lit(k + 1)) * c
        return total

    left = base.join(model, list(panel.keys)).withColumn("_e", F.col(panel.target) - value(F.col("coef"), xs)).groupBy(*panel.keys).agg(F.collect_list("_e").alias("resid"), F.first("_first").alias("_first"), F.first("_span").alias("_span"), F.first("coef").alias("coef"))
    out = df.join(left, list(panel.keys), "left")
    out = _ahead(out, panel, covariates, steps) if extra else out.withColumn("_future", F.lit(None).cast("array<array<double>>"))
    out = out.withColumn("state", F.when(F.col("coef").isNotNull(), F.struct("coef", F.col("_first").alias("first"), F.col("_span").alias("span"), F.to_date("last").alias("last"), F.col("_future").alias("future"))))

    def advance(s: Column, k: Column, e: Column) -> tuple[Column, Column]:
        x = features(F.date_add(s["last"], (k * panel.days).cast("int")), s["first"], s["span"])
        known = F.get(s["future"], k.cast("int") - 1)
        return value(s["coef"], [*x, *[F.get(known, F.lit(j)) for j in range(len(extra))]]) + e, s

    return out, advance, 2 * (changepoints + 2 * (yearly + weekly)) + len(extra)


UNIVARIATE = ("fast_fourier_transform", "exponential_smoothing", "arima_univariate", "four_theta", "theta", "croston", "autoarima_univariate")
MULTIVARIATE = ("regressor", "regressor_darts", "arima", "autoarima", "statsforecast_autoarima", "kalman", "random_forest", "lgbm", "prophet")
PROBABILISTIC = ("exponential_smoothing", "arima_univariate", "regressor", "arima", "kalman", "statsforecast_autoarima", "prophet", "random_forest", "lgbm")


def model_info() -> dict[str, dict[str, bool]]:
    """The models: whether they take covariates and give intervals."""
    return {m: {"covariates": m in MULTIVARIATE, "probabilistic": m in PROBABILISTIC} for m in (*UNIVARIATE, *MULTIVARIATE)}


_PLAIN = {"fast_fourier_transform": fast_fourier_transform, "exponential_smoothing": exponential_smoothing, "four_theta": four_theta, "theta": theta, "croston": croston}
_KNOWING = {"kalman": kalman, "prophet": prophet}


def _options(name: str) -> set[str]:
    """The options that a model takes."""
    if name in ("regressor", "regressor_darts"):
        return {"lags"}
    if name in ("random_forest", "lgbm"):
        return {"lags", "trees", "depth", "seed"}
    if found := _PLAIN.get(name) or _KNOWING.get(name):
        return ({"slope", "rounds"} if name == "kalman" else set()) | set(inspect.signature(found).parameters) - {"df", "panel", "rows", "covariates", "steps", "resid"}
    return {"p", "d", "q"}


def _model(name: str, df: DataFrame, panel: Panel, rows: DataFrame, options: Mapping, covariates: DataFrame | None, steps: int, resid: bool) -> tuple[DataFrame, Advance, int]:
    if name in _PLAIN:
        return _PLAIN[name](df, panel, resid=resid, **options)
    if name in _KNOWING:
        return _KNOWING[name](df, panel, rows, covariates, steps, resid=resid, **{k: v for k, v in options.items() if k not in ("slope", "rounds")} if name == "kalman" else options)
    if name in ("regressor", "regressor_darts"):
        return _autoregression(df, panel, rows, options.get("lags", 7), 0, covariates, steps, resid)
    if "auto" in name:  # every order up to p and q; differences by a test, unless given
        orders = [(p, q) for p in range(options.get("p", 5) + 1) for q in range(options.get("q", 2) + 1)]
        return _arma(df, panel, rows, sorted(orders, key=sum), options.get("d"), covariates, steps)
    lags, difference, errors = options.get("p", 12), options.get("d", 1), options.get("q", 0)
    if errors:
        return _arma(df, panel, rows, [(lags, errors)], difference, covariates, steps)
    return _autoregression(df, panel, rows, lags, difference, covariates, steps, resid)


def forecast(df: DataFrame, panel: Panel, model: str, steps: int = 1, options: Mapping | None = None, covariates: DataFrame | None = None, samples: int | None = None, lower: float = 0.25, upper: float = 0.75, seed: int = 7, dry_run: bool = False) -> DataFrame:
    """keys, time, predictions (and quantile columns), error, type_error: ``steps`` rows after each series' own last.

    A series that is too short, irregular or holds nulls gives one row with an
    error and no prediction. With ``samples``, paths are simulated with errors
    drawn from the model's residuals, by a hash of key, sample and step, and the
    two quantiles of each step are added. With ``dry_run``, the first series is
    forecast at once, and its error raised. The regressors take an ``estimator``
    with fit and predict among their options; see ``regressed``. ``kalman`` takes
    ``slope``: level and slope by EM, with bands from the model's variance.
    """
    if model not in (*UNIVARIATE, *MULTIVARIATE):
        raise OptionError(f"model: one of {(*UNIVARIATE, *MULTIVARIATE)}, not {model!r}")
    if not isinstance(steps, int) or steps < 1:
        raise StepsError("steps must be an integer of at least 1")
    if not 0 <= lower < upper <= 1:
        raise QuantilesError("quantiles: 0 <= lower < upper <= 1")
    if samples is not None and model not in PROBABILISTIC:
        raise NotProbabilisticModelError(f"{model} gives no intervals")
    if covariates is not None and not model_info()[model]["covariates"]:
        raise CovariateError(f"{model} takes no covariates")
    if covariates is not None and panel.time not in covariates.columns:
        raise CovariateNamesError(f"covariates need the column {panel.time}")
    if dry_run:
        failed = forecast(first_series(df, panel), panel, model, steps, options, covariates, samples, lower, upper, seed).where("error is not null").collect()
        if failed:
            raise SeriesError(f"the first series: {failed[0]['error']}")
    if model in ("regressor", "regressor_darts") and "estimator" in (options or {}):
        return regressed(df, panel, steps=steps, covariates=covariates, interval=(lower, upper) if samples else None, **{"lags": 7} | dict(options))
    if unknown := sorted(set(options or {}) - _options(model)):
        raise OptionError(f"{model} has no options {unknown}; it has {sorted(_options(model))}")
    if model in ("random_forest", "lgbm"):
        return _trees(df, panel, model, steps, covariates, band=(lower, upper) if samples else None, samples=samples or 0, draw=seed, **(options or {}))
    if model == "kalman" and (options or {}).get("slope"):
        if covariates is not None:
            raise CovariateError("kalman with a slope takes no covariates")
        return _level_and_slope(df, panel, steps, (lower, upper) if samples else None, options.get("rounds", 60))
    rows = packed(df, panel)
    fit, advance, least = _model(model, rows, panel, df, dict(options or {}), covariates, steps, samples is not None)
    bad = F.when(F.col("nulls") > 0, "series with nulls").when(~F.col("regular"), "series with gaps or duplicates").when(F.col("n") < least, F.concat(F.lit(f"series under {least} rows: "), F.col("n").cast("string")))
    if "coef" in fit.columns:  # folds always have a state
        bad = bad.when(F.col("state").isNull(), "model not fitted")
    if covariates is not None:
        bad = bad.when(F.coalesce(F.size("_future"), F.lit(0)) < steps, "covariates do not cover the horizon")

    def path(noise: Callable[[Column], Column]) -> Column:
        def step(acc: Column, k: Column) -> Column:
            y, state = advance(acc["s"], k.cast("double"), noise(k))
            return F.struct(state.alias("s"), F.concat(acc["out"], F.array(y)).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.col("state").alias("s"), _empty().alias("out")), step, lambda a: a["out"])

    good = fit.withColumn("error", bad)
    point = good.where("error is null").withColumn("_p", path(lambda k: F.lit(0.0)))
    # an outer explode, as the optimizer would turn the others' "not empty" into a filter that folds once more
    out = point.select(*panel.keys, F.col("last").alias(panel.time), F.posexplode_outer("_p").alias("_k", "predictions"))
    out = out.withColumn(panel.time, panel.moved(F.col("_k") + 1))
    if samples is not None:
        drawn = good.where("error is null").withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(samples))))
        pick = lambda k: F.coalesce(F.get("resid", F.pmod(F.xxhash64(*panel.keys, "_s", k, F.lit(seed)), F.greatest(F.size("resid"), F.lit(1))).cast("int")), F.lit(0.0))
        paths = drawn.withColumn("_p", path(pick)).select(*panel.keys, F.posexplode_outer("_p").alias("_k", "_y"))
        band = paths.groupBy(*panel.keys, "_k").agg(F.percentile("_y", F.lit(lower)).alias(f"lower_quantile_{lower}"), F.percentile("_y", F.lit(upper)).alias(f"upper_quantile_{upper}"))
        out = out.join(band, [*panel.keys, "_k"])
    out = out.drop("_k").withColumn("error", F.lit(None).cast("string")).withColumn("type_error", F.lit(None).cast("string"))
    failed = good.where("error is not null").select(*panel.keys, "error", F.lit("SeriesError").alias("type_error"))
    return out.unionByName(failed, allowMissingColumns=True)


#: Groups of predictions, and the errors that each of them keeps.
LEAVES, KEPT = 16, 200


def _leaves(errors: DataFrame) -> tuple[Callable[[Column], Column], Column]:
    """(the group of a prediction, each group's errors at even shares) of rows ``_y``, ``_e``; LEAVES * KEPT numbers in all.

    Groups start between quantiles of the predictions and have their means as
    centres; a prediction is of the group with the nearest centre.
    """
    ends = quantiles(errors.withColumn("_g", F.lit(0)), ["_g"], F.col("_y"), [k / LEAVES for k in range(1, LEAVES)]).first()["_q"]
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(ends))])
    means = errors.groupBy(F.size(F.filter(bounds, lambda b: b < F.col("_y"))).alias("_g")).agg(F.avg("_y")).collect()
    centres = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(m)).alias("m")) for i, (_, m) in enumerate(sorted(means))])

    def group(y: Column) -> Column:
        return F.array_min(F.transform(centres, lambda c: F.struct(F.abs(y - c["m"]).alias("d"), c["i"].alias("i"))))["i"]

    shares = [(k + 0.5) / KEPT for k in range(KEPT)]
    kept = {r["_g"]: r["_q"] for r in quantiles(errors.withColumn("_g", group(F.col("_y"))), ["_g"], F.col("_e"), shares).collect()}
    near = [kept[min(kept, key=lambda g: (abs(g - k), g))] for k in range(len(means))]  # an empty group takes a neighbour's
    return group, F.array(*[F.array(*[F.lit(float(e)) for e in g]) for g in near])


def _trees(df: DataFrame, panel: Panel, model: str, steps: int, covariates: DataFrame | None = None, lags: int = 7, trees: int = 20, depth: int = 5, seed: int = 1, band: tuple[float, float] | None = None, samples: int = 0, draw: int = 7) -> DataFrame:
    """One tree ensemble for all regular series, on their lags and covariates; each step is predicted from the ones before.

    With a ``band``, ``samples`` paths of each series are followed as well. What a
    step adds to its prediction is drawn from the errors of held-out rows (every
    fifth, by a hash of series and time, that a second ensemble has not seen)
    whose predictions fall in the same of LEAVES groups: each keeps the quantiles
    of its errors, as a leaf would.
    """
    w, keys, extra = panel.ordered(), list(panel.keys), _extra(covariates, panel)
    names = [*[f"_l{k}" for k in range(1, lags + 1)], *[f"_c_{c}" for c in extra]]
    rows = packed(df, panel)
    if extra:
        rows = _ahead(rows, panel, covariates, steps)
    bad = F.when(F.col("nulls") > 0, "series with nulls").when(~F.col("regular"), "series with gaps or duplicates").when(F.col("n") <= lags, F.concat(F.lit(f"series under {lags + 1} rows: "), F.col("n").cast("string")))
    rows = rows.withColumn("error", bad.when(F.col("_future").isNull(), "covariates do not cover the horizon") if extra else bad)
    good = rows.where("error is null")
    made = panel.checked(df).join(good.select(*keys), keys).select("*", *[F.lag(panel.target, k).over(w).alias(n) for k, n in enumerate(names[:lags], 1)])
    train = (_with_covariates(made, panel, covariates) if extra else made).na.drop(subset=[panel.target, *names])
    failed = rows.where("error is not null").select(*keys, "error", F.lit("SeriesError").alias("type_error"))
    kinds = {f.name: f.dataType for f in panel.checked(df).schema.fields}
    if train.isEmpty():  # no series can be forecast
        none = failed.select(*keys, F.lit(None).cast(kinds[panel.time]).alias(panel.time), F.lit(None).cast("double").alias("predictions"), "error", "type_error")
        return none
    kind = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed) if model == "random_forest" else GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed)
    kind = kind.setFeaturesCol("_x").setLabelCol(panel.target).setPredictionCol("_y")
    whole = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), kind])
    fit = whole.fit(train)
    held = ["last", *(["_future"] if extra else [])]
    now = good.select(*keys, *held, F.slice(F.reverse("ys"), 1, lags).alias("_w"), _empty().alias("_out"))
    for k in range(steps):
        given = [F.get(F.get("_future", F.lit(k)), F.lit(j)).alias(f"_c_{c}") for j, c in enumerate(extra)]
        made = fit.transform(now.select("*", *[F.get("_w", F.lit(i)).alias(n) for i, n in enumerate(names[:lags])], *given))
        now = made.select(*keys, *held, F.slice(F.concat(F.array("_y"), "_w"), 1, lags).alias("_w"), F.concat("_out", F.array("_y")).alias("_out"))
    out = now.select(*keys, F.col("last").alias(panel.time), F.posexplode("_out").alias("_k", "predictions"))
    out = out.withColumn(panel.time, panel.moved(F.col("_k") + 1))
    if band:
        apart = F.pmod(F.xxhash64(*keys, panel.time, F.lit(draw)), F.lit(5)) == 0
        unseen = train.where(apart)
        second = fit if unseen.isEmpty() or train.where(~apart).isEmpty() else whole.fit(train.where(~apart))
        group, leaves = _leaves(second.transform(train if second is fit else unseen).select("_y", (F.col(panel.target) - F.col("_y")).alias("_e")))
        share = lambda k: F.pmod(F.xxhash64(*keys, "_s", F.lit(k), F.lit(draw)), F.lit(1 << 30)) / float(1 << 30)
        paths = good.select(*keys, *held, F.slice(F.reverse("ys"), 1, lags).alias("_w"), _empty().alias("_out"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("_s"))
        for k in range(steps):
            given = [F.get(F.get("_future", F.lit(k)), F.lit(j)).alias(f"_c_{c}") for j, c in enumerate(extra)]
            made = fit.transform(paths.select("*", *[F.get("_w", F.lit(i)).alias(n) for i, n in enumerate(names[:lags])], *given))
            leaf = F.get(leaves, group(F.col("_y")))
            y = F.col("_y") + F.get(leaf, F.floor(share(k) * F.size(leaf)).cast("int"))
            paths = made.select(*keys, *held, "_s", F.slice(F.concat(F.array(y), "_w"), 1, lags).alias("_w"), F.concat("_out", F.array(y)).alias("_out"))
        drawn = paths.select(*keys, F.posexplode("_out").alias("_k", "_y"))
        out = out.join(drawn.groupBy(*keys, "_k").agg(*[F.percentile("_y", F.lit(q)).alias(f"{n}_quantile_{q}") for n, q in zip(("lower", "upper"), band, strict=True)]), [*keys, "_k"])
    out = out.drop("_k").withColumn("error", F.lit(None).cast("string")).withColumn("type_error", F.lit(None).cast("string"))
    return out.unionByName(failed, allowMissingColumns=True)


def forecast_by_class(df: DataFrame, panel: Panel, classes: DataFrame, models: Mapping[str, Mapping], steps: int = 1, covariates: DataFrame | None = None) -> DataFrame:
    """Forecasts with a model for each class of ``classes`` (keys, classification).

    ``models`` maps a class to {"model": name, "options": {...}}; covariates go to
    the models that take them. A class without a model is an error; series
    without a class are left out. Rows and classes are joined once, and classes
    with the same model and options are forecast together.
    """
    known = F.col("classification").isin(*models)
    checked = classes.withColumn("classification", F.when(known, F.col("classification")).otherwise(F.raise_error(F.concat(F.lit("no model for class "), F.coalesce("classification", F.lit("null"))))))
    passes: dict[str, tuple[Mapping, list[str]]] = {}
    for name, spec in models.items():
        passes.setdefault(repr((spec["model"], sorted((spec.get("options") or {}).items(), key=str))), (spec, []))[1].append(name)
    joined = df.join(checked.select(*panel.keys, "classification"), list(panel.keys))
    if len(passes) > 1:
        joined = settled(joined)
    out = None
    for spec, names in passes.values():
        takes = covariates if model_info().get(spec["model"], {}).get("covariates") else None
        part = forecast(joined.where(F.col("classification").isin(*names)).drop("classification"), panel, spec["model"], steps, spec.get("options"), takes)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
