"""Autoregression with any estimator that has fit and predict, a series at a time in its own group.

Least squares over all series at once is in ``forecast``; this is for estimators
that only Python knows. Spark deals the series to tasks; a group holds one series.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import CovariateNamesError, EstimatorError, LagsError, OptionError, QuantilesError, StepsError
from chronoloom.series import Panel

#: Share of the rows that a refit draws, with replacement.
SHARE = 0.9


class Estimator(Protocol):
    """What a regressor must do."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> object: ...

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def _row(history: np.ndarray, lags: int, rolling: Mapping[str, tuple[Callable, int]], known: np.ndarray) -> np.ndarray:
    """Features of the row behind ``history``: lags (latest first), rolling predictors, covariates."""
    made = [float(f(history[-width:])) for f, width in rolling.values()]
    return np.concatenate((history[: -lags - 1 : -1], made, known))


def _refits(estimator: Estimator, x: np.ndarray, y: np.ndarray, number: int, seed: int) -> tuple[list[Estimator], list[float]]:
    """Models of bootstrap samples, and each one's mean error on the rows that it did not draw."""
    random, models, missed = np.random.default_rng(seed), [], []
    for _ in range(number):
        drawn = random.integers(0, len(y), max(int(SHARE * len(y)), 1))
        rest = np.setdiff1d(np.arange(len(y)), drawn)
        model = copy.deepcopy(estimator)
        model.fit(x[drawn], y[drawn])
        models.append(model)
        if len(rest):
            missed.append(float(np.mean(y[rest] - model.predict(x[rest]))))
    return models, missed


def _mixed_residuals(y: np.ndarray, guess: np.ndarray, missed: list[float]) -> np.ndarray:
    """Percentiles 0 to 99 of training and out-of-sample residuals, mixed by the .632+ rule."""
    train, valid = (np.percentile(v, np.arange(100)) for v in (y - guess, missed or [0.0]))
    none = np.mean(y * y) - 2 * np.mean(y) * np.mean(guess) + np.mean(guess * guess)
    far = np.abs(none - train)
    over = np.mean(np.divide(abs(np.mean(missed or [0.0]) - np.mean(y - guess)), far, out=np.zeros(100), where=far > 0))
    weight = 0.632 / (1 - 0.368 * min(over, 1.0))
    return (1 - weight) * train + weight * valid


def regressed(df: DataFrame, panel: Panel, estimator: Estimator, lags: int, steps: int = 1, covariates: DataFrame | None = None, rolling: Mapping[str, tuple[Callable[[np.ndarray], float], int]] | None = None, interval: tuple[float, float] | None = None, refits: int | None = None, seed: int = 5) -> DataFrame:
    """keys, time, predictions (and lower_quantile_<q>, upper_quantile_<q>), error, type_error.

    A copy of ``estimator`` is fitted for each series on its ``lags`` last values
    (latest first), on ``rolling`` predictors (name: a function of the window's
    values in order, and the window, not shorter than the lags) and on
    ``covariates`` (time, any of the keys, columns of numbers), then predicts step
    by step from its own predictions. ``interval`` asks for a band by ``refits``
    bootstrap refits (the root of the rows unless given) with .632+ residuals.
    Whatever goes wrong with a series, in the estimator too, gives one row with
    its error; the other series are not touched.
    """
    if not isinstance(lags, int) or lags < 1:
        raise LagsError("lags must be an integer of at least 1")
    if not isinstance(steps, int) or steps < 1:
        raise StepsError("steps must be an integer of at least 1")
    if isinstance(estimator, type) or not all(callable(getattr(estimator, m, None)) for m in ("fit", "predict")):
        raise EstimatorError("an estimator is an object with fit and predict")
    if interval and not 0 <= interval[0] < interval[1] <= 1:
        raise QuantilesError("quantiles: 0 <= lower < upper <= 1")
    rolling = dict(rolling or {})
    if short := [n for n, (_, width) in rolling.items() if width < lags]:
        raise OptionError(f"rolling windows shorter than the lags: {short}")
    keys, time, target = list(panel.keys), panel.time, panel.target
    rows = panel.checked(df).withColumn("_ahead", F.lit(False))
    extra: list[str] = []
    if covariates is not None:
        if time not in covariates.columns:
            raise CovariateNamesError(f"covariates need the column {time}")
        extra = [c for c in covariates.columns if c not in (*keys, time)]
        shared = [c for c in (*keys, time) if c in covariates.columns]
        ends = rows.groupBy(*keys).agg(F.max(time).alias(time)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        ahead = ends.select(*keys, panel.moved(F.col("_k")).alias(time), F.lit(None).cast("double").alias(target), F.lit(True).alias("_ahead"))
        known = covariates.select(*shared, *[F.col(c).cast("double").alias(f"_c_{c}") for c in extra])
        rows = rows.unionByName(ahead).join(known, shared, "left")
    need, step = max([lags, *(w for _, w in rolling.values())]), pd.Timedelta(seconds=panel.seconds)
    bands = [f"lower_quantile_{interval[0]}", f"upper_quantile_{interval[1]}"] if interval else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0][keys].to_dict()
        try:
            pdf = pdf.sort_values(time, kind="stable")
            past, ahead = pdf[~pdf["_ahead"].astype(bool)], pdf[pdf["_ahead"].astype(bool)]
            y, t = past[target].to_numpy(float), pd.to_datetime(past[time])
            if np.isnan(y).any():
                raise ValueError("series with nulls")
            if (t.diff().iloc[1:] != step).any():
                raise ValueError("series with gaps or duplicates")
            if len(y) <= need:
                raise ValueError(f"series under {need + 1} rows: {len(y)}")
            c = past[[f"_c_{n}" for n in extra]].to_numpy(float)
            future = ahead[[f"_c_{n}" for n in extra]].to_numpy(float) if extra else np.zeros((steps, 0))
            if np.isnan(c[need:]).any() or np.isnan(future).any():
                raise ValueError("covariates do not cover the series and the horizon")
            x = np.stack([_row(y[:i], lags, rolling, c[i]) for i in range(need, len(y))])
            if np.isnan(x).any():
                raise ValueError("a rolling predictor gave no number")
            goal = y[need:]
            model = copy.deepcopy(estimator)
            model.fit(x, goal)
            history, seen, out = y, [], []
            for k in range(steps):
                seen.append(_row(history, lags, rolling, future[k]))
                out.append(float(np.asarray(model.predict(seen[-1][None])).ravel()[0]))
                history = np.append(history, out[-1])
            columns = {time: [t.iloc[-1] + (k + 1) * step for k in range(steps)], "predictions": out}
            if interval:
                models, missed = _refits(estimator, x, goal, refits or max(int(len(goal) ** 0.5), 1), seed)
                left = _mixed_residuals(goal, np.asarray(model.predict(x)).ravel(), missed)
                guesses = np.stack([np.asarray(m.predict(np.stack(seen))).ravel() for m in models])
                spread = (guesses - guesses.mean(0))[:, None, :] + left[None, :, None]
                for name, q in zip(bands, interval, strict=True):
                    columns[name] = np.array(out) + np.quantile(spread.reshape(-1, steps), q, axis=0)
            made = pd.DataFrame(columns)
            made[time] = made[time].dt.date if panel.daily else made[time]
            return made.assign(**head, error=None, type_error=None)[[*keys, *made.columns, "error", "type_error"]]
        except Exception as error:  # noqa: BLE001  one bad series must not end the others
            return pd.DataFrame([head | {time: None, "predictions": None} | dict.fromkeys(bands) | {"error": str(error), "type_error": type(error).__name__}])

    kinds = {f.name: f.dataType.simpleString() for f in panel.checked(df).schema.fields}
    schema = [*(f"`{k}` {kinds[k]}" for k in keys), f"`{time}` {'date' if panel.daily else 'timestamp_ntz'}", "predictions double", *(f"`{b}` double" for b in bands), "error string, type_error string"]
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(schema))
