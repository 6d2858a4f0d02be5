"""Lag features and rolling predictors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import CovariateNamesError, LagsError, OptionError
from chronoloom.series import Panel

ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}


def lagged(df: DataFrame, panel: Panel, lags: int, rolling: Mapping[str, int | tuple[Callable[[Column], Column], int]] | None = None, covariates: DataFrame | None = None, on: Sequence[str] | None = None) -> DataFrame:
    """keys, time, target, lag_1 .. lag_n (and rolling_<name>, covariates) of rows with a full history.

    ``rolling`` maps a predictor's name to its window, which ends one row before,
    or to a function of the window's values (an array in order) and the window; a
    window must not be shorter than ``lags``. ``covariates`` are joined by time
    (and by keys that they hold); a training row without them raises an error.
    """
    if not isinstance(lags, int) or lags < 1:
        raise LagsError("lags must be an integer of at least 1")
    rows = panel.checked(df)
    blocks = panel.blocks(rows)
    w = blocks.local(panel.time)
    made: list[Column] = [F.lag(panel.target, k).over(w).alias(f"lag_{k}") for k in range(1, lags + 1)]
    need = lags
    for name, spec in (rolling or {}).items():
        function, width = spec if isinstance(spec, tuple) else (None, spec)
        if not function and name not in ROLLING:
            raise OptionError(f"rolling predictor: one of {tuple(ROLLING)}, not {name!r}")
        if width < lags:
            raise OptionError("a rolling window must not be shorter than the lags")
        frame = w.rowsBetween(-width, -1)
        value = function(F.collect_list(panel.target).over(frame)) if function else ROLLING[name](panel.target).over(frame)
        made.append(value.alias(f"rolling_{name}"))
        need = max(need, width)
    near = blocks.haloed([panel.time], need)  # a block's own rows have more than ``need`` rows before them where the series' do
    out = near.select("*", *made, F.row_number().over(w).alias("_i")).where((F.col("_i") > need) & ~F.col("_halo")).drop("_i", "_halo", "_block")
    if covariates is None:
        return out
    shared = list(on or [c for c in (*panel.keys, panel.time) if c in covariates.columns])
    if panel.time not in shared:
        raise CovariateNamesError("covariates need the time column")
    extra = [c for c in covariates.columns if c not in shared]
    joined = out.join(covariates.select(*shared, F.lit(True).alias("_known"), *[F.col(c).cast("double").alias(c) for c in extra]), shared, "left")
    complete = F.coalesce(F.col("_known"), F.lit(False))
    for c in extra:
        complete = complete & F.col(c).isNotNull()
    first = F.when(complete, F.col("lag_1")).otherwise(F.raise_error(F.lit("a row without covariates")).cast("double"))
    return joined.withColumn("lag_1", first).select(*out.columns, *extra)
