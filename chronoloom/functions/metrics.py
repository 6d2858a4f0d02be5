"""Accuracy measures as grouped aggregates: one window pass, one aggregation.

Groups that may not fit a task get their lags from halo rows of blocks, their
means and largest values by joins, and their medians by counted blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.scans import Blocks, matched, quantiles, seconds

EPS = 1e-10
DEFAULT = ("mae", "mape", "mse", "rmse", "wmape")


def _columns() -> dict[str, Column]:
    """Each measure over the columns that ``evaluated`` prepares."""
    a, p, e, pe, re, bre, naive = (F.col(c) for c in ("_a", "_p", "_e", "_pe", "_re", "_bre", "_naive"))
    n = F.count(e)
    size, mean = F.abs(e), F.avg(F.abs(e))
    mape, gap = F.avg(F.abs(pe)), F.avg(naive)
    smape = 2 * size / (F.abs(a) + F.abs(p) + EPS)
    spread = F.sum((a - F.col("_mean")) * (a - F.col("_mean")))

    def geometric(x: Column) -> Column:
        some = F.when(x != 0, F.ln(F.abs(x)))
        return F.when(F.count(some) == 0, 0.0).otherwise(F.exp(F.avg(some)))

    def around(x: Column, centre: Column) -> Column:
        return F.sqrt(F.greatest(F.try_divide(F.sum(x * x) - 2 * centre * F.sum(x) + n * centre * centre, n - 1), F.lit(0.0)))

    rrse = F.sqrt(F.sum(e * e) / (spread + EPS))
    return {
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "nrmse": F.when(F.max(F.abs(a)) == 0, 0.0).otherwise(F.try_divide(F.sqrt(F.avg(e * e)), F.max(a) - F.min(a))),
        "me": F.avg(e),
        "mae": mean,
        "mad": mean,
        "wmape": F.try_divide(F.sum(size), F.sum(a) + EPS),
        "gmae": geometric(size),
        "mdae": F.median(size),
        "mpe": F.avg(pe),
        "mape": mape,
        "mdape": F.median(F.abs(pe)),
        "smape": F.avg(smape),
        "smdape": F.median(smape),
        "maape": F.avg(F.atan(F.abs(F.try_divide(e, a + EPS)))),
        "mase": F.when(mean == 0, 0.0).otherwise(F.try_divide(mean, gap)),
        "std_ae": around(e, mean),
        "std_ape": around(pe, mape),
        "rmspe": F.sqrt(F.avg(pe * pe)),
        "rmdspe": F.sqrt(F.median(pe * pe)),
        "rmsse": F.when((F.max(size) == 0) | (gap == 0), 0.0).otherwise(F.try_divide(F.sqrt(F.avg(e * e)), gap)),
        "inrse": rrse,
        "rrse": rrse,
        "mre": F.avg(re),
        "rae": F.sum(size) / (F.sum(F.abs(a - F.col("_mean"))) + EPS),
        "mrae": F.avg(F.abs(re)),
        "mdrae": F.median(F.abs(re)),
        "gmrae": geometric(re),
        "mbrae": F.avg(bre),
        "umbrae": F.try_divide(F.avg(bre), 1 - F.avg(bre)),
        "mda": F.avg(F.col("_same")),
    }


METRICS = tuple(
    "mse rmse nrmse me mae mad wmape gmae mdae mpe mape mdape smape smdape maape mase std_ae std_ape rmspe rmdspe rmsse inrse rrse mre rae mrae mdrae gmrae mbrae umbrae mda".split()
)


def _medians() -> dict[str, Column]:
    """What the measures by medians take the median of."""
    a, p, e = F.col("_a"), F.col("_p"), F.col("_e")
    return {"mdae": F.abs(e), "mdape": F.abs("_pe"), "smdape": 2 * F.abs(e) / (F.abs(a) + F.abs(p) + EPS), "rmdspe": F.col("_pe") * F.col("_pe"), "mdrae": F.abs("_re")}


def evaluated(df: DataFrame, actual: str, predicted: str, by: Sequence[str], order: str, metrics: Sequence[str] = DEFAULT, benchmark: str | int = 1, seasonality: int = 1, block: int | None = None) -> DataFrame:
    """One row a group with the measures asked for (``"all"``: all 31).

    ``benchmark`` is a column of benchmark forecasts or the lag of a naive one;
    ``seasonality`` is the lag of the scaled errors. Rows with a null actual or
    prediction are left out. The percentage error of an actual of 0 is 1, or 0
    where the error is 0; where all actuals of a group are 0 it is the error.
    ``block`` asks for blocks of so many rows; without it sizes decide.
    """
    names = list(METRICS) if metrics == "all" else list(metrics)
    unknown = [m for m in names if m not in METRICS]
    if unknown:
        raise OptionError(f"unknown metrics {unknown}")
    a, p, e = F.col("_a"), F.col("_p"), F.col("_e")
    rows = df.select(*by, order, F.col(actual).cast("double").alias("_a"), F.col(predicted).cast("double").alias("_p"), *([F.col(benchmark).cast("double").alias("_bench")] if isinstance(benchmark, str) else []))
    rows = rows.where(a.isNotNull() & p.isNotNull()).withColumn("_e", a - p)
    blocks = Blocks(rows, by, seconds(F.col(order), rows.schema[order].dataType), block)
    o = blocks.local(order)
    whole = {"_mean": F.avg("_a"), "_zero": F.max(F.abs("_a")) == 0, "_exact": F.max(F.abs("_e")) == 0}
    near = blocks.haloed([order], max(1, seasonality, benchmark if isinstance(benchmark, int) else 1))
    if not isinstance(benchmark, str):
        near = near.withColumn("_bench", F.lag("_a", benchmark).over(o))
    near = near.select("*", F.lag("_a", 1).over(o).alias("_a1"), F.lag("_p", 1).over(o).alias("_p1"), F.lag("_a", seasonality).over(o).alias("_as"))
    if blocks.split:
        rows = matched(near.where(~F.col("_halo")), rows.groupBy(*by).agg(*[c.alias(n) for n, c in whole.items()]), by)
    else:
        w = Window.partitionBy(*by)
        rows = near.select("*", F.avg("_a").over(w).alias("_mean"), (F.max(F.abs("_a")).over(w) == 0).alias("_zero"), (F.max(F.abs("_e")).over(w) == 0).alias("_exact"))
    pe = F.when(F.col("_zero") & F.col("_exact"), 0.0).when(F.col("_zero"), F.abs(e)).when(a == 0, F.when(e == 0, 0.0).otherwise(1.0)).otherwise(F.try_divide(F.abs(e), a))
    off = a - F.col("_bench")
    rows = rows.select("*", pe.alias("_pe"), F.try_divide(e, off + EPS).alias("_re"), (F.abs(e) / (F.abs(e) + F.abs(off) + EPS)).alias("_bre"), F.abs(a - F.col("_as")).alias("_naive"), F.when(F.col("_a1").isNotNull(), (F.signum(a - F.col("_a1")) == F.signum(p - F.col("_p1"))).cast("double")).alias("_same"))
    columns = _columns()
    middle = {m: c for m, c in _medians().items() if m in names} if blocks.split else {}
    out = rows.groupBy(*by).agg(*[columns[m].alias(m) for m in names if m not in middle], F.lit(True).alias("_some"))
    for m, c in middle.items():
        value = F.get(f"_q_{m}", F.lit(0))
        out = matched(out, quantiles(rows, by, c, (0.5,), f"_q_{m}", block), by).withColumn(m, F.sqrt(value) if m == "rmdspe" else value)
    return out.select(*by, *names)
