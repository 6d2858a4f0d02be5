"""Prediction intervals of autoregressions by bootstrap refits and .632+ residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.functions.lags import lagged
from chronoloom.models.forecast import forecast, packed
from chronoloom.models.linear import fitted
from chronoloom.series import Panel

#: Each row is drawn a Poisson number of times with this mean into a refit.
SHARE = 0.9


def _dot(coef: Column, x: Column) -> Column:
    terms = F.zip_with(F.slice(coef, 2, F.size(x)), x, lambda c, v: c * v)
    return F.get(coef, F.lit(0)) + F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def bootstrap_interval(df: DataFrame, panel: Panel, lags: int, steps: int = 1, lower: float = 0.25, upper: float = 0.75, refits: int | None = None, seed: int = 5) -> DataFrame:
    """keys, time, predictions, lower_quantile_<q>, upper_quantile_<q> of a linear autoregression.

    Every series is refitted ``refits`` times (the root of its rows unless given)
    in one aggregation over (series, refit). A step's band holds the quantiles of
    point + centred refit prediction + residual, where residuals mix training and
    out-of-sample ones by the .632+ weight. Draws depend on key, refit and row
    alone. A series without enough rows has no row here; ``forecast`` says why.
    """
    if not 0 <= lower < upper <= 1:
        raise OptionError("quantiles: 0 <= lower < upper <= 1")
    keys = list(panel.keys)
    xs = [F.col(f"lag_{k}") for k in range(1, lags + 1)]
    base = lagged(df, panel, lags)
    rows = base.select(*keys, panel.time, F.col(panel.target).alias("_y"), *xs)
    point = fitted(rows, keys, F.col("_y"), xs).where("coef is not null").select(*keys, "coef", F.col("rows").alias("_n"))

    # draws: a Poisson count for each (row, refit), from a hash; a row that is not drawn is out of sample
    b = F.explode(F.sequence(F.lit(1), F.lit(refits) if refits else F.floor(F.sqrt("_n")).cast("int"))).alias("_b")
    u = (F.pmod(F.xxhash64(*keys, panel.time, "_b", F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    spread = rows.join(point.select(*keys, "_n"), keys).select("*", b).withColumn("_u", u)
    p, total, count = 2.718281828459045**-SHARE, 0.0, F.lit(0)
    for k in range(8):
        total += p
        count = F.when(F.col("_u") >= total, k + 1).otherwise(count)
        p *= SHARE / (k + 1)
    spread = spread.withColumn("_w", count)
    drawn = spread.where("_w > 0").select(*keys, "_b", "_y", *xs, F.explode(F.sequence(F.lit(1), F.col("_w"))))
    refit = fitted(drawn, [*keys, "_b"], F.col("_y"), xs).where("coef is not null").select(*keys, "_b", "coef")
    outside = spread.where("_w = 0").join(refit, [*keys, "_b"])
    missed = outside.groupBy(*keys, "_b").agg(F.avg(F.col("_y") - _dot(F.col("coef"), F.array(*xs))).alias("_v"))

    # residuals: training ones, out-of-sample ones, and their .632+ mixture
    hundred = F.array(*[F.lit(k / 100) for k in range(100)])
    fit = rows.join(point, keys).withColumn("_p", _dot(F.col("coef"), F.array(*xs)))
    e = F.col("_y") - F.col("_p")
    train = fit.groupBy(*keys).agg(F.percentile(e, hundred).alias("_train"), F.avg(e).alias("_mt"), (F.avg(F.col("_y") * F.col("_y")) - 2 * F.avg("_y") * F.avg("_p") + F.avg(F.col("_p") * F.col("_p"))).alias("_none"))
    valid = missed.groupBy(*keys).agg(F.percentile("_v", hundred).alias("_valid"), F.avg("_v").alias("_mv"))
    both = train.join(valid, keys)
    over = F.aggregate("_train", F.lit(0.0), lambda a, t: a + F.coalesce(F.try_divide(F.abs(F.col("_mv") - F.col("_mt")), F.abs(F.col("_none") - t)), F.lit(0.0))) / 100
    weight = F.least(F.lit(1.0), 0.632 / (1 - 0.368 * F.least(over, F.lit(1.0))))
    residuals = both.withColumn("_k", weight).select(*keys, F.zip_with("_train", "_valid", lambda t, v: (1 - F.col("_k")) * t + F.col("_k") * v).alias("_resid"))

    # the rows that the recursion looks at, then all refits on them
    ahead = forecast(df, panel, "regressor", steps, {"lags": lags}).where("error is null").select(*keys, panel.time, "predictions")
    paths = ahead.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(panel.time, "predictions"))), lambda r: r["predictions"]).alias("_path"))
    seen = packed(df, panel).join(paths, keys).withColumn("_all", F.concat("ys", "_path"))
    looked = seen.select(*keys, F.col("last").alias(panel.time), "n", "_all", "_path", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_h"))
    looked = looked.select(*keys, panel.time, "_h", F.get("_path", F.col("_h") - 1).alias("predictions"), F.reverse(F.slice("_all", F.col("n") + F.col("_h") - lags, F.lit(lags))).alias("_x"))
    guesses = looked.join(refit, keys).withColumn("_g", _dot(F.col("coef"), F.col("_x"))).groupBy(*keys, panel.time, "_h", "predictions").agg(F.collect_list("_g").alias("_g"))
    mean = F.aggregate("_g", F.lit(0.0), lambda a, g: a + g) / F.size("_g")
    mixed = guesses.withColumn("_m", mean).join(residuals, keys).select(*keys, panel.time, "_h", "predictions", F.explode(F.flatten(F.transform("_g", lambda g: F.transform("_resid", lambda r: F.col("predictions") + g - F.col("_m") + r)))).alias("_y"))
    band = mixed.groupBy(*keys, panel.time, "_h", "predictions").agg(F.percentile("_y", F.lit(lower)).alias(f"lower_quantile_{lower}"), F.percentile("_y", F.lit(upper)).alias(f"upper_quantile_{upper}"))
    return band.withColumn(panel.time, panel.moved(F.col("_h"))).drop("_h")
