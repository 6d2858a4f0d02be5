"""Features that describe a whole series, and clusters of series by them."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.functions.smoothing import smoothed
from chronoloom.series import Panel

NAMES = ("lumpiness", "acf1", "level_shift", "variance_change", "crossing_median", "flat_spots", "linearity", "curvature", "trend", "spikiness")
SMOOTHERS = ("mean", "spline")


def polynomials(df: DataFrame, panel: Panel, degree: int) -> DataFrame:
    """``df`` with p1 .. p<degree>: polynomials of each row's place in its series, orthonormal over the series.

    The recurrence is that of the discrete Chebyshev polynomials, so each value
    needs only the row's place and the series' length. Where a series has not more
    rows than the degree, the polynomial is null.
    """
    if degree < 1:
        raise OptionError("degree must be at least 1")
    rows = df.select("*", (F.row_number().over(panel.ordered()) - 1).cast("double").alias("_i"), F.count(F.lit(1)).over(panel.by()).cast("double").alias("_n"))
    n = F.col("_n")
    x = F.col("_i") - (n - 1) / 2
    before, now, size, made = F.lit(0.0), F.lit(1.0), n, []
    for k in range(1, degree + 1):
        ratio = (k - 1) ** 2 * (n * n - (k - 1) ** 2) / (4 * (4 * (k - 1) ** 2 - 1)) if k > 1 else F.lit(0.0)
        before, now = now, x * now - ratio * before
        size = size * (k * k * (n * n - k * k) / (4 * (4 * k * k - 1)))
        made.append(F.when(n > k, now / F.sqrt(size)).alias(f"p{k}"))
    return rows.select(*df.columns, *made)


def decomposed(df: DataFrame, panel: Panel, period: int) -> DataFrame:
    """keys, time, target, trend, seasonal, rest: trend by a centred moving mean over ``period`` rows, seasons by the mean of what it leaves.

    The first and last half period have no trend and no rest; seasons sum to 0.
    """
    if period < 2:
        raise OptionError("period must be at least 2")
    y, w, half = F.col(panel.target), panel.ordered(), period // 2
    inner = F.sum(y).over(w.rowsBetween(-((period - 1) // 2), (period - 1) // 2))
    ends = (F.lag(y, half).over(w) + F.lead(y, half).over(w)) / 2 if period % 2 == 0 else F.lit(0.0)
    full = F.count(y).over(w.rowsBetween(-half, half)) == 2 * half + 1
    rows = panel.checked(df).select("*", F.when(full, (inner + ends) / period).alias("trend"), ((F.row_number().over(w) - 1) % period).alias("_p"))
    means = rows.groupBy(*panel.keys, "_p").agg(F.avg(y - F.col("trend")).alias("_s"))
    means = means.withColumn("seasonal", F.col("_s") - F.avg("_s").over(panel.by()))
    out = rows.join(means.drop("_s"), [*panel.keys, "_p"])
    return out.select(*panel.keys, panel.time, panel.target, "trend", "seasonal", (y - F.col("trend") - F.col("seasonal")).alias("rest"))


def strengths(df: DataFrame, panel: Panel, period: int) -> DataFrame:
    """One row a series: how much trend and seasons explain (0 to 1), and the spikiness of the rest, for series with a period."""
    rows = decomposed(df, panel, period).where(F.col("rest").isNotNull())
    share = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce(F.try_divide(F.var_pop("rest"), F.var_pop(v)), F.lit(1.0))))
    y, m = F.col(panel.target), F.count(F.lit(1)).over(panel.by()) - 1
    total, squares = F.sum("rest").over(panel.by()), F.sum(F.col("rest") * F.col("rest")).over(panel.by())
    one_out = F.when(m > 1, ((squares - F.col("rest") * F.col("rest")) - (total - F.col("rest")) * (total - F.col("rest")) / m) / (m - 1))
    return rows.withColumn("_out", one_out).groupBy(*panel.keys).agg(share(y - F.col("seasonal")).alias("trend"), share(y - F.col("trend")).alias("seasonality"), F.var_pop("_out").alias("spikiness"))


def featurized(df: DataFrame, panel: Panel, width: int = 10, smoother: str = "mean") -> DataFrame:
    """One row a series with the features of NAMES, from windows over the ordered series.

    The trend is a centred moving mean of ``width`` rows, or a penalised smoother
    with ``smoother="spline"`` (see ``smoothing.smoothed``); trend strength and
    spikiness come from what it leaves; linearity and curvature are the trend's
    coefficients on the first two orthogonal polynomials of its place.
    """
    if width <= 1:
        raise OptionError("width must be over 1")
    if smoother not in SMOOTHERS:
        raise OptionError(f"smoother: one of {SMOOTHERS}, not {smoother!r}")
    y, by, w = F.col(panel.target), panel.by(), panel.ordered()
    frame = w.rowsBetween(-(width - 1), 0)
    n = F.count(F.lit(1)).over(by)
    rows = panel.checked(df)
    if smoother == "spline":
        rows, trend = smoothed(rows, panel).withColumnRenamed("trend", "_fit"), F.col("_fit")
    else:
        trend = F.avg(y).over(w.rowsBetween(-(width // 2), (width - 1) // 2))
    a = rows.select("*", (F.row_number().over(w) - 1).alias("_i"), n.alias("_n"), F.lag(y, 1).over(w).alias("_y1"), F.min(y).over(by).alias("_low"), F.max(y).over(by).alias("_high"), F.when(F.count(y).over(frame) == width, F.avg(y).over(frame)).alias("_mean"), F.when(F.count(y).over(frame) == width, F.var_samp(y).over(frame)).alias("_var"), trend.alias("_trend"))
    bin_ = F.when(F.col("_high") == F.col("_low"), 1).otherwise(F.greatest(F.ceil(F.try_divide((y - F.col("_low")) * 10, F.col("_high") - F.col("_low"))), F.lit(1)))
    b = a.select("*", bin_.alias("_bin"), F.floor(F.col("_i") / width).alias("_seg"), F.abs(F.col("_mean") - F.lag("_mean", width).over(w)).alias("_dm"), F.abs(F.col("_var") - F.lag("_var", width).over(w)).alias("_dv"), (y - F.col("_trend")).alias("_rest"))
    # places as orthogonal polynomials: x is centred, x*x - mean(x*x) is orthogonal to it
    x = F.col("_i") - (F.col("_n") - 1) / 2
    q = x * x - (F.col("_n") * F.col("_n") - 1) / 12
    b = b.select("*", x.alias("_x"), q.alias("_q"), F.when(F.lag("_bin").over(w) == F.col("_bin"), 0).otherwise(1).alias("_turn"))
    sums = F.sum("_rest").over(by), F.sum(F.col("_rest") * F.col("_rest")).over(by)
    m = F.col("_n") - 1
    one_out = F.when(F.col("_n") > 2, ((sums[1] - F.col("_rest") * F.col("_rest")) - (sums[0] - F.col("_rest")) * (sums[0] - F.col("_rest")) / m) / (m - 1))
    c = b.select("*", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"), one_out.alias("_out"))
    full = F.col("_seg") < F.floor(F.col("_n") / width)
    segments = c.where(full & (F.col("_i") % width != 0)).groupBy(*panel.keys, "_seg").agg(F.var_samp(y).alias("v")).groupBy(*panel.keys).agg(F.var_pop("v").alias("lumpiness"))
    runs = c.groupBy(*panel.keys, "_run").agg(F.count(F.lit(1)).alias("r")).groupBy(*panel.keys).agg(F.max("r").alias("flat_spots"))
    rest = F.var_pop("_rest")
    whole = c.groupBy(*panel.keys).agg(
        F.corr(y, F.col("_y1")).alias("acf1"),
        F.max("_dm").alias("level_shift"),
        F.max("_dv").alias("variance_change"),
        F.sum(F.when((F.col("_i") >= 1) & (y <= (F.col("_high") - F.col("_low")) / 2), 1).otherwise(0)).alias("crossing_median"),
        F.try_divide(F.sum(F.col("_trend") * F.col("_x")), F.sqrt(F.sum(F.col("_x") * F.col("_x")))).alias("linearity"),
        F.try_divide(F.sum(F.col("_trend") * F.col("_q")), F.sqrt(F.sum(F.col("_q") * F.col("_q")))).alias("curvature"),
        F.when(F.var_pop(y) < 1e-10, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(rest, F.var_pop(y))))).alias("trend"),
        F.var_pop("_out").alias("spikiness"),
    )
    return whole.join(segments, list(panel.keys), "left").join(runs, list(panel.keys)).select(*panel.keys, *NAMES)


def clusterized(df: DataFrame, panel: Panel, k: int = 3, seed: int = 1, width: int = 10) -> DataFrame:
    """The series' features with ``cluster``, by k-means over min-max scaled features; missing features count as 0."""
    table = featurized(df, panel, width).na.fill(0.0, list(NAMES))
    steps = [VectorAssembler(inputCols=list(NAMES), outputCol="_raw"), MinMaxScaler(inputCol="_raw", outputCol="_scaled"), KMeans(featuresCol="_scaled", predictionCol="cluster", k=k, seed=seed)]
    return Pipeline(stages=steps).fit(table).transform(table).drop("_raw", "_scaled")
