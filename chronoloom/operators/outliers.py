"""Outlier detection: column ``inlier`` is 1, or -1 for outliers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.models.linear import fitted, vector_fitted
from chronoloom.scans import Blocks, matched, quantiles
from chronoloom.series import Panel


def _marks(inside: Column) -> Column:
    return F.when(inside, 1).otherwise(-1).alias("inlier")


def _with(df: DataFrame, stats: DataFrame, panel: Panel) -> DataFrame:
    """Rows with their series' statistics: aggregated first, so that a long series is not one task's window; null keys match."""
    return matched(df, stats, panel.keys)


def iqr(df: DataFrame, panel: Panel, factor: float = 2.2) -> DataFrame:
    """Inliers lie within ``factor`` interquartile ranges of the quartiles, bounds included."""
    y = F.col(panel.target)
    quartiles = quantiles(df, panel.keys, y, (0.25, 0.75), block=panel.block)
    low, high = F.col("_q")[0], F.col("_q")[1]
    return _with(df, quartiles, panel).select(*df.columns, _marks(y.isNull() | y.between(low - factor * (high - low), high + factor * (high - low))))


def modified_zscore(df: DataFrame, panel: Panel, threshold: float = 5.0) -> DataFrame:
    """Inliers have |0.6745 (y - median) / MAD| under ``threshold``; with MAD 0 the plain z-score counts, and a score of 0/0 passes."""
    y, panel = F.col(panel.target), panel.sized(df)
    a = _with(df, df.groupBy(*panel.keys).agg(F.avg(y).alias("_avg"), F.stddev_pop(y).alias("_sd")), panel)
    a = _with(a, quantiles(df, panel.keys, y, (0.5,), "_m", panel.block), panel).withColumn("_m", F.get("_m", F.lit(0)))
    b = _with(a, quantiles(a, panel.keys, F.abs(y - F.col("_m")), (0.5,), "_mad", panel.block), panel).withColumn("_mad", F.get("_mad", F.lit(0)))
    z = F.when(F.col("_mad") != 0, F.try_divide(0.6745 * (y - F.col("_m")), F.col("_mad"))).otherwise(F.try_divide(y - F.col("_avg"), F.col("_sd")))
    return b.select(*df.columns, _marks(z.isNull() | (F.abs(z) < threshold)))


def rolling_window(df: DataFrame, panel: Panel, quantile: float = 0.9) -> DataFrame:
    """Inliers are at most the ``quantile`` of |y - moving mean|, over windows of half the series.

    The width differs by series, so the mean comes from prefix sums, joined to
    those one width before; rows without a full window take the series' mean. Of
    a long series the sums start anew in each block, and a scan carries them on.
    """
    y, panel = F.col(panel.target), panel.sized(df)
    known = df.where(y.isNotNull())
    blocks = panel.blocks(known)
    order = blocks.local(panel.time, panel.target)
    rows = blocks.rows.select("*", F.row_number().over(order).alias("_i"), F.sum(y).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"))
    rows = blocks.carried(rows, {"_rows": F.count(F.lit(1)), "_sums": F.sum(y)}, {"_i0": lambda past, _: F.sum("_rows").over(past), "_c0": lambda past, _: F.sum("_sums").over(past)})
    rows = rows.withColumn("_i", F.col("_i") + F.coalesce("_i0", F.lit(0))).withColumn("_c", F.col("_c") + F.coalesce("_c0", F.lit(0.0)))
    rows = _with(rows, known.groupBy(*panel.keys).agg(F.floor(F.count(y) / 2).alias("_w"), F.avg(y).alias("_avg")), panel)
    earlier = rows.select(*panel.keys, (F.col("_i") + F.col("_w")).alias("_i"), F.col("_c").alias("_before"))
    joined = matched(rows, earlier, [*panel.keys, "_i"])
    total = F.when(F.col("_i") == F.col("_w"), F.col("_c")).when(F.col("_i") > F.col("_w"), F.col("_c") - F.col("_before"))
    off = joined.withColumn("_off", F.abs(y - F.coalesce(F.try_divide(total, F.col("_w")), F.col("_avg"))))
    top = _with(off, quantiles(off, panel.keys, F.col("_off"), (quantile,), "_top", panel.block), panel)
    return top.select(*df.columns, _marks(y <= F.get("_top", F.lit(0)))).unionByName(df.where(y.isNull()).select("*", F.lit(1).alias("inlier")))


def dbscan(df: DataFrame, panel: Panel, eps: float = 2.0, min_samples: int = 5) -> DataFrame:
    """Density clustering along the target's axis; noise is an outlier. Adds ``cluster`` too (from 0, by value; -1: noise).

    Rows are in order of their values. A row is a core if ``min_samples`` rows lie
    within ``eps``, which its nearest ``min_samples - 1`` rows on each side
    decide: the halo of a block. Cores chain up where they are ``eps`` apart at
    most; the last core and the number of chains are carried over blocks.
    """
    y, e = F.col(panel.target), float(eps)
    blocks = Blocks(df.where(y.isNotNull()), panel.keys, y, panel.block)
    order = (panel.target, panel.time)
    near = blocks.haloed(order, min_samples - 1, min_samples - 1)
    names = ", ".join(f"`{k}`" for k in blocks.by)
    dense = F.expr(f"count(1) over (partition by {names} order by `{panel.target}` range between {e!r}D preceding and {e!r}D following)") >= min_samples
    rows = near.withColumn("_core", dense).where(~F.col("_halo")).drop("_halo")
    w = blocks.local(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    core = F.when(F.col("_core"), y)
    rows = blocks.carried(rows, {"_top": F.max(core)}, {"_top0": lambda p, _: F.max("_top").over(p)})
    rows = rows.withColumn("_last", F.coalesce(F.last(core, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top0")))
    fresh = F.when(F.col("_core") & (F.col("_last").isNull() | (y - F.col("_last") > e)), 1).otherwise(0)
    rows = rows.withColumn("_f", fresh).withColumn("_n", F.sum("_f").over(past))
    rows = blocks.carried(rows, {"_chains": F.sum("_f")}, {"_n0": lambda p, _: F.sum("_chains").over(p)})
    rows = rows.withColumn("_c", F.when(F.col("_core"), F.struct(y.alias("y"), (F.col("_n") + F.coalesce("_n0", F.lit(0)) - 1).alias("c"))))
    rows = blocks.carried(rows, {"_l": F.max("_c"), "_h": F.min("_c")}, {"_l0": lambda p, _: F.max("_l").over(p), "_h0": lambda _, f: F.min("_h").over(f)})
    kind = "struct<y:double,c:bigint>"
    rows = rows.select("*", F.coalesce(F.last("_c", True).over(past), F.col("_l0").cast(kind)).alias("_a"), F.coalesce(F.last("_c", True).over(blocks.back(*order)), F.col("_h0").cast(kind)).alias("_b"))
    cluster = F.when(y - F.col("_a.y") <= e, F.col("_a.c")).when(F.col("_b.y") - y <= e, F.col("_b.c")).otherwise(-1).cast("int")
    return rows.withColumn("cluster", cluster).select(*df.columns, _marks(F.col("cluster") >= 0), "cluster")


#: Critical points of the Dickey-Fuller statistic with a constant, by the share of rejections.
CRITICAL = {0.01: -3.43, 0.05: -2.86, 0.1: -2.57}


def residual(df: DataFrame, panel: Panel, times: float = 1.0, order: int = 1, search: bool = False, difference: bool = False) -> DataFrame:
    """Outliers have a squared autoregression residual of at least mean + ``times`` standard deviations.

    The autoregression has ``order`` lags; with ``search``, as many of them as give
    the least AICc. With ``difference``, series that are not stationary are
    differenced first, up to three times. Rows without a residual are inliers.
    """
    if order < 1:
        raise OptionError("order must be at least 1")
    y, w = F.col(panel.target), panel.ordered()
    rows = df.withColumn("_v", y)
    for _ in range(3 if difference else 0):
        level = stationary(rows.select(*panel.keys, panel.time, F.col("_v").alias(panel.target)), panel).select(*panel.keys, F.col("stationary").alias("_ok"))
        rows = _with(rows.withColumn("_w", F.col("_v") - F.lag("_v").over(w)), level, panel)
        rows = rows.withColumn("_v", F.when(F.coalesce("_ok", F.lit(True)), F.col("_v")).otherwise(F.col("_w"))).drop("_ok", "_w")
    lags = [f"_p{k}" for k in range(1, order + 1)]
    rows = rows.select("*", *[F.lag("_v", k).over(w).alias(c) for k, c in enumerate(lags, 1)])
    if order == 1 and not search:
        model = rows.groupBy(*panel.keys).agg(F.array(F.regr_intercept("_v", "_p1"), F.regr_slope("_v", "_p1")).alias("_f"))
    else:
        model = fitted(rows, panel.keys, F.col("_v"), [F.col(c) for c in lags], search=search).select(*panel.keys, F.col("coef").alias("_f"))
    guess = F.get("_f", F.lit(0))
    for k, c in enumerate(lags, 1):
        guess = guess + F.get("_f", F.lit(k)) * F.col(c)
    squared = _with(rows, model, panel).withColumn("_e", F.pow(F.col("_v") - guess, F.lit(2)))
    tops = squared.groupBy(*panel.keys).agg((F.avg("_e") + times * F.stddev_samp("_e")).alias("_top"))
    return _with(squared, tops, panel).select(*df.columns, _marks(F.col("_e").isNull() | F.col("_top").isNull() | (F.col("_e") < F.col("_top"))))


def joint_residual(df: DataFrame, panel: Panel, columns: Sequence[str], times: float = 1.0, order: int = 1) -> DataFrame:
    """Outliers of several columns at once, by a vector autoregression of up to ``order`` lags (see ``vector_fitted``).

    A row's distance is that of its residuals, squared, by their inverse
    covariance; outliers have one of at least mean + ``times`` standard
    deviations. Rows without all lags, and series too short or without spread,
    have inliers. ``df`` keeps all its columns; series are in blocks where long.
    """
    if order < 1 or not columns:
        raise OptionError("a vector autoregression needs an order of at least 1 and a column")
    blocks = panel.blocks(df)
    w, m = blocks.local(panel.time), len(columns)
    lags = [[f"_l{k}_{i}" for i in range(m)] for k in range(1, order + 1)]
    near = blocks.haloed([panel.time], order)
    rows = near.select("*", *[F.lag(F.col(c).cast("double"), k).over(w).alias(lags[k - 1][i]) for k in range(1, order + 1) for i, c in enumerate(columns)]).where(~F.col("_halo"))
    flat = [c for lag in lags for c in lag]
    model = vector_fitted(rows, panel.keys, [F.col(c) for c in columns], [[F.col(c) for c in lag] for lag in lags])
    rows = _with(rows, model, panel)

    def left(i: int, c: str) -> Column:
        coef = F.get("coef", F.lit(i))
        return sum((F.get(coef, F.lit(j + 1)) * F.col(x) for j, x in enumerate(flat)), F.get(coef, F.lit(0))) * -1 + F.col(c).cast("double")

    rows = rows.select("*", *[left(i, c).alias(f"_r{i}") for i, c in enumerate(columns)])
    far = sum((F.col(f"_r{i}") * F.get(F.get("inverse", F.lit(i)), F.lit(j)) * F.col(f"_r{j}") for i in range(m) for j in range(m)), F.lit(0.0))
    rows = rows.withColumn("_e", far)
    tops = rows.groupBy(*panel.keys).agg((F.avg("_e") + times * F.stddev_samp("_e")).alias("_top"))
    return _with(rows, tops, panel).select(*df.columns, _marks(F.col("_e").isNull() | F.col("_top").isNull() | (F.col("_e") < F.col("_top"))))


def stationary(df: DataFrame, panel: Panel, critical: float = CRITICAL[0.05], lags: int = 0) -> DataFrame:
    """One row a series: the (augmented, with ``lags``) Dickey-Fuller statistic of its differences on its levels, and whether it is at most ``critical``."""
    y, w = F.col(panel.target), panel.ordered()
    rows = df.withColumn("_x", F.lag(panel.target).over(w)).withColumn("_d", y - F.col("_x"))
    if lags:
        rows = rows.select("*", *[F.lag("_d", k).over(w).alias(f"_d{k}") for k in range(1, lags + 1)])
        more = [F.col(f"_d{k}") for k in range(1, lags + 1)]
        # the level's slope and its error are those of what the lagged differences leave of level and difference
        rows = rows.na.drop(subset=["_d", f"_d{lags}"])
        for name in ("_d", "_x"):
            model = fitted(rows, panel.keys, F.col(name), more).select(*panel.keys, F.col("coef").alias("_f"))
            guess = F.get("_f", F.lit(0))
            for k in range(1, lags + 1):
                guess = guess + F.get("_f", F.lit(k)) * F.col(f"_d{k}")
            rows = _with(rows, model, panel).withColumn(f"{name}_left", F.col(name) - guess).drop("_f")
        rows = rows.withColumn("_d", F.col("_d_left")).withColumn("_x", F.col("_x_left"))
    rows = rows.where(F.col("_d").isNotNull())
    s = rows.groupBy(*panel.keys).agg(F.regr_slope("_d", "_x").alias("b"), F.regr_sxx("_d", "_x").alias("sxx"), F.regr_syy("_d", "_x").alias("syy"), F.regr_sxy("_d", "_x").alias("sxy"), F.count("_d").alias("n"))
    error = F.sqrt(F.try_divide(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)), (F.col("n") - 2 - lags) * F.col("sxx")))
    return s.select(*panel.keys, F.try_divide("b", error).alias("statistic")).withColumn("stationary", F.coalesce(F.col("statistic") <= critical, F.lit(False)))


def capped(df: DataFrame, panel: Panel, window: int = 14, quantile: float = 0.95, amount: str | None = None) -> DataFrame:
    """The target (nulls as 0) clipped between 0 and the ``quantile`` of |y - moving mean over ``window`` rows|.

    A column ``amount`` that goes with the target (such as its value in money) is
    scaled by what is left of the target, and is 0 where the target is.
    """
    y, panel = F.coalesce(F.col(panel.target), F.lit(0.0)), panel.sized(df)
    blocks = panel.blocks(df.withColumn(panel.target, y))
    order = blocks.local(panel.time).rowsBetween(-(window - 1), 0)
    full = F.count(panel.target).over(order) == window
    rows = blocks.haloed([panel.time], window - 1).withColumn("_off", F.when(full, F.abs(F.col(panel.target) - F.avg(panel.target).over(order)))).where(~F.col("_halo")).drop("_halo", "_block")
    rows = _with(rows, quantiles(rows, panel.keys, F.col("_off"), (quantile,), "_top", panel.block), panel).withColumn("_top", F.get("_top", F.lit(0)))
    out = rows.withColumn("capped", F.when(F.col("_top").isNull(), F.col(panel.target)).otherwise(F.greatest(F.lit(0.0), F.least(F.col(panel.target), F.col("_top"))))).drop("_off", "_top")
    if amount:
        out = out.withColumn(amount, F.coalesce(F.try_divide(F.col(amount) * F.col("capped"), F.col(panel.target)), F.lit(0.0)))
    return out


def corrected(df: DataFrame, panel: Panel, eps: float = 2.0, threshold: float = 5.0, window: int = 14, quantile: float = 0.95, amount: str | None = None) -> DataFrame:
    """The target with outliers replaced by their capped values, in series where Grubbs' test finds any; adds ``outlier``.

    Of two sets of rows the larger one of a series counts: those that are outliers
    by density and by isolation, or those by modified z-score.
    """
    extra = [c for c in df.columns if c not in (*panel.keys, panel.time, panel.target)]
    panel.checked(df)
    panel = panel.sized(df)
    rows = df.select(*panel.keys, panel.time, F.col(panel.target).cast("double").alias(panel.target), *extra)
    # each detector adds a flag to the rows themselves, so no copies of the rows are joined
    flags = modified_zscore(isolation_forest(dbscan(rows, panel, eps).drop("cluster").withColumnRenamed("inlier", "_d"), panel).withColumnRenamed("inlier", "_i"), panel, threshold).withColumnRenamed("inlier", "_z")
    dense, far = (F.col("_d") == -1) & (F.col("_i") == -1), F.col("_z") == -1
    flags = flags.withColumn("_dense", F.coalesce(dense, F.lit(False))).withColumn("_far", F.coalesce(far, F.lit(False)))
    sums = flags.groupBy(*panel.keys).agg((F.sum(F.col("_dense").cast("int")) > F.sum(F.col("_far").cast("int"))).alias("_larger"))
    out = _with(_with(capped(flags, panel, window, quantile), sums, panel), grubbs(rows, panel).select(*panel.keys, F.col("outlier").alias("_some")), panel)
    out = out.withColumn("_chosen", F.when(F.col("_larger"), F.col("_dense")).otherwise(F.col("_far"))).withColumn("_some", F.coalesce("_some", F.lit(False)))
    hit = F.col("_chosen") & F.col("_some")
    out = out.withColumn("outlier", hit)
    if amount:
        out = out.withColumn(amount, F.when(hit, F.coalesce(F.try_divide(F.col(amount) * F.col("capped"), F.col(panel.target)), F.lit(0.0))).otherwise(F.col(amount)))
    return out.withColumn(panel.target, F.when(hit, F.col("capped")).otherwise(F.col(panel.target))).select(*df.columns, "outlier")


#: Coefficients of the approximation of the normal quantile.
NORMAL = (
    (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239),
    (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1),
    (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416),
)


def _t_quantile(p: Column, freedom: Column) -> Column:
    """Student's t quantile for p over 1/2: the normal quantile (Acklam's rational approximation) and its expansion in 1/freedom."""
    a, b, c, d = NORMAL

    def poly(x: Column, k: tuple[float, ...]) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    middle = poly(q * q, a) * q / (poly(q * q, b) * q * q + 1)
    far = F.sqrt(-2 * F.log(F.greatest(1 - p, F.lit(1e-300))))
    z = F.when(p <= 0.97575, middle).otherwise(-poly(far, c) / (poly(far, d) * far + 1))
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return z + g1 / freedom + g2 / freedom**2 + g3 / freedom**3 + g4 / freedom**4


def grubbs(df: DataFrame, panel: Panel, alpha: float = 0.05) -> DataFrame:
    """One row a series: the largest deviation in standard deviations, its critical value, and whether there is an outlier.

    Series under three values, or without spread, have none.
    """
    y = F.col(panel.target)
    far = F.greatest(F.max(y) - F.avg(y), F.avg(y) - F.min(y))
    s = df.groupBy(*panel.keys).agg(F.try_divide(far, F.stddev_samp(y)).alias("statistic"), F.count(y).cast("double").alias("n")).where("n > 0")
    t = _t_quantile(1 - alpha / (2 * F.col("n")), F.greatest(F.col("n") - 2, F.lit(1.0)))
    critical = (F.col("n") - 1) / F.sqrt("n") * F.sqrt(t * t / (F.col("n") - 2 + t * t))
    return s.withColumn("critical", F.when(F.col("n") > 2, critical)).select(*panel.keys, "statistic", "critical", F.coalesce(F.col("statistic") >= F.col("critical"), F.lit(False)).alias("outlier"))


def _usual(n: np.ndarray) -> np.ndarray:
    """The mean depth of an unsuccessful search among n values: what is left below a leaf of n values."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


def grown(values: np.ndarray, depth: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """An isolation tree of sorted values as an array: its cuts in order, and the path length of each interval between them.

    A node is cut at random between its least and largest value, unless these are
    equal or the node is ``depth`` steps down. A value at a cut goes left.
    """
    cuts: list[float] = []
    lengths: list[float] = []

    def node(low: int, high: int, down: int) -> None:
        if down >= depth or high - low < 2 or values[low] == values[high - 1]:
            lengths.append(down + float(_usual(high - low)))
            return
        cut = min(max(random.uniform(values[low], values[high - 1]), values[low]), np.nextafter(values[high - 1], values[low]))
        at = int(np.searchsorted(values, cut, "right"))
        node(low, at, down + 1)
        cuts.append(float(cut))
        node(at, high, down + 1)

    node(0, len(values), 0)
    return np.array(cuts), np.array(lengths)


def isolation_scores(pool: np.ndarray, trees: int, sample: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest's score as a step function: cuts in order, and the score of each interval (what is at most its cut, and above the one before).

    Each tree grows on its own draw of ``sample`` values of the pool, all with
    one generator, one after another.
    """
    size = min(sample, len(pool))
    if size < 2:
        return np.zeros(0), np.zeros(1)
    random = np.random.default_rng(seed)
    made = [grown(np.sort(random.choice(pool, size, replace=False)), int(np.ceil(np.log2(size))), random) for _ in range(trees)]
    cuts = np.unique(np.concatenate([c for c, _ in made]))
    total = np.zeros(len(cuts) + 1)
    for own, lengths in made:  # an interval lies in the tree's interval that its upper end lies in
        total += lengths[np.append(np.searchsorted(own, cuts, "left"), len(own))]
    return cuts, 2.0 ** (-total / trees / max(float(_usual(np.array(size))), 1e-9))


def isolation_spans(pool: np.ndarray, trees: int, sample: int, seed: int, threshold: float) -> list[tuple[float, float]]:
    """The intervals (above low, up to high) whose score is at least ``threshold``, of one pool; open ends are infinite."""
    cuts, scores = isolation_scores(pool, trees, sample, seed)
    ends = [-np.inf, *cuts.tolist(), np.inf]
    found: list[tuple[float, float]] = []
    for k in np.flatnonzero(scores >= threshold).tolist():
        low = found.pop()[0] if found and found[-1][1] == ends[k] else ends[k]
        found.append((low, ends[k + 1]))
    return found


def grown_together(values: np.ndarray, sizes: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grown`` for many trees in step: a row of sorted ``values`` each, of which the first ``sizes`` count, and a column of ``draws`` of the unit interval.

    Rows are a power of two wide, filled up with infinity. For each row: the cut
    to the left of each value (infinite: none; the first is open), the path length
    of the interval that begins there, and how many draws were used.
    """
    count, width = values.shape
    usual, depths = _usual(np.arange(width + 1)), np.ceil(np.log2(sizes)).astype(np.int64)
    cuts, lengths, used = np.full(values.shape, np.inf), np.zeros(values.shape), np.zeros(count, np.int64)
    cuts[:, 0], lengths[:, 0] = -np.inf, usual[sizes]
    v, below, c, l = values.ravel(), np.nextafter(values, -np.inf).ravel(), cuts.ravel(), lengths.ravel()
    stack = np.zeros((int(depths.max()) + 2) * count, np.int64)  # nodes that wait, as numbers: steps down, end, begin
    row = np.flatnonzero(values[:, 0] != v[np.arange(count) * width + sizes - 1])
    base, depth, place, k = row * width, depths[row], row, 0  # place: the row's next one in the stack
    node, low28, one = base + sizes[row] << 28 | base, (1 << 28) - 1, 1 << 56
    while len(row):
        low, high, down = node & low28, node >> 28 & low28, (node >> 56) + 1
        least, most = v[low], v[high - 1]
        cut = np.minimum(np.maximum(least + (most - least) * draws[k][row], least), below[high - 1])
        at, step = base.copy(), width >> 1
        while step:  # the number of the row's values up to the cut
            at += (v[at + (step - 1)] <= cut) * step
            step >>= 1
        # a child that is cut again writes its first interval anew
        c[at], l[low], l[at] = cut, down + usual[at - low], down + usual[high - at]
        deep = down < depth
        node += one
        stack[place] = node - low + at
        place = place + (deep & (v[at] != most)) * count
        stack[place] = node - (high - at << 28)  # the left one comes next
        place += (deep & (least != v[at - 1])) * count
        k += 1
        done = place < count
        if done.any():
            used[row[done]] = k
            row, place, base, depth = (x[~done] for x in (row, place, base, depth))
        place -= count
        node = stack[place]
    return cuts, lengths, used


#: Fixed value: so many cuts of all trees at once, at most (two arrays of them, and some to order them).
CUTS = 1 << 23


def forests_spans(pools: Sequence[np.ndarray], trees: int, sample: int, seed: int, threshold: float) -> list[list[tuple[float, float]]]:
    """``isolation_spans`` of each pool, the same to the bit, with pools of like sizes in step."""
    out: list[list[tuple[float, float]]] = [[] for _ in pools]
    drawn, alike = [], {}
    for i, pool in enumerate(pools):
        size = min(sample, len(pool))
        if size < 2 or not np.isfinite(pool.max() - pool.min()):
            out[i] = isolation_spans(pool, trees, sample, seed, threshold)
        elif len(pool) > sample:
            drawn.append(i)
        else:
            alike.setdefault((size - 1).bit_length(), []).append(i)
    for own in (drawn, *(sorted(a, key=lambda i: len(pools[i])) for a in alike.values())):
        each = max(1, CUTS // (trees * min(sample, len(pools[own[-1]])))) if own else 1
        for k in range(0, len(own), each):
            some = own[k : k + each]
            for i, spans in zip(some, _spans([pools[i] for i in some], trees, sample, seed, threshold), strict=True):
                out[i] = isolation_spans(pools[i], trees, sample, seed, threshold) if spans is None else spans
    return out


def _spans(pools: Sequence[np.ndarray], trees: int, sample: int, seed: int, threshold: float) -> list[list[tuple[float, float]] | None]:
    """The spans of pools that are all drawn from, or all sampled whole; None where only ``isolation_spans`` tells."""
    count, lens = len(pools), np.array([len(p) for p in pools])
    sizes = np.minimum(lens, sample)
    most = int(sizes.max())
    values = np.full((count, 1 << (most - 1).bit_length()), np.inf)
    unsure = np.zeros(count, bool)
    whole = lens[0] <= sample
    if whole:
        values[np.arange(values.shape[1]) < lens[:, None]] = np.concatenate(pools)
        values.sort(axis=1)
        # All series start with one stream of random numbers. A choice of all n values changes nothing but its place: it takes
        # n - 1 numbers, halves of which are bounded by 2 .. n and then by n .. 2, unless one is refused (about one of 2^28).
        stream = np.random.default_rng(seed).bit_generator.random_raw(2 * trees * most)
        halves, units, place = stream.astype("<u8").view("<u4"), (stream >> 11) * 2.0**-53, np.zeros(count, np.int64)
        refusals = np.zeros(len(halves), bool)
        for n in range(2, most + 1):
            refusals |= halves * np.uint32(n) < (1 << 32) % n
        refusals = np.append(0, refusals.reshape(-1, 2).any(axis=1).cumsum())
    else:
        generators = [np.random.default_rng(seed) for _ in pools]
    cuts, steps = np.full((count, trees, most), np.inf), np.zeros((count, trees, most))
    for t in range(trees):
        if whole:
            for i in np.flatnonzero(refusals[place + sizes - 1] > refusals[place]).tolist():
                bounds = np.append(np.arange(2, sizes[i] + 1), np.arange(sizes[i], 1, -1))
                unsure[i] |= (halves[2 * place[i] :][: len(bounds)] * bounds.astype(np.uint32) < (1 << 32) % bounds).any()
            place += sizes - 1
            draws = units[place + np.arange(most - 1)[:, None]]
        else:
            draws = np.empty((most - 1, count))
            for i, (pool, random) in enumerate(zip(pools, generators, strict=True)):
                values[i, :most] = random.choice(pool, most, replace=False)
                state = random.bit_generator.state
                draws[:, i] = random.random(most - 1)
                random.bit_generator.state = state
            values.sort(axis=1)
        c, l, used = grown_together(values, sizes, draws)
        if whole:
            place += used
        else:
            for random, n in zip(generators, used.tolist(), strict=True):
                random.bit_generator.random_raw(n, False)
        cuts[:, t] = c[:, :most]
        held = cuts[:, t] < np.inf
        own = l[:, :most][held]
        change = np.diff(own, prepend=0.0)
        first = np.append(0, np.cumsum(held.sum(axis=1))[:-1])
        change[first] = own[first]
        steps[:, t][held] = change
    bounds = (-np.log2(threshold) if threshold > 0 else np.inf) * trees * np.maximum(_usual(sizes), 1e-9)
    return [s for k in range(0, count, 64) for s in _runs(cuts[k : k + 64].reshape(-1, trees * most), steps[k : k + 64].reshape(-1, trees * most), bounds[k : k + 64], unsure[k : k + 64])]


def _runs(cuts: np.ndarray, steps: np.ndarray, bounds: np.ndarray, unsure: np.ndarray) -> list[list[tuple[float, float]] | None]:
    """The spans where the sums of a row's ``steps`` at its ``cuts`` are at most its bound; None where sums could be the bound but for rounding, or ``unsure``."""
    order = np.argsort(cuts, axis=1)
    low = np.take_along_axis(cuts, order, 1)
    total = np.take_along_axis(steps, order, 1).cumsum(axis=1)
    high = np.append(low[:, 1:], np.full((len(low), 1), np.inf), axis=1)
    some = low < high
    unsure = unsure | (some & (np.abs(total - bounds[:, None]) < 1e-7)).any(axis=1)
    inside = (total <= bounds[:, None])[some]
    row = np.repeat(np.arange(len(cuts)), some.sum(axis=1))
    joined = inside[1:] & inside[:-1] & (row[1:] == row[:-1])
    begins, ends = inside & ~np.append(False, joined), inside & ~np.append(joined, False)
    found = list(zip(low[some][begins].tolist(), high[some][ends].tolist(), strict=True))
    upto = np.append(0, np.bincount(row[begins], minlength=len(cuts)).cumsum()).tolist()
    return [None if u else found[upto[i] : upto[i + 1]] for i, u in enumerate(unsure.tolist())]


#: Fixed value: so many equal values of a series are numbered at once.
TIES = 4096


def isolation_ranges(df: DataFrame, panel: Panel, trees: int = 50, sample: int = 256, threshold: float = 0.6, seed: int = 1, pool: int = 4096) -> DataFrame:
    """One row a series: ``ranges``, the intervals (above low, up to high) of values whose score is at least ``threshold``; null ends are open.

    Trees draw from a pool of about ``pool`` values of a series, those of least
    hash, where equal values are told apart by number; so the pool depends on the
    rows alone. Along one axis the score is a step function, so that the whole
    forest becomes a few intervals.
    """
    keys, bound = list(panel.keys), min(sample, pool)
    known = df.where(F.col(panel.target).isNotNull()).select(*keys, F.col(panel.target).cast("double").alias("_v"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    # a series that is sampled whole is its own pool, in any order; only values of longer ones are counted
    short = matched(known, sizes.where(F.col("_all") <= bound), keys, "inner").groupBy(*keys).agg(F.collect_list("_v").alias("_pool"))
    counts = matched(known, sizes.where(F.col("_all") > bound), keys, "inner").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
    # few counts may stand for many rows, so they are dealt out anew, in runs of TIES
    runs = counts.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(TIES).cast("long"))))
    runs = runs.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_v", "_i")
    each = runs.withColumn("_j", F.explode(F.sequence("_i", F.least("_n", F.col("_i") + (TIES - 1)))))
    place = F.pmod(F.xxhash64("_v", "_j", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)  # one of all values is under pool / all, about
    held = each.withColumn("_h", place).where(F.col("_h") * F.col("_all") < pool)
    pools = short.unionByName(held.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_h", "_v"))), lambda x: x["_v"]).alias("_pool")))

    @F.pandas_udf("array<struct<low:double,high:double>>")
    def ranges(pools: pd.Series) -> pd.Series:
        found = forests_spans([np.asarray(p, float) for p in pools], trees, sample, seed, threshold)
        return pd.Series([[{"low": low if low > -np.inf else None, "high": high if high < np.inf else None} for low, high in spans] for spans in found])

    return pools.select(*keys, ranges("_pool").alias("ranges"))


def isolation_forest(df: DataFrame, panel: Panel, trees: int = 50, sample: int = 256, threshold: float = 0.6, seed: int = 1, pool: int = 4096) -> DataFrame:
    """Outliers have an isolation score of at least ``threshold``; see ``isolation_ranges``. Rows are judged by a join and an expression, whatever their number."""
    y = F.col(panel.target).cast("double")
    rows = _with(df, isolation_ranges(df, panel, trees, sample, threshold, seed, pool), panel)
    out = F.exists("ranges", lambda r: (r["low"].isNull() | (y > r["low"])) & (r["high"].isNull() | (y <= r["high"])))
    return rows.select(*df.columns, _marks(y.isNull() | ~F.coalesce(out, F.lit(False))))


METHODS = {"iqr": iqr, "modified_zscore": modified_zscore, "rolling_window": rolling_window, "dbscan": dbscan, "residual": residual, "isolation_forest": isolation_forest}


def marked(df: DataFrame, panel: Panel, method: str, **options: float) -> DataFrame:
    """``df`` with ``inlier`` by the named method."""
    if method not in METHODS:
        raise OptionError(f"outliers: one of {tuple(METHODS)}, not {method!r}")
    return METHODS[method](df, panel, **options).select(*df.columns, "inlier")
