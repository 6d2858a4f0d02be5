"""Cleansing: duplicates, calendar, outliers, interpolation, filling and padding, as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.operators import outliers
from chronoloom.scans import Blocks, fits, matched, quantiles
from chronoloom.series import Panel

DUPLICATES = ("sum", "mean", "median", "mode")
FILLS = ("zero", "mean", "median")
#: Further methods' names, which stand for linear here.
OTHERS = ("index", "values", "backfill", "zero", "slinear", "quadratic", "spline", "barycentric", "polynomial", "krogh", "piecewise_polynomial", "pchip", "akima", "cubicspline", "from_derivatives")
INTERPOLATIONS = ("linear", "time", "pad", "ffill", "bfill", "nearest", "cubic")
DIRECTIONS, AREAS = ("forward", "backward", "both"), ("inside", "outside")


def deduplicated(df: DataFrame, panel: Panel, how: str = "mode", *more: Column) -> DataFrame:
    """One row for each bin that has rows, with ``more`` aggregates. A bin of nulls alone sums to 0 and has no mean, median or mode."""
    if how not in DUPLICATES:
        raise OptionError(f"duplicates: one of {DUPLICATES}, not {how!r}")
    y = F.col(panel.target)
    merged = {"sum": F.coalesce(F.sum(y), F.lit(0.0)), "mean": F.avg(y), "median": F.median(y), "mode": F.mode(y, True)}[how]
    return panel.bucketed(df).groupBy(*panel.keys, panel.time).agg(merged.alias(panel.target), *more)


def completed(df: DataFrame, panel: Panel) -> DataFrame:
    """Adds the missing bins between each series' first and last, with null targets.

    Each row spans the gap up to the next one, so no calendar is joined.
    """
    blocks = panel.blocks(df)
    kind = df.schema[panel.time].dataType
    rows = blocks.carried(blocks.rows, {"_t": F.min(panel.time)}, {"_t1": lambda _, after: F.min("_t").over(after)})
    rows = rows.withColumn("_next", F.coalesce(F.lead(panel.time).over(blocks.local(panel.time)), F.col("_t1").cast(kind)))
    last = F.coalesce(F.col("_next") - panel.step, F.col(panel.time))
    days = F.posexplode(F.sequence(F.col(panel.time), last.cast("date") if panel.daily else last, panel.step))
    spread = rows.select(*panel.keys, F.col(panel.target).alias("_y"), days.alias("_at", "_time"))
    return spread.select(*panel.keys, F.col("_time").alias(panel.time), F.when(F.col("_at") == 0, F.col("_y")).alias(panel.target))


def interpolated(df: DataFrame, panel: Panel, method: str = "linear", limit: int | None = None, limit_direction: str | None = None, limit_area: str | None = None) -> DataFrame:
    """Fills nulls between equally spaced rows, and nulls outside the values by the nearest value where the options allow it.

    The methods: linear (and time, which is the same on a regular grid), pad or
    ffill, bfill, nearest and cubic (a spline, see ``spline``; series of fewer than
    four values get lines); the last two fill nothing outside the values.
    ``limit`` bounds how many nulls of a run are filled, from the end that
    ``limit_direction`` names: forward (the default; leading nulls stay), backward
    (trailing nulls stay) or both; pad only goes forward and bfill backward.
    ``limit_area`` keeps to nulls between values (inside) or beside them (outside).
    """
    if method not in INTERPOLATIONS:
        if method not in OTHERS:
            raise OptionError(f"interpolation: one of {(*INTERPOLATIONS, *OTHERS)}, not {method!r}")
        method = "linear"  # as for methods that fail
    only = {"pad": "forward", "ffill": "forward", "bfill": "backward"}.get(method)
    direction = limit_direction or only or "forward"
    if direction not in DIRECTIONS or only not in (None, direction):
        raise OptionError(f"limit_direction of {method}: one of {(only,) if only else DIRECTIONS}, not {limit_direction!r}")
    if limit_area not in (None, *AREAS):
        raise OptionError(f"limit_area: one of {AREAS}, not {limit_area!r}")
    if limit is not None and limit < 1:
        raise OptionError("limit must be at least 1")
    y, blocks = F.col(panel.target), panel.blocks(df)
    w = blocks.local(panel.time)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    at = blocks.carried(blocks.rows.withColumn("_i", F.row_number().over(w)), {"_rows": F.count(F.lit(1))}, {"_i0": lambda before, _: F.sum("_rows").over(before)})
    at = at.withColumn("_i", F.col("_i") + F.coalesce("_i0", F.lit(0)))
    at = at.withColumn("_known", F.when(y.isNotNull(), F.struct(F.col("_i").alias("i"), y.alias("y"))))
    at = blocks.carried(at, {"_last": F.max("_known"), "_first": F.min("_known")}, {"_p0": lambda before, _: F.max("_last").over(before), "_n0": lambda _, after: F.min("_first").over(after)})
    kind = "struct<i:bigint,y:double>"
    at = at.select("*", F.coalesce(F.last("_known", True).over(past), F.col("_p0").cast(kind)).alias("_p"), F.coalesce(F.last("_known", True).over(blocks.back(panel.time)), F.col("_n0").cast(kind)).alias("_n"))
    at = at.select("*", F.col("_p.y").alias("_pv"), F.col("_p.i").alias("_pi"), F.col("_n.y").alias("_nv"), F.col("_n.i").alias("_ni"))
    since, until = F.col("_i") - F.col("_pi"), F.col("_ni") - F.col("_i")
    near = lambda steps: F.coalesce(steps.isNotNull() if limit is None else steps <= limit, F.lit(False))
    reached = {"forward": near(since), "backward": near(until), "both": near(since) | near(until)}[direction]
    inside = F.col("_pv").isNotNull() & F.col("_nv").isNotNull()
    if limit_area:
        reached = reached & (inside if limit_area == "inside" else ~inside)
    line = F.col("_pv") + F.try_divide((F.col("_nv") - F.col("_pv")) * since, F.col("_ni") - F.col("_pi"))
    if method in ("pad", "ffill"):
        value = F.col("_pv")
    elif method == "bfill":
        value = F.col("_nv")
    elif method == "nearest":
        value = F.when(inside, F.when(since <= until, F.col("_pv")).otherwise(F.col("_nv")))
    elif method == "cubic":
        at = matched(at, spline(at.where(y.isNotNull()).select(*panel.keys, "_i", y.alias("_y")), panel).withColumnRenamed("_i", "_pi"), [*panel.keys, "_pi"])
        width = F.col("_ni") - F.col("_pi")
        bend = lambda part, m: (part * part * part / width - part * width) * F.col(m) / 6
        value = F.when(inside, line + F.coalesce(bend(until, "_m") + bend(since, "_m1"), F.lit(0.0)))
    else:
        value = F.when(inside, line).otherwise(F.coalesce("_pv", "_nv"))
    return at.select(*panel.keys, panel.time, F.coalesce(y, F.when(reached, value)).alias(panel.target))


#: Values of the neighbouring blocks that a block's spline sees: what lies farther bends a curve less than 2 ** -64 as much.
BEND = 64


def spline(knots: DataFrame, panel: Panel) -> DataFrame:
    """keys, _i, _m, _m1: second derivatives, at each value and the next one, of the cubic spline through ``knots`` (keys, _i: places that rise, _y).

    The third derivative does not change at the second value and the last but one
    (no knots there). Its tridiagonal system is solved by a forward and a backward
    sweep over a series' values, or a block's with a halo of BEND values on either
    side, as every sweep at least halves what it carries on. Derivatives are null
    in a series of fewer than four values.
    """
    blocks = Blocks(knots, panel.keys, F.col("_i"), panel.block)
    rows = blocks.haloed(["_i"], BEND, BEND)
    lists = rows.groupBy(*blocks.by).agg(F.array_sort(F.collect_list(F.struct(F.col("_i"), F.col("_y"), F.col("_halo")))).alias("_s"))

    @F.pandas_udf("array<double>")
    def solved(places: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([bends(np.asarray(x, float), np.asarray(v, float)) for x, v in zip(places, values, strict=True)])

    made = lists.select(*panel.keys, "_s", solved(F.col("_s._i"), F.col("_s._y")).alias("_ms"))
    pairs = F.transform("_s", lambda s, k: F.struct(s["_i"].alias("_i"), s["_halo"].alias("_halo"), F.get("_ms", k).alias("_m"), F.get("_ms", k + 1).alias("_m1")))
    return made.select(*panel.keys, F.explode(pairs).alias("_e")).where("not _e._halo").select(*panel.keys, "_e._i", "_e._m", "_e._m1")


def bends(x: np.ndarray, y: np.ndarray) -> list[float | None]:
    """The spline's second derivatives at each of ``x``, or nulls for fewer than four."""
    if len(x) < 4:
        return [None] * len(x)
    h = np.diff(x)
    right = 6 * np.diff(np.diff(y) / h)
    low, middle, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    # the outer derivatives are on a line with the two inside of them
    middle[0] += h[0] * (1 + h[0] / h[1])
    high[0] -= h[0] * h[0] / h[1]
    middle[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] * h[-1] / h[-2]
    for k in range(1, len(right)):
        share = low[k] / middle[k - 1]
        middle[k] -= share * high[k - 1]
        right[k] -= share * right[k - 1]
    m = np.empty(len(x))
    m[-2] = right[-1] / middle[-1]
    for k in range(len(right) - 2, -1, -1):
        m[k + 1] = (right[k] - high[k] * m[k + 2]) / middle[k]
    m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    return m.tolist()


def filled(df: DataFrame, panel: Panel, how: str = "mean") -> DataFrame:
    """Sets what is still null to 0 or to the series' mean or median, interpolated values included."""
    if how not in FILLS:
        raise OptionError(f"fill: one of {FILLS}, not {how!r}")
    y = F.col(panel.target)
    if how == "zero":
        return df.withColumn(panel.target, F.coalesce(y, F.lit(0.0)))
    if fits(df, panel.block):
        return df.withColumn(panel.target, F.coalesce(y, (F.avg(y) if how == "mean" else F.median(y)).over(panel.by())))
    stats = df.groupBy(*panel.keys).agg(F.array(F.avg(y)).alias("_q")) if how == "mean" else quantiles(df, panel.keys, y, (0.5,), block=panel.block)
    return matched(df, stats, panel.keys).select(*panel.keys, panel.time, F.coalesce(y, F.get("_q", F.lit(0))).alias(panel.target))


def padded(df: DataFrame, panel: Panel, repeat_forward_to: str | None = None, zero_back_to: str | None = None, repeat_back_to: str | None = None) -> DataFrame:
    """Extends series forward with the last value, or back with 0 or the first value; dates inside a series change nothing.

    Bins stay in phase with the series; the grid ends at the last bin that does not pass the date.
    """
    if zero_back_to and repeat_back_to:
        raise OptionError("pad back with zeros or with the first value, not both")
    back = zero_back_to or repeat_back_to
    if not (back or repeat_forward_to):
        return df
    kind = "date" if panel.daily else "timestamp_ntz"
    t, blocks = F.col(panel.time), panel.blocks(df)
    w = blocks.local(panel.time)
    steps = (lambda a, b: F.floor(F.datediff(b, a) / panel.days)) if panel.daily else (lambda a, b: F.floor((F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))) / panel.seconds))
    rows = blocks.carried(blocks.rows, {"_rows": F.count(F.lit(1))}, {"_r0": lambda before, _: F.sum("_rows").over(before), "_r1": lambda _, after: F.sum("_rows").over(after)})
    marked = rows.select("*", (F.lag(panel.time).over(w).isNull() & F.col("_r0").isNull()).alias("_first"), (F.lead(panel.time).over(w).isNull() & F.col("_r1").isNull()).alias("_last"))

    def count(edge: str, date: str | None, forward: bool) -> Column:
        if not date:
            return F.lit(0)
        d = F.lit(date).cast(kind)
        return F.when(F.col(edge), F.greatest(steps(t, d) if forward else steps(d, t), F.lit(0))).otherwise(0).cast("int")

    offsets = F.explode(F.sequence(-count("_first", back, False), count("_last", repeat_forward_to, True))).alias("_k")
    spread = marked.select(*panel.keys, panel.time, panel.target, offsets)
    y = F.when(F.col("_k") < 0, 0.0).otherwise(F.col(panel.target)) if zero_back_to else F.col(panel.target)
    return spread.select(*panel.keys, panel.moved(F.col("_k")).alias(panel.time), y.alias(panel.target))


def cleansed(df: DataFrame, panel: Panel, duplicates: str = "mode", fill: str = "mean", interpolation: Mapping | None = None, outlier: str | None = None, outlier_options: Mapping | None = None, repeat_forward_to: str | None = None, zero_back_to: str | None = None, repeat_back_to: str | None = None, on_all_null: str = "raise") -> DataFrame:
    """The whole cleansing of all series, in its fixed order, with no Python worker.

    Outliers become null (with every row of their time), bins are merged and
    completed, then nulls are interpolated (if asked for) and filled, and series
    are padded. A series without any value raises an error, or is left out with
    ``on_all_null="drop"``. Times are ordered, so the result does not depend on
    the order of the input.
    """
    panel = panel.sized(df)
    rows = panel.checked(df).withColumn("_known", F.col(panel.target).isNotNull().cast("int"))
    if outlier:
        marked = outliers.marked(rows, panel, outlier, **(outlier_options or {}))
        worst = F.min("inlier").over(Window.partitionBy(*panel.keys, panel.time))
        rows = marked.withColumn(panel.target, F.when(worst == -1, None).otherwise(F.col(panel.target)))
    # rows of a bin meet first, with partial sums; windows then hold one row a bin
    merged = deduplicated(rows, panel, duplicates, F.sum("_known").alias("_known"))
    if fits(merged, panel.block):
        merged = merged.withColumn("_values", F.sum("_known").over(panel.by()))
    else:
        merged = matched(merged, merged.groupBy(*panel.keys).agg(F.sum("_known").alias("_values")), panel.keys)
    some = F.col("_values") > 0
    if on_all_null == "drop":
        merged = merged.withColumn("_some", some).where("_some")
    else:
        message = F.concat(F.lit("series without values: "), F.to_json(F.struct(*panel.keys)))
        merged = merged.withColumn(panel.target, F.when(some, F.col(panel.target)).otherwise(F.raise_error(message).cast("double")))
    out = completed(merged, panel)
    if interpolation is not None:
        if unknown := set(interpolation) - {"method", "limit", "limit_direction", "limit_area", "axis", "inplace"}:
            raise OptionError(f"unknown interpolation options {sorted(unknown)}")
        out = interpolated(out, panel, **{k: v for k, v in interpolation.items() if k not in ("axis", "inplace")})
    return padded(filled(out, panel, fill), panel, repeat_forward_to, zero_back_to, repeat_back_to)


def cleansed_by_class(df: DataFrame, panel: Panel, classes: DataFrame, options: Mapping[str, Mapping], **pads: str) -> DataFrame:
    """Cleansing with options for each class of ``classes`` (keys, classification); series without a class are left out.

    Classes with equal options share one pass.
    """
    unknown = {k for o in options.values() for k in o} - {"duplicates", "fill", "interpolation", "outlier", "outlier_options"}
    if unknown:
        raise OptionError(f"unknown options {sorted(unknown)}")
    passes: dict[str, tuple[Mapping, list[str]]] = {}
    for name, o in options.items():
        passes.setdefault(repr(sorted(o.items())), (o, []))[1].append(name)
    known = F.col("classification").isin(*options)
    checked = classes.withColumn("classification", F.when(known, F.col("classification")).otherwise(F.raise_error(F.concat(F.lit("no options for class "), F.col("classification")))))
    joined = panel.checked(df).join(checked.select(*panel.keys, "classification"), list(panel.keys))
    parts = [cleansed(joined.where(F.col("classification").isin(*names)), panel, **o, **pads) for o, names in passes.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
