"""A penalised smoother: cubic B-splines over a series' places, fitted from sums by piece."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.errors import OptionError
from chronoloom.scans import matched
from chronoloom.series import Panel

#: Penalties that are tried, as multiples of a series' values a piece.
GRID = tuple(10.0 ** (k / 2) for k in range(-8, 13))


def smoothed(df: DataFrame, panel: Panel, pieces: int = 10, penalty: float | None = None) -> DataFrame:
    """keys, time, target, trend: each series by cubic splines of ``pieces`` equal pieces, at each row.

    The squares of what is left plus ``penalty`` times the squares of the
    coefficients' second differences are least; without a penalty, the one of GRID
    with the least generalised cross-validation is taken (of equals the stiffest).
    A row sends 15 products to the sums of its piece, so only moments leave a series,
    of any length. Null targets have a trend but no say; a series of nulls has none.
    """
    if pieces < 1:
        raise OptionError("pieces must be at least 1")
    if penalty is not None and penalty < 0:
        raise OptionError("penalty must not be negative")
    rows, y, keys = panel.checked(df), F.col(panel.target), list(panel.keys)
    blocks = panel.blocks(rows)
    placed = blocks.rows.withColumn("_i", F.row_number().over(blocks.local(panel.time)) - 1)
    placed = blocks.carried(placed, {"_rows": F.count(F.lit(1))}, {"_i0": lambda before, _: F.sum("_rows").over(before)})
    placed = placed.withColumn("_i", F.col("_i") + F.coalesce("_i0", F.lit(0))).select(*keys, panel.time, panel.target, "_i")
    placed = matched(placed, placed.groupBy(*keys).agg(F.max("_i").alias("_end"), F.avg(y).alias("_mean")), keys)
    u = F.coalesce(F.try_divide(F.col("_i") * pieces, F.col("_end")), F.lit(0.0))
    placed = placed.withColumn("_p", F.least(F.floor(u), F.lit(pieces - 1)).cast("int")).withColumn("_u", u - F.col("_p"))
    own = placed.where(y.isNotNull()).withColumn("_b", F.array(*basis(F.col("_u")))).withColumn("_d", y - F.col("_mean"))
    b = [F.get("_b", F.lit(k)) for k in range(4)]
    terms = [*[b[j] * b[k] for j in range(4) for k in range(j, 4)], *[x * F.col("_d") for x in b], F.col("_d") * F.col("_d")]
    sums = own.groupBy(*keys, "_p").agg(F.array(F.count(F.lit(1)).cast("double"), *[F.sum(t) for t in terms]).alias("_s"))
    lists = sums.groupBy(*keys).agg(F.collect_list("_p").alias("_ps"), F.collect_list("_s").alias("_ss"))

    @F.pandas_udf("array<double>")
    def solved(places: pd.Series, moments: pd.Series) -> pd.Series:
        return pd.Series([coefficients(np.asarray(p, int), np.vstack(s), pieces, penalty) for p, s in zip(places, moments, strict=True)])

    fitted = matched(placed, lists.select(*keys, solved("_ps", "_ss").alias("_c")), keys)
    value = sum((F.get("_c", F.col("_p") + k) * x for k, x in enumerate(basis(F.col("_u")))), F.col("_mean"))
    return fitted.select(*keys, panel.time, panel.target, value.alias("trend"))


def basis(u: Column) -> list[Column]:
    """The four splines over a piece, at ``u`` from 0 to 1 within it."""
    v = 1 - u
    return [v * v * v / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (3 * v * v * v - 6 * v * v + 4) / 6, u * u * u / 6]


def coefficients(places: np.ndarray, moments: np.ndarray, pieces: int, penalty: float | None) -> list[float]:
    """The splines' coefficients from each piece's sums: rows, products of splines, products with values, squares of values."""
    size = pieces + 3
    full, right = np.zeros((size, size)), np.zeros(size)
    j, k = np.triu_indices(4)
    for p, m in zip(places, moments, strict=True):
        full[p + j, p + k] += m[1:11]
        right[p : p + 4] += m[11:15]
    full = full + np.triu(full, 1).T
    n, squares = moments[:, 0].sum(), moments[:, 15].sum()
    differences = np.diff(np.eye(size), 2, axis=0)
    stiff = differences.T @ differences
    best, least = np.zeros(size), np.inf
    for weight in [penalty] if penalty is not None else [n / pieces * g for g in reversed(GRID)]:
        inverse = np.linalg.pinv(full + weight * stiff, hermitian=True)
        c = inverse @ right
        left, free = max(squares - 2 * c @ right + c @ full @ c, 0.0), n - np.trace(inverse @ full)
        score = n * left / free**2 if free > 1e-9 * n else np.inf
        if penalty is not None or score < least * (1 - 1e-9):
            best, least = c, score
    return best.tolist()
