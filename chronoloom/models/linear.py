"""Least squares for each group from means and covariances, so that only moments leave the aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fitted(df: DataFrame, by: Sequence[str], target: Column, features: Sequence[Column], ridge: float = 0.0, search: bool = False) -> DataFrame:
    """One row a group: coef (intercept first), sse, used (features), aicc, rows.

    With ``search``, only the first ``used`` features have coefficients, as many
    as give the least AICc. Groups with too few rows have null coefficients.
    """
    columns = [*[c.cast("double") for c in features], target.cast("double")]
    m = len(columns)
    named = df.select(*by, *[c.alias(f"_x{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"_x{i}" for i in range(m)])
    spreads = [F.covar_pop(f"_x{i}", f"_x{j}") for i in range(m) for j in range(i, m)]
    moments = named.groupBy(*by).agg(F.array(F.count(F.lit(1)).cast("double"), *[F.avg(f"_x{i}") for i in range(m)], *spreads).alias("_m"))

    @F.pandas_udf("coef array<double>, sse double, used int, aicc double, rows long")
    def solve(moments: pd.Series) -> pd.DataFrame:
        out = []
        for x in moments:
            n, mean, full = x[0], np.asarray(x[1 : m + 1]), np.zeros((m, m))
            full[np.triu_indices(m)] = x[m + 1 :]
            full = full + np.triu(full, 1).T
            best = None
            for k in range(0 if search else m - 1, m):
                if n < k + 2:
                    continue
                b = np.linalg.lstsq(full[:k, :k] + ridge / n * np.eye(k), full[:k, -1], rcond=None)[0]
                sse = max(n * (full[-1, -1] - 2 * b @ full[:k, -1] + b @ full[:k, :k] @ b), 0.0)
                aicc = n * np.log(max(sse / n, 1e-300)) + 2 * (k + 2) + 2 * (k + 2) * (k + 3) / max(n - k - 3, 1e-9)
                if best is None or aicc < best[3]:
                    best = ([mean[-1] - b @ mean[:k], *b, *[0.0] * (m - 1 - k)], sse, k, aicc, int(n))
            out.append(best or (None, None, None, None, int(n)))
        return pd.DataFrame(out, columns=["coef", "sse", "used", "aicc", "rows"])

    return moments.select(*by, solve("_m").alias("_f")).select(*by, "_f.*")


def vector_fitted(df: DataFrame, by: Sequence[str], targets: Sequence[Column], lagged: Sequence[Sequence[Column]]) -> DataFrame:
    """One row a group: a vector autoregression of ``targets`` on ``lagged`` (for each lag, all targets), from one aggregation of moments.

    ``lags`` is the number of lags, up to all, of least Akaike criterion (log
    determinant of the residual covariance, of equals the fewer); ``coef`` holds an
    intercept and slopes (0 beyond ``lags``) for each target, ``inverse`` the
    inverse residual covariance by rows. Groups with too few rows have nulls.
    """
    m, depth, columns = len(targets), len(lagged), [c.cast("double") for c in [*[c for lag in lagged for c in lag], *targets]]
    n_all = len(columns)
    named = df.select(*by, *[c.alias(f"_x{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"_x{i}" for i in range(n_all)])
    spreads = [F.covar_pop(f"_x{i}", f"_x{j}") for i in range(n_all) for j in range(i, n_all)]
    moments = named.groupBy(*by).agg(F.array(F.count(F.lit(1)).cast("double"), *[F.avg(f"_x{i}") for i in range(n_all)], *spreads).alias("_m"))

    @F.pandas_udf("coef array<array<double>>, inverse array<array<double>>, lags int")
    def solve(moments: pd.Series) -> pd.DataFrame:
        out = []
        for x in moments:
            n, mean, full = x[0], np.asarray(x[1 : n_all + 1]), np.zeros((n_all, n_all))
            full[np.triu_indices(n_all)] = x[n_all + 1 :]
            full = full + np.triu(full, 1).T
            wide, best = n_all - m, (None, None, None)
            least = np.inf
            for k in range(1, depth + 1):
                w = k * m
                if n <= w + m + 1:
                    break
                b = np.linalg.lstsq(full[:w, :w], full[:w, wide:], rcond=None)[0]
                sigma = full[wide:, wide:] - full[wide:, :w] @ b
                sign, size = np.linalg.slogdet(sigma)
                if sign <= 0:
                    continue
                if size + 2 * m * w / n < least - 1e-12:
                    least = size + 2 * m * w / n
                    slopes = np.pad(b.T, ((0, 0), (0, wide - w)))
                    best = (np.column_stack((mean[wide:] - slopes @ mean[:wide], slopes)).tolist(), np.linalg.inv(sigma).tolist(), k)
            out.append(best)
        return pd.DataFrame(out, columns=["coef", "inverse", "lags"])

    return moments.select(*by, solve("_m").alias("_f")).select(*by, "_f.*")
