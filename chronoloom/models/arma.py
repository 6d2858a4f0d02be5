"""Autoregressions with moving-average terms by conditional least squares, many series at once.

The errors of a series follow from its values by a recursion in time, and so do
their derivatives; Gauss-Newton steps lessen their sum of squares. Series of a
batch go through the recursions side by side, one row each, aligned at their ends.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Gauss-Newton steps, and the least relative gain of one that goes on.
STEPS, GAIN = 25, 1e-9
#: Fixed value: critical point of the KPSS statistic with a constant, at 5 %.
CRITICAL = 0.463


def aligned(series: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(values, known) as matrices of equal rows, aligned at the end; the start is 0."""
    n = max(map(len, series), default=0)
    values, known = np.zeros((len(series), n)), np.zeros((len(series), n), bool)
    for row, s in enumerate(series):
        if len(s):
            values[row, n - len(s) :], known[row, n - len(s) :] = s, True
    return values, known


def errors(y: np.ndarray, used: np.ndarray, x: np.ndarray, coef: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(errors, their derivatives by each coefficient) of series ``y`` (series, times) with regressors ``x`` (series, times, r).

    Coefficients are: constant, regressors, ``p`` lags, ``q`` lagged errors.
    Errors of times that are not ``used`` are 0.
    """
    b, n = y.shape
    fixed = 1 + x.shape[2] + p
    late = lambda k: np.pad(y, ((0, 0), (k, 0)))[:, :n, None]
    line = np.concatenate((np.ones((b, n, 1)), x, *[late(k) for k in range(1, p + 1)]), 2) * used[:, :, None]
    e, d = y * used - np.einsum("btk,bk->bt", line, coef[:, :fixed]), np.concatenate((-line, np.zeros((b, n, q))), 2)
    ma = coef[:, fixed:]
    for t in range(1, n if q else 0):  # what lagged errors add follows in time
        m = min(q, t)
        before = e[:, t - m : t][:, ::-1]
        live = used[:, t, None]
        e[:, t] -= (ma[:, :m] * before).sum(1) * live[:, 0]
        d[:, t] -= np.einsum("bm,bmk->bk", ma[:, :m], d[:, t - m : t][:, ::-1]) * live
        d[:, t, fixed : fixed + m] -= before * live
    return e, d


def fit(y: np.ndarray, known: np.ndarray, x: np.ndarray, p: int, q: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, sums of squares, errors, used) of each series: ``fit`` of ARMA(p, q) with regressors.

    The first ``skip`` values of a series (``p`` at least) only serve as lags.
    Without lagged errors one step from 0 is least squares; with them the start
    is a long autoregression's errors, then steps are damped until they gain.
    """
    b, n = y.shape
    k = 1 + x.shape[2] + p + q
    used = known & (np.cumsum(known, 1) > max(p, skip or 0))
    centre = (y * known).sum(1) / np.maximum(known.sum(1), 1)
    scale = np.sqrt(np.maximum(((y - centre[:, None]) ** 2 * known).sum(1) / np.maximum(known.sum(1), 1), 1e-300))
    z = np.where(known, (y - centre[:, None]) / scale[:, None], 0.0)  # of one size, so that one damping fits all
    spread = np.maximum(np.abs(x).max((0, 1), initial=0.0), 1e-300)
    u = x / spread

    def step(coef: np.ndarray, damping: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e, d = errors(z[rows], used[rows], u[rows], coef, p, q)
        normal, right = np.einsum("bti,btj->bij", d, d), np.einsum("bti,bt->bi", d, e)
        size = np.maximum(np.trace(normal, axis1=1, axis2=2) / k, 1e-12)
        return (e**2).sum(1), -np.linalg.solve(normal + (size * damping)[:, None, None] * np.eye(k), right[:, :, None])[:, :, 0]

    coef = np.zeros((b, k))
    if q:
        long = min(p + q + 4, max(n // 4, 1))
        first = np.linalg.lstsq  # a long autoregression for each series, then least squares on its errors
        for row in range(b):
            own = z[row, known[row]]
            if len(own) <= 2 * long + k + 2:
                continue
            lags = np.column_stack([np.ones(len(own) - long), *[own[long - j : len(own) - j] for j in range(1, long + 1)]])
            e = np.concatenate((np.zeros(long), own[long:] - lags @ first(lags, own[long:], rcond=None)[0]))
            at = long + q
            regress = u[row, known[row]][at:]
            line = np.column_stack([np.ones(len(own) - at), regress, *[own[at - j : len(own) - j] for j in range(1, p + 1)], *[e[at - j : len(own) - j] for j in range(1, q + 1)]])
            start = first(line, own[at:], rcond=None)[0]
            start[1 + x.shape[2] + p :] = np.clip(start[1 + x.shape[2] + p :], -0.9 / q, 0.9 / q)
            coef[row] = start
    damping = np.full(b, 1e-12 if not q else 1e-6)
    live = np.arange(b)
    sse, move = step(coef, damping, live)
    for _ in range(STEPS):
        with np.errstate(over="ignore", invalid="ignore"):
            tried, next_move = step(coef[live] + move[live], damping[live], live)
        better = np.isfinite(tried) & (tried < sse[live])
        gain = np.where(better, (sse[live] - tried) / np.maximum(sse[live], 1e-300), 0.0)
        up, back = live[better], live[~better]
        coef[up], sse[up], move[up] = coef[up] + move[up], tried[better], next_move[better]
        damping[up], damping[back] = damping[up] / 4, damping[back] * 10
        if not q:
            break
        if len(back):  # a shorter step from where the series stands
            move[back] = step(coef[back], damping[back], back)[1]
        live = live[np.where(better, gain >= GAIN, damping[live] <= 1e4)]
        if not len(live):
            break
    # back to the values' own size: constant, regressors, lags, lagged errors
    e, _ = errors(z, used, u, coef, p, q)
    lag = coef[:, 1 + x.shape[2] : 1 + x.shape[2] + p]
    out = coef.copy()
    out[:, 1 : 1 + x.shape[2]] = coef[:, 1 : 1 + x.shape[2]] * scale[:, None] / spread
    out[:, 0] = coef[:, 0] * scale + centre * (1 - lag.sum(1))
    return out, sse * scale**2, e * scale[:, None], used


def aicc(sse: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.where(rows - k - 2 > 0, rows * np.log(np.maximum(sse / np.maximum(rows, 1), 1e-300)) + 2 * (k + 1) + 2 * (k + 1) * (k + 2) / np.maximum(rows - k - 2, 1), np.inf)


def differences(y: np.ndarray, most: int) -> int:
    """How often a series is differenced, at most: while the KPSS statistic is over its critical point."""
    for d in range(most):
        n = len(y)
        if n < 8:
            return d
        e = y - y.mean()
        lags = int(4 * (n / 100) ** 0.25)
        spread = (e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))) / n
        if spread <= 0 or (np.cumsum(e) ** 2).sum() / (n * n * spread) <= CRITICAL:
            return d
        y = np.diff(y)
    return most


def undifferenced(coef: np.ndarray, r: int, p: int, d: int, lags: int, q: int) -> np.ndarray:
    """Coefficients of a model of ``d``-th differences as those of a model of the values, with ``lags`` lags and ``q`` lagged errors (padded with 0)."""
    own = np.concatenate(([1.0], -coef[1 + r : 1 + r + p]))
    for _ in range(d):
        own = np.convolve(own, (1.0, -1.0))
    ma = coef[1 + r + p :]
    return np.concatenate((coef[: 1 + r], -own[1:], np.zeros(lags - p - d), ma, np.zeros(q - len(ma))))


def searched(series: Sequence[np.ndarray], regressors: Sequence[np.ndarray], orders: Sequence[tuple[int, int]], d: int | None, most: int) -> list[tuple]:
    """(coefficients for the values, order, residuals, last errors) of each series: the (p, q) of least AICc, of equals the first.

    ``d`` is given, or chosen by series up to ``most``. All orders are fitted to
    the same times. Series too short for any order give None.
    """
    p, q = max(a for a, _ in orders), max(m for _, m in orders)
    depth = [d if d is not None else differences(np.asarray(s, float), most) for s in series]
    out: list[tuple] = [(None, None, None, None)] * len(series)
    top = most if d is None else d
    for level in sorted(set(depth)):
        rows = [i for i, v in enumerate(depth) if v == level]
        y, known = aligned([np.diff(np.asarray(series[i], float), level) if len(series[i]) > level else np.zeros(0) for i in rows])
        r = regressors[rows[0]].shape[1] if len(regressors) else 0
        x = np.zeros((*y.shape, r))
        for row, i in enumerate(rows):
            if r and (m := int(known[row].sum())):
                x[row, -m:] = regressors[i][-m:]
        best = np.full(len(rows), np.inf)
        for a, m in orders:
            coef, sse, e, used = fit(y, known, x, a, m, p)
            score = aicc(sse, used.sum(1), coef.shape[1])
            for row in np.flatnonzero(score < best - 1e-9):
                best[row] = score[row]
                last = e[row, ::-1][:q]
                out[rows[row]] = (undifferenced(coef[row], r, a, level, p + top, q), [a, level, m], e[row, used[row]], np.pad(last, (0, q - len(last))))
    return out
