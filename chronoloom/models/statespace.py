"""Level and slope as a linear-Gaussian state space: filter, smoother and EM, many series at once."""

from __future__ import annotations

import numpy as np

#: The level moves by the slope.
MOVE = np.array([[1.0, 1.0], [0.0, 1.0]])
#: Variance of the first level and slope, in units of the series' own variance: next to nothing is known.
PRIOR = 1e4


def filtered(y: np.ndarray, known: np.ndarray, q: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """Predicted (``ap``, ``pp``) and filtered (``a``, ``p``) states and covariances of each time, and the log likelihood.

    ``q`` are the variances of level and slope steps, ``r`` that of a value, by
    series. A time that is not known moves the state alone; nothing moves ahead of
    a series' first known time.
    """
    b, n = y.shape
    step = np.zeros((b, 2, 2))
    step[:, 0, 0], step[:, 1, 1] = q.T
    a, p = np.zeros((b, 2)), np.broadcast_to(PRIOR * np.eye(2), (b, 2, 2)).copy()
    out = {"ap": np.zeros((b, n, 2)), "pp": np.zeros((b, n, 2, 2)), "a": np.zeros((b, n, 2)), "p": np.zeros((b, n, 2, 2)), "likelihood": np.zeros(b)}
    begun = np.zeros(b, bool)
    for t in range(n):
        ap = np.where(begun[:, None], a @ MOVE.T, a)
        pp = np.where(begun[:, None, None], MOVE @ p @ MOVE.T + step, p)
        s = pp[:, 0, 0] + r
        e = np.where(known[:, t], y[:, t] - ap[:, 0], 0.0)
        gain = pp[:, :, 0] / s[:, None] * known[:, t, None]
        a, p = ap + gain * e[:, None], pp - gain[:, :, None] * pp[:, None, 0, :]
        out["likelihood"] -= np.where(known[:, t], 0.5 * (np.log(2 * np.pi * s) + e * e / s), 0.0)
        begun |= known[:, t]
        for k, v in (("ap", ap), ("pp", pp), ("a", a), ("p", p)):
            out[k][:, t] = v
    return out


def smoothed(f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and covariances of the states given all values, and each state's covariance with the one before."""
    a, p = f["a"].copy(), f["p"].copy()
    cross = np.zeros_like(p)
    for t in range(a.shape[1] - 2, -1, -1):
        back = f["p"][:, t] @ MOVE.T @ np.linalg.inv(f["pp"][:, t + 1])
        a[:, t] += np.einsum("bij,bj->bi", back, a[:, t + 1] - f["ap"][:, t + 1])
        p[:, t] += back @ (p[:, t + 1] - f["pp"][:, t + 1]) @ back.transpose(0, 2, 1)
        cross[:, t + 1] = p[:, t + 1] @ back.transpose(0, 2, 1)
    return a, p, cross


def estimated(y: np.ndarray, known: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(variances of steps, of values, the filter's output) by EM on standardised series: no round lessens the likelihood."""
    b, n = y.shape
    q, r = np.tile((0.05, 0.005), (b, 1)), np.full(b, 0.5)
    begun = np.cumsum(known, 1) > 0
    pairs = begun[:, 1:] & begun[:, :-1]
    for _ in range(rounds):
        a, p, cross = smoothed(filtered(y, known, q, r))
        both = p + np.einsum("bti,btj->btij", a, a)
        lagged = cross[:, 1:] + np.einsum("bti,btj->btij", a[:, 1:], a[:, :-1])
        moved = both[:, 1:] - lagged @ MOVE.T - MOVE @ lagged.transpose(0, 1, 3, 2) + MOVE @ both[:, :-1] @ MOVE.T
        count = np.maximum(pairs.sum(1), 1)
        q = np.maximum(np.einsum("btii,bt->bi", moved, pairs) / count[:, None], 1e-10)
        left = (y - a[:, :, 0]) ** 2 + p[:, :, 0, 0]
        r = np.maximum((left * known).sum(1) / np.maximum(known.sum(1), 1), 1e-10)
    return q, r, filtered(y, known, q, r)


def ahead(y: np.ndarray, known: np.ndarray, steps: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the next ``steps`` values of each series, in closed form."""
    n = np.maximum(known.sum(1), 1)
    centre = (y * known).sum(1) / n
    scale = np.sqrt(np.maximum((((y - centre[:, None]) ** 2) * known).sum(1) / n, 1e-300))
    z = np.where(known, (y - centre[:, None]) / scale[:, None], 0.0)
    q, r, f = estimated(z, known, rounds)
    a, p = f["a"][:, -1], f["p"][:, -1]
    step = np.zeros((len(y), 2, 2))
    step[:, 0, 0], step[:, 1, 1] = q.T
    means, variances = [], []
    for _ in range(steps):
        a, p = a @ MOVE.T, MOVE @ p @ MOVE.T + step
        means.append(centre + scale * a[:, 0])
        variances.append(scale**2 * (p[:, 0, 0] + r))
    return np.stack(means, 1), np.stack(variances, 1)
