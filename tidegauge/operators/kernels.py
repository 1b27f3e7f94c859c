"""Recursions over time as NumPy folds. The leading axis is the series; only time is looped over."""

from __future__ import annotations

import numpy as np

LOG_2PI = np.log(2 * np.pi)
TINY, NUDGE = 1e-6, 1e-3  # floor of positive states; mean and variance of what a negative one is pulled to


def dlt_step(level, slope, y, lev_sm, slp_sm, theta, eps=0.0):
    """One step of the damped local trend: new level, new slope, component."""
    c = level + theta * slope
    seen = np.where(np.isnan(y), c + eps, y)
    ok = np.isfinite(seen)
    new_level = np.where(ok, lev_sm * np.where(ok, seen, 0.0) + (1 - lev_sm) * c, level)
    new_slope = np.where(ok, slp_sm * (new_level - level) + (1 - slp_sm) * slope, slope)
    return new_level, new_slope, c


def dlt_scan(y, lev_sm, slp_sm, theta, level=None, slope=None, eps=None):
    """Levels, slopes and components (B, T). Without a start the first observation is the level."""
    y = np.asarray(y, float)
    if level is None:
        if np.isnan(y[:, 0]).any():
            raise ValueError("the first observation of a series is missing")
        level = y[:, 0]
    slope = np.zeros_like(level) if slope is None else slope
    out = np.empty((3, *y.shape))
    for t in range(y.shape[1]):
        level, slope, c = dlt_step(level, slope, y[:, t], lev_sm, slp_sm, theta, 0.0 if eps is None else eps[:, t])
        out[0, :, t], out[1, :, t], out[2, :, t] = level, slope, c
    return out[0], out[1], out[2]


def _spread(x, shape):
    return np.broadcast_to(np.asarray(x, float), shape)


def _fuse(a, p, a_obs, p_obs):
    """Combines N(a, p) with N(a_obs, p_obs); an infinite variance says nothing."""
    new = 1 / (1 / p + 1 / p_obs)
    return new * (a / p + a_obs / p_obs), new


def kalman_filter(y, z, a0, p0, sigma_h, sigma_q, *, positivity=None, a_obs=None, p_obs=None, exponent=None, skip_missing=False):
    """Filter with diagonal state covariances; y (B, T), z (B, T, n) or (T, n).

    Without ``exponent`` states are linear, P enters as predicted and is stored with the process noise
    added; positive states are nudged and floored. With it, masked states (all without a mask) act as
    exp(exponent * a), the noise is added before each step, and P is stored as filtered.
    NaN observations are an error unless ``skip_missing`` has them predicted over."""
    y = np.asarray(y, float)
    b, steps = y.shape
    z = np.broadcast_to(np.asarray(z, float), (b, steps, np.shape(z)[-1]))
    n = z.shape[-1]
    if np.isnan(y).any() and not skip_missing:
        raise ValueError("missing observations; skip_missing predicts over them")
    if (a_obs is None) != (p_obs is None):
        raise ValueError("a_obs and p_obs come together")
    a, p, q = _spread(a0, (b, n)).copy(), _spread(p0, (b, n)).copy(), _spread(sigma_q, (b, n)) ** 2
    h = _spread(sigma_h, (b,)) ** 2
    ekf = exponent is not None
    mask = np.ones(n, bool) if positivity is None else np.asarray(positivity, bool)
    at, pt, kt, vt, ft = np.empty((b, steps, n)), np.empty((b, steps, n)), np.empty((b, steps, n)), np.empty((b, steps)), np.empty((b, steps))
    terms = np.zeros((b, steps))
    for t in range(steps):
        zt = z[:, t]
        if ekf:
            p = p + q
        if a_obs is not None:
            a, p = _fuse(a, p, _spread(np.asarray(a_obs)[..., t, :], (b, n)), _spread(np.asarray(p_obs)[..., t, :], (b, n)))
        if ekf:
            e = np.exp(np.clip(exponent * a, -10, 10))
            state, grad = np.where(mask, e, a), np.where(mask, exponent * zt * e, zt)
        else:
            state, grad = a, zt
        v, f = y[:, t] - (zt * state).sum(1), (p * grad**2).sum(1) + h
        k = p * grad / f[:, None]
        if skip_missing:
            gone = np.isnan(v)
            k, seen = np.where(gone[:, None], 0.0, k), np.where(gone, 0.0, v)
        else:
            gone, seen = np.zeros(b, bool), v
        terms[:, t] = np.where(gone, 0.0, -0.5 * (LOG_2PI + np.log(f) + seen**2 / f))
        a, p = a + k * seen[:, None], p * (1 - k * grad)
        if not ekf:
            p = p + q
            if positivity is not None:
                low = mask & (a < 0)
                fused_a, fused_p = _fuse(a, p, NUDGE, NUDGE)
                a, p = np.where(low, fused_a, a), np.where(low, fused_p, p)
                a = np.where(mask, np.maximum(a, TINY), a)
        at[:, t], pt[:, t], kt[:, t], vt[:, t], ft[:, t] = a, p, k, v, f
    return {"a": at, "p": pt, "k": kt, "v": vt, "f": ft, "log_p": terms.sum(1)}


def dk_smoother(out, z, a0, p0, *, sigma_q=None, a_obs=None, p_obs=None, exponent=None, positivity=None):
    """Durbin-Koopman state means, by the backward recursion over innovations."""
    at, pt, kt, vt, ft = (out[c] for c in ("a", "p", "k", "v", "f"))
    b, steps, n = at.shape
    z = np.broadcast_to(np.asarray(z, float), at.shape)
    ap = np.concatenate([_spread(a0, (b, 1, n)), at[:, :-1]], 1)
    pp = np.concatenate([_spread(p0, (b, 1, n)), pt[:, :-1]], 1)
    ekf = exponent is not None
    if ekf:
        pp = pp + (_spread(sigma_q, (b, n)) ** 2)[:, None]
    mask = np.ones(n, bool) if positivity is None else np.asarray(positivity, bool)
    r, smooth = np.zeros((b, n)), np.empty_like(at)
    for t in range(steps - 1, -1, -1):
        a_pred, p_pred, grad = ap[:, t], pp[:, t], z[:, t]
        told = a_obs is not None and p_obs is not None
        if told:
            ao, po = _spread(np.asarray(a_obs)[..., t, :], (b, n)), _spread(np.asarray(p_obs)[..., t, :], (b, n))
        if ekf:
            at_a = _fuse(a_pred, p_pred, ao, po)[0] if told else a_pred
            grad = np.where(mask, exponent * grad * np.exp(np.clip(exponent * at_a, -10, 10)), grad)
        r = grad * (vt[:, t] / ft[:, t])[:, None] + (1 - kt[:, t] * grad) * r
        if told:
            finite = np.isfinite(po)
            fo = np.where(finite, p_pred + po, 1.0)
            r = np.where(finite, (ao - a_pred) / fo + np.where(finite, po, 0.0) / fo * r, r)
        smooth[:, t] = a_pred + p_pred * r
    return smooth


def rts_smoother(out, sigma_q, *, ekf=False):
    """Rauch-Tung-Striebel means and variances of diagonal states."""
    at, pt = out["a"], out["p"]
    b, steps, n = at.shape
    q = _spread(sigma_q, (b, n)) ** 2
    a_s, p_s = at.copy(), pt.copy()
    if ekf:
        for t in range(steps - 2, -1, -1):
            ahead = pt[:, t] + q
            j = pt[:, t] / ahead
            a_s[:, t] = at[:, t] + j * (a_s[:, t + 1] - at[:, t])
            p_s[:, t] = pt[:, t] + j**2 * (p_s[:, t + 1] - ahead)
        return a_s, p_s
    a_next, p_next = at[:, -1], pt[:, -1]
    for t in range(steps - 1, -1, -1):
        filtered = pt[:, t] - q
        j = filtered / pt[:, t]
        a_s[:, t] = at[:, t] + j * (a_next - at[:, t])
        p_s[:, t] = filtered + j**2 * (p_next - pt[:, t])
        a_next, p_next = a_s[:, t], p_s[:, t]
    return a_s, p_s


def _symmetric(p):
    return (p + np.swapaxes(p, -1, -2)) / 2


def kalman_filter_st(y, z, a0, p0, sigma_h, sigma_q, *, positivity=None, a_obs=None, p_obs=None, exponent=None):
    """Filter of one panel whose m series share n states with a full covariance; y (T, m), z (T, m, n)."""
    y, z = np.asarray(y, float), np.asarray(z, float)
    steps, m, n = z.shape
    if np.isnan(y).any():
        raise ValueError("missing observations")
    a, p = np.array(a0, float), np.array(p0, float)
    h, q = np.diag(_spread(sigma_h, (m,)) ** 2), np.diag(_spread(sigma_q, (n,)) ** 2)
    ekf = exponent is not None
    mask = np.ones(n, bool) if positivity is None else np.asarray(positivity, bool)
    out = {"a": np.empty((steps, n)), "p": np.empty((steps, n, n)), "v": np.empty((steps, m)), "f": np.empty((steps, m, m)), "k": np.empty((steps, n, m))}
    log_p = 0.0

    def fuse(a, p, ao, po):
        w = np.where(np.isfinite(po), 1 / po, 0.0)
        new = _symmetric(np.linalg.solve(np.eye(n) + p * w, p))
        return new @ (np.linalg.solve(p, a) + w * ao), new

    for t in range(steps):
        if ekf:
            p = _symmetric(p + q)
        if a_obs is not None:
            a, p = fuse(a, p, np.asarray(a_obs)[t], np.asarray(p_obs)[t])
        e = np.exp(np.clip(exponent * a, -10, 10)) if ekf else None
        state, grad = (np.where(mask, e, a), z[t] * np.where(mask, exponent * e, 1.0)) if ekf else (a, z[t])
        v, f = y[t] - z[t] @ state, grad @ p @ grad.T + h
        k = np.linalg.solve(f, grad @ p).T
        log_p -= 0.5 * (m * LOG_2PI + np.linalg.slogdet(f)[1] + v @ np.linalg.solve(f, v))
        a, p = a + k @ v, p - k @ grad @ p
        p = _symmetric(p if ekf else p + q)
        if not ekf and positivity is not None:
            low = mask & (a < 0)
            if low.any():
                a, p = fuse(a, p, np.where(low, NUDGE, 0.0), np.where(low, NUDGE, np.inf))
            a = np.where(mask, np.maximum(a, TINY), a)
        for c, x in zip(("a", "p", "v", "f", "k"), (a, p, v, f, k), strict=True):
            out[c][t] = x
    return out | {"log_p": log_p}


def simulate_forecast(a0, z, sigma_h, sigma_q, rng, draws):
    """Random-walk states and observations (draws, T) ahead of a last state."""
    z = np.asarray(z, float)
    steps, n = z.shape
    a = np.asarray(a0, float) + np.cumsum(rng.standard_normal((draws, steps, n)) * np.asarray(sigma_q, float), 1)
    return (a * z).sum(2) + rng.standard_normal((draws, steps)) * sigma_h


def simulation_smoother(y, z, a0, p0, sigma_h, sigma_q, rng, draws):
    """Draws of the states given the observations: smoothed plus what a simulated path leaves over."""
    y, z = np.asarray(y, float)[None], np.asarray(z, float)
    steps, n = z.shape
    start = rng.standard_normal((draws, 1, n)) * np.sqrt(p0)
    noise = np.concatenate([start, rng.standard_normal((draws, steps - 1, n)) * sigma_q], 1)
    a_plus = np.cumsum(noise, 1)
    y_plus = (a_plus * z).sum(2) + rng.standard_normal((draws, steps)) * sigma_h
    rest = y - (np.asarray(a0, float) * z).sum(1) - y_plus
    out = kalman_filter(rest, z, np.zeros(n), p0, sigma_h, sigma_q)
    return a_plus + dk_smoother(out, z, np.zeros(n), p0) + np.asarray(a0, float)
