"""Small dense steps of the state-space fits, applied inside tasks.

A period enters only through its collapsed observations: with loadings ``C``
and diagonal noise ``R`` over the series seen at ``t``,

    I_t = C' R^-1 C,   b_t = C' R^-1 y_t,   n_t,   sum log R,   sum y^2 / R.

These are sums over series, so Spark adds them up; everything here is as large
as the state and the calendar, never as the panel.
"""

from __future__ import annotations

import numpy as np

from tidecast.functions.numeric import STATE_LIMIT, VARIANCE_LIMIT

R_FLOOR = 1e-8  # fixed value: smallest noise variance after a step
R_START_FLOOR, R_START = 1e-6, 0.1  # fixed values: a flatter residual starts at R_START
Q_START = 0.1  # fixed value: variance of states without a fitted equation


def _bounded(v: np.ndarray) -> np.ndarray:
    v = (v + v.T) / 2
    np.fill_diagonal(v, np.clip(np.diag(v), 0.0, VARIANCE_LIMIT))
    return v


def _right_inverse(m: np.ndarray) -> np.ndarray:
    try:
        inv = np.linalg.inv(m)
        return inv if np.isfinite(inv).all() else np.linalg.pinv(m)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(m)


def collapse(y: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums over the series (rows of ``y``) for each period (columns)."""
    k = c.shape[1]
    seen = ~np.isnan(y)
    w = seen / r[:, None]
    y0 = np.where(seen, y, 0.0)
    outer = (c[:, :, None] * c[:, None, :]).reshape(len(c), k * k)
    return (
        (w.T @ outer).reshape(-1, k, k),
        (w * y0).T @ c,
        seen.sum(0).astype(float),
        seen.T @ np.log(r),
        (w * y0 * y0).sum(0),
    )


def filter_states(info, b, a, q, z0, v0):
    """Forward pass: predicted and filtered moments of every period."""
    n_t, k = b.shape
    zp, vp = np.zeros((n_t, k)), np.zeros((n_t, k, k))
    zf, vf = np.zeros((n_t, k)), np.zeros((n_t, k, k))
    z, v = np.clip(z0, -STATE_LIMIT, STATE_LIMIT), _bounded(v0.copy())
    eye = np.eye(k)
    for t in range(n_t):
        z = np.clip(a @ z, -STATE_LIMIT, STATE_LIMIT)
        v = _bounded(a @ v @ a.T + q)
        zp[t], vp[t] = z, v
        v = np.linalg.solve(eye + v @ info[t], v)
        v = (v + v.T) / 2
        z = z + v @ (b[t] - info[t] @ z)
        zf[t], vf[t] = z, v
    return zp, vp, zf, vf


def smooth_states(a, zp, vp, zf, vf):
    """Backward pass: smoothed moments and the covariance with the period before."""
    n_t = len(zf)
    zs, vs, cross = zf.copy(), vf.copy(), np.zeros_like(vf)
    for t in range(n_t - 2, -1, -1):
        j = vf[t] @ a.T @ _right_inverse(vp[t + 1])
        zs[t] = np.clip(zf[t] + j @ (zs[t + 1] - zp[t + 1]), -STATE_LIMIT, STATE_LIMIT)
        vs[t] = _bounded(vf[t] + j @ (vs[t + 1] - vp[t + 1]) @ j.T)
        cross[t + 1] = vs[t + 1] @ j.T
    return zs, vs, cross


def innovations_loglik(info, b, n, log_r, yy, zp, vp) -> float:
    """Gaussian log-likelihood from the predicted moments and the collapsed observations."""
    total, eye = 0.0, np.eye(b.shape[1])
    for t in range(len(b)):
        if n[t] == 0:
            continue
        z, v, it = zp[t], vp[t], info[t]
        w = b[t] - it @ z
        gain = eye + v @ it
        spread = np.linalg.slogdet(gain)[1]
        fit = yy[t] - 2 * z @ b[t] + z @ it @ z - w @ np.linalg.solve(gain, v) @ w
        total -= 0.5 * (n[t] * np.log(2 * np.pi) + log_r[t] + spread + fit)
    return float(total)


def stationary_variance(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V = A V A' + Q by doubling; the identity where it does not converge."""
    v, m = q.copy(), a.copy()
    for _ in range(60):
        step = m @ v @ m.T
        v, m = v + step, m @ m
        if not np.isfinite(v).all():
            return np.eye(len(a))
        if np.abs(step).max() < 1e-12 * max(1.0, np.abs(v).max()):
            return (v + v.T) / 2
    return np.eye(len(a))


def psd(q: np.ndarray) -> np.ndarray:
    q = (q + q.T) / 2
    low = np.linalg.eigvalsh(q).min()
    return q + np.eye(len(q)) * (abs(low) + 1e-8) if low < 0 else q


def factor_var(f: np.ndarray, p: int, n_extra: int = 0):
    """Companion VAR(p) of factors ``f`` by least squares, plus ``n_extra`` free states."""
    n_t, r = f.shape
    k = r * p + n_extra
    a, q = np.zeros((k, k)), np.eye(k) * Q_START
    a[r : r * p, : r * (p - 1)] = np.eye(r * (p - 1))
    q[r : r * p, r : r * p] = 0.0
    if n_t > p + 1:
        x = np.hstack([f[p - i - 1 : n_t - i - 1] for i in range(p)])
        beta = np.linalg.lstsq(x, f[p:], rcond=None)[0]
        a[:r, : r * p] = beta.T
        q[:r, :r] = np.atleast_2d(np.cov((f[p:] - x @ beta).T))
    return a, q


def regress_loadings(y, zs, vs, allowed):
    """Loadings and noise of every series given smoothed states (rows of ``allowed`` mask states)."""
    n, k = len(y), zs.shape[1]
    seen = ~np.isnan(y)
    y0 = np.where(seen, y, 0.0)
    ezz = vs + zs[:, :, None] * zs[:, None, :]
    zz = (seen.astype(float) @ ezz.reshape(len(zs), k * k)).reshape(n, k, k)
    zy = y0 @ zs
    c = np.zeros((n, k))
    for mask in np.unique(allowed, axis=0):
        rows, cols = (allowed == mask).all(1), np.flatnonzero(mask)
        sub = zz[rows][:, cols][:, :, cols]
        solved = np.array([_right_inverse(m) @ v for m, v in zip(sub, zy[rows][:, cols])])
        part = np.zeros((rows.sum(), k))
        part[:, cols] = solved
        c[rows] = part
    count = seen.sum(1)
    err = np.where(seen, y0 - c @ zs.T, 0.0)
    noise = seen @ vs.reshape(len(zs), k * k)
    spread = np.einsum("nk,nkl,nl->n", c, noise.reshape(n, k, k), c)
    r = (np.square(err).sum(1) + spread) / np.maximum(count, 1)
    return c, np.where(count > 0, np.maximum(r, R_FLOOR), 1.0)


def transition_step(zs, vs, cross, r: int, p: int):
    """Transition and its noise given smoothed moments; each extra state has its own AR(1)."""
    n_t, k = zs.shape
    ezz = vs + zs[:, :, None] * zs[:, None, :]
    s_lag, s_now = ezz[:-1].sum(0), ezz[1:].sum(0)
    s_cross = cross[1:].sum(0) + zs[1:].T @ zs[:-1]
    a, q, m = np.zeros((k, k)), np.zeros((k, k)), r * p
    a[:r, :m] = s_cross[:r, :m] @ _right_inverse(s_lag[:m, :m])
    a[r:m, : m - r] = np.eye(m - r)
    q[:r, :r] = psd((s_now[:r, :r] - a[:r, :m] @ s_cross[:r, :m].T) / (n_t - 1))
    for i in range(m, k):
        a[i, i] = s_cross[i, i] / max(s_lag[i, i], 1e-12)
        q[i, i] = max((s_now[i, i] - a[i, i] * s_cross[i, i]) / (n_t - 1), 1e-8)
    return a, q
