"""Covariance shrinkage, regularisation, stable Cholesky and PCA selection: D x D numpy on the driver."""

from __future__ import annotations

import numpy as np


def oas(s: np.ndarray, n: float) -> float:
    """Oracle-approximating shrinkage intensity of a covariance of n rows."""
    d = len(s)
    if n <= 1 or d <= 1:
        return 1.0
    t2, t = float((s * s).sum()), float(np.trace(s))
    den = (n + 1 - 2 / d) * (t2 - t * t / d)
    return 1.0 if den <= 0 else float(np.clip(((1 - 2 / d) * t2 + t * t) / den, 0, 1))


def rblw(s: np.ndarray, n: float) -> float:
    """Rao-Blackwell Ledoit-Wolf shrinkage intensity."""
    d = len(s)
    if n <= 2 or d <= 1:
        return 1.0
    t2, t = float((s * s).sum()), float(np.trace(s))
    den = (n + 2) * (t2 - t * t / d)
    return 1.0 if den <= 0 else float(np.clip(((n - 2) / n * t2 + t * t) / den, 0, 1))


def ledoit_wolf(biased: np.ndarray, n: float, fourth: float) -> float:
    """Ledoit-Wolf intensity from the biased covariance and the sum of fourth powers of the
    centred rows' norms."""
    d = len(biased)
    mu = np.trace(biased) / d
    delta = float((biased * biased).sum()) - d * mu * mu
    beta = (fourth / n - float((biased * biased).sum())) / n
    return 0.0 if delta <= 0 or beta <= 0 else float(min(beta, delta) / delta)


def regularize(s: np.ndarray, rho: float, floor_ratio: float, method: str = "FIXED", enabled: bool = True) -> np.ndarray:
    """(1 - rho) S + rho mu I with eigenvalues floored at floor_ratio * max(|mu|, 1e-12)."""
    s = (s + s.T) / 2
    if not enabled or method == "JITTER_ONLY":
        return s
    mu = np.trace(s) / len(s)
    out = (1 - rho) * s + rho * mu * np.eye(len(s))
    floor = floor_ratio * max(abs(mu), 1e-12)
    if floor > 0:
        w, v = np.linalg.eigh(out)
        if w.min() < floor:
            out = (v * np.maximum(w, floor)) @ v.T
            out = (out + out.T) / 2
    return out


def stable_cholesky(s: np.ndarray, min_jitter: float = 1e-12, max_jitter: float = 1.0, multiplier: float = 10.0) -> tuple[np.ndarray, float]:
    """(L, jitter): the first of jitters 0, min, min * multiplier, ... up to max that factors."""
    jitter = 0.0
    while True:
        try:
            return np.linalg.cholesky(s + jitter * np.eye(len(s))), jitter
        except np.linalg.LinAlgError:
            jitter = min_jitter if jitter == 0 else jitter * multiplier
            if jitter > max_jitter:
                w = np.linalg.eigvalsh(s)
                raise ValueError(f"no Cholesky factor up to jitter {max_jitter}: eigenvalues from {w[0]:.3g} to {w[-1]:.3g}") from None


def principal(cov: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components by rows, their variances, all ratios) reaching the variance ratio. If it is
    never reached, one component. Each component's largest loading is positive."""
    w, v = np.linalg.eigh(cov)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1].T
    share = w / w.sum() if w.sum() > 0 else np.zeros_like(w)
    reached = np.cumsum(share) >= ratio - 1e-12
    k = int(np.argmax(reached)) + 1
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])
    v = v * np.where(sign == 0, 1, sign)[:, None]
    return v[:k], w[:k], share
