"""Mahalanobis whitening z = L^-1 (x - mean) by a shrunk, floored and jittered Cholesky factor."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions import linalg
from .moments import Moments, fit_moments, fourth_moment
from .reduction import map_vectors

METHODS = ("OAS", "LEDOIT_WOLF", "FIXED", "JITTER_ONLY")


@dataclass(frozen=True)
class WhiteningConfig:
    enabled: bool = True
    method: str = "OAS"
    shrinkage: float | str = "auto"
    eigen_floor_ratio: float = 1e-8
    min_jitter: float = 1e-12
    max_jitter: float = 1.0
    jitter_multiplier: float = 10.0
    storage_precision: str = "float64"

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}")
        if (self.method == "FIXED") != (self.shrinkage != "auto"):
            raise ValueError("a shrinkage is given with FIXED, and only with it")
        if self.shrinkage != "auto" and not 0 <= float(self.shrinkage) <= 1:
            raise ValueError("shrinkage must be in [0, 1]")
        if self.eigen_floor_ratio < 0 or self.min_jitter <= 0 or self.max_jitter < self.min_jitter or self.jitter_multiplier <= 1:
            raise ValueError("bad floor or jitter")
        if self.storage_precision not in ("float64", "float32"):
            raise ValueError("storage_precision is float64 or float32")


@dataclass
class WhiteningModel:
    mean: np.ndarray
    inverse: np.ndarray
    rho: float
    jitter: float

    def transform(self, df: DataFrame, column: str, out: str = "z") -> DataFrame:
        return map_vectors(df, column, out, lambda x: (x - self.mean) @ self.inverse.T)


def shrinkage(config: WhiteningConfig, m: Moments, fourth: float | None) -> float:
    """fourth: of exact Ledoit-Wolf; without it (streams) Rao-Blackwell Ledoit-Wolf stands in."""
    if config.method == "FIXED":
        return float(config.shrinkage)
    if config.method == "OAS":
        return linalg.oas(m.cov, m.n)
    if config.method == "LEDOIT_WOLF":
        return linalg.rblw(m.cov, m.n) if fourth is None else linalg.ledoit_wolf(m.m2 / m.n, m.n, fourth)
    return 0.0


def whitening_of(m: Moments, config: WhiteningConfig, fourth: float | None = None) -> WhiteningModel:
    rho = shrinkage(config, m, fourth) if config.enabled else 0.0
    s = linalg.regularize(m.cov, rho, config.eigen_floor_ratio, config.method, config.enabled)
    factor, jitter = linalg.stable_cholesky(s, config.min_jitter, config.max_jitter, config.jitter_multiplier)
    inverse = np.linalg.solve(factor, np.eye(len(s)))
    if config.storage_precision == "float32":
        inverse = inverse.astype(np.float32).astype(np.float64)
    return WhiteningModel(m.mean, inverse, rho, jitter)


def fit_whitening(df: DataFrame, column: str, config: WhiteningConfig = WhiteningConfig(), streaming: bool = False, passes: int = 1) -> WhiteningModel:
    """One pass over df (two for exact Ledoit-Wolf). passes > 1 counts the rows again, as
    repeated streaming passes do, which changes the divisor and the intensities."""
    m = fit_moments(df, column)
    fourth = fourth_moment(df, column, m.mean) if config.method == "LEDOIT_WOLF" and not streaming else None
    return whitening_of(m.repeated(passes), config, fourth)
