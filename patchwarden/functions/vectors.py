"""Column expressions on array<double> vectors: all stay inside the JVM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def adaptive_pool(a: Column, length: int, out: int) -> Column:
    """Means over out bins [floor(i L / O), ceil((i + 1) L / O)), which overlap where O does not divide L."""
    bins = [(i * length // out, -(-(i + 1) * length // out)) for i in range(out)]
    mean = lambda lo, hi: F.aggregate(F.slice(a, lo + 1, hi - lo), F.lit(0.0), lambda s, x: s + x) / (hi - lo)
    return F.array(*(mean(lo, hi) for lo, hi in bins))


def bround_vector(a: Column, decimals: int) -> Column:
    """Half-even rounding of each element, the key of quantized dedup. Adding 0.0 folds -0.0."""
    return F.transform(a, lambda x: F.bround(x, decimals) + F.lit(0.0))


def chi2_sf(x: Column, dim: int) -> Column:
    """Upper tail of the chi-squared distribution with dim degrees of freedom."""
    if dim % 2:
        return _chi2_sf_odd(x, F.lit(dim))
    h = x / 2
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    if dim == 2:
        return F.exp(-h)
    step = lambda s, i: F.struct((s["term"] * h / i).alias("term"), (s["sum"] + s["term"] * h / i).alias("sum"))
    return F.exp(-h) * F.aggregate(F.sequence(F.lit(1), F.lit(dim // 2 - 1)), start, step)["sum"]


@F.pandas_udf(T.DoubleType())
def _chi2_sf_odd(x: pd.Series, dim: pd.Series) -> pd.Series:
    h = x.to_numpy(float) / 2
    out = np.array([math.erfc(math.sqrt(v)) for v in h])
    term = np.sqrt(h) * np.exp(-h) / math.gamma(1.5)
    for i in range(int(dim.iloc[0]) // 2 if len(dim) else 0):
        out = out + term
        term = term * h / (i + 1.5)
    return pd.Series(out)


def is_finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def require_finite(df: DataFrame, column: str) -> DataFrame:
    """df; raises ValueError with the number of rows that hold a null, NaN or infinite value."""
    bad = df.where(~is_finite(F.col(column))).count()
    if bad:
        raise ValueError(f"{bad} rows of {column} hold values that are not finite")
    return df


def vector_dim(df: DataFrame, column: str) -> int:
    """The common length of the vectors; raises ValueError if they differ or there are none."""
    r = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    if r.lo is None or r.lo != r.hi or r.lo < 1:
        raise ValueError(f"{column} has lengths from {r.lo} to {r.hi}")
    return r.lo


def merge_features(columns: list[Column], how: str = "concat") -> Column:
    """One vector of several: concatenated, or averaged element by element."""
    if how == "concat":
        return F.concat(*columns)
    if how != "average":
        raise ValueError(f"unknown merger {how}")
    out = columns[0]
    for c in columns[1:]:
        out = F.zip_with(out, c, lambda x, y: x + y)
    return F.transform(out, lambda x: x / len(columns))
