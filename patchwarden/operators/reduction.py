"""PCA as an estimator and model: batch and incremental fits are one exact fit of merged moments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import arrow as A
from ..functions import linalg
from .moments import Moments, fit_moments


@dataclass
class PCAModel:
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    ratios: np.ndarray

    def transform(self, df: DataFrame, column: str, out: str = "reduced") -> DataFrame:
        return map_vectors(df, column, out, lambda x: (x - self.mean) @ self.components.T)


def fit_pca(df: DataFrame, column: str, variance_ratio: float = 0.99) -> PCAModel:
    return pca_of(fit_moments(df, column), variance_ratio)


def pca_of(m: Moments, variance_ratio: float = 0.99) -> PCAModel:
    if not 0 < variance_ratio <= 1:
        raise ValueError("the variance ratio must be in (0, 1]")
    return PCAModel(m.mean, *linalg.principal(m.cov, variance_ratio))


class IdentityReducer:
    """The reducer that changes nothing."""

    def transform(self, df: DataFrame, column: str, out: str = "reduced") -> DataFrame:
        return df.withColumn(out, df[column])


def map_vectors(df: DataFrame, column: str, out: str, f) -> DataFrame:
    """df and a column of f(matrix of rows), by Arrow batches."""
    names = [c for c in df.columns if c != out]
    at = names.index(column)
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = f(A.matrix(b.column(at)))
                if not np.isfinite(y).all():
                    raise ValueError(f"{out} is not finite")
                yield pa.RecordBatch.from_arrays([*b.columns, A.lists(y)], names=[*names, out])

    return df.select(*names).mapInArrow(apply, schema)
