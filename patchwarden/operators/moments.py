"""Mergeable means and covariances of vector columns, whole or by group.

Each partition folds its Arrow batches into (count, mean, M2); partials are merged pairwise-stable
(Chan) on the executors, by key, in a tree, so the driver gets one D x D matrix however many
partitions there are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as A

#: partials that one task merges
FAN_IN = 64


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    m2: np.ndarray

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not self.n or not o.n:
            return o if not self.n else self
        d = o.mean - self.mean
        return Moments(n, self.mean + d * (o.n / n), self.m2 + o.m2 + np.outer(d, d) * (self.n * o.n / n))

    @property
    def cov(self) -> np.ndarray:
        """Unbiased covariance; zeros for fewer than two rows."""
        return self.m2 / (self.n - 1) if self.n > 1 else np.zeros_like(self.m2)

    def repeated(self, passes: int) -> Moments:
        """The moments of the same rows added in several passes."""
        return Moments(self.n * passes, self.mean, self.m2 * passes)


def of_rows(x: np.ndarray) -> Moments:
    mean = x.mean(0)
    c = x - mean
    return Moments(len(x), mean, c.T @ c)


def partial_moments(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mean, m2) with one row for each key and partition; mean and m2 are packed doubles."""
    keys = keys or []
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("mean", T.BinaryType()), T.StructField("m2", T.BinaryType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, Moments] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = A.matrix(b.column(len(keys)))
            if keys:
                t = pa.table({k: b.column(i) for i, k in enumerate(keys)})
                groups: dict[tuple, list[int]] = {}
                for i, r in enumerate(zip(*(t.column(k).to_pylist() for k in keys))):
                    groups.setdefault(r, []).append(i)
            else:
                groups = {(): list(range(len(x)))}
            for g, at in groups.items():
                m = of_rows(x[at])
                state[g] = state[g].merge(m) if g in state else m
        if state:
            yield _record(schema, keys, state)

    return df.select(*keys, column).mapInArrow(fold, schema)


def _record(schema: T.StructType, keys: list[str], state: dict) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(schema)
    cols = [pa.array([g[i] for g in state], types.field(k).type) for i, k in enumerate(keys)]
    return pa.RecordBatch.from_arrays(
        [*cols, pa.array([m.n for m in state.values()], pa.int64()), pa.array([A.pack(m.mean) for m in state.values()], pa.binary()), pa.array([A.pack(m.m2) for m in state.values()], pa.binary())],
        names=[f.name for f in schema],
    )


def _read(n: int, mean: bytes, m2: bytes) -> Moments:
    x = np.frombuffer(mean, "<f8")
    return Moments(n, x, np.frombuffer(m2, "<f8").reshape(len(x), len(x)))


def merged_moments(partials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each key. Rows of a key are merged as they stream by, in constant memory."""
    keys = keys or []
    schema = partials.schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, Moments] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for *g, n, mean, m2 in zip(*cols):
                m = _read(n, mean, m2)
                state[tuple(g)] = state[tuple(g)].merge(m) if tuple(g) in state else m
        if state:
            yield _record(schema, keys, state)

    n = partials.rdd.getNumPartitions() if not keys else 1
    while not keys and n > FAN_IN:
        n = -(-n // FAN_IN)
        partials = partials.repartition(n).mapInArrow(merge, schema)
    return (partials.repartition(*keys) if keys else partials.coalesce(1) if n == 1 else partials.repartition(1)).mapInArrow(merge, schema)


def fit_moments(df: DataFrame, column: str) -> Moments:
    """Moments of a whole column, on the driver."""
    r = merged_moments(partial_moments(df, column)).collect()
    if not r:
        raise ValueError("no rows to fit")
    return _read(r[0].n, r[0].mean, r[0].m2)


def grouped_cov(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, n, i, j, mean_i, cov) in long form, i <= j from 1."""
    merged = merged_moments(partial_moments(df, column, keys), keys)
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, t()) for c, t in (("n", T.LongType), ("i", T.IntegerType), ("j", T.IntegerType), ("mean_i", T.DoubleType), ("cov", T.DoubleType)))])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                m = _read(*(b.column(len(keys) + k)[r].as_py() for k in range(3)))
                i, j = np.triu_indices(len(m.mean))
                take = pa.array(np.full(len(i), r))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(take) for k in range(len(keys))), pa.array(np.full(len(i), m.n)), pa.array((i + 1).astype(np.int32)), pa.array((j + 1).astype(np.int32)), pa.array(m.mean[i]), pa.array(m.cov[i, j])],
                    names=[f.name for f in schema],
                )

    return merged.mapInArrow(long, schema)


def fourth_moment(df: DataFrame, column: str, mean: np.ndarray) -> float:
    """Sum over rows of |x - mean|^4, the extra pass of exact Ledoit-Wolf."""
    from ..functions.vectors import sq_dist

    mu = F.array(*(F.lit(float(v)) for v in mean))
    return df.select(sq_dist(F.col(column), mu).alias("q")).agg(F.sum(F.col("q") * F.col("q"))).first()[0]


def scalar_moments(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mean, std): population standard deviation."""
    return df.groupBy(*(keys or [])).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
