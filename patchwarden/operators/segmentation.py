"""Operators on grids held as flat row-major arrays: patches, resizing, smoothing, regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as A
from ..functions import kernels as N
from .reduction import map_vectors


def cells(df: DataFrame, column: str, width: int) -> DataFrame:
    """df's other columns with (row, col, value) for each cell."""
    keys = [c for c in df.columns if c != column]
    x = df.select(*keys, F.posexplode(column).alias("__p", "value"))
    return x.select(*keys, F.expr(f"__p div {width}").cast("int").alias("row"), (F.col("__p") % width).alias("col"), "value")


def patchify(df: DataFrame, column: str, height: int, width: int, k: int = 3, stride: int = 1, out: str = "patch") -> DataFrame:
    """df's other columns with (row, col, patch) for each position of a k x k window, zero-padded."""
    keys = [c for c in df.columns if c != column]
    schema = T.StructType([*(df.schema[c] for c in keys), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField(out, T.ArrayType(T.DoubleType()))])
    cols = (width + 2 * ((k - 1) // 2) - k) // stride + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = N.patchify(A.matrix(b.column(len(keys))).reshape(-1, 1, height, width), k, stride)
                n, p = x.shape[:2]
                take = pa.array(np.repeat(np.arange(n), p))
                at = np.tile(np.arange(p), n)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), pa.array((at // cols).astype(np.int32)), pa.array((at % cols).astype(np.int32)), A.lists(x.reshape(n * p, -1))], names=[f.name for f in schema])

    return df.select(*keys, column).mapInArrow(windows, schema)


def resize(df: DataFrame, column: str, shape: tuple[int, int], to: tuple[int, int], sigma: float = 0.0, out: str = "resized") -> DataFrame:
    """Bilinear resize and, with sigma, Gaussian smoothing: both are separable linear maps, so
    a batch of grids is two matrix products."""
    return map_vectors(df, column, out, lambda x: N.smooth_resize(x.reshape(-1, *shape), to, sigma).reshape(len(x), -1))


def region_labels(df: DataFrame, mask: str, height: int, width: int, out: str = "labels") -> DataFrame:
    """df and 4-connected region labels of its masks, 1 up in row-major order."""
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = A.matrix(b.column(names.index(mask))).reshape(-1, height, width) > 0
                x = np.stack([N.regions(v).ravel() for v in m]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x.tolist(), pa.list_(pa.int32()))], names=[*names, out])

    return df.select(*names).mapInArrow(label, schema)


def align_layers(df: DataFrame, layers: list[str], shapes: list[tuple[int, int]], out: str = "aligned") -> DataFrame:
    """df and one array: every layer's grid resized to the first one's, side by side."""
    x = df
    names = []
    for name, shape in zip(layers, shapes):
        if shape == shapes[0]:
            names.append(name)
        else:
            x = resize(x, name, shape, shapes[0], out=f"__{name}")
            names.append(f"__{name}")
    return x.withColumn(out, F.concat(*names)).drop(*(n for n in names if n.startswith("__")))
