"""Between Arrow list columns and numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and len(flat) % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    """A matrix as a list<double> column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


def unpack(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, "<f8").reshape(-1, dim)
