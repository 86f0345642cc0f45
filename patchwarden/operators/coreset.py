"""Reference banks from training vectors: (bank_id, features) in order of selection.

Micro-batches reduce in parallel and meet in a tree (merge-reduce). Selections over all rows run in one task if
the vectors fit a block; beyond it in distributed passes over lazily kept distances (``selection``). What is inherently sequential streams through one task with
the state of K centers, never with a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import kernels as N
from ..functions.vectors import sq_norm, vector_dim
from . import selection as S
from .selection import BANK

#: bytes of vectors that one task may hold
BLOCK_BYTES = 256 << 20
#: products of rows, picks and dimensions that one task may take for a greedy bank, whose picks grow with the rows
TASK_WORK = 1 << 32


def _bank(x: np.ndarray) -> pa.Table:
    return pa.table({"bank_id": pa.array(np.arange(len(x))), "features": A.lists(x)})


def _in_order(t: pa.Table, order: str, column: str) -> np.ndarray:
    t = t.sort_by(order)
    return A.matrix(t.column(column))


def _fits(df: DataFrame, column: str, block_bytes: int | None) -> bool:
    return df.count() * vector_dim(df, column) * 8 <= (BLOCK_BYTES if block_bytes is None else block_bytes)


def one_block(df: DataFrame, column: str, order: str, pick) -> DataFrame:
    """pick(matrix in order) -> rows, in one task; the caller has checked the size."""
    return df.select(F.lit(0).alias("g"), order, column).groupBy("g").applyInArrow(lambda t: _bank((x := _in_order(t, order, column))[pick(x)]), BANK)


def farthest_first(df: DataFrame, column: str, order: str, k: int, log: list[S.Pass] | None = None, block_bytes: int | None = None) -> DataFrame:
    """Exact farthest-first of all rows (all of them in order if there are k or fewer): in one task if the vectors fit a block, else in passes."""
    if _fits(df, column, block_bytes):
        return one_block(df, column, order, lambda x: N.farthest_first(x, k))
    from .moments import fit_moments

    m = fit_moments(df, column)
    if k >= m.n:
        return S.numbered(df, column, order)
    return S.farthest_rows(df, column, order, k, lambda x: N.distances(x, m.mean), True, log=log)


def _reduce(k: int):
    def reduce(t: pa.Table) -> pa.Table:
        t = t.sort_by([("slot", "ascending")])
        dim = t.column("dim")[0].as_py()
        x = np.concatenate([A.unpack(b, dim) for b in t.column("x").to_pylist()])
        x = x[N.farthest_first(x, min(k, len(x)))]
        return pa.table({"level": pa.array([t.column("level")[0].as_py() + 1], pa.int32()), "slot": [t.column("slot")[0].as_py() // 2], "dim": pa.array([dim], pa.int32()), "x": pa.array([A.pack(x)], pa.binary())})

    return reduce


def merge_reduce(df: DataFrame, column: str, batch: str, order: str, k: int, chunk: int = 256) -> DataFrame:
    """Merge-reduce k-center: each batch's coreset of min(k, chunk) rows; neighbours of a level
    merge and reduce like the digits of a binary counter; what is left over, lowest level first,
    reduces to k. Batches are numbered 0, 1, ... by ``batch`` in order; log2(batches) shuffles of
    packed coresets, no task with more than two of them but the last (one a level)."""
    cap = min(k, chunk)
    dim = vector_dim(df, column)
    schema = "level int, slot long, dim int, x binary"

    def block(t: pa.Table) -> pa.Table:
        x = _in_order(t, order, column)
        x = x[N.farthest_first(x, min(cap, len(x)))]
        return pa.table({"b": [t.column("b")[0].as_py()], "dim": pa.array([dim], pa.int32()), "x": pa.array([A.pack(x)], pa.binary())})

    blocks = df.select(F.col(batch).cast("long").alias("b"), order, column).groupBy("b").applyInArrow(block, "b long, dim int, x binary")
    ids = df.select(F.col(batch).cast("long").alias("b")).distinct()
    lo, hi, count = ids.agg(F.min("b"), F.max("b"), F.count("*")).first()
    if not count:
        raise ValueError("no batches")
    if hi - lo + 1 != count:  # gaps: number the batches
        from pyspark.sql import Window

        number = ids.withColumn("slot", F.row_number().over(Window.orderBy("b")) - 1)
        level = blocks.join(number, "b").select(F.lit(0).alias("level"), F.col("slot").cast("long").alias("slot"), "dim", "x")
    else:
        level = blocks.select(F.lit(0).alias("level"), (F.col("b") - lo).alias("slot"), "dim", "x")
    rest = None
    n = count
    while n > 1:
        if n % 2:
            odd = level.where(F.col("slot") == n - 1)
            rest = odd if rest is None else rest.union(odd)
            level = level.where(F.col("slot") < n - 1)
        level = level.groupBy((F.col("slot") / 2).cast("long").alias("pair")).applyInArrow(lambda t: _reduce(cap)(t), schema)
        n //= 2
    rest = level if rest is None else rest.union(level)

    def final(t: pa.Table) -> pa.Table:
        t = t.sort_by([("level", "ascending"), ("slot", "ascending")])
        x = np.concatenate([A.unpack(b, dim) for b in t.column("x").to_pylist()])
        return _bank(x[N.farthest_first(x, min(k, len(x)))])

    return rest.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(final, BANK)


def _streamed(df: DataFrame, column: str, order: str, start, update, result) -> DataFrame:
    """A fold over all rows in order, in one task that holds only the fold's state."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for b in batches:
            if b.num_rows:
                update(state, A.matrix(b.column(0)))
        x = result(state)
        if len(x):
            yield from _bank(x).to_batches()

    return df.select(order, column).repartition(1).sortWithinPartitions(order).select(column).mapInArrow(fold, BANK)


def budgeted_kcenter(df: DataFrame, column: str, order: str, k: int, threshold: float | None = None) -> DataFrame:
    return _streamed(df, column, order, lambda: N.Budgeted(k, threshold), lambda s, x: s.update(x), lambda s: s.c)


def greedy(df: DataFrame, column: str, order: str, share: float = 0.1, approximate: bool = False, seed: int = 0, dim: int = 128, starts: int = 10, log: list[S.Pass] | None = None, block_bytes: int | None = None) -> DataFrame:
    """Greedy coreset of int(n * share) rows (offline): always the row farthest from those picked, where all rows
    start with the norm of their row of the distance matrix, or, approximately, with the mean distance to
    some rows chosen by hash, on a random projection."""
    if not 0 < share < 1:
        raise ValueError("the share must be in (0, 1)")
    n = df.count()
    if not n:
        raise ValueError("no rows")
    view = lambda x: x
    if approximate:
        size = vector_dim(df, column)
        matrix = np.random.default_rng(seed).uniform(-1, 1, (size, dim)) / np.sqrt(size)
        view = lambda x: x @ matrix if size != dim else x
        picked = df.select(order, column).orderBy(F.xxhash64(F.lit(seed), order), order).limit(starts).toArrow()
        first = view(A.matrix(picked.column(column)))
        start = lambda x: N.pairwise(view(x), first).mean(1)
    else:
        m = df.agg(*(F.sum(F.col(column)[i]) for i in range(vector_dim(df, column)))).first()
        total, squares = np.array(list(m)), df.agg(F.sum(sq_norm(F.col(column)))).first()[0]
        start = lambda x: np.sqrt(np.maximum(n * (x * x).sum(1) - 2 * x @ total + squares, 0))
    k = int(n * share)
    if not k:
        return df.sparkSession.createDataFrame([], BANK)
    if n * k * (dim if approximate else len(total)) <= TASK_WORK and _fits(df, column, block_bytes):
        return one_block(df, column, order, lambda x: N.greedy_picks(view(x), start(x), k))
    return S.farthest_rows(df, column, order, k, start, False, view, log)


def kmeans(df: DataFrame, column: str, k: int, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """Batch k-means centers (distributed, k-means|| start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(df.select(array_to_vector(column).alias("features")))
    return df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], BANK)


class MiniBatchKMeans:
    """Buffers rows until max(k, batch) are there, then moves centers by decayed means."""

    def __init__(self, k: int, batch: int = 256, seed: int = 0):
        self.k, self.need, self.rng = k, max(k, batch), np.random.default_rng(seed)
        self.buffer: list[np.ndarray] = []
        self.centers: np.ndarray | None = None
        self.counts = np.zeros(k)

    def update(self, x: np.ndarray) -> None:
        self.buffer.append(x)
        if sum(map(len, self.buffer)) >= self.need:
            self._step()

    def _step(self) -> None:
        x = np.concatenate(self.buffer)
        self.buffer = []
        if self.centers is None:
            if len(x) < self.k:
                raise ValueError("fewer rows than clusters")
            pick = [int(self.rng.integers(len(x)))]
            while len(pick) < self.k:  # k-means++
                d = N.pairwise(x, x[pick]).min(1) ** 2
                pick.append(int(self.rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(self.rng.integers(len(x))))
            self.centers = x[pick].copy()
        near = N.pairwise(x, self.centers).argmin(1)
        n = np.bincount(near, minlength=self.k)
        total = np.zeros_like(self.centers)
        np.add.at(total, near, x)
        self.counts += n
        hit = n > 0
        self.centers[hit] += (total[hit] - n[hit, None] * self.centers[hit]) / self.counts[hit, None]

    def result(self) -> np.ndarray:
        if self.buffer:
            self._step()
        return self.centers if self.centers is not None else np.zeros((0, 0))


def minibatch_kmeans(df: DataFrame, column: str, order: str, k: int, batch: int = 256, seed: int = 0) -> DataFrame:
    return _streamed(df, column, order, lambda: MiniBatchKMeans(k, batch, seed), lambda s, x: [s.update(x[i : i + batch]) for i in range(0, len(x), batch)], lambda s: s.result())


def cluster_count(n_clusters: int | str, cluster_range: tuple[int, int] | str, contract: str, n_rows: int) -> int:
    """A given count, or ``auto``: a tenth of the rows within the range offline, its upper end in streams."""
    if n_clusters != "auto":
        return int(n_clusters)
    lo, hi = (1, 1000) if cluster_range == "auto" else cluster_range
    return hi if contract == "STREAMING" else min(max(int(0.1 * n_rows), lo), hi)


def enforce_budget(bank: DataFrame, limit: int, enforce: bool = True, contract: str = "STREAMING") -> int:
    """The bank's size; raises ValueError beyond the limit where it is enforced (streams only)."""
    n = bank.count()
    if n > limit and enforce and contract == "STREAMING":
        raise ValueError(f"the bank has {n} rows; its limit is {limit}")
    return n
