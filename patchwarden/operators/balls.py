"""Exact nearest neighbours against banks beyond memory: blocks that are balls, and pairs of blocks skipped by the triangle inequality.

Queries and bank are cut into blocks of near rows: ranges of their first principal axis, cut along the second. A block has a center and
a radius, so rows of two blocks are at least (distance of the centers - both radii) apart. Each block of queries meets the bank's balls
nearest first, in rounds of more and more balls; a ball that is farther than the k-th neighbour of each query found so far is skipped, as are all behind it. Between
rounds a query block carries its k best so far in a packed row, so what is shuffled follows the pairs of blocks that meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import kernels as N
from ..sources.scratch import written
from .moments import fit_moments

#: rows of queries and of the bank whose product is taken at once, pairs whose differences are, pairs that are held
QUERY_PIECE, BANK_PIECE, PAIRS, MOST_PAIRS = 512, 4096, 1 << 14, 1 << 20
#: rows of a block of queries and of the bank, balls that a block meets in the first round (twice as many in each further one)
QUERY_ROWS, BANK_ROWS, FIRST = 2048, 4096, 2
_BALL = "blk long, dim int, ids binary, x binary, center binary, radius double"
_STATE = "blk long, dim int, ids binary, x binary, near binary, dist binary, far double"


def top_k(x: np.ndarray, ids: np.ndarray, bank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bank ids, squared distances) of the k nearest, nearest first; ids ascend in bank order. Queries meet the bank in pieces of bounded size, whatever the
    size of the bank. A product leaves out pairs that are farther than k others by more than its rounding; distances of what is left are taken exactly, so that no tie is lost."""
    k = min(k, len(bank))
    out_i, out_d = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    sq = np.einsum("ij,ij->i", bank, bank)  # no second bank
    most = sq[np.isfinite(sq)].max(initial=0)
    todo = [(a, min(a + QUERY_PIECE, len(x))) for a in range(0, len(x), QUERY_PIECE)]
    while todo and k:
        lo, hi = todo.pop()
        q = x[lo:hi]
        found = _candidates(q, bank, sq, most, k)
        if found is None:  # large groups of ties
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
            continue
        i, j = found
        exact = np.empty(len(i))
        for c in range(0, len(i), PAIRS):
            exact[c : c + PAIRS] = ((q[i[c : c + PAIRS]] - bank[j[c : c + PAIRS]]) ** 2).sum(-1)
        by = np.lexsort((ids[j], exact, i))
        by = by[np.searchsorted(i[by], np.arange(len(q)))[:, None] + np.arange(k)]
        out_i[lo:hi], out_d[lo:hi] = ids[j[by]], exact[by]
    return out_i, out_d


def _candidates(q: np.ndarray, bank: np.ndarray, sq: np.ndarray, most: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs (row of q, row of the bank) with the k nearest of each row among them; None where they are too many for several rows at once."""
    qq = (q * q).sum(1)
    slack = 1e-9 * (qq + most)
    best = np.full((len(q), k), np.inf)
    rows, cols, near, n = [], [], [], 0
    for b in range(0, len(bank), BANK_PIECE):
        d = q @ bank[b : b + BANK_PIECE].T
        d *= -2
        d += sq[b : b + BANK_PIECE]
        d += qq[:, None]
        least = d.min(1, keepdims=True) if k == 1 else d if d.shape[1] <= k else np.partition(d, k - 1, 1)[:, :k]
        best = np.fmin(best, least) if k == 1 else np.partition(np.concatenate([best, least], 1), k - 1, 1)[:, :k]
        flat = np.flatnonzero(d <= (best.max(1) + slack)[:, None])
        n += len(flat)
        if n > MOST_PAIRS and len(q) > 1:
            return None
        rows.append(flat // d.shape[1])
        cols.append(flat % d.shape[1] + b)
        near.append(d.ravel()[flat])
    i, j = np.concatenate(rows), np.concatenate(cols)
    ok = np.concatenate(near) <= (best.max(1) + slack)[i]
    i, j = i[ok], j[ok]
    few = np.flatnonzero(np.bincount(i, minlength=len(q)) < k)  # numbers that are not finite: all of the bank
    if len(few):
        if len(few) * len(bank) > MOST_PAIRS and len(q) > 1:
            return None
        ok = ~np.isin(i, few)
        i, j = np.concatenate([i[ok], few.repeat(len(bank))]), np.concatenate([j[ok], np.tile(np.arange(len(bank)), len(few))])
    return i, j


def _axes(bank: DataFrame) -> np.ndarray:
    """The two directions of the largest variance."""
    return np.linalg.eigh(fit_moments(bank, "features").m2)[1][:, ::-1][:, :2]


def balls(df: DataFrame, axes: np.ndarray, rows: int) -> DataFrame:
    """(id, features) as packed balls of at most ``rows`` rows."""

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = A.matrix(b.column(1)) @ axes
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p[:, 0]), pa.array(p[:, -1])], names=["id", "features", "p", "p2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk, held = TaskContext.get().partitionId() << 33, []

        def ball(t: pa.Table) -> pa.RecordBatch:
            x = A.matrix(t.column("features"))
            center = x.mean(0)
            radius = float(N.distances(x, center).max()) * (1 + 1e-9)
            cols = [([blk], pa.int64()), ([x.shape[1]], pa.int32()), ([t.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), ([A.pack(x)], pa.binary()), ([A.pack(center)], pa.binary()), ([radius], pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in cols], names=[f.split()[0] for f in _BALL.split(", ")])

        for b in batches:
            held.append(b)
            if sum(h.num_rows for h in held) >= rows:
                t = pa.Table.from_batches(held)
                while t.num_rows >= rows:
                    yield ball(t.slice(0, rows))
                    t, blk = t.slice(rows), blk + 1
                held = t.to_batches()
        if sum(h.num_rows for h in held):
            yield ball(pa.Table.from_batches(held))

    n = df.count()
    blocks = -(-n // rows)
    slabs = max(1, round(blocks**0.5))  # so many ranges of the first axis, each cut along the second
    placed = df.select(F.col("id").cast("long").alias("id"), "features").mapInArrow(along, "id long, features array<double>, p double, p2 double")
    return placed.repartitionByRange(slabs, "p").sortWithinPartitions("p2").mapInArrow(cut, _BALL)


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(blk, blk2, lower, place): all pairs of balls without their rows, the least distance of their rows, and the ball's place among those of
    blk, nearest first."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, c2 = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<f8").reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1)) for k in ("center", "center2"))
            d = N.distances(c, c2)
            lower = np.maximum(d * (1 - 1e-9) - b.column("radius").to_numpy() - b.column("radius2").to_numpy(), 0)
            yield pa.RecordBatch.from_arrays([b.column("blk"), b.column("blk2"), pa.array(lower), pa.array(d)], names=["blk", "blk2", "lower", "d"])

    box = lambda t, s: t.select(*(F.col(c).alias(f"{c}{s}") for c in ("blk", "center", "radius")))
    met = box(left, "").crossJoin(box(right, "2")).mapInArrow(apart, "blk long, blk2 long, lower double, d double")  # a row a pair of balls, not of rows
    return met.withColumn("place", F.row_number().over(Window.partitionBy("blk").orderBy("lower", "d", "blk2"))).drop("d")


def _partial(k: int):
    """Pairs of blocks to (blk, near, dist): the k nearest of each query of the block, packed."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blk, dim, *packed in zip(*(b.column(c) for c in ("blk", "dim", "x", "ids2", "x2"))):
                blk, dim, (x, ids2, x2) = blk.as_py(), dim.as_py(), (p.as_buffer() for p in packed)  # in place, not a copy of all of the batch
                ids, y = np.frombuffer(ids2, "<i8"), A.unpack(x2, dim)
                by = np.argsort(ids, kind="stable")
                i, d = top_k(A.unpack(x, dim), ids[by], y[by], k)
                yield pa.RecordBatch.from_arrays([pa.array([blk]), pa.array([_padded(i, k, np.iinfo(np.int64).max)], pa.binary()), pa.array([_padded(d, k, np.inf)], pa.binary())], names=["blk", "near", "dist"])

    return partial


def _padded(v: np.ndarray, k: int, fill) -> bytes:
    out = np.full((len(v), k), fill, v.dtype)
    out[:, : v.shape[1]] = v
    return out.tobytes()


def _merged(k: int):
    """A query block and partial results to the block with the k best of all."""

    def merged(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = len(left.column("ids")[0].as_py()) // 8
        tables = (left, right)
        ids = np.concatenate([np.frombuffer(v, "<i8").reshape(n, k) for t in tables for v in t.column("near").to_pylist()], 1)
        d = np.concatenate([np.frombuffer(v, "<f8").reshape(n, k) for t in tables for v in t.column("dist").to_pylist()], 1)
        by = np.lexsort((ids, d), axis=1)[:, :k]
        d = np.take_along_axis(d, by, 1)
        new = {"near": pa.array([np.take_along_axis(ids, by, 1).tobytes()], pa.binary()), "dist": pa.array([d.tobytes()], pa.binary()), "far": pa.array([float(np.sqrt(d[:, -1].max()))], pa.float64())}
        return pa.table({c: new.get(c, left.column(c) if c in left.column_names else None) for c in (f.split()[0] for f in _STATE.split(", "))})

    return merged


def ball_knn(queries: DataFrame, bank: DataFrame, k: int, met: list[tuple[int, int]] | None = None) -> DataFrame:
    """(id, rank, bank_id, sq_dist): the k bank rows (id, features) nearest to each query (id, features), ties to the lowest id. met gets (pairs of blocks
    compared, all pairs)."""
    queries, bank = (t.select(F.col("id").cast("long").alias("id"), "features") for t in (queries, bank))
    schema = "id long, rank int, bank_id long, sq_dist double"
    if not bank.take(1) or not queries.take(1):
        return queries.sparkSession.createDataFrame([], schema)
    axes = _axes(bank)
    right = written(balls(bank, axes, BANK_ROWS), "knn-bank")
    left = written(balls(queries, axes, QUERY_ROWS), "knn-queries")
    pairs = written(_pairs(left, right), "knn-pairs")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(v) // 8 for v in b.column("ids").to_pylist()]
            fill = [pa.array([np.full(m * k, f).tobytes() for m in n], pa.binary()) for f in (np.iinfo(np.int64).max, np.inf)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("blk", "dim", "ids", "x")), *fill, pa.array([float("inf")] * len(n))], names=[f.split()[0] for f in _STATE.split(", ")])

    state = left.mapInArrow(begin, _STATE)
    done, step, compared = 0, FIRST, 0
    other = right.select(F.col("blk").alias("blk2"), F.col("ids").alias("ids2"), F.col("x").alias("x2"))
    most = right.count()
    while done < most:
        chosen = pairs.where((F.col("place") > done) & (F.col("place") <= done + step)).select("blk", "blk2", "lower")
        seen = Observation()
        # a little slack, so that ties are not lost to rounding
        todo = chosen.join(state.select("blk", "dim", "x", "far"), "blk").where(F.col("lower") <= F.col("far") * (1 + 1e-9) + 1e-12).drop("lower", "far")
        partial = todo.observe(seen, F.count("*").alias("n")).join(other, "blk2").mapInArrow(_partial(k), "blk long, near binary, dist binary")
        state = written(state.groupBy("blk").cogroup(partial.groupBy("blk")).applyInArrow(_merged(k), _STATE), "knn-round")
        compared += seen.get["n"]
        done, step = done + step, 2 * step
        if not seen.get["n"]:
            break  # places go by distance: what is left is farther
    if met is not None:
        met.append((compared, pairs.count()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, near, dist in zip(*(b.column(c).to_pylist() for c in ("ids", "near", "dist"))):
                q, i, d = np.frombuffer(ids, "<i8"), np.frombuffer(near, "<i8"), np.frombuffer(dist, "<f8")
                ok = np.isfinite(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[ok]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(q))[ok]), pa.array(i[ok]), pa.array(d[ok])], names=[f.split()[0] for f in schema.split(", ")])

    return state.select("ids", "near", "dist").mapInArrow(rows, schema)
