"""Selections that always take the row farthest from all rows taken so far, over tables of any size.

Rows are written once as blocks, each with its rows' distances to the picks, the largest of them (its bound) and its farthest
rows. Distances only shrink, so an old bound stays an upper bound: a pass reads the blocks whose bound reaches the best
candidate known, or which lag LAG passes behind, lowers their distances by the picks that they have not seen and writes them anew; all
other blocks are left alone. A row meets each pick at most once, whatever the number of passes, and a pass
costs the same however many picks there are. A pass settles as many picks as its candidates prove; it writes
them to the table of picks, and only the picks of the last LAG passes (CANDIDATES each at most) are held and broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import kernels as N
from ..sources.scratch import new_folder, written

BANK = "bank_id long, features array<double>"
#: rows and bytes of a block's vectors, rows of a block that a pass may take, rows that it looks at, passes that a block may lag behind
BLOCK_ROWS, PART_BYTES, TOP, CANDIDATES, LAG = 4096, 8 << 20, 64, 1024, 8
_STATE = "blk long, dim int, o binary, x binary, d binary, bound double, rest double, version int, work long, tops array<struct<o:long,d:double,v:binary>>"
_TOP = pa.list_(pa.struct([("o", pa.int64()), ("d", pa.float64()), ("v", pa.binary())]))


class Pass(NamedTuple):
    """What a pass did: blocks read, distances computed, picks settled."""

    blocks: int
    distances: int
    picks: int


def lowered(d: np.ndarray, z: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Distances d of the rows z, lowered by those to some picks. A product tells which pairs may be nearer; their distances
    are taken exactly, so the result is the same as pick by pick."""
    d, zz = d.copy(), (z * z).sum(1)
    for lo in range(0, len(picks), 256):
        p = picks[lo : lo + 256]
        pp = (p * p).sum(1)
        square = zz[:, None] + pp - 2 * z @ p.T
        i, j = np.nonzero(square - 1e-9 * (zz[:, None] + pp) < (d * d)[:, None])
        for a in range(0, len(i), 1 << 16):
            s = slice(a, a + (1 << 16))
            np.minimum.at(d, i[s], N.distances(z[i[s]], p[j[s]]))
    return d


def _row(blk: int, version: int, work: int, o: np.ndarray, x: np.ndarray, d: np.ndarray, top: int) -> pa.RecordBatch:
    by = np.lexsort((o, -d))
    tops = [{"o": int(o[k]), "d": float(d[k]), "v": A.pack(x[k])} for k in by[:top].tolist()]
    rest = float(d[by[top]]) if len(by) > top else float("-inf")
    cols = [[blk], [x.shape[1]], [o.astype("<i8").tobytes()], [A.pack(x)], [A.pack(d)], [float(d[by[0]])], [rest], [version], [work]]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array([tops], _TOP)], names=[f.split()[0] for f in _STATE.split(", ")[:9]] + ["tops"])


def _blocks(begin: Callable[[np.ndarray], np.ndarray], rows: int, top: int):
    """(o, v) to blocks with the distances that ``begin`` gives."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blk = TaskContext.get().partitionId() << 33
        held: list[pa.RecordBatch] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, blk
            t = pa.Table.from_batches(held)
            lo = 0
            while t.num_rows - lo >= rows or last and lo < t.num_rows:
                part = t.slice(lo, rows)
                x = A.matrix(part.column(1))
                yield _row(blk, 1, len(x), part.column(0).to_numpy(), x, begin(x), top)
                lo += part.num_rows
                blk += 1
            held = t.slice(lo).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(b)
                if sum(h.num_rows for h in held) >= rows:
                    yield from cut(False)
        if held:
            yield from cut(True)

    return blocks


def _refresh(sent, view, version: int, top: int):
    """Blocks with the distances lowered by the picks since their version."""

    def refresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = sent.value
        for b in batches:
            for r in b.to_pylist():
                x, o, d = A.unpack(r["x"], r["dim"]), np.frombuffer(r["o"], "<i8"), np.frombuffer(r["d"], "<f8")
                unseen = [p for v, p in recent.items() if v >= r["version"]]
                picks = np.concatenate(unseen) if unseen else x[:0]
                yield _row(r["blk"], version, len(x) * len(picks), o, x, lowered(d, view(x), view(picks)) if len(picks) else d, top)

    return refresh


def farthest_rows(df: DataFrame, column: str, order: str, k: int, start: Callable[[np.ndarray], np.ndarray], afresh: bool, view: Callable[[np.ndarray], np.ndarray] = lambda x: x, log: list[Pass] | None = None) -> DataFrame:
    """(bank_id, features) of k rows, each time the one with the largest distance from those picked (ties: the lowest order; picked rows are not masked). start(rows) are
    the distances to begin with, for the first pick only (afresh) or as a bound on all later ones. view: of the rows that
    distances are taken on. log: gets a line for each pass."""
    spark = df.sparkSession
    picked = new_folder(spark, "picks")
    rows = df.select(F.col(order).cast("long").alias("o"), F.col(column).alias("v"))
    n_picks = 0

    def keep(x: np.ndarray) -> None:
        nonlocal n_picks
        spark.createDataFrame([(n_picks + i, [float(v) for v in p]) for i, p in enumerate(x)], BANK).coalesce(1).write.mode("append").parquet(picked)
        n_picks += len(x)

    begin = start
    if afresh:
        first = _best(rows, start)
        keep(first)
        origin = view(first)[0]
        begin = lambda x: N.distances(view(x), origin)
    dim = len(rows.first()["v"])
    per_block = max(1, min(BLOCK_ROWS, PART_BYTES // (8 * dim)))
    fresh = rows.mapInArrow(_blocks(begin, per_block, TOP), _STATE)
    live: dict[int, list] = {}  # version: [blocks written in that pass, bound from which on they were read again]
    recent: dict[int, np.ndarray] = {}
    version = 1
    while n_picks < k:
        path, seen = new_folder(spark, "selection"), Observation()
        # a small row group for each block, so that blocks with a low bound are not read
        fresh.observe(seen, F.max("rest").alias("rest"), F.sum("work").alias("work"), F.count("*").alias("blocks")).write.option("parquet.block.size", 1 << 20).parquet(path)
        now = spark.read.schema(_STATE).parquet(path)
        others = [b.where(F.col("bound") < cap).select("bound") for b, cap in live.values()]
        unread = None
        for o in others:
            unread = o if unread is None else unread.union(o)
        far = [seen.get["rest"], unread.agg(F.max("bound")).first()[0] if unread is not None else None]
        t = now.select(F.explode("tops").alias("t")).select("t.*").orderBy(F.desc("d"), "o").limit(CANDIDATES).toArrow()
        d, o = t.column("d").to_numpy().copy(), t.column("o").to_numpy()
        x = A.unpack(b"".join(t.column("v").to_pylist()), dim)
        z, bar = view(x), max([float("-inf"), *(f for f in far if f is not None), *([d[-1]] if len(d) == CANDIDATES else [])])
        live[version] = [now, float("inf")]
        at, taken = 0, []
        while True:
            taken.append(at)
            d = np.minimum(d, N.distances(z, z[at]))
            at = int(np.lexsort((o, -d))[0])
            if n_picks + len(taken) == k or d[at] <= bar or len(taken) >= CANDIDATES:
                break
        keep(x[taken])
        recent[version] = x[taken]
        if log is not None:
            log.append(Pass(seen.get["blocks"], seen.get["work"], len(taken)))
        version += 1
        need, fresh = float(d[at]), None
        for v in list(live):
            blocks, cap = live[v]
            old = v <= version - LAG
            part = blocks.where(F.col("bound") < cap) if old else blocks.where((F.col("bound") < cap) & (F.col("bound") >= need))
            fresh = part if fresh is None else fresh.unionByName(part)
            live[v][1] = min(cap, need)
            if old:
                del live[v]
        recent = {v: p for v, p in recent.items() if v >= version - LAG}
        fresh = fresh.mapInArrow(_refresh(spark.sparkContext.broadcast(recent), view, version, TOP), _STATE)
    return spark.read.schema(BANK).parquet(picked)


def _best(rows: DataFrame, start) -> np.ndarray:
    """The row with the largest start, as a matrix of one."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = start(A.matrix(b.column(1)))
                at = pa.array(np.lexsort((b.column(0).to_numpy(), -d))[:1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(d).take(at), b.column(1).take(at)], names=["o", "d", "v"])

    t = rows.mapInArrow(best, "o long, d double, v array<double>").orderBy(F.desc("d"), "o").limit(1).toArrow()
    return A.matrix(t.column("v"))


def numbered(df: DataFrame, column: str, order: str) -> DataFrame:
    """(bank_id, features) of all rows in order: a global sort, and the sizes of its ranges."""
    ranged = written(df.select(order, column).orderBy(order).select(F.monotonically_increasing_id().alias("i"), F.col(column).alias("features")), "numbered")
    part = F.shiftright("i", 33)
    sizes = ranged.groupBy(part.alias("p")).count().orderBy("p").collect()  # a row a partition of the sort
    at, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    known = df.sparkSession.createDataFrame(offsets, "p long, offset long")
    return ranged.join(F.broadcast(known), part == F.col("p")).select((F.col("offset") + F.col("i").bitwiseAND((1 << 33) - 1)).alias("bank_id"), "features")
