"""Tail-aware k-center banks: a protected main coreset plus representatives of rare rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import kernels as N
from ..functions.vectors import chi2_sf, sq_norm, vector_dim
from ..sources.scratch import written
from . import coreset as B
from . import dedup as D
from .knn import min_distance

STRATEGIES = ("geometric_residual", "geometric_main_residual", "geometric_pruning_gap", "chi2_band")


@dataclass(frozen=True)
class TailConfig:
    k: int
    strategy: str = "geometric_residual"
    main_fraction: float = 0.85
    pool: int | None = 1000
    p_min: float = 0.0
    p_max: float = 0.05
    phase1_passes: int = 1
    epochs: int = 2
    dedup: str = "exact_row"
    decimals: int = 6
    eps: float = 0.0
    chunk: int = 256

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if self.epochs < 2 or not 0 < self.phase1_passes < self.epochs:
            raise ValueError("tail selection needs two passes or more, and fewer of phase 1")
        if self.k < 2 or not 0 < self.main_fraction < 1 or self.chunk < 1:
            raise ValueError("bad budget")
        if self.strategy != "chi2_band" and (self.pool is None or self.pool < self.tail_budget):
            raise ValueError("the candidate pool is smaller than the tail budget")
        if not 0 <= self.p_min <= self.p_max <= 1:
            raise ValueError("bad probabilities")

    @property
    def main_budget(self) -> int:
        return max(1, min(self.k - 1, round(self.main_fraction * self.k)))

    @property
    def tail_budget(self) -> int:
        return self.k - self.main_budget


def chi2_band(df: DataFrame, column: str, p_min: float, p_max: float) -> DataFrame:
    """Rows whose chi-squared tail probability of the squared norm lies in the closed band."""
    return df.withColumn("tail_p", chi2_sf(sq_norm(F.col(column)), vector_dim(df, column))).where(F.col("tail_p").between(p_min, p_max))


def residual_scores(df: DataFrame, centers: DataFrame, column: str = "features") -> DataFrame:
    """df and ``tail_score``: the distance to the nearest center."""
    return min_distance(df.withColumn("__x", F.col(column)), centers, "__x").withColumnRenamed("distance", "tail_score")


def pruning_gap_scores(df: DataFrame, full: DataFrame, main: DataFrame, column: str = "features") -> DataFrame:
    """df and ``tail_score``: how much farther the nearest main center is than the nearest of all, 0 at least."""
    a = residual_scores(df, full, column).withColumnRenamed("tail_score", "__full")
    return residual_scores(a, main, column).withColumn("tail_score", F.greatest(F.lit(0.0), F.col("tail_score") - F.col("__full"))).drop("__full")


def _matrix(df: DataFrame) -> np.ndarray:
    """A bank of bounded size, on the driver, by bank_id."""
    t = df.toArrow().sort_by("bank_id")
    return A.matrix(t.column("features"))


def _new(x: np.ndarray, pool: np.ndarray, c: TailConfig) -> np.ndarray:
    """Rows of x that are not in the pool, without repeats."""
    if c.dedup == "tolerance":
        return x[N.tolerance_kept(x, c.eps, pool)]
    q = (lambda v: np.round(v, c.decimals) + 0.0) if c.dedup == "quantized" else (lambda v: v + 0.0)
    seen = {r.tobytes() for r in q(pool)}
    keep = []
    for i, r in enumerate(q(x)):
        if (b := r.tobytes()) not in seen:
            seen.add(b)
            keep.append(i)
    return x[keep]


def _as_bank(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], B.BANK)


def tail_scores(x: DataFrame, full: np.ndarray, main: np.ndarray, c: TailConfig) -> DataFrame:
    """x (o, features) and ``tail_score`` by the strategy."""
    bank = lambda m: _as_bank(x.sparkSession, m)
    if c.strategy == "geometric_residual":
        return residual_scores(x, bank(full))
    if c.strategy == "geometric_main_residual":
        return residual_scores(x, bank(main))
    return pruning_gap_scores(x, bank(full), bank(full[N.farthest_first(full, min(c.main_budget, len(full)))]))


class BestDistinct:
    """The ``size`` best of different rows: a mergeable state of bounded size. Of equal vectors the first by order counts; the best have the largest scores, ties go
    by order. Equal vectors have equal scores, so what falls out of a part cannot be among the best of the whole."""

    def __init__(self, size: int):
        self.size, self.best = size, pa.table({"o": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "x": pa.array([], pa.binary())})

    def add(self, o: np.ndarray, s: np.ndarray, x: pa.Array) -> None:
        """More rows: orders, scores, packed vectors."""
        if self.best.num_rows >= self.size:  # most rows are below the worst of the best
            ok = np.flatnonzero(s >= self.best.column("s")[-1].as_py())
            o, s, x = o[ok], s[ok], x.take(pa.array(ok))
        t = pa.concat_tables([self.best, pa.table({"o": pa.array(o, pa.int64()), "s": pa.array(s, pa.float64()), "x": x.cast(pa.binary())})])
        by = np.lexsort((t.column("o").to_numpy(), -t.column("s").to_numpy()))
        seen: set[bytes] = set()
        keep = []
        vectors = t.column("x").to_pylist()
        for k in by.tolist():
            if vectors[k] not in seen:
                seen.add(vectors[k])
                keep.append(k)
                if len(keep) == self.size:
                    break
        self.best = t.take(pa.array(keep, pa.int64()))


#: parts that are merged at a time
FAN_IN = 32


def best_distinct(scored: DataFrame, size: int) -> DataFrame:
    """(o, features, tail_score): the best rows of different vectors. Each partition keeps ``size`` of its rows, the parts merge in a tree of groupings, so what is
    shuffled is bounded by partitions * size whatever the number of rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = BestDistinct(size)
        for b in batches:
            if b.num_rows:
                state.add(b.column(0).to_numpy(), b.column(2).to_numpy(), pa.array([A.pack(r + 0.0) for r in A.matrix(b.column(1))], pa.binary()))
        t = state.best
        yield from t.append_column("slot", pa.array(np.full(t.num_rows, TaskContext.get().partitionId()), pa.int64())).combine_chunks().to_batches()

    def merge(t: pa.Table) -> pa.Table:
        state = BestDistinct(size)
        state.add(t.column("o").to_numpy(), t.column("s").to_numpy(), t.column("x").combine_chunks())
        return state.best.append_column("slot", pa.array(np.full(state.best.num_rows, t.column("slot")[0].as_py() // FAN_IN), pa.int64()))

    schema = "o long, s double, x binary, slot long"
    level = written(scored.select(F.col("o").cast("long").alias("o"), "features", F.col("tail_score").cast("double").alias("s")).mapInArrow(part, schema), "pool-parts")
    slots = (level.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        level = level.groupBy(F.floor(F.col("slot") / FAN_IN).alias("to")).applyInArrow(merge, schema)
        slots = -(-slots // FAN_IN)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("o"), A.lists(np.frombuffer(b"".join(x), "<f8").reshape(len(x), -1)) if x else pa.array([], pa.list_(pa.float64())), b.column("s")], names=["o", "features", "tail_score"])

    return level.mapInArrow(unpacked, "o long, features array<double>, tail_score double")


def best_of(scored: DataFrame, c: TailConfig) -> DataFrame:
    """The pool: the best rows of (o, features, tail_score) without repeats. Quantized keys travel as hashes with orders and scores, as a key's first row counts and
    its score need not be the best of the key; only the pool's vectors are fetched."""
    if c.dedup == "exact_row":
        return D.stable_top_k(best_distinct(scored, c.pool), "tail_score", "o", c.pool)
    if c.dedup == "tolerance":
        once = D.dedup_tolerance(scored, "features", "o", c.eps)
        return D.stable_top_k(once.select("o", "features", "tail_score"), "tail_score", "o", c.pool)
    key = F.struct(F.xxhash64(k := D.dedup_key("features", c.dedup, c.decimals)), F.xxhash64(F.lit(1), k))
    first = scored.groupBy(key.alias("k")).agg(F.min(F.struct("o", "tail_score")).alias("f")).select("f.*")
    top = D.stable_top_k(first, "tail_score", "o", c.pool).select(F.col("o").alias("__o"))
    return D.stable_top_k(scored.join(F.broadcast(top), F.col("o") == F.col("__o")).select("o", "features", "tail_score"), "tail_score", "o", c.pool)


def chosen(full: np.ndarray, main: np.ndarray, pool: np.ndarray, c: TailConfig) -> tuple[np.ndarray, dict[str, int]]:
    """The bank's rows (main centers, the pool's rows farthest from all chosen, and full centers for what is
    left of the budget), and how many of each there are."""
    out = main
    fresh = _new(pool, main, c) if len(pool) else pool
    if len(fresh):
        out = np.concatenate([out, fresh[N.farthest_from(fresh, main, min(c.tail_budget, len(fresh)))]])
    tail = len(out) - len(main)
    if len(out) < c.k:
        more = _new(full, out, c)
        if len(more):
            out = np.concatenate([out, more[N.farthest_from(more, out, min(c.k - len(out), len(more)))]])
    out = out[: c.k]
    counts = {"budget": c.k, "main_budget": c.main_budget, "tail_budget": c.tail_budget, "full": len(full), "main": min(len(main), c.k), "pool": len(pool), "pool_new": len(fresh), "tail": tail, "filled": len(out) - len(main) - tail, "bank": len(out)}
    return out, counts


def tail_aware_bank(df: DataFrame, column: str, batch: str, order: str, c: TailConfig, telemetry: dict[str, int] | None = None) -> DataFrame:
    """(bank_id, features) of at most k rows; telemetry is filled with the sizes of what was selected from.

    Phase 1 builds provisional centers by merge-reduce. Phase 2 scores all rows against them in one
    distributed pass and keeps the best ``pool`` of them (scores of single rows do not change from
    batch to batch, so the batchwise pool is the overall stable top). The final selection works on
    banks of at most k and a pool of bounded size, on the driver."""
    x = df.select(F.col(batch).alias("b"), F.col(order).alias("o"), F.col(column).alias("features"))
    bank = lambda k: B.merge_reduce(x, "features", "b", "o", k, c.chunk)
    full = _matrix(bank(c.k))
    # the pools of both phases see the same rows, and with a chunk below both budgets the same blocks
    main = _matrix(bank(c.main_budget)) if c.main_budget < c.chunk else full[N.farthest_first(full, c.main_budget)] if len(full) > c.main_budget else full
    if c.strategy == "chi2_band":
        pool = _farthest_pool(chi2_band(x, "features", c.p_min, c.p_max), main, c)
    else:
        t = best_of(tail_scores(x, full, main, c), c).toArrow()
        pool = A.matrix(t.column("features")) if t.num_rows else full[:0]
    out, counts = chosen(full, main, pool, c)
    if telemetry is not None:
        telemetry |= counts
    return _as_bank(df.sparkSession, out)


def _farthest_pool(band: DataFrame, main: np.ndarray, c: TailConfig) -> np.ndarray:
    """At most k rows of the band, folded batch by batch: whenever there are more than k, those
    farthest from the main centers and each other stay."""

    def start():
        return [np.zeros((0, main.shape[1]))]

    def update(state, x):
        new = _new(np.concatenate([state[0], x]), main[:0], c)
        state[0] = new if len(new) <= c.k else new[N.farthest_from(new, main, c.k)]

    return _matrix(B._streamed(band, "features", "o", start, update, lambda s: s[0])) if band.take(1) else np.zeros((0, main.shape[1]))
