"""Structured Streaming forms of the mergeable and sequential operators.

Every stream keeps its progress in ``checkpointLocation`` and its state in a table that is written anew for
each batch id, both in one folder of the shared file system. A batch that runs again after a failure
reads the state before it and replaces its own result, and a stream that is started again on its
folder goes on where it stopped."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType

from ..functions import arrow as A
from ..functions import kernels as N
from ..operators import coreset as B
from ..operators import tail as T
from ..operators.moments import Moments, fit_moments
from ..operators.reduction import PCAModel, pca_of
from ..operators.whitening import WhiteningConfig, WhiteningModel, whitening_of
from ..sources.scratch import new_folder


@dataclass(frozen=True)
class UpdateContext:
    """Where an update stands: its pass of all passes over the data, counted from 1, and its batch in the pass, counted from 0."""

    pass_number: int
    passes: int
    batch_id: int

    def __post_init__(self):
        for name in ("pass_number", "passes", "batch_id"):
            v = getattr(self, name)
            if isinstance(v, bool) or not isinstance(v, int):
                raise TypeError(f"{name} is a whole number, not {v!r}")
        if self.passes < 1 or not 1 <= self.pass_number <= self.passes:
            raise ValueError(f"pass {self.pass_number} of {self.passes}")
        if self.batch_id < 0:
            raise ValueError(f"batch {self.batch_id}")

    @property
    def last_pass(self) -> bool:
        return self.pass_number == self.passes

    @property
    def name(self) -> str:
        """Names sort as updates follow each other."""
        return f"{self.pass_number:06d}-{self.batch_id:012d}"


class StateTable:
    """A table of state for each batch of each pass; the two newest stay."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.path, self.fs = path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        """Finished states, oldest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*/_SUCCESS")
        return sorted(str(f.getPath().getParent().getName()) for f in self.fs.globStatus(path) or [])

    def last(self, before: str | None = None) -> DataFrame | None:
        names = [n for n in self._names() if before is None or n < before]
        return self.spark.read.parquet(f"{self.folder}/{names[-1]}") if names else None

    def write(self, df: DataFrame, context: UpdateContext) -> None:
        name = context.name
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        for old in [n for n in self._names() if n < name][:-1]:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{old}"), True)


class DeltaState:
    """The newest row of each key. A batch writes only the keys that it changed, under its own name; after ``every`` such deltas they and the base before them become
    a new base. What is read is an aggregate of the newest base and the deltas behind it. The base before the newest and all that came
    behind it stay, so a batch that runs again after a failure replaces its own delta, and base, with the same rows."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], every: int = 16):
        if every < 1:
            raise ValueError("a base is made of one delta at least")
        self.spark, self.folder, self.keys, self.every = spark, folder, keys, every
        self.deltas, self.bases = StateTable(spark, f"{folder}/delta"), StateTable(spark, f"{folder}/base")

    def latest(self, until: str | None = None) -> DataFrame | None:
        """The newest rows, of the batches up to one of this name."""
        upto = lambda t: [n for n in t._names() if until is None or n <= until]
        base = ([None, *upto(self.bases)])[-1]
        paths = [f"{self.deltas.folder}/{n}" for n in upto(self.deltas) if base is None or n > base]
        parts = ([self.spark.read.parquet(f"{self.bases.folder}/{base}")] if base else []) + ([self.spark.read.parquet(*paths)] if paths else [])
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        values = [c for c in rows.columns if c not in (*self.keys, "__at")]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "__at").alias("v"), F.max("__at").alias("__at")).select(*self.keys, "v.*", "__at")

    def write(self, changed: DataFrame, context: UpdateContext) -> None:
        """changed: a row for each key that the batch changed."""
        name = context.name
        changed.withColumn("__at", F.lit(name)).write.mode("overwrite").parquet(f"{self.deltas.folder}/{name}")
        bases = [n for n in self.bases._names() if n < name]
        behind = [n for n in self.deltas._names() if (not bases or n > bases[-1]) and n <= name]
        if len(behind) < self.every:
            return
        rows = self.latest(name) if not self.bases._names() or self.bases._names()[-1] < name else self._before(name)
        rows.write.mode("overwrite").parquet(f"{self.bases.folder}/{name}")
        keep = bases[-1] if bases else ""
        for t in (self.deltas, self.bases):
            for old in [n for n in t._names() if n < keep or n == keep and t is self.deltas]:
                t.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{old}"), True)

    def _before(self, name: str) -> DataFrame:
        """The rows up to a batch whose base is there already and is made anew: computed from what lies before that base."""
        path = f"{self.bases.folder}/{name}"
        self.bases.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        return self.latest(name)


Update = Callable[[DataFrame, DataFrame | None, UpdateContext], DataFrame]


def run_stream(spark: SparkSession, source: Callable[[], DataFrame], update: Update, folder: str | None = None, passes: int = 1, mode: str = "append") -> DataFrame | None:
    """Fold a stream: update(batch, state before it or None, context) gives the state after it. Each pass reads
    all that is available anew, with its own progress. The state after the last batch, None without input."""
    folder = folder or new_folder(spark, "stream")
    table = StateTable(spark, f"{folder}/state")
    for p in range(passes):

        def fold(batch: DataFrame, batch_id: int, p: int = p) -> None:
            context = UpdateContext(p + 1, passes, batch_id)
            if not batch.isEmpty():
                table.write(update(batch, table.last(context.name), context), context)

        writer = source().writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress-{p}")
        writer.foreachBatch(fold).trigger(availableNow=True).start().awaitTermination()
    return table.last()


def run_keyed_stream(spark: SparkSession, source: Callable[[], DataFrame], keys: list[str], folder: str | None = None, every: int = 16) -> DataFrame | None:
    """The newest row of each key of a stream in update mode. A micro-batch writes the keys that it changed (``DeltaState``). None without input."""
    folder = folder or new_folder(spark, "stream")
    table = DeltaState(spark, f"{folder}/state", keys, every)

    def fold(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            table.write(batch, UpdateContext(1, 1, batch_id))

    source().writeStream.outputMode("update").option("checkpointLocation", f"{folder}/progress-0").foreachBatch(fold).trigger(availableNow=True).start().awaitTermination()
    out = table.latest()
    return None if out is None else out.drop("__at")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a Parquet file or folder, in micro-batches of some files."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    status = spark._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = status.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(status).isDirectory()
    source = path if is_dir else f"{folder}/{name[:-1]}[{name[-1]}]"  # a single file needs a glob
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)


def update_moments(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merges micro-batches into (n, mean, m2) of a key and emits the state so far."""
    n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
    for f in frames:
        x = f["v"].dropna().to_numpy(float)
        if len(x):
            bn, bm = len(x), float(x.mean())
            b2 = float(((x - bm) ** 2).sum())
            d = bm - mean
            m2 += b2 + d * d * n * bn / (n + bn)
            mean += d * bn / (n + bn)
            n += bn
    state.update((n, mean, m2))
    yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": [mean], "std": [math.sqrt(m2 / n) if n else float("nan")]})


def stream_scalar_moments(spark: SparkSession, path: str, key: str, value: str, folder: str | None = None, every: int = 16) -> DataFrame:
    """(key, n, mean, std) after all available input: one keyed state across micro-batches."""
    schema = "key string, n long, mean double, std double"

    def source() -> DataFrame:
        s = read_stream(spark, path).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v"))
        return s.groupBy("key").applyInPandasWithState(update_moments, schema, "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)

    out = run_keyed_stream(spark, source, ["key"], folder, every)
    return (spark.createDataFrame([], schema) if out is None else out).withColumnRenamed("key", key)


_MOMENTS = "n long, mean array<double>, m2 array<double>"


def _moments_row(m: Moments) -> tuple:
    return (m.n, m.mean.tolist(), m.m2.ravel().tolist())


def _moments_of(state: DataFrame | None) -> Moments | None:
    if state is None:
        return None
    r = state.first()
    return Moments(r.n, np.array(r.mean), np.array(r.m2).reshape(len(r.mean), -1))


def stream_vector_moments(spark: SparkSession, path: str, column: str, folder: str | None = None, passes: int = 1) -> Moments:
    """Moments of a vector column, merged micro-batch by micro-batch; further passes count the rows again."""

    def update(batch: DataFrame, state: DataFrame | None, _: UpdateContext) -> DataFrame:
        new, old = fit_moments(batch.withColumn("__v", F.col(column).cast("array<double>")), "__v"), _moments_of(state)
        return spark.createDataFrame([_moments_row(new if old is None else old.merge(new))], _MOMENTS)

    out = _moments_of(run_stream(spark, lambda: read_stream(spark, path), update, folder, passes))
    if out is None:
        raise ValueError("the stream had no rows")
    return out


def stream_pca(spark: SparkSession, path: str, column: str, variance_ratio: float = 0.99, folder: str | None = None) -> PCAModel:
    return pca_of(stream_vector_moments(spark, path, column, folder), variance_ratio)


def stream_whitening(spark: SparkSession, path: str, column: str, config: WhiteningConfig = WhiteningConfig(), folder: str | None = None, passes: int = 1) -> WhiteningModel:
    return whitening_of(stream_vector_moments(spark, path, column, folder, passes), config)


_LEVELS = "level int, dim int, x binary"
#: neighbouring blocks that a task merges before the driver gets their coreset
FAN = 16


class BinaryCounter:
    """Merge-reduce state: at most one coreset a level; equal levels merge and carry."""

    def __init__(self, k: int, chunk: int, levels: dict[int, np.ndarray] | None = None):
        self.k, self.cap, self.levels = k, min(k, chunk), levels or {}

    @property
    def blocks(self) -> int:
        """How many blocks are in it."""
        return sum(1 << level for level in self.levels)

    def push(self, block: np.ndarray, level: int = 0) -> None:
        """A block, or the coreset of 2^level of them where their number so far is a multiple of that."""
        while level in self.levels:
            block = np.concatenate([self.levels.pop(level), block])
            block = block[N.farthest_first(block, min(self.cap, len(block)))]
            level += 1
        self.levels[level] = block

    def centers(self) -> np.ndarray:
        x = np.concatenate([self.levels[k] for k in sorted(self.levels)])
        return x[N.farthest_first(x, min(self.k, len(x)))]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, x.shape[1], bytearray(A.pack(x))) for k, x in self.levels.items()], _LEVELS)

    @staticmethod
    def of(k: int, chunk: int, state: DataFrame | None) -> BinaryCounter:
        rows = [] if state is None else state.collect()  # log2(blocks) coresets
        return BinaryCounter(k, chunk, {r.level: A.unpack(bytes(r.x), r.dim).copy() for r in rows})


class Waiting:
    """Rows (b, o, v) of blocks b that cannot be pushed yet. A batch writes its own rows once, under its own name, so a batch that
    runs again writes them anew; a table whose rows are all pushed is deleted by a batch that started from a state with them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = StateTable(spark, folder)

    def rows(self, pushed: int, context: UpdateContext | None = None) -> DataFrame | None:
        """The rows behind so many pushed blocks, with the ``name`` of their table, of the batches before a context's or all."""
        t = self.table
        paths = [f"{t.folder}/{n}" for n in t._names() if context is None or n < context.name]
        if not paths:
            return None
        rows = t.spark.read.parquet(*paths).select("b", "o", "v", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("name"))
        return rows.where(F.col("b") >= pushed) if pushed else rows

    def write(self, rows: DataFrame, context: UpdateContext) -> None:
        rows.write.mode("overwrite").parquet(f"{self.table.folder}/{context.name}")

    def keep(self, names: set[str], context: UpdateContext) -> None:
        """Delete the other tables of the batches before a context's."""
        t = self.table
        for old in [n for n in t._names() if n < context.name and n not in names]:
            t.fs.delete(t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.folder}/{old}"), True)


def _push_blocks(counter: BinaryCounter, x: DataFrame) -> None:
    """Push the blocks of x (b, o, v), numbered on from those that are pushed. Whole groups of FAN blocks merge in a task."""
    cap, schema = counter.cap, "b long, level int, dim int, x binary"

    def node(b: int, level: int, m: np.ndarray) -> pa.Table:
        return pa.table({"b": pa.array([b], pa.int64()), "level": pa.array([level], pa.int32()), "dim": pa.array([m.shape[1]], pa.int32()), "x": pa.array([A.pack(m)], pa.binary())})

    def block(t: pa.Table) -> pa.Table:
        m = B._in_order(t, "o", "v")
        return node(t.column("b")[0].as_py(), 0, m[N.farthest_first(m, min(cap, len(m)))])

    def merge(t: pa.Table) -> pa.Table:
        if t.num_rows < FAN:
            return t
        whole, rows = BinaryCounter(cap, cap), t.sort_by("b").to_pylist()
        for r in rows:
            whole.push(A.unpack(r["x"], r["dim"]))
        ((level, m),) = whole.levels.items()
        return node(rows[0]["b"], level, m)

    x = x.select("b", "o", F.col("v").cast("array<double>").alias("v"))
    nodes = x.groupBy("b").applyInArrow(block, schema).groupBy(F.floor(F.col("b") / FAN)).applyInArrow(merge, schema)
    for r in nodes.orderBy("b").toLocalIterator():
        counter.push(A.unpack(bytes(r.x), r.dim).copy(), r.level)


def _push_batch(counters: list[BinaryCounter], batch: DataFrame, waiting: Waiting, context: UpdateContext, column: str, order: str, rows_per_block: int) -> None:
    """Push the blocks floor(order / rows_per_block) of a micro-batch to each counter. Files may cut blocks and come in any order: a block is
    pushed once all its rows are there and all blocks from 0 up to it are pushed, as no later row can change it then. Other rows wait."""
    pushed = counters[0].blocks
    new = batch.select(F.floor(F.col(order) / rows_per_block).alias("b"), F.col(order).alias("o"), F.col(column).alias("v"), F.lit("").alias("name")).where("b IS NOT NULL")
    old = waiting.rows(pushed, context)
    rows = new if old is None else new.unionByName(old)
    firsts = {r.name: r.b for r in rows.groupBy("name").agg(F.min("b").alias("b")).toLocalIterator()}
    first, end = min(firsts.values(), default=None), pushed
    if pushed and first is not None and first < pushed:
        raise ValueError(f"block {first} had all its {rows_per_block} rows and gets another; {order} numbers rows from 0, each once")
    if first == pushed and isinstance(rows.schema["o"].dataType, IntegralType):
        full = rows.groupBy("b").agg(F.collect_set("o").alias("o")).where(F.size("o") == rows_per_block).select("b")
        after = full.select((F.col("b") + 1).alias("b")).union(rows.sparkSession.range(pushed, pushed + 1).toDF("b"))
        end = after.join(full, "b", "left_anti").agg(F.min("b")).first()[0]
    if end > pushed:
        for counter in counters:
            _push_blocks(counter, rows.where(F.col("b") < end))
    waiting.write((new.where(F.col("b") >= end) if end > pushed else new).drop("name"), context)
    waiting.keep(set(firsts), context)


def _push_rest(counters: list[BinaryCounter], waiting: Waiting) -> None:
    """After all input: push what waits, where missing blocks are left out of the count."""
    pushed = counters[0].blocks
    rows = waiting.rows(pushed)
    if rows is None:
        return
    ids = rows.select("b").distinct()
    first, last, count = ids.agg(F.min("b"), F.max("b"), F.count("*")).first()
    if not count:
        return
    if first != pushed or last - first + 1 != count:
        number = ids.select("b", (F.row_number().over(Window.orderBy("b")) + (pushed - 1)).alias("n"))
        rows = rows.join(number, "b").select(F.col("n").cast("long").alias("b"), "o", "v")
    for counter in counters:
        _push_blocks(counter, rows)


def _bank(spark: SparkSession, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], B.BANK)


def stream_merge_reduce(spark: SparkSession, path: str, column: str, order: str, rows_per_block: int, k: int, chunk: int, folder: str | None = None) -> DataFrame:
    """A merge-reduce bank of a stream of vectors: blocks reduce in parallel, and their coresets fold, in the order of blocks, into a
    state of log2(blocks) coresets. Rows before which others are missing wait in a table."""
    folder = folder or new_folder(spark, "stream")
    waiting = Waiting(spark, f"{folder}/waiting")

    def update(batch: DataFrame, state: DataFrame | None, context: UpdateContext) -> DataFrame:
        counter = BinaryCounter.of(k, chunk, state)
        _push_batch([counter], batch, waiting, context, column, order, rows_per_block)
        return counter.table(spark)

    counter = BinaryCounter.of(k, chunk, run_stream(spark, lambda: read_stream(spark, path), update, folder))
    _push_rest([counter], waiting)
    if not counter.levels:
        raise ValueError("the stream had no rows")
    return _bank(spark, counter.centers())


def _stream_fold(spark: SparkSession, path: str, column: str, order: str, make, dump, load, folder: str | None) -> str:
    """A sequential fold in stream order; its state is one row of JSON, and it runs in one task a micro-batch."""

    def update(batch: DataFrame, state: DataFrame | None, _: UpdateContext) -> DataFrame:
        before = None if state is None else state.first().state

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = make() if before is None else load(json.loads(before))
            for b in batches:
                if b.num_rows:
                    s.update(A.matrix(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(dump(s))])], names=["state"])

        x = batch.select(F.col(order).alias("o"), F.col(column).cast("array<double>").alias("v"))
        return x.repartition(1).sortWithinPartitions("o").select("v").mapInArrow(fold, "state string")

    out = run_stream(spark, lambda: read_stream(spark, path), update, folder)
    if out is None:
        raise ValueError("the stream had no rows")
    return out.first().state


def stream_budgeted(spark: SparkSession, path: str, column: str, order: str, k: int, threshold: float | None = None, folder: str | None = None) -> DataFrame:
    """Budgeted k-center of a stream; the state are its centers."""

    def load(d: dict) -> N.Budgeted:
        s = N.Budgeted(k, threshold)
        s.c = np.array(d["c"])
        return s

    state = _stream_fold(spark, path, column, order, lambda: N.Budgeted(k, threshold), lambda s: {"c": s.c.tolist()}, load, folder)
    return _bank(spark, np.array(json.loads(state)["c"]))


def stream_minibatch_kmeans(spark: SparkSession, path: str, column: str, order: str, k: int, batch: int = 256, seed: int = 0, folder: str | None = None) -> DataFrame:
    """Mini-batch k-means of a stream; the state are centers, their counts, rows that wait and the generator."""

    class Steps(B.MiniBatchKMeans):
        def update(self, x: np.ndarray) -> None:
            for i in range(len(x)):  # a step as soon as enough rows wait, whatever the micro-batches are
                super().update(x[i : i + 1])

    def dump(s: Steps) -> dict:
        wait = np.concatenate(s.buffer).tolist() if s.buffer else []
        return {"centers": None if s.centers is None else s.centers.tolist(), "counts": s.counts.tolist(), "wait": wait, "rng": s.rng.bit_generator.state}

    def load(d: dict) -> Steps:
        s = Steps(k, batch, seed)
        s.centers = None if d["centers"] is None else np.array(d["centers"])
        s.counts, s.buffer = np.array(d["counts"]), [np.array(d["wait"])] if d["wait"] else []
        s.rng.bit_generator.state = d["rng"]
        return s

    state = _stream_fold(spark, path, column, order, lambda: Steps(k, batch, seed), dump, load, folder)
    return _bank(spark, load(json.loads(state)).result())


def stream_tail_aware(spark: SparkSession, path: str, column: str, order: str, rows_per_block: int, c: T.TailConfig, folder: str | None = None) -> DataFrame:
    """A tail-aware bank of a stream in two passes: the first folds the centers by merge-reduce, the second the pool of
    the rows that score best against them. Strategies on residuals."""
    if c.strategy == "chi2_band":
        raise ValueError("the band of a stream is not folded; use tail_aware_bank")
    folder = folder or new_folder(spark, "stream")
    waiting = Waiting(spark, f"{folder}/waiting")
    vectors = lambda b: b.select(F.col(order).alias("o"), F.col(column).cast("array<double>").alias("features"))
    schema = "level int, dim int, x binary, o long, features array<double>, tail_score double"

    def counters(state: DataFrame | None) -> tuple[BinaryCounter, BinaryCounter]:
        rows = None if state is None else state.where("level IS NOT NULL")
        of = lambda k, sign: BinaryCounter.of(k, c.chunk, None if rows is None else rows.where(f"level {sign}").withColumn("level", F.abs("level") - 1))
        return of(c.k, "> 0"), of(c.main_budget, "< 0")

    def main_of(full: BinaryCounter, main: BinaryCounter) -> np.ndarray:
        x = full.centers()
        return main.centers() if c.main_budget < c.chunk else x[N.farthest_first(x, c.main_budget)] if len(x) > c.main_budget else x

    whole: list[tuple[np.ndarray, np.ndarray]] = []  # the centers after the first pass

    def centers(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if not whole:
            full, main = counters(state)
            _push_rest([full, main], waiting)
            whole.append((full.centers(), main_of(full, main)))
        return whole[0]

    def packed(full: BinaryCounter, main: BinaryCounter) -> DataFrame:
        rows = [((k + 1) * sign, x.shape[1], bytearray(A.pack(x)), None, None, None) for counter, sign in ((full, 1), (main, -1)) for k, x in counter.levels.items()]
        return spark.createDataFrame(rows, schema)

    def update(batch: DataFrame, state: DataFrame | None, context: UpdateContext) -> DataFrame:
        full, main = counters(state)
        if context.pass_number == 1:
            _push_batch([full, main], batch, waiting, context, column, order, rows_per_block)
            return packed(full, main)
        scored = T.tail_scores(vectors(batch), *centers(state), c).select("o", "features", "tail_score")
        old = state.where("level IS NULL").select("o", "features", "tail_score")
        pool = T.best_of(scored.unionByName(old), c)
        return packed(full, main).unionByName(pool.select(F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("dim"), F.lit(None).cast("binary").alias("x"), F.col("o").cast("long").alias("o"), "features", "tail_score"))

    out = run_stream(spark, lambda: read_stream(spark, path), update, folder, 2)
    if out is None:
        raise ValueError("the stream had no rows")
    full, main = centers(out)
    t = out.where("level IS NULL").orderBy(F.desc("tail_score"), "o").toArrow()  # the pool's bound
    pool = A.matrix(t.column("features")) if t.num_rows else full[:0]
    return _bank(spark, T.chosen(full, main, pool, c)[0])
