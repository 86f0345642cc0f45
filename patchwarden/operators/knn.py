"""Exact k-nearest-neighbour joins on squared Euclidean distance; ties go to the lowest bank_id.

A bank within ``BANK_BYTES`` (checked) is sent to every worker and queries stream past it in
blocks, without a shuffle. A larger bank is cut into balls, and query blocks meet only those that can hold a
neighbour (``balls``).
Distances rank by the BLAS expansion and the survivors are computed again from exact differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as A
from ..functions.vectors import sq_dist
from .balls import ball_knn, top_k

BANK_BYTES = 256 << 20
#: rows of a block of queries, of bank rows
QUERY_CHUNK, BANK_CHUNK = 2048, 8192


def _read_bank(bank: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = bank.select(F.col("bank_id").cast("long").alias("bank_id"), "features").toArrow().sort_by("bank_id")
    return t.column("bank_id").to_numpy(), A.matrix(t.column("features"))


def knn_join(queries: DataFrame, bank: DataFrame, k: int, column: str = "features", bank_bytes: int = BANK_BYTES) -> DataFrame:
    """Long form: the queries' other columns, rank from 1, bank_id, sq_dist."""
    keys = [c for c in queries.columns if c != column]
    size = bank.agg(F.coalesce(F.sum(F.size("features").cast("long")), F.lit(0))).first()[0] * 8
    if size > bank_bytes:
        return _knn_by_blocks(queries, bank, k, column, keys)
    shared = queries.sparkSession.sparkContext.broadcast(_read_bank(bank))
    schema = T.StructType([*(queries.schema[c] for c in keys), T.StructField("rank", T.IntegerType()), T.StructField("bank_id", T.LongType()), T.StructField("sq_dist", T.DoubleType())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            i, d = top_k(A.matrix(b.column(len(keys))), ids, x, k)
            take = pa.array(np.repeat(np.arange(len(i)), i.shape[1]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(len(keys))), pa.array(np.tile(np.arange(1, i.shape[1] + 1, dtype=np.int32), len(i))), pa.array(i.ravel()), pa.array(d.ravel())], names=[f.name for f in schema])

    return queries.select(*keys, column).mapInArrow(near, schema)


def _knn_by_blocks(queries: DataFrame, bank: DataFrame, k: int, column: str, keys: list[str]) -> DataFrame:
    named = queries.withColumn("__q", F.xxhash64(*keys, column))
    best = ball_knn(named.select(F.col("__q").alias("id"), F.col(column).alias("features")).dropDuplicates(["id"]), bank.select(F.col("bank_id").alias("id"), "features"), k)
    return named.drop(column).join(best.withColumnRenamed("id", "__q"), "__q").select(*keys, "rank", "bank_id", "sq_dist")


def _near_blocks(k: int):
    """Pairs of packed blocks to the k nearest of each query."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, q_ids, q_x, ids, x in zip(*(c.to_pylist() for c in b.columns)):
                bank_ids, y = np.frombuffer(ids, "<i8"), A.unpack(x, dim)
                by = np.argsort(bank_ids, kind="stable")
                i, d = top_k(A.unpack(q_x, dim), bank_ids[by], y[by], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(q_ids, "<i8"), i.shape[1])), pa.array(i.ravel()), pa.array(d.ravel())], names=["__q", "bank_id", "sq_dist"])

    return near


def patch_scores(knn: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the k squared distances."""
    return knn.groupBy(*keys).agg(F.avg("sq_dist").alias("score"))


def min_distance(points: DataFrame, pool: DataFrame, column: str = "features") -> DataFrame:
    """points' other columns and the Euclidean distance to the nearest row of the pool."""
    keys = [c for c in points.columns if c != column]
    return knn_join(points, pool, 1, column).select(*keys, F.sqrt("sq_dist").alias("distance"))


def self_distance(bank: DataFrame) -> DataFrame:
    """(bank_id, self_distance): the nearest other row of the bank; empty for fewer than two rows."""
    pairs = knn_join(bank.select(F.col("bank_id").alias("q"), "features"), bank, 2)
    other = pairs.where("q <> bank_id").groupBy("q").agg(F.min("sq_dist").alias("d"))
    return other.select(F.col("q").alias("bank_id"), F.sqrt("d").alias("self_distance"))


def support(bank: DataFrame, b: int) -> DataFrame:
    """(anchor_id, rank, nbr_id): the b nearest bank rows of each bank row, itself included."""
    pairs = knn_join(bank.select(F.col("bank_id").alias("anchor_id"), "features"), bank, b)
    return pairs.select("anchor_id", "rank", F.col("bank_id").alias("nbr_id"))


def _blocks_by(df: DataFrame, keys: list[str], id_: str, column: str, rows: int, prefix: str) -> DataFrame:
    """(keys, dim, <prefix>_ids, <prefix>_x): rows of each key packed in blocks of about ``rows``."""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    blk = F.pmod(F.xxhash64(id_), F.lit(-(-most // rows) or 1))
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("dim", T.IntegerType()), T.StructField(f"{prefix}_ids", T.BinaryType()), T.StructField(f"{prefix}_x", T.BinaryType())])

    def pack(t: pa.Table) -> pa.Table:
        x = A.matrix(t.column("__x"))
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([x.shape[1]], pa.int32()), pa.array([t.column("__id").to_numpy().astype("<i8").tobytes()]), pa.array([A.pack(x)])], names=[f.name for f in schema])

    return df.select(*keys, blk.alias("__blk"), F.col(id_).cast("long").alias("__id"), F.col(column).alias("__x")).groupBy(*keys, "__blk").applyInArrow(pack, schema)


def position_knn(queries: DataFrame, bank: DataFrame, position: list[str], k: int) -> DataFrame:
    """k nearest among the bank rows of the same position. Queries and bank rows of a position are packed in blocks of
    bounded size, pairs of blocks give partial top k, and these are merged, so a position is spread over tasks."""
    keys = [c for c in queries.columns if c != "features"]
    named = queries.withColumn("__q", F.xxhash64(*keys, "features"))
    left = _blocks_by(named, position, "__q", "features", QUERY_CHUNK, "q")
    right = _blocks_by(bank, position, "bank_id", "features", BANK_CHUNK, "b").drop("dim")
    pairs = left.join(right, position).select("dim", "q_ids", "q_x", "b_ids", "b_x").mapInArrow(_near_blocks(k), "__q long, bank_id long, sq_dist double")
    best = pairs.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy("sq_dist", "bank_id"))).where(F.col("rank") <= k)
    return named.drop("features").join(best, "__q").select(*keys, "rank", "bank_id", "sq_dist")


def grid_neighbours(cells: DataFrame, kernel: int, exclude_self: bool = False) -> DataFrame:
    """(row, col, nrow, ncol) within the kernel of each cell; a cell without any is its own.
    The offsets are generated, so the range join is an equi-join on the grid."""
    r = kernel // 2
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in range(-r, r + 1) for b in range(-r, r + 1) if not exclude_self or (a, b) != (0, 0)) or [F.struct(F.lit(0).alias("dr"), F.lit(0).alias("dc"))])
    grid = cells.select("row", "col").distinct()
    n = grid.select("row", "col", F.explode(offsets).alias("o")).select("row", "col", (F.col("row") + F.col("o.dr")).alias("nrow"), (F.col("col") + F.col("o.dc")).alias("ncol"))
    found = n.join(grid.select(F.col("row").alias("nrow"), F.col("col").alias("ncol")), ["nrow", "ncol"])
    alone = grid.join(found.select("row", "col").distinct(), ["row", "col"], "left_anti").select("row", "col", F.col("row").alias("nrow"), F.col("col").alias("ncol"))
    return found.select("row", "col", "nrow", "ncol").union(alone)


FAMILIES = {"nearest": {"bank_id", "features"}, "density": {"component_id", "weight", "mean", "variance"}, "local": {"row", "col", "bank_id", "features"}}


def bank_family(bank: DataFrame) -> str:
    """nearest, density or local, by the bank's columns; raises ValueError for others."""
    for name in ("local", "density", "nearest"):
        if FAMILIES[name] <= set(bank.columns):
            return name
    raise ValueError(f"no bank has the columns {bank.columns}")


def query_bank(queries: DataFrame, bank: DataFrame, k: int) -> DataFrame:
    """Neighbours, components or same-position neighbours of queries, as the bank's family asks."""
    family = bank_family(bank)
    if family == "density":
        from .scoring import density_join

        return density_join(queries, bank)
    return position_knn(queries, bank, ["row", "col"], k) if family == "local" else knn_join(queries, bank, k)


def materialize_bank(bank: DataFrame, self_distances: bool = False) -> DataFrame:
    """The bank, with ``self_distance`` where asked; that needs two rows or more."""
    if not self_distances:
        return bank
    if bank.limit(2).count() < 2:
        raise ValueError("self distances need two rows")
    return bank.join(self_distance(bank), "bank_id")
