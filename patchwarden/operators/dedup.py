"""Dedup of vectors, first row wins; membership in and difference from a pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import bround_vector
from ..sources.scratch import written
from .tolerance import first_within


def dedup_key(column: str, strategy: str = "exact_row", decimals: int = 6) -> Column:
    c = F.col(column)
    if strategy == "exact_row":
        return F.transform(c, lambda x: x + F.lit(0.0))
    if strategy == "quantized":
        return bround_vector(c, decimals)
    raise ValueError(f"no key for {strategy}")


def dedup_first(df: DataFrame, column: str, order: str, strategy: str = "exact_row", decimals: int = 6) -> DataFrame:
    """The first row by order of each key, all columns: an aggregate with map-side combine, so a
    key with many copies costs one row a task."""
    row = F.struct(*df.columns)
    return df.groupBy(dedup_key(column, strategy, decimals).alias("__k")).agg(F.min_by(row, order).alias("r")).select("r.*")


def dedup_tolerance(df: DataFrame, column: str, order: str, eps: float) -> DataFrame:
    """Rows that stay when each within eps of a kept earlier row goes, by a whole-number order. Equal vectors go first, in an
    aggregate with map-side combine, as what keeps or drops the first of them drops the others; the different ones are decided
    in parallel rounds (``tolerance``)."""
    once = written(dedup_first(df, column, order).withColumn("__rid", F.monotonically_increasing_id()), "tolerance-rows")
    kept = first_within(once, "__rid", column, order, eps)
    return once.join(kept, F.col("__rid") == F.col("rid"), "left_semi").select(*df.columns)


def in_pool(df: DataFrame, pool: DataFrame, column: str = "features", strategy: str = "exact_row", decimals: int = 6, eps: float = 0.0) -> DataFrame:
    return _against(df, pool, column, strategy, decimals, eps, True)


def not_in_pool(df: DataFrame, pool: DataFrame, column: str = "features", strategy: str = "exact_row", decimals: int = 6, eps: float = 0.0) -> DataFrame:
    return _against(df, pool, column, strategy, decimals, eps, False)


def _against(df: DataFrame, pool: DataFrame, column: str, strategy: str, decimals: int, eps: float, inside: bool) -> DataFrame:
    if strategy == "tolerance":
        from .knn import knn_join

        bank = pool.select(F.monotonically_increasing_id().alias("bank_id"), F.col(column).alias("features"))
        near = knn_join(df.withColumn("__x", F.col(column)), bank, 1, "__x")
        hit = F.sqrt("sq_dist") <= eps
        return near.where(hit if inside else ~hit).select(*df.columns)
    k = pool.select(dedup_key(column, strategy, decimals).alias("__k")).distinct()
    return df.withColumn("__k", dedup_key(column, strategy, decimals)).join(k, "__k", "left_semi" if inside else "left_anti").select(*df.columns)


def stable_top_k(df: DataFrame, score: str, order: str, k: int) -> DataFrame:
    """The k best rows, best first; ties by order."""
    return df.orderBy(F.desc(score), order).limit(k)
