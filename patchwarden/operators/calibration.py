"""Score calibration against the scores of training images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("none", "zscore", "ecdf")


def check_mode(mode: str, contract: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown calibration {mode}")
    if mode == "ecdf" and contract == "STREAMING":
        raise ValueError("ecdf calibration keeps all training scores; a stream cannot")


def zscore(df: DataFrame, train: DataFrame, score: str, eps: float = 1e-12, out: str = "calibrated") -> DataFrame:
    """(x - mean) / max(population deviation, eps) of the training scores."""
    m = train.agg(F.avg(score).alias("__m"), F.greatest(F.stddev_pop(score), F.lit(eps)).alias("__s"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, (F.col(score) - F.col("__m")) / F.col("__s")).drop("__m", "__s")  # one row


def ecdf(df: DataFrame, train: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """Share of training scores up to and with x. Ranks come from one running total over ranges of
    scores; scores below all of training get 0."""
    from .metrics import _running_totals

    n = train.where(F.col(score).isNotNull()).agg(F.count("*").alias("__n"))
    points = train.where(F.col(score).isNotNull()).select((-F.col(score)).alias("score"), F.lit(1).alias("pos")).union(df.where(F.col(score).isNotNull()).select(-F.col(score), F.lit(0))).groupBy("score").agg(F.sum("pos").alias("pos"))
    ranks = _running_totals(points.withColumn("neg", F.lit(0))).select((-F.col("score")).alias("__x"), F.col("tp").alias("__r"))
    x = df.join(ranks, F.col(score) == F.col("__x"), "left").crossJoin(F.broadcast(n))  # one row
    return x.withColumn(out, F.col("__r") / F.col("__n")).drop("__x", "__r", "__n")


def self_ecdf(df: DataFrame, score: str, keys: list[str] | None = None, out: str = "calibrated") -> DataFrame:
    """ecdf of rows against their own group; null scores stay null. Ranks come from running totals over ranges of
    scores, so a group is spread over tasks."""
    from .metrics import _running_totals

    keys = keys or []
    points = df.where(F.col(score).isNotNull()).groupBy(*keys, (-F.col(score)).alias("score")).agg(F.count("*").alias("pos")).withColumn("neg", F.lit(0))
    ranks = _running_totals(points, keys).select(*(F.col(k).alias(f"__{k}") for k in keys), (-F.col("score")).alias("__x"), (F.col("tp") / F.col("P")).alias(out))
    same = F.col(score) == F.col("__x")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.drop(out).join(ranks, same, "left").drop("__x", *(f"__{k}" for k in keys))
