"""Named plugins of the fit pipeline, and scalar kernels for SQL text.

A bank builder takes (vectors with batch, seq and features, configuration, size) and returns
(bank_id, features); it names the contracts it supports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import coreset as B
from ..operators import tail as T

_banks: dict[str, tuple[tuple[str, ...], Callable]] = {}


def register_bank(name: str, contracts: tuple[str, ...], build: Callable[[DataFrame, object, int], DataFrame]) -> None:
    if name in _banks:
        raise ValueError(f"{name} is registered already")
    if not set(contracts) <= {"OFFLINE", "STREAMING"}:
        raise ValueError("contracts are OFFLINE and STREAMING")
    _banks[name] = (contracts, build)


def check_bank(name: str, contract: str) -> None:
    if name not in _banks:
        raise ValueError(f"unknown bank {name}")
    if contract not in _banks[name][0]:
        raise ValueError(f"{name} does not support {contract}")


def build_bank(z: DataFrame, config, n: int, telemetry: dict[str, int] | None = None) -> DataFrame:
    """The bank; telemetry is filled by builders that report what they selected from."""
    check_bank(config.bank, config.contract)
    build = _banks[config.bank][1]
    return build(z, config, n) if build.__code__.co_argcount < 4 else build(z, config, n, telemetry)


register_bank("kcenter", ("STREAMING",), lambda z, c, n: B.merge_reduce(z, "features", "batch", "seq", n, c.chunk))
register_bank("budgeted", ("STREAMING",), lambda z, c, n: B.budgeted_kcenter(z, "features", "seq", n, c.threshold))
register_bank("tail_aware", ("STREAMING",), lambda z, c, n, seen: T.tail_aware_bank(z, "features", "batch", "seq", c.tail, seen))
register_bank("greedy", ("OFFLINE",), lambda z, c, n: B.greedy(z, "features", "seq", c.coreset_share, seed=c.seed))
register_bank("kmeans", ("OFFLINE", "STREAMING"), lambda z, c, n: B.kmeans(z, "features", n, c.seed) if c.contract == "OFFLINE" else B.minibatch_kmeans(z, "features", "seq", n, seed=c.seed))


def register_functions(spark: SparkSession) -> list[str]:
    """SQL functions over array<double>: sq_dist(a, b) and sq_norm(a). They are SQL bodies, so
    Catalyst inlines them."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sq_dist(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sq_norm(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(a, 0D, (s, x) -> s + x * x)")
    return ["sq_dist", "sq_norm"]
