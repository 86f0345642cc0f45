"""Analytics over finished runs: resource and phase aggregates, summary, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("fit", "calibration", "infer", "total")


def resource_aggregates(samples: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """(keys, max_<s>, mean_<s>); NaN readings do not count."""
    clean = {s: F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")) for s in series}
    return samples.groupBy(*keys).agg(*(f(clean[s]).alias(f"{n}_{s}") for s in series for n, f in (("max", F.max), ("mean", F.avg))))


def phase_pivot(timings: DataFrame, keys: list[str], phases: tuple[str, ...] = PHASES, phase: str = "phase", duration: str = "duration_s") -> DataFrame:
    """(keys, time_<phase>_s): sums; a missing total is NaN, another missing phase 0."""
    wide = timings.groupBy(*keys).pivot(phase, list(phases)).agg(F.sum(duration))
    return wide.select(*keys, *(F.coalesce(F.col(f"`{p}`"), F.lit(float("nan") if p == "total" else 0.0)).alias(f"time_{p}_s") for p in phases))


def run_metrics(rows: DataFrame, run: list[str], metrics: list[str], dataset: str = "dataset") -> DataFrame:
    """(run, metrics, from_mean): the MEAN row of each run, else the mean of its other rows without NaN."""
    is_mean = F.col(dataset) == "MEAN"
    clean = lambda m: F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
    agg = [F.max(is_mean.cast("int")).alias("__has")] + [f.alias(a) for m in metrics for a, f in ((f"__m_{m}", F.first(F.when(is_mean, F.col(m).cast("double")), True)), (f"__a_{m}", F.avg(F.when(~is_mean, clean(m)))))]
    x = rows.groupBy(*run).agg(*agg)
    pick = lambda m: F.coalesce(F.when(F.col("__has") == 1, F.col(f"__m_{m}")).otherwise(F.col(f"__a_{m}")), F.lit(float("nan")))
    return x.select(*run, *(pick(m).alias(m) for m in metrics), (F.col("__has") == 1).alias("from_mean"))


def summary_table(parts: list[DataFrame]) -> DataFrame:
    """Runs of all parts, their columns united; experiment ascending, newest first, directory ascending."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("experiment", F.desc("timestamp"), "run_dir")


def leaderboard(summary: DataFrame, metrics: list[str], k: int = 10, ids: list[str] | None = None) -> DataFrame:
    """(metric, rank, ids, value): the k best runs with status ok of each metric."""
    ids = ids or ["run_dir"]
    long = summary.where("status = 'ok'").unpivot(ids, metrics, "metric", "value").where("value IS NOT NULL AND NOT isnan(value)")
    w = Window.partitionBy("metric").orderBy(F.desc("value"), *ids)
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("metric", "rank", *ids, "value")


def fastest_slowest(summary: DataFrame, column: str, k: int = 5, ids: list[str] | None = None) -> DataFrame:
    """(kind, rank, ids, value): two top-k selections of the runs with status ok."""
    ids = ids or ["run_dir"]
    x = summary.where(f"status = 'ok' AND {column} IS NOT NULL AND NOT isnan({column})").select(*ids, F.col(column).alias("value"))
    both = []
    for kind, order in (("fastest", F.asc("value")), ("slowest", F.desc("value"))):
        top = x.orderBy(order, *ids).limit(k)
        both.append(top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, *ids)).alias("rank"), *ids, "value"))
    return both[0].union(both[1])


def phase_map(timings: DataFrame, keys: list[str], phase: str = "phase", duration: str = "duration_s") -> DataFrame:
    """(keys, phases): a map of each phase to its summed duration."""
    sums = timings.groupBy(*keys, phase).agg(F.sum(duration).alias("d"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(phase, "d")))).alias("phases"))
