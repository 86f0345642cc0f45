"""Ranking and threshold metrics of scored rows, by group or whole, as DataFrame aggregates.

Rows are first reduced to counts for each distinct score, so what is sorted is the number of
distinct scores. Undefined metrics are NaN."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import kernels as N
from ..sources.scratch import written

NAN = float("nan")


def binary_label(c: Column) -> Column:
    """1 for any value above 0."""
    return (c > 0).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def positive(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("int")


def confusion(df: DataFrame, label: str, score: str, threshold: Column | float, keys: list[str] | None = None) -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1, accuracy, balanced_accuracy)."""
    y, p = F.col(label) > 0, F.col(score) >= threshold
    n = lambda c: F.sum(c.cast("long"))
    counts = df.groupBy(*(keys or [])).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall = ratio(tp, tp + fn)
    return counts.select(
        *(keys or []), "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ((recall + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def by_score(df: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, score, pos, neg) with running totals tp, fp from the highest score down and the totals P and N.
    The ranking metrics take it as ``sweep``, so that several share one (persisted) table."""
    keys = keys or []
    y = F.col(label) > 0
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(y.cast("long")).alias("pos"), F.sum((~y).cast("long")).alias("neg"))
    return _running_totals(counts, keys)


def _same(keys: list[str], a: str, b: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def _ranged(counts: DataFrame, keys: list[str], buckets: int, least: int) -> DataFrame:
    """counts and ``range``: scores of a key with 1 / buckets of all rows or more (so there are buckets such keys at most) are cut into
    ranges at the key's own quantiles; those of other keys are one range."""
    total = counts.count()
    if total < least:
        return counts.withColumn("range", F.lit(0))
    heavy = counts.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= max(least, -(-total // buckets))).select(*keys, F.lit(1).alias("heavy"))
    rows = counts.alias("x").join(F.broadcast(heavy).alias("h"), _same(keys, "x", "h")).select("x.*")
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    x = counts.alias("x").join(F.broadcast(cuts).alias("c"), _same(keys, "x", "c"), "left").select("x.*", "c.cuts")
    return x.withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda v: F.col("score") > v)), F.lit(0))).drop("cuts")


def _running_totals(counts: DataFrame, keys: list[str] | None = None, buckets: int = 64, least: int = 1 << 14) -> DataFrame:
    """Running totals over the distinct scores of each key without a task that sorts all of a heavy key's: totals within each range of a key, and the
    sums of its ranges above."""
    keys = keys or []
    x = _ranged(written(counts, "scores"), keys, buckets, least)
    sums = x.groupBy(*keys, "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))  # buckets rows a key
    parts = keys or [F.lit(0)]
    above = Window.partitionBy(*parts).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    sums = sums.select(*keys, "range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("an"), F.sum("rp").over(whole).alias("P"), F.sum("rn").over(whole).alias("N"))
    down = Window.partitionBy(*keys, "range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    same = (F.col("x.range") == F.col("s.range")) & _same(keys, "x", "s")
    y = x.alias("x").join((sums if keys else F.broadcast(sums)).alias("s"), same).select("x.*", "s.ap", "s.an", "s.P", "s.N")
    return y.select(*keys, "score", "pos", "neg", (F.col("ap") + F.sum("pos").over(down)).alias("tp"), (F.col("an") + F.sum("neg").over(down)).alias("fp"), "P", "N")


def best_f1(df: DataFrame, label: str, score: str, keys: list[str] | None = None, sweep: DataFrame | None = None) -> DataFrame:
    """(keys, threshold, f1): the score whose ``>=`` predictions have the best F1, the highest of those
    within 1e-12 of it."""
    keys = keys or []
    s = (by_score(df, label, score, keys) if sweep is None else sweep).withColumn("f1", ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")))
    top = s.groupBy(*keys).agg(F.max("f1").alias("top"))
    near = s.join(top, keys) if keys else s.crossJoin(F.broadcast(top))  # one row
    return near.where(F.col("f1") >= F.col("top") - 1e-12).groupBy(*keys).agg(F.max("score").alias("threshold"), F.max_by("f1", "score").alias("f1"))


def threshold_for(df: DataFrame, label: str, score: str, policy: str = "best_f1", sweep: DataFrame | None = None) -> float:
    """0.5 for ``fixed_0_5`` and where there are no rows."""
    if policy == "fixed_0_5":
        return 0.5
    if policy != "best_f1":
        raise ValueError(f"unknown policy {policy}")
    r = best_f1(df, label, score, sweep=sweep).first()
    return 0.5 if r is None or r.threshold is None else float(r.threshold)


def auroc(df: DataFrame, label: str, score: str, keys: list[str] | None = None, sweep: DataFrame | None = None) -> DataFrame:
    """(keys, auroc): ties count half; NaN with one class."""
    keys = keys or []
    s = by_score(df, label, score, keys) if sweep is None else sweep
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    p, n = F.max("P"), F.max("N")
    return s.groupBy(*keys).agg(F.when((p > 0) & (n > 0), area / (p * n)).otherwise(F.lit(NAN)).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str, keys: list[str] | None = None, sweep: DataFrame | None = None) -> DataFrame:
    """(keys, average_precision): the sum of recall steps times precision; NaN with one class."""
    keys = keys or []
    s = by_score(df, label, score, keys) if sweep is None else sweep
    step = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    p, n = F.max("P"), F.max("N")
    return s.groupBy(*keys).agg(F.when((p > 0) & (n > 0), step / p).otherwise(F.lit(NAN)).alias("average_precision"))


def aupro(cells: DataFrame, max_fpr: float = 0.3, num_thresholds: int = 256) -> DataFrame:
    """One row (aupro) of cells (value double, weight double, normal long).

    Each region's pixels have weight 1 / its size, normal pixels weight 0 and normal 1. A pixel is
    put to the first of the thresholds, evenly spaced from the largest value down, that it
    reaches; running totals over the thresholds give overlap and false-positive rate. Points beyond
    max_fpr go, the overlap is made monotone along the rate (ties by threshold), and both ends are
    extended flat."""
    if not 0 < max_fpr <= 1 or num_thresholds < 8:
        raise ValueError("max_fpr must be in (0, 1] and num_thresholds 8 or more")
    r = cells.agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.sum("weight").alias("regions"), F.sum("normal").alias("normal"))
    x = cells.crossJoin(F.broadcast(r.select("hi", "lo")))  # one row
    steps = num_thresholds - 1
    # index of the first threshold hi - i * (hi - lo) / steps that is not above the value
    value_of = lambda i: F.when(i == steps, F.col("lo")).otherwise(F.col("hi") + i * ((F.col("lo") - F.col("hi")) / steps))
    guess = F.when(F.col("hi") > F.col("lo"), F.ceil((F.col("hi") - F.col("value")) / (F.col("hi") - F.col("lo")) * steps)).otherwise(0).cast("int")
    g = F.least(F.greatest(guess, F.lit(0)), F.lit(steps))
    x = x.withColumn("g", g)
    x = x.withColumn("i", F.when((F.col("g") > 0) & (F.col("value") >= value_of(F.col("g") - 1)), F.col("g") - 1).when(F.col("value") < value_of(F.col("g")), F.col("g") + 1).otherwise(F.col("g")))
    h = x.groupBy("i").agg(F.sum("weight").alias("w"), F.sum("normal").alias("n"))
    grid = cells.sparkSession.range(num_thresholds).select(F.col("id").cast("int").alias("i"))
    h = grid.join(h, "i", "left").fillna(0).crossJoin(F.broadcast(r.select("regions", "normal")))
    up = Window.partitionBy(F.lit(0)).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # num_thresholds rows
    c = h.select("i", "regions", "normal", (F.sum("w").over(up) / F.col("regions")).alias("pro"), (F.sum("n").over(up) / F.col("normal")).alias("fpr")).where(F.col("fpr") <= max_fpr)
    along = Window.partitionBy(F.lit(0)).orderBy("fpr", "i")
    c = c.withColumn("pro", F.max("pro").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.select("pro", "fpr", "i", F.lag("pro").over(along).alias("p0"), F.lag("fpr").over(along).alias("f0"))
    piece = F.when(F.col("f0").isNull(), F.col("pro") * F.col("fpr")).otherwise((F.col("fpr") - F.col("f0")) * (F.col("pro") + F.col("p0")) / 2)
    last = F.max_by("pro", F.struct("fpr", "i"))
    area = c.agg((F.sum(piece) + last * (max_fpr - F.max("fpr"))).alias("a"))
    return r.crossJoin(F.broadcast(area)).select(F.when((F.col("regions") > 0) & (F.col("normal") > 0) & F.col("a").isNotNull(), F.col("a") / max_fpr).otherwise(F.lit(NAN)).alias("aupro"))


def pixel_cells(maps: DataFrame, score_map: str, mask: str, height: int, width: int) -> DataFrame:
    """(value, weight, normal) of every pixel of score maps and masks (flat, row-major), reduced in each
    batch to distinct values; regions are 4-connected and labelled image by image."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = A.matrix(b.column(0))
            m = A.matrix(b.column(1)).reshape(-1, height, width) > 0
            weight = np.zeros(v.shape)
            for i in range(len(m)):
                if m[i].any():
                    label = N.regions(m[i]).ravel()
                    size = np.bincount(label)
                    weight[i] = np.where(label > 0, 1 / np.maximum(size[label], 1), 0)
            u, inv = np.unique(v.ravel(), return_inverse=True)
            normal = np.bincount(inv, (~m).ravel(), len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(inv, weight.ravel(), len(u))), pa.array(normal)], names=["value", "weight", "normal"])

    return maps.select(score_map, mask).mapInArrow(cells, "value double, weight double, normal long")


def image_cells(df: DataFrame, label: str, score: str) -> DataFrame:
    """aupro's input for whole images: each anomalous one is a region of its own."""
    y = F.col(label) > 0
    return df.select(F.col(score).cast("double").alias("value"), y.cast("double").alias("weight"), (~y).cast("long").alias("normal"))


def metric_row(df: DataFrame, label: str, score: str, keys: list[str], threshold: float, prefix: str = "image") -> DataFrame:
    """(keys, n, n_anomalous, confusion metrics, best F1, AUROC, AP) for each group: one sweep, written, and two aggregates of it."""
    s = written(by_score(df, label, score, keys).withColumn("f1", ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P"))), "sweep")
    over = F.col("score") >= threshold
    p, n = F.max("P"), F.max("N")
    both = (p > 0) & (n > 0)
    one = s.groupBy(*keys).agg(
        (p + n).alias("num_images"), p.alias("num_anomalous_images"), F.when(both, F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / (p * n)).otherwise(F.lit(NAN)).alias("auroc"),
        F.when(both, F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))) / p).otherwise(F.lit(NAN)).alias("average_precision"),
        F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.max("f1").alias("top"),
    )
    near = s.alias("s").join(one.select(*keys, "top").alias("o"), _same(keys, "s", "o")).where(F.col("s.f1") >= F.col("o.top") - 1e-12).select("s.*")
    best = near.groupBy(*keys).agg(F.max("score").alias("threshold"), F.max_by("f1", "score").alias("best_f1"))
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("num_anomalous_images") - F.col("tp"), F.col("num_images") - F.col("num_anomalous_images") - F.col("fp")
    recall = ratio(tp, tp + fn)
    joined = one.alias("o").join(best.alias("b"), _same(keys, "o", "b")).select("o.*", "b.threshold", "b.best_f1")
    measured = {
        "auroc": F.col("auroc"), "average_precision": F.col("average_precision"), "threshold": F.col("threshold"), "best_f1": F.col("best_f1"), "tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": ratio(tp, tp + fp), "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (recall + ratio(tn, tn + fp)) / 2,
    }
    return joined.select(*keys, "num_images", "num_anomalous_images", *(c.alias(f"{prefix}_{k}") for k, c in measured.items()))


def with_mean(rows: DataFrame, key: str, label: str = "MEAN") -> DataFrame:
    """rows and one more: the mean of every numeric column without its NaNs."""
    number = [f.name for f in rows.schema if f.name != key and f.dataType.typeName() in ("double", "float", "long", "integer", "short")]
    cast = rows.select(F.col(key).cast("string").alias(key), *(F.col(c).cast("double").alias(c) for c in number))
    mean = cast.agg(*(F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in number)).select(F.lit(label).alias(key), *number)
    return cast.union(mean)


def map_rows(maps: DataFrame, score_map: str, mask: str, threshold: float) -> DataFrame:
    """maps' other columns with per-image pixel ratios, maximum and mean of the map."""
    keys = [c for c in maps.columns if c not in (score_map, mask)]
    share = lambda c, f: F.size(F.filter(c, f)) / F.size(c)
    return maps.select(
        *keys, share(F.col(mask), lambda v: v > 0).alias("pixel_gt_positive_ratio"), share(F.col(score_map), lambda v: v >= threshold).alias("pixel_pred_positive_ratio"),
        F.array_max(score_map).alias("pixel_map_max"), (F.aggregate(score_map, F.lit(0.0), lambda s, v: s + v) / F.size(score_map)).alias("pixel_map_mean"),
    )
