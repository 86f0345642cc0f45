"""From patches to images: maxima, soft and mass-based means, and support reweighting.

Patch tables have (image_idx, patch_pos, score); kNN tables have (image_idx, patch_pos, rank,
bank_id, sq_dist). Every score is a composition of window and aggregate functions keyed by image."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrow as A
from ..functions.vectors import sq_dist
from ..sources.scratch import written
from . import knn as J

MIN_VARIANCE = 1e-12


def _image():
    return Window.partitionBy("image_idx")


def unpatch(patches: DataFrame, column: str = "score") -> DataFrame:
    """(image_idx, scores): an image's patch scores in position order."""
    pairs = F.array_sort(F.collect_list(F.struct("patch_pos", column)))
    return patches.groupBy("image_idx").agg(pairs.alias("p")).select("image_idx", F.col(f"p.{column}").alias("scores"))


def image_max(patches: DataFrame) -> DataFrame:
    return patches.groupBy("image_idx").agg(F.max("score").alias("score"))


def first_neighbours(knn: DataFrame) -> DataFrame:
    """(image_idx, patch_pos, score, bank_id) of each patch's nearest bank row."""
    return knn.where("rank = 1").select("image_idx", "patch_pos", F.col("sq_dist").alias("score"), "bank_id")


def _ranked(patches: DataFrame) -> DataFrame:
    return patches.withColumn("r", F.row_number().over(_image().orderBy(F.desc("score"), "patch_pos")))


def top_k_candidates(patches: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """The k best patches of each image with their softmax weights."""
    if k < 1 or temperature <= 0:
        raise ValueError("k and temperature must be positive")
    top = _ranked(patches).where(F.col("r") <= k)
    e = F.exp((F.col("score") - F.max("score").over(_image())) / temperature)
    return top.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(_image())).drop("e")


def top_k_soft(patches: DataFrame, k: int = 5, temperature: float = 1.0) -> DataFrame:
    return top_k_candidates(patches, k, temperature).groupBy("image_idx").agg(F.sum(F.col("weight") * F.col("score")).alias("score"))


def top_p_candidates(patches: DataFrame, p: float = 0.9, max_k: int = 32) -> DataFrame:
    """Best patches up to the first whose cumulative share of the positive mass reaches p, at most max_k;
    one where there is no mass. The chosen scores themselves are not clipped."""
    if not 0 < p <= 1 or max_k < 1:
        raise ValueError("p must be in (0, 1] and max_k positive")
    mass = F.greatest("score", F.lit(0.0))
    before = F.coalesce(F.sum("mass").over(_image().orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = _ranked(patches).withColumn("mass", mass).withColumn("total", F.sum("mass").over(_image())).withColumn("before", before)
    chosen = F.when(F.col("total") > 0, (F.col("before") / F.col("total") < p) & (F.col("r") <= max_k)).otherwise(F.col("r") == 1)
    return x.where(chosen | (F.col("r") == 1)).drop("mass", "total", "before")


def top_p_mean(patches: DataFrame, p: float = 0.9, max_k: int = 32) -> DataFrame:
    return top_p_candidates(patches, p, max_k).groupBy("image_idx").agg(F.avg("score").alias("score"))


def eq7_candidates(candidates: DataFrame, features: DataFrame, bank: DataFrame, b: int = 9) -> DataFrame:
    """candidates (image_idx, patch_pos, score, bank_id, ...) with ``eq7`` = w * score.

    The support of a candidate are the b bank rows nearest to its neighbour, which is one of
    them; w = 1 - exp(score - m) / sum(exp(d - m)) over their squared distances d to the patch, m
    the largest, clipped to [0, 1]. With b <= 1, or without a finite denominator, the score stays."""
    if b <= 1:
        return candidates.withColumn("eq7", F.col("score"))
    near = J.support(bank, b).select(F.col("anchor_id").alias("bank_id"), "nbr_id")
    key = ["image_idx", "patch_pos"]
    x = candidates.select(*key, "score", "bank_id").join(features.select(*key, F.col("features").alias("__x")), key).join(near, "bank_id")
    x = x.join(bank.select(F.col("bank_id").alias("nbr_id"), F.col("features").alias("__m")), "nbr_id").withColumn("d", sq_dist(F.col("__m"), F.col("__x"))).drop("__x", "__m")
    m = x.groupBy(*key).agg(F.max("score").alias("s"), F.collect_list("d").alias("d")).withColumn("m", F.array_max("d"))
    den = F.aggregate(F.transform("d", lambda v: F.exp(v - F.col("m"))), F.lit(0.0), lambda a, v: a + v)
    w = m.withColumn("den", den).select(*key, _weight(F.col("s"), F.col("m"), F.col("den")).alias("__w"), F.col("den").alias("__den"))
    out = candidates.join(w, key, "left")
    usable = F.col("__den").isNotNull() & (F.col("__den") > 0) & (F.col("__den") < float("inf")) & ~F.isnan("__den")
    return out.withColumn("eq7", F.when(usable, F.col("__w") * F.col("score")).otherwise(F.col("score"))).drop("__w", "__den")


def _weight(s: Column, m: Column, den: Column) -> Column:
    return F.least(F.greatest(1 - F.exp(s - m) / den, F.lit(0.0)), F.lit(1.0))


def eq7_image(knn: DataFrame, features: DataFrame, bank: DataFrame, b: int = 9) -> DataFrame:
    """The best patch (ties: the lowest position), reweighted."""
    best = _ranked(first_neighbours(knn)).where("r = 1").drop("r")
    return eq7_candidates(best, features, bank, b).select("image_idx", "patch_pos", F.col("eq7").alias("score"))


def eq7_top_k_soft(knn: DataFrame, features: DataFrame, bank: DataFrame, b: int = 9, k: int = 5, temperature: float = 1.0) -> DataFrame:
    c = eq7_candidates(top_k_candidates(first_neighbours(knn), k, temperature), features, bank, b)
    return c.groupBy("image_idx").agg(F.sum(F.col("weight") * F.col("eq7")).alias("score"))


def eq7_top_p_mean(knn: DataFrame, features: DataFrame, bank: DataFrame, b: int = 9, p: float = 0.9, max_k: int = 32) -> DataFrame:
    c = eq7_candidates(top_p_candidates(first_neighbours(knn), p, max_k), features, bank, b)
    return c.groupBy("image_idx").agg(F.avg("eq7").alias("score"))


def position_prior(labels: DataFrame) -> DataFrame:
    """(row, col, bank_id, prior): shares of the prototypes at each position of the training images."""
    n = labels.groupBy("row", "col", "bank_id").agg(F.count("*").alias("n"))
    return n.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy("row", "col"))).drop("n")


def pni_gate(patches: DataFrame, knn: DataFrame, bank: DataFrame, prior: DataFrame, kernel: int = 3, exclude_self: bool = True, gamma: float = 0.5, threshold: float = 0.01, scale: float = 1.0) -> DataFrame:
    """Distance to the nearest eligible prototype, else to the nearest of all, times scale.

    patches: (image_idx, patch_pos, row, col, features). A prototype is eligible where gamma *
    position prior + (1 - gamma) * its share among the nearest prototypes of the patch's
    neighbours reaches the threshold. Only prototypes with some prior can, if the threshold is
    positive; with threshold 0 all are eligible."""
    nearest = first_neighbours(knn).select("image_idx", "patch_pos", F.col("score").alias("g"))
    if threshold <= 0:
        return nearest.select("image_idx", "patch_pos", (scale * F.col("g")).alias("score"))
    label = patches.select("image_idx", "patch_pos", "row", "col").join(first_neighbours(knn).drop("score"), ["image_idx", "patch_pos"])
    near = J.grid_neighbours(patches, kernel, exclude_self)
    votes = near.join(label.select("image_idx", F.col("row").alias("nrow"), F.col("col").alias("ncol"), "bank_id"), ["nrow", "ncol"])
    hood = votes.groupBy("image_idx", "row", "col", "bank_id").agg(F.count("*").alias("n"))
    hood = hood.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("image_idx", "row", "col")))
    known = hood.join(prior, ["row", "col", "bank_id"], "left").withColumn("mixed", gamma * F.coalesce("prior", F.lit(0.0)) + (1 - gamma) * F.col("share"))
    # without a share the prior alone must reach the threshold: priors of a position add up to 1, so gamma / threshold prototypes can at most
    heavy = prior.where(gamma * F.col("prior") >= threshold).select("row", "col", "bank_id")
    alone = patches.select("image_idx", "row", "col").join(F.broadcast(heavy) if gamma / threshold <= 256 else heavy, ["row", "col"])
    key = ["image_idx", "row", "col", "bank_id"]
    eligible = known.where(F.col("mixed") >= threshold).select(*key).union(alone.select(*key)).distinct()
    d = patches.join(eligible, ["image_idx", "row", "col"]).join(bank.select("bank_id", F.col("features").alias("__m")), "bank_id")
    best = d.groupBy("image_idx", "patch_pos").agg(F.min(sq_dist(F.col("features"), F.col("__m"))).alias("e"))
    return nearest.join(best, ["image_idx", "patch_pos"], "left").select("image_idx", "patch_pos", (scale * F.coalesce("e", "g")).alias("score"))


def log_weights(components: DataFrame) -> DataFrame:
    """components (component_id, weight, mean, variance) with the log of their share, and with floors."""
    total = components.agg(F.sum("weight")).first()[0]
    share = F.col("weight") / F.lit(float(total or 0))
    return components.withColumn("log_weight", F.log(F.greatest(share, F.lit(MIN_VARIANCE)))).withColumn("variance", F.transform("variance", lambda v: F.greatest(v, F.lit(MIN_VARIANCE))))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _log_prob(x: np.ndarray, mean: np.ndarray, variance: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """Logs of weighted diagonal Gaussians (rows x components), from exact differences in bounded pieces."""
    out = np.empty((len(x), len(mean)))
    base = log_weight - 0.5 * (np.log(variance).sum(1) + x.shape[1] * math.log(2 * math.pi))
    step = max(1, PIECE // mean.size)
    for a in range(0, len(x), step):
        d = x[a : a + step, None, :] - mean[None]
        out[a : a + step] = base - 0.5 * np.einsum("qcd,cd->qc", d * d, 1 / variance)
    return out


#: numbers of a piece of differences
PIECE = 1 << 22


def density_join(queries: DataFrame, components: DataFrame, bank_bytes: int = J.BANK_BYTES) -> DataFrame:
    """queries' other columns, component_id, log_prob, with distance = -log_prob, of all components. A mixture within
    bank_bytes (checked) is sent to every worker; a larger one is cut into blocks that the queries meet one by one."""
    keys = [c for c in queries.columns if c != "features"]
    c = log_weights(components)
    n, size = c.agg(F.count("*"), F.coalesce(F.sum(F.size("mean").cast("long") * 2 + 2), F.lit(0))).first()
    if not n:
        raise ValueError("the mixture has no components")
    parts = -(-size * 8 // bank_bytes)
    out = None
    for i in range(parts):  # as many passes as the mixture has blocks
        part = c if parts == 1 else c.where(F.pmod(F.xxhash64("component_id"), F.lit(parts)) == i)
        one = _density_block(queries, part, keys)
        out = one if out is None else out.unionByName(one)
    return out


def _density_block(queries: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    t = components.select(F.col("component_id").cast("long").alias("component_id"), "mean", "variance", "log_weight").toArrow().sort_by("component_id")
    shared = queries.sparkSession.sparkContext.broadcast((t.column("component_id").to_numpy(), *(A.matrix(t.column(k)) for k in ("mean", "variance")), t.column("log_weight").to_numpy()))
    schema = T.StructType([*(queries.schema[k] for k in keys), *(T.StructField(k, v()) for k, v in (("component_id", T.LongType), ("log_prob", T.DoubleType), ("distance", T.DoubleType)))])

    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mean, variance, log_weight = shared.value
        for b in batches:
            if b.num_rows and len(ids):
                lp = _log_prob(A.matrix(b.column(len(keys))), mean, variance, log_weight)
                take = pa.array(np.repeat(np.arange(b.num_rows), len(ids)))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keys))), pa.array(np.tile(ids, b.num_rows)), pa.array(lp.ravel()), pa.array(-lp.ravel())], names=[f.name for f in schema])

    return queries.select(*keys, "features").mapInArrow(density, schema)


def best_components(x: np.ndarray, ids: np.ndarray, mean: np.ndarray, variance: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(component, distance) of each row's nearest component by -log of its weighted density, ties to the lowest id, and how many pairs were evaluated. A component's distance
    is at least that with its largest variance in all directions, which needs only the distance to its mean: those whose bound is above the exact distance to the component
    of the lowest bound are left out."""
    base = log_weight - 0.5 * (np.log(variance).sum(1) + x.shape[1] * math.log(2 * math.pi))
    inverse, wide, mm = 1 / variance, 0.5 / variance.max(1), (mean * mean).sum(1)
    out, dist, pairs = np.empty(len(x), ids.dtype), np.empty(len(x)), 0

    def exact(q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d, step = np.empty(len(i)), max(1, PIECE // mean.shape[1])
        for a in range(0, len(i), step):
            at = slice(a, a + step)
            d[at] = 0.5 * np.einsum("pd,pd->p", (q[i[at]] - mean[j[at]]) ** 2, inverse[j[at]])
        return d - base[j]

    for a in range(0, len(x), step := max(1, PIECE // len(mean))):
        q = x[a : a + step]
        qq = (q * q).sum(1)[:, None]
        bound = wide * np.maximum(qq + mm - 2 * q @ mean.T - 1e-9 * (qq + mm), 0) - base
        every = np.arange(len(q))
        known = exact(q, every, np.argmin(bound, 1))
        i, j = np.nonzero(bound <= (known + 1e-9 * (1 + np.abs(known)))[:, None])
        d = exact(q, i, j)
        by = np.lexsort((ids[j], d, i))
        first = by[np.searchsorted(i[by], every)]
        out[a : a + len(q)], dist[a : a + len(q)] = ids[j[first]], d[first]
        pairs += len(q) + len(i)
    return out, dist, pairs


def best_component(queries: DataFrame, components: DataFrame, bank_bytes: int = J.BANK_BYTES) -> DataFrame:
    """queries' other columns, component_id, distance of the nearest component alone: one row a query leaves a block of the mixture, whatever the number of its
    components. A mixture beyond bank_bytes (checked) comes in blocks, whose best ones are compared."""
    keys = [c for c in queries.columns if c != "features"]
    c = log_weights(components)
    n, size = c.agg(F.count("*"), F.coalesce(F.sum(F.size("mean").cast("long") * 2 + 2), F.lit(0))).first()
    if not n:
        raise ValueError("the mixture has no components")
    parts = -(-size * 8 // bank_bytes)
    out = None
    for i in range(parts):
        part = c if parts == 1 else c.where(F.pmod(F.xxhash64("component_id"), F.lit(parts)) == i)
        one = _best_block(queries, part, keys)
        out = one if out is None else out.unionByName(one)
    if parts == 1:
        return out
    return out.groupBy(*keys).agg(F.min(F.struct("distance", "component_id")).alias("m")).select(*keys, "m.component_id", "m.distance")


def _best_block(queries: DataFrame, components: DataFrame, keys: list[str]) -> DataFrame:
    t = components.select(F.col("component_id").cast("long").alias("component_id"), "mean", "variance", "log_weight").toArrow().sort_by("component_id")
    shared = queries.sparkSession.sparkContext.broadcast((t.column("component_id").to_numpy(), *(A.matrix(t.column(k)) for k in ("mean", "variance")), t.column("log_weight").to_numpy()))
    schema = T.StructType([*(queries.schema[k] for k in keys), T.StructField("component_id", T.LongType()), T.StructField("distance", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and len(shared.value[0]):
                ids, d, _ = best_components(A.matrix(b.column(len(keys))), *shared.value)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(ids), pa.array(d)], names=[f.name for f in schema])

    return queries.select(*keys, "features").mapInArrow(best, schema)


def pair_density(pairs: DataFrame) -> DataFrame:
    """pairs (features, mean, variance, log_weight and other columns) to their other columns and distance = -log_prob: one component a row."""
    keys = [c for c in pairs.columns if c not in ("features", "mean", "variance", "log_weight")]
    schema = T.StructType([*(pairs.schema[k] for k in keys), T.StructField("distance", T.DoubleType())])

    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, m, v = (A.matrix(b.column(len(keys) + i)) for i in range(3))
                d = 0.5 * (((x - m) ** 2 / v).sum(1) + np.log(v).sum(1) + x.shape[1] * math.log(2 * math.pi)) - b.column(len(keys) + 3).to_numpy()
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(d)], names=[f.name for f in schema])

    return pairs.select(*keys, "features", "mean", "variance", "log_weight").mapInArrow(density, schema)


def bhattacharyya(components: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(anchor_id, component_id, distance) of diagonal Gaussians; an anchor's distance to itself is -1. anchors: a table of anchor_id to which anchors are confined."""
    c = log_weights(components)
    some = c if anchors is None else c.join(anchors.select(F.col("anchor_id").alias("component_id")).distinct(), "component_id", "left_semi")
    a = some.select(F.col("component_id").alias("anchor_id"), F.col("mean").alias("am"), F.col("variance").alias("av"))
    mid = F.zip_with("av", "variance", lambda p, q: (p + q) / 2)
    mean_term = _sum(F.zip_with(F.zip_with("am", "mean", lambda p, q: (p - q) * (p - q)), mid, lambda d, v: d / F.greatest(v, F.lit(MIN_VARIANCE)))) / 8
    logs = lambda v: _sum(F.transform(v, lambda x: F.log(x)))
    det_term = (logs(mid) - (logs(F.col("av")) + logs(F.col("variance"))) / 2) / 2
    d = F.when(F.col("anchor_id") == F.col("component_id"), F.lit(-1.0)).otherwise(mean_term + det_term)
    return a.crossJoin(c).select("anchor_id", "component_id", d.alias("distance"))  # all pairs of anchors and components are its result


def density_eq7(patches: DataFrame, components: DataFrame, b: int = 9) -> DataFrame:
    """Images scored by the mixture: the patch with the largest -log of its best component, reweighted
    over the b components nearest to that one. patches: (image_idx, patch_pos, features)."""
    best = best_component(patches.select("image_idx", "patch_pos", "features"), components).select("image_idx", "patch_pos", F.col("distance").alias("score"), F.col("component_id").alias("anchor_id"))
    top = written(_ranked(best).where("r = 1").drop("r"), "density-top")  # a patch an image
    if b <= 1:
        return top.select("image_idx", "patch_pos", "score")
    w = Window.partitionBy("anchor_id").orderBy("distance", "component_id")
    near = bhattacharyya(components, top).withColumn("o", F.row_number().over(w)).where(F.col("o") <= b).select("anchor_id", "component_id", "o")
    met = top.join(patches.select("image_idx", "patch_pos", "features"), ["image_idx", "patch_pos"]).join(near, "anchor_id")  # b rows an image
    s = pair_density(met.join(log_weights(components).select(F.col("component_id").cast("long").alias("component_id"), "mean", "variance", "log_weight"), "component_id"))
    g = s.groupBy("image_idx", "patch_pos").agg(F.max("score").alias("score"), F.max("distance").alias("m"), F.collect_list("distance").alias("ds"), F.max(F.when(F.col("o") == 1, F.col("distance"))).alias("a"), F.count("*").alias("n"))
    den = _sum(F.transform("ds", lambda v: F.exp(v - F.col("m"))))
    return g.withColumn("w", F.when(F.col("n") > 1, _weight(F.col("a"), F.col("m"), den)).otherwise(1.0)).select("image_idx", "patch_pos", (F.col("w") * F.col("score")).alias("score"))
