"""The query catalogue: every operator applied to the driver's tables, whole.

Vectors of ``embeddings`` play the patches: 25 neighbouring rows are an image of 5 x 5 patches,
the mean patch of every image is a prototype of the bank, and each vector read as 8 x 8 is
a score map. Documents with their labels play scored images, events the timings and samples of runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import calibration as CA
from ..operators import coreset as B
from ..operators import dedup as D
from ..operators import knn as J
from ..operators import metrics as M
from ..operators import moments as MO
from ..operators import reduction as R
from ..operators import scoring as C
from ..operators import segmentation as G
from ..operators import summary as S
from ..operators import tail as T
from ..operators import whitening as W
from ..sources.scratch import written
from ..sources.tables import read_table

DIM = 64
_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _registry[f.__name__] = f
    return f


def catalogue() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


def r6(c: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# --- inputs ---------------------------------------------------------------------------------


def patches(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.selectExpr("vec_id", "vec_id div 25 AS image_idx", "vec_id % 25 AS patch_pos", "(vec_id % 25) div 5 AS row", "vec_id % 5 AS col", "vec_id div 64 AS batch", "label", "cast(embedding AS array<double>) AS features")


def prototypes(spark: SparkSession, sf: str, group: str = "image_idx") -> DataFrame:
    """(bank_id, features): the mean vector of every group, without gathering its rows; written, as a bank is read
    several times."""
    sums = [F.avg(F.col("features")[i]) for i in range(DIM)]
    return written(patches(spark, sf).groupBy(F.col(group).cast("long").alias("bank_id")).agg(F.array(*sums).alias("features")), "prototypes")


def _near(spark, sf, k: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, b = patches(spark, sf).select("vec_id", "image_idx", "patch_pos", "features"), prototypes(spark, sf)
    return p, b, J.knn_join(p, b, k)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, score, label): text length as the score of toxic documents."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return d.join(read_table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


def maps(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, map, mask): a vector as its score map, its successor's large cells as its mask (the last has none)."""
    e = patches(spark, sf).select("vec_id", F.col("features").alias("map"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("map", lambda v: (v > 0.15).cast("int")).alias("mask"))
    return e.join(nxt, "vec_id", "left").withColumn("mask", F.coalesce("mask", F.transform("map", lambda _: F.lit(0))))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as metrics of runs: experiment = return flag, run = supplier, dataset = status."""
    return read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("experiment"), F.col("l_suppkey").alias("run_dir"), F.col("l_linestatus").alias("dataset")).agg(
        F.avg("l_discount").alias("image_auroc"), F.avg("l_tax").alias("image_ap"), F.max("l_shipdate").alias("timestamp")
    )


# --- joins and scoring ----------------------------------------------------------------------


@query
def knn_top3(spark, sf):
    return _near(spark, sf, 3)[2].select("vec_id", "rank", "bank_id", r6("sq_dist").alias("sq_dist"))


@query
def knn_by_balls(spark, sf):
    """The three vectors nearest to each of all vectors, by balls."""
    from ..operators.balls import ball_knn

    x = patches(spark, sf).select(F.col("vec_id").alias("id"), "features")
    return ball_knn(x, x, 3).select(F.col("id").alias("vec_id"), "rank", "bank_id", r6("sq_dist").alias("sq_dist"))


@query
def patch_score_meank(spark, sf):
    return J.patch_scores(_near(spark, sf, 3)[2], ["vec_id"]).select("vec_id", r6("score").alias("score"))


@query
def image_score_max(spark, sf):
    return C.image_max(C.first_neighbours(_near(spark, sf)[2])).select("image_idx", r6("score").alias("score"))


@query
def unpatch_scores(spark, sf):
    u = C.unpatch(C.first_neighbours(_near(spark, sf)[2]))
    return u.select("image_idx", F.size("scores").alias("n"), r6(F.col("scores")[0]).alias("first_score"), r6(F.element_at("scores", -1)).alias("last_score"))


@query
def eq7_image_score(spark, sf):
    p, b, k = _near(spark, sf)
    return C.eq7_image(k, p, b, 5).select("image_idx", "patch_pos", r6("score").alias("score"))


@query
def topk_soft_score(spark, sf):
    return C.top_k_soft(C.first_neighbours(_near(spark, sf)[2]), 5, 0.5).select("image_idx", r6("score").alias("score"))


@query
def eq7_topk_soft(spark, sf):
    p, b, k = _near(spark, sf)
    return C.eq7_top_k_soft(k, p, b, 5, 5, 0.5).select("image_idx", r6("score").alias("score"))


@query
def topp_mean_score(spark, sf):
    return C.top_p_mean(C.first_neighbours(_near(spark, sf)[2]), 0.55, 8).select("image_idx", r6("score").alias("score"))


@query
def eq7_topp_mean(spark, sf):
    p, b, k = _near(spark, sf)
    return C.eq7_top_p_mean(k, p, b, 5, 0.25, 8).select("image_idx", r6("score").alias("score"))


@query
def pni_gate_score(spark, sf):
    p = patches(spark, sf).select("image_idx", "patch_pos", "row", "col", "features")
    b = prototypes(spark, sf)
    k = written(J.knn_join(p.select("image_idx", "patch_pos", "row", "col", "features"), b, 1), "pni-knn")  # read three times
    prior = C.position_prior(k.select("row", "col", "bank_id"))
    return C.pni_gate(p, k.drop("row", "col"), b, prior, gamma=0.4, threshold=0.12, scale=2.0).select("image_idx", "patch_pos", r6("score").alias("score"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """A diagonal Gaussian for each label, written."""
    x = F.col("features")
    return written(patches(spark, sf).groupBy(F.col("label").cast("long").alias("component_id")).agg(
        F.count("*").cast("double").alias("weight"), F.array(*(F.avg(x[i]) for i in range(DIM))).alias("mean"), F.array(*(F.var_pop(x[i]) for i in range(DIM))).alias("variance")
    ), "components")


@query
def density_log_prob(spark, sf):
    d = C.density_join(patches(spark, sf).select("vec_id", "features"), components(spark, sf))
    return d.select("vec_id", "component_id", F.round("log_prob", 4).alias("log_prob"))


@query
def best_component(spark, sf):
    """The likeliest component of each vector, by bounds and exact evaluation of what they leave."""
    d = C.best_component(patches(spark, sf).select("vec_id", "features"), components(spark, sf))
    return d.select("vec_id", "component_id", F.round("distance", 4).alias("distance"))


@query
def density_eq7(spark, sf):
    return C.density_eq7(patches(spark, sf).select("image_idx", "patch_pos", "features"), components(spark, sf), 5).select("image_idx", "patch_pos", F.round("score", 4).alias("score"))


@query
def local_position_knn(spark, sf):
    p = patches(spark, sf)
    bank = p.select("row", "col", F.col("vec_id").alias("bank_id"), "features")
    return J.position_knn(p.select("vec_id", "row", "col", "features"), bank, ["row", "col"], 3).select("vec_id", "rank", "bank_id", r6("sq_dist").alias("sq_dist"))


@query
def bank_support(spark, sf):
    return J.support(prototypes(spark, sf), 4).select("anchor_id", "rank", "nbr_id")


@query
def bank_self_distance(spark, sf):
    return J.self_distance(prototypes(spark, sf)).select("bank_id", r6("self_distance").alias("self_distance"))


@query
def min_distance_to_pool(spark, sf):
    return J.min_distance(patches(spark, sf).select("vec_id", "features"), prototypes(spark, sf, "label")).select("vec_id", r6("distance").alias("distance"))


@query
def grid_neighbourhood(spark, sf):
    return J.grid_neighbours(patches(spark, sf).select("row", "col"), 3, True)


# --- moments, reduction, whitening ------------------------------------------------------------


@query
def feature_mean_cov(spark, sf):
    x = MO.grouped_cov(patches(spark, sf).withColumn("g", F.lit(0)), "features", ["g"])
    return x.select("i", "j", F.round("mean_i", 8).alias("mean_i"), (F.round("cov", 8) + 0.0).alias("cov"))


@query
def cov_per_label(spark, sf):
    return MO.grouped_cov(patches(spark, sf), "features", ["label"]).select("label", "n", "i", "j", (F.round("cov", 8) + 0.0).alias("cov"))


def _rho(spark, sf, method: str) -> DataFrame:
    df = patches(spark, sf)
    m = MO.fit_moments(df, "features")
    config = W.WhiteningConfig(method="LEDOIT_WOLF" if method == "RBLW" else method)
    rho = W.shrinkage(config, m, MO.fourth_moment(df, "features", m.mean) if method == "LEDOIT_WOLF" else None)
    return spark.createDataFrame([(round(rho, 6),)], "rho double")


@query
def oas_shrinkage(spark, sf):
    return _rho(spark, sf, "OAS")


@query
def rblw_shrinkage(spark, sf):
    return _rho(spark, sf, "RBLW")


@query
def ledoit_wolf(spark, sf):
    return _rho(spark, sf, "LEDOIT_WOLF")


@query
def regularized_cov(spark, sf):
    from ..functions import linalg

    s = linalg.regularize(MO.fit_moments(patches(spark, sf), "features").cov, 0.07, 1e-8)
    i, j = np.triu_indices(DIM)
    return spark.createDataFrame([(int(a) + 1, int(b) + 1, round(float(s[a, b]), 8) + 0.0) for a, b in zip(i, j)], "i int, j int, value double")


def _whitened(spark, sf, dim: int, config: W.WhiteningConfig) -> DataFrame:
    df = patches(spark, sf).select("vec_id", F.slice("features", 1, dim).alias("x"))
    return W.fit_whitening(df, "x", config).transform(df, "x")


_PLAIN = W.WhiteningConfig(method="JITTER_ONLY")


@query
def whitened_norm_2d(spark, sf):
    return _whitened(spark, sf, 2, _PLAIN).select("vec_id", r6(V.sq_norm(F.col("z"))).alias("norm"))


@query
def whitened_norm_6d(spark, sf):
    return _whitened(spark, sf, 6, _PLAIN).select("vec_id", r6(V.sq_norm(F.col("z"))).alias("norm"))


@query
def whitened_norm_64d(spark, sf):
    return _whitened(spark, sf, DIM, W.WhiteningConfig(method="FIXED", shrinkage=0.07)).select("vec_id", r6(V.sq_norm(F.col("z"))).alias("norm"))


@query
def whitened_total(spark, sf):
    """Unregularised whitening makes the squared norms add up to (n - 1) * D."""
    z = _whitened(spark, sf, DIM, _PLAIN).agg(F.sum(V.sq_norm(F.col("z"))).alias("s"), F.count("*").alias("n"))
    return z.select("n", F.round("s", 4).alias("total"))


@query
def pca_explained_variance(spark, sf):
    m = R.fit_pca(patches(spark, sf), "features", 0.99)
    return spark.createDataFrame([(i + 1, round(float(v), 8), round(float(s), 8)) for i, (v, s) in enumerate(zip(m.variances, m.ratios))], "component int, variance double, ratio double")


@query
def pca_power_sums(spark, sf):
    """Sums of powers of all eigenvalues over their mean: traces of the powers of the covariance."""
    v = R.fit_pca(patches(spark, sf), "features", 1.0).variances
    return spark.createDataFrame([(k, round(float(((v / v.mean()) ** k).sum()), 5)) for k in (1, 2, 3, 4)], "power int, total double")


@query
def pca_total_variance(spark, sf):
    m = R.fit_pca(patches(spark, sf), "features", 1.0)
    return spark.createDataFrame([(round(float(m.variances.sum()), 8),)], "total double")


@query
def pca_reduced(spark, sf):
    """With all components, projections keep the distance from the mean."""
    df = patches(spark, sf).select("vec_id", "features")
    return R.fit_pca(df, "features", 1.0).transform(df, "features").select("vec_id", r6(V.sq_norm(F.col("reduced"))).alias("norm"))


@query
def online_moments(spark, sf):
    x = MO.scalar_moments(read_table(spark, sf, "events"), "value", ["event_type"])
    return x.select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"))


# --- banks --------------------------------------------------------------------------------------


def _norms(bank: DataFrame) -> DataFrame:
    return bank.select("bank_id", r6(F.sqrt(V.sq_norm(F.col("features")))).alias("norm"), r6(F.col("features")[0]).alias("first"))


@query
def farthest_first(spark, sf):
    p = patches(spark, sf)
    picked = B.farthest_first(p, "features", "vec_id", 20)
    return picked.select("bank_id", *(r6(F.col("features")[i]).alias(f"x{i}") for i in range(3)))


@query
def farthest_first_passes(spark, sf):
    """farthest_first in lazy passes, as for tables beyond a block."""
    picked = B.farthest_first(patches(spark, sf), "features", "vec_id", 20, block_bytes=0)
    return picked.select("bank_id", *(r6(F.col("features")[i]).alias(f"x{i}") for i in range(3)))


@query
def greedy_passes(spark, sf):
    """greedy_exact in lazy passes."""
    return B.greedy(patches(spark, sf), "features", "vec_id", 0.02, block_bytes=0).select("bank_id", *(r6(F.col("features")[i]).alias(f"x{i}") for i in range(3)))


@query
def merge_reduce_bank(spark, sf):
    return _norms(B.merge_reduce(patches(spark, sf), "features", "batch", "vec_id", 100, 32))


@query
def budgeted_kcenter(spark, sf):
    return _norms(B.budgeted_kcenter(patches(spark, sf), "features", "vec_id", 20))


@query
def greedy_exact(spark, sf):
    return B.greedy(patches(spark, sf), "features", "vec_id", 0.02).select("bank_id", *(r6(F.col("features")[i]).alias(f"x{i}") for i in range(3)))


@query
def greedy_approx(spark, sf):
    return _norms(B.greedy(patches(spark, sf), "features", "vec_id", 0.02, True))


@query
def kmeans_bank(spark, sf):
    return _norms(B.kmeans(patches(spark, sf), "features", 10, 7))


@query
def minibatch_kmeans(spark, sf):
    return _norms(B.minibatch_kmeans(patches(spark, sf), "features", "vec_id", 10, 64, 7))


@query
def bank_invariants(spark, sf):
    """What holds for banks with random starts: their size, that greedy picks are rows of the table, and that
    means of clusters are closer to the rows than one center, the mean of all, is."""
    p = patches(spark, sf).select("vec_id", "batch", "features")
    mean = p.agg(F.array(*(F.avg(F.col("features")[i]) for i in range(DIM)))).first()[0]
    banks = {"greedy_approx": B.greedy(p, "features", "vec_id", 0.02, True), "kmeans": B.kmeans(p, "features", 10, 7), "minibatch_kmeans": B.minibatch_kmeans(p, "features", "vec_id", 10, 64, 7)}
    inertia = lambda b: J.min_distance(p.select("vec_id", "features"), b).agg(F.sum(F.col("distance") ** 2)).first()[0]
    one = inertia(spark.createDataFrame([(0, mean)], B.BANK))
    rows = []
    for name, bank in banks.items():
        found = written(bank, "bank")  # a greedy bank grows with the rows
        known = name != "greedy_approx" or found.join(p.select("features"), "features", "left_anti").isEmpty()
        rows.append((name, found.count(), known, name == "greedy_approx" or inertia(found) < one))
    return spark.createDataFrame(rows, "bank string, n_rows long, from_table boolean, closer_than_mean boolean")


@query
def tail_residual_topk(spark, sf):
    s = T.residual_scores(patches(spark, sf).select("vec_id", "features"), prototypes(spark, sf))
    return D.stable_top_k(s, "tail_score", "vec_id", 50).select("vec_id", r6("tail_score").alias("tail_score"))


@query
def tail_pruning_gap(spark, sf):
    s = T.pruning_gap_scores(patches(spark, sf).select("vec_id", "features"), prototypes(spark, sf), prototypes(spark, sf, "label"))
    return s.select("vec_id", r6("tail_score").alias("tail_score"))


@query
def tail_aware_bank(spark, sf):
    return _norms(T.tail_aware_bank(patches(spark, sf), "features", "batch", "vec_id", T.TailConfig(k=40, pool=60, chunk=32)))


@query
def chi2_tail_band(spark, sf):
    """Vectors standardised in every dimension, around the middle of the chi-squared distribution."""
    p = patches(spark, sf)
    m = p.agg(F.array(*(F.avg(F.col("features")[i]) for i in range(DIM))).alias("m"), F.array(*(F.stddev_samp(F.col("features")[i]) for i in range(DIM))).alias("s"))
    z = p.crossJoin(F.broadcast(m)).select("vec_id", F.zip_with(F.zip_with("features", "m", lambda a, b: a - b), "s", lambda a, b: a / b).alias("z"))  # one row
    return T.chi2_band(z, "z", 0.45, 0.55).select("vec_id", r6("tail_p").alias("tail_p"))


def _prefix(spark, sf) -> DataFrame:
    return patches(spark, sf).select("vec_id", F.slice("features", 1, 2).alias("features"))


@query
def dedup_exact(spark, sf):
    x = _prefix(spark, sf).withColumn("features", V.bround_vector(F.col("features"), 1))
    return D.dedup_first(x, "features", "vec_id").select("vec_id")


@query
def dedup_quantized(spark, sf):
    return D.dedup_first(_prefix(spark, sf), "features", "vec_id", "quantized", 1).select("vec_id", r6(F.col("features")[0]).alias("x0"))


@query
def dedup_tolerance(spark, sf):
    return D.dedup_tolerance(_prefix(spark, sf), "features", "vec_id", 0.04).select("vec_id")


@query
def pool_semi_join(spark, sf):
    pool = prototypes(spark, sf).select(F.slice("features", 1, 2).alias("features"))
    return D.in_pool(_prefix(spark, sf), pool, strategy="quantized", decimals=1).select("vec_id")


@query
def pool_anti_join(spark, sf):
    pool = prototypes(spark, sf).select(F.slice("features", 1, 2).alias("features"))
    return D.not_in_pool(_prefix(spark, sf), pool, strategy="quantized", decimals=1).select("vec_id")


@query
def dedup_whole(spark, sf):
    """All 64 dimensions, each row twice: exact keys, and keys rounded to tenths."""
    p = patches(spark, sf).select("vec_id", "features")
    twice = p.union(p.select((F.col("vec_id") + 10**9).alias("vec_id"), "features"))
    exact = D.dedup_first(twice, "features", "vec_id").select(F.lit("exact").alias("key"), "vec_id")
    return exact.union(D.dedup_first(twice, "features", "vec_id", "quantized", 1).select(F.lit("quantized"), "vec_id"))


@query
def dedup_tolerance_whole(spark, sf):
    return D.dedup_tolerance(patches(spark, sf).select("vec_id", "features"), "features", "vec_id", 1.2).select("vec_id")


@query
def pool_whole(spark, sf):
    """Rows in and outside the pool of even rows, by whole vectors, and within a tolerance of the prototypes."""
    p = patches(spark, sf).select("vec_id", "features")
    pool = p.where("vec_id % 2 = 0").select("features")
    inside = D.in_pool(p, pool).select(F.lit("in").alias("side"), "vec_id")
    outside = D.not_in_pool(p, pool).select(F.lit("out"), "vec_id")
    return inside.union(outside).union(D.in_pool(p, prototypes(spark, sf), strategy="tolerance", eps=0.95).select(F.lit("near"), "vec_id"))


# --- projections and grids ------------------------------------------------------------------------


def _pooled(spark, sf, out: int) -> DataFrame:
    p = patches(spark, sf).select("vec_id", F.posexplode(V.adaptive_pool(F.col("features"), DIM, out)).alias("bin", "v"))
    return p.select("vec_id", "bin", r6("v").alias("value"))


@query
def adaptive_pool_16(spark, sf):
    return _pooled(spark, sf, 16)


@query
def adaptive_pool_10(spark, sf):
    return _pooled(spark, sf, 10)


@query
def merge_average(spark, sf):
    p = patches(spark, sf).select("vec_id", V.merge_features([F.slice("features", 1, 32), F.slice("features", 33, 32)], "average").alias("m"))
    return p.select("vec_id", r6(V.sq_norm(F.col("m"))).alias("norm"))


@query
def patchify_3x3(spark, sf):
    x = G.patchify(patches(spark, sf).select("vec_id", F.col("features").alias("map")), "map", 8, 8)
    return x.select("vec_id", "row", "col", r6(F.aggregate("patch", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def _resized(spark, sf, to: int, sigma: float) -> DataFrame:
    x = G.resize(patches(spark, sf).select("vec_id", F.col("features").alias("map")), "map", (8, 8), (to, to), sigma)
    return x.select("vec_id", F.posexplode("resized").alias("cell", "v")).select("vec_id", "cell", r6("v").alias("value"))


@query
def bilinear_upsample(spark, sf):
    return _resized(spark, sf, 12, 0.0)


@query
def gaussian_smooth(spark, sf):
    return _resized(spark, sf, 8, 1.0)


@query
def grid_regions(spark, sf):
    x = G.region_labels(maps(spark, sf).select("vec_id", "mask"), "mask", 8, 8)
    cell = x.select("vec_id", F.posexplode("labels").alias("cell", "label")).where("label > 0")
    return cell.groupBy("vec_id", "label").agg(F.min("cell").alias("first_cell"), F.count("*").alias("size")).select("vec_id", "first_cell", "size")


# --- metrics and calibration ------------------------------------------------------------------------


@query
def pixel_aupro(spark, sf):
    return M.aupro(M.pixel_cells(maps(spark, sf), "map", "mask", 8, 8), 0.3, 256).select(r6("aupro").alias("aupro"))


@query
def image_aupro(spark, sf):
    return M.aupro(M.image_cells(scored(spark, sf), "label", "score"), 0.3, 256).select(r6("aupro").alias("aupro"))


@query
def pixel_auroc(spark, sf):
    p = maps(spark, sf).select(F.explode(F.arrays_zip("map", "mask")).alias("x")).select(F.col("x.map").alias("score"), F.col("x.mask").alias("label"))
    return M.auroc(p, "label", "score").select(r6("auroc").alias("auroc"))


@query
def zscore_calibration(spark, sf):
    d = scored(spark, sf)
    return CA.zscore(d, d.where("label = 0"), "score").select("doc_id", r6("calibrated").alias("calibrated"))


@query
def ecdf_calibration(spark, sf):
    d = scored(spark, sf)
    return CA.ecdf(d, d.where("label = 0"), "score").select("doc_id", r6("calibrated").alias("calibrated"))


@query
def self_ecdf_by_type(spark, sf):
    return CA.self_ecdf(read_table(spark, sf, "events"), "value", ["event_type"]).select("event_id", r6("calibrated").alias("calibrated"))


_CONFUSION = ["precision", "recall", "f1", "accuracy", "balanced_accuracy"]


@query
def confusion_metrics(spark, sf):
    x = M.confusion(scored(spark, sf), "label", "score", 1500.0)
    return x.select("tp", "fp", "fn", "tn", *(r6(c).alias(c) for c in _CONFUSION))


@query
def best_f1_threshold(spark, sf):
    return M.best_f1(scored(spark, sf), "label", "score").select("threshold", r6("f1").alias("f1"))


@query
def auroc(spark, sf):
    return M.auroc(scored(spark, sf), "label", "score").select(r6("auroc").alias("auroc"))


@query
def average_precision(spark, sf):
    return M.average_precision(scored(spark, sf), "label", "score").select(r6("average_precision").alias("average_precision"))


@query
def per_dataset_metrics_with_mean(spark, sf):
    rows = M.with_mean(M.metric_row(scored(spark, sf), "label", "score", ["lang"], 1500.0), "lang")
    return rows.select("lang", *(r6(c).alias(c) for c in rows.columns if c != "lang"))


@query
def per_image_rows(spark, sf):
    x = M.map_rows(maps(spark, sf), "map", "mask", 0.1)
    return x.select("vec_id", *(r6(c).alias(c) for c in x.columns if c != "vec_id"))


@query
def artifact_top_k(spark, sf):
    from .artifacts import select_artifacts

    return select_artifacts(scored(spark, sf), "top_k", 20, "label", "score", "doc_id").select("doc_id", "score")


# --- runs ---------------------------------------------------------------------------------------------


@query
def phase_timing_pivot(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("phase"), F.col("value").alias("duration_s"))
    names = {"click": "fit", "view": "calibration", "scroll": "infer", "purchase": "total"}
    phase = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("phase")], F.lit("other"))
    x = S.phase_pivot(e.withColumn("phase", phase), ["run"])
    return x.select("run", *(r6(F.nanvl(c, F.lit(-1.0))).alias(c) for c in x.columns if c != "run"))


@query
def resource_aggregates(spark, sf):
    x = S.resource_aggregates(read_table(spark, sf, "events").select("event_type", F.col("value").alias("ram_mb"), F.col("user_id").cast("double").alias("cpu_pct")), ["event_type"], ["ram_mb", "cpu_pct"])
    return x.select("event_type", *(r6(c).alias(c) for c in x.columns if c != "event_type"))


def _summary(spark, sf) -> DataFrame:
    r = runs(spark, sf)
    m = S.run_metrics(r, ["experiment", "run_dir"], ["image_auroc", "image_ap"])
    t = r.groupBy("experiment", "run_dir").agg(F.max("timestamp").alias("timestamp"))
    return m.join(t, ["experiment", "run_dir"]).withColumn("status", F.lit("ok"))


@query
def run_summary(spark, sf):
    s = S.summary_table([_summary(spark, sf)])
    return s.select("experiment", "run_dir", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), r6("image_auroc").alias("image_auroc"), r6("image_ap").alias("image_ap"), "from_mean")


@query
def leaderboard_top10(spark, sf):
    s = _summary(spark, sf).withColumn("image_auroc", r6("image_auroc")).withColumn("image_ap", r6("image_ap"))
    return S.leaderboard(s, ["image_auroc", "image_ap"], 10, ["experiment", "run_dir"])


@query
def fastest_slowest(spark, sf):
    s = _summary(spark, sf).withColumn("image_auroc", r6("image_auroc"))
    return S.fastest_slowest(s, "image_auroc", 5, ["experiment", "run_dir"])


@query
def pricing_summary(spark, sf):
    """Metric rows with their total row at scale."""
    li = read_table(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.count("*").alias("n"))
    rows = M.with_mean(g, "l_returnflag")
    return rows.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("sum_qty", "avg_price", "n")))


@query
def order_priority_top(spark, sf):
    """The five largest orders of each priority: a ranking window."""
    o = read_table(spark, sf, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("o_orderpriority", "rank", "o_orderkey", "o_totalprice")


# --- streams ------------------------------------------------------------------------------------------


@query
def stream_moments(spark, sf):
    from ..streaming.state import stream_scalar_moments

    x = stream_scalar_moments(spark, f"{sf}/events.parquet", "event_type", "value")
    return x.select("event_type", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query
def stream_bank(spark, sf):
    from ..streaming.state import stream_merge_reduce

    return _norms(stream_merge_reduce(spark, f"{sf}/embeddings.parquet", "embedding", "vec_id", 64, 50, 32))


# --- the flagship ---------------------------------------------------------------------------------------


@query
def staged_scores(spark, sf):
    """anomaly_scores of a fit whose stages were exported and loaded again."""
    from ..sources.scratch import new_folder
    from .pipeline import FitConfig, fit

    p, folder = patches(spark, sf), new_folder(spark, "staged")
    config = FitConfig(whitening=W.WhiteningConfig(method="FIXED", shrinkage=0.07), n_clusters=100, chunk=64, reweight=5)
    fit(p, config, folder=folder)
    return fit(p, config, folder=folder).image_scores(p).select("image_idx", r6("score").alias("score"))


@query
def finite_rows(spark, sf):
    """How many vectors of each label hold finite numbers only."""
    return patches(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_if(V.is_finite(F.col("features"))).alias("n_finite"))


@query
def anomaly_scores(spark, sf):
    """Fit and infer end to end: whitening, merge-reduce bank, exact neighbours, reweighted scores."""
    from .pipeline import FitConfig, fit

    p = patches(spark, sf)
    model = fit(p, FitConfig(whitening=W.WhiteningConfig(method="FIXED", shrinkage=0.07), n_clusters=100, chunk=64, reweight=5))
    return model.image_scores(p).select("image_idx", r6("score").alias("score"))
