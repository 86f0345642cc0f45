"""A whole run: every category is fitted, calibrated, scored, evaluated and written."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as CA
from ..operators import metrics as M
from ..operators import scoring as C
from ..operators import segmentation as G
from ..sources import images as I
from ..sources import runs as R
from ..sources.scratch import written
from .artifacts import denormalize, select_artifacts, write_artifacts
from .config import RunConfig
from .pipeline import fit
from .profiling import Profiler


PHASES = ("fit", "calibration", "infer", "total")


def banner(c: RunConfig) -> str:
    """The run's stages in order."""
    f = c.fit
    train = ["images", c.backbone, f"patchify {c.patch}", f"pool {c.dim}", *([f"pca {f.pca_ratio}"] if f.pca_ratio else []), *([f"whiten {f.whitening.method}"] if f.whitening else []), f"bank {f.bank}"]
    return f"{c.name} ({f.contract})\nTRAIN: {' -> '.join(train)}\nINFER: {' -> '.join([*train[:-1], f'knn {f.k}', f.scorer, f.mode])}"


def score_maps(patch_scores: DataFrame, grid: tuple[int, int], size: tuple[int, int], sigma: float = 4.0) -> DataFrame:
    """(image_idx, map): patch scores on their grid, resized to the image and smoothed."""
    return G.resize(C.unpatch(patch_scores).withColumnRenamed("scores", "__g"), "__g", grid, size, sigma, "map").drop("__g")


def run_category(spark: SparkSession, c: RunConfig, category: str, folder: str, backbone=None) -> tuple[dict, DataFrame, Profiler]:
    """(metric row, per-image rows, profile) of one category."""
    from dataclasses import replace

    loader = replace(c.loader, categories=(category,), per_category={k: v for k, v in c.loader.per_category.items() if k == category})
    layers = tuple(I.resolve_layers(c.backbone, list(c.layers))) if backbone else c.layers  # the backbone's own names
    embed = lambda x: I.embed_images(x, backbone or I.filter_bank, layers, c.patch, c.stride, c.pre_dim, c.dim)
    e = c.evaluation
    with Profiler(category, spark=spark) as prof:
        with prof.phase("fit"):
            patches = embed(I.load_images(spark, loader, "train", c.train_augment)).withColumn("seq", F.shiftleft(F.col("image_idx"), 31) + F.col("patch_pos")).persist()
            model = fit(patches, c.fit, "batch_idx", "seq")
        with prof.phase("calibration"):
            clean = embed(I.load_images(spark, loader, "train")) if e.calibration != "none" else None
            train_scores = None if clean is None else model.image_scores(clean)
        with prof.phase("infer"):
            images = I.load_images(spark, loader, "test").persist()
            test = embed(images).persist()
            grid = tuple(v + 1 for v in test.agg(F.max("row"), F.max("col")).first())
            scores = model.image_scores(test)
            maps = score_maps(model.patch_scores(test), grid, loader.crop)
            if e.calibration != "none" and e.calibrate_image:
                scores = (CA.zscore(scores, train_scores, "score", e.eps) if e.calibration == "zscore" else CA.ecdf(scores, train_scores, "score")).select("image_idx", F.col("calibrated").alias("score"))
            if e.calibration == "zscore" and e.calibrate_pixel:
                pixel = score_maps(model.patch_scores(clean), grid, loader.crop).select(F.explode("map").alias("v")).agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(e.eps)).alias("s")).first()
                maps = maps.withColumn("map", F.transform("map", lambda v: (v - pixel.m) / pixel.s))
            table = scores.join(maps, "image_idx").join(images.select("image_idx", "path", "label", F.col("mask").cast("array<int>").alias("mask")), "image_idx").persist()
            table.count()
        began = time.monotonic()
        pixels = table.select(F.explode(F.arrays_zip("map", "mask")).alias("x")).select(F.col("x.map").alias("score"), F.col("x.mask").alias("label"))
        policy = lambda p: "best_f1" if p.startswith("best_f1") else p
        sweeps = [M.by_score(x, "label", "score").persist() for x in (table, pixels)]
        it, pt = (M.threshold_for(x, "label", "score", policy(p), w) for x, p, w in ((table, e.image_threshold, sweeps[0]), (pixels, e.pixel_threshold, sweeps[1])))
        row: dict = {"dataset": category, "num_images": table.count(), "num_anomalous_images": table.where("label > 0").count()}
        nan = float("nan")
        for prefix, df, t, w in (("image", table, it, sweeps[0]), ("pixel", pixels, pt, sweeps[1])):
            c1 = M.confusion(df, "label", "score", t).first()
            row |= {f"{prefix}_auroc": M.auroc(df, "label", "score", sweep=w).first()[0], f"{prefix}_ap": M.average_precision(df, "label", "score", sweep=w).first()[0]}
            row |= {f"{prefix}_{k}": c1[k] for k in ("f1", "precision", "recall", "accuracy")} | {f"{prefix}_weighted_accuracy": c1.balanced_accuracy, f"{prefix}_threshold": t}
            row |= {f"{prefix}_{k}": c1[k] for k in ("tp", "fp", "fn", "tn")}
        row["image_aupro"] = M.aupro(M.image_cells(table, "label", "score"), e.max_fpr, e.num_thresholds).first()[0] if e.image_aupro else nan
        row["pixel_aupro"] = M.aupro(M.pixel_cells(table, "map", "mask", *loader.crop), e.max_fpr, e.num_thresholds).first()[0] if e.pixel_aupro else nan
        per_image = M.map_rows(table.select("image_idx", F.col("label").alias("image_label"), F.col("score").alias("image_score"), "map", "mask"), "map", "mask", pt)
        per_image = per_image.select(F.lit(category).alias("dataset"), F.col("image_idx").alias("image_index"), "image_label", "image_score", M.positive(F.col("image_score"), it).alias("image_pred"), "pixel_gt_positive_ratio", "pixel_pred_positive_ratio", "pixel_map_max", "pixel_map_mean")
        prof.timings.append((category, "metrics", time.monotonic() - began))
        if c.artifacts["enabled"]:
            with prof.phase("artifacts"):
                _artifacts(table.join(images.select("image_idx", "image"), "image_idx"), c, folder, category, loader.crop, pt)
    row |= {f"time_{p}_s": d for _, p, d in prof.timings if p in PHASES}
    per_image = written(per_image, "per-image")
    for x in (patches, images, test, table, *sweeps):
        x.unpersist()
    return row, per_image, prof


def _artifacts(table: DataFrame, c: RunConfig, folder: str, category: str, size: tuple[int, int], threshold: float) -> None:
    """Rasters of the chosen images, written where they are computed, to a shared folder."""
    import numpy as np

    limit, alpha = c.artifacts["max_images"] or 2**31 - 1, c.artifacts["alpha"]
    out = f"{folder}/artifacts/{category}"

    def write(rows, save=None) -> None:
        for r in rows:
            image = denormalize(np.array(r["image"], float).reshape(3, *size))
            write_artifacts(out, f"{r['image_idx']:05d}", image, np.array(r["mask"]).reshape(size), np.array(r["map"]).reshape(size), threshold, alpha, save)

    chosen = select_artifacts(table, c.artifacts["save_mode"], limit, "label", "score", "image_idx")
    if "://" in out and not out.startswith("file:"):  # one image at a time, through Hadoop's file system
        write(chosen.toLocalIterator(), R.write_bytes)
    else:
        chosen.foreachPartition(write)


def run_experiment(spark: SparkSession, c: RunConfig, config_text: str = "", backbone=None) -> str:
    """Runs every category and writes the five metric files, and what each phase used of driver and executors; returns the run's directory."""
    print(banner(c))
    folder = f"{c.output_root}/{c.name}/{datetime.now().strftime('%Y%m%d_%H%M%S')}"
    began = time.monotonic()
    rows, images, profiles, usage = [], None, [], None
    for category in c.loader.categories:
        row, per_image, prof = run_category(spark, c, category, folder, backbone)
        rows.append(row)
        images = per_image if images is None else images.unionByName(per_image)
        profiles.append(prof.tables(spark))
        used = prof.usage(spark)
        usage = used if usage is None else usage.unionByName(used)
    import pandas as pd

    per_dataset = spark.createDataFrame(pd.DataFrame(rows).astype({k: float for k in rows[0] if k != "dataset"}))
    R.write_csv(per_dataset, f"{folder}/metrics/per_dataset.csv")
    R.write_csv(M.with_mean(per_dataset, "dataset"), f"{folder}/metrics/summary.csv")
    R.write_csv(images, f"{folder}/metrics/per_image.csv")
    for i, name in enumerate(("profiling_samples", "profiling_timings")):
        table = profiles[0][i]
        for p in profiles[1:]:
            table = table.union(p[i])
        R.write_csv(table, f"{folder}/metrics/{name}.csv")
    R.write_csv(usage, f"{folder}/metrics/profiling_phases.csv")
    R.reproducibility(folder, config_text)
    print(f"{len(rows)} categories in {time.monotonic() - began:.1f} s -> {folder}")
    return folder
