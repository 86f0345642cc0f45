"""Image trees as DataFrames: <root>/<category>/{train,test}/<defect or good>/*.png with masks in
ground_truth/<defect>/<stem>_mask.png.

All categories are read in one job. A test image outside ``good`` whose mask is missing gets a zero
mask, and so counts as normal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.artifacts import CHANNEL_MEAN, CHANNEL_STD

#: fixed value: what a pass adds to the seed
EPOCH_SEED = 1_000_003
POLICIES = ("none", "independent", "pass_consistent")


def image_files(spark: SparkSession, root: str, categories: list[str], split: str) -> DataFrame:
    """(dataset, split, image_idx, path, defect, stem, h, w, channels, data): decoded by Spark's image source,
    numbered by path within a category."""
    if not categories:
        raise ValueError("no categories")
    paths = [f"{root}/{c}/{split}/*/*.png" for c in categories]
    x = spark.read.format("image").load(paths).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    at = rf"/([^/]+)/{split}/([^/]+)/([^/]+)\.png$"
    x = x.select("path", *(F.regexp_extract("path", at, i).alias(n) for i, n in ((1, "dataset"), (2, "defect"), (3, "stem"))), F.lit(split).alias("split"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data")
    return x.withColumn("image_idx", (F.row_number().over(Window.partitionBy("dataset").orderBy("path")) - 1).cast("long"))


def with_masks(images: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """images and ``mask_data`` (null where there is none, or the image is good): a left join on the stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_mask.png").load(root).select(
        *(F.regexp_extract("path", r"/([^/]+)/ground_truth/([^/]+)/([^/]+)_mask\.png$", i).alias(n) for i, n in ((1, "dataset"), (2, "defect"), (3, "stem"))), F.col("path").alias("mask_path")
    )
    decoded = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_mask.png").load(root).select(F.col("image.origin").alias("mask_path"), F.col("image.data").alias("mask_data"), F.col("image.nChannels").alias("mask_channels"))
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    masks = files.join(decoded.withColumn("k", same("mask_path")).drop("mask_path"), same(files["mask_path"]) == F.col("k")).drop("k", "mask_path")
    return images.join(masks.where("defect <> 'good'"), ["dataset", "defect", "stem"], "left")


@dataclass(frozen=True)
class Augmentation:
    """Probabilities of the train transforms; jitter strengths; largest rotation in degrees."""

    hflip: float = 0.0
    vflip: float = 0.0
    rotate: float = 0.0
    random90: float = 0.0
    jitter: float = 0.0
    degrees: float = 30.0
    strengths: tuple[float, float, float, float] = (0.2, 0.2, 0.2, 0.1)


@dataclass(frozen=True)
class LoaderConfig:
    root: str
    categories: tuple[str, ...]
    batch_size: int = 16
    resize: tuple[int, int] = (256, 256)
    crop: tuple[int, int] = (224, 224)
    seed: int = 0
    policy: str = "independent"
    augment: Augmentation = field(default_factory=Augmentation)
    per_category: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.categories or self.batch_size < 1:
            raise ValueError("categories and a positive batch size are needed")
        if self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy}")
        unknown = set(self.per_category) - set(self.categories)
        if unknown:
            raise ValueError(f"overrides of unknown categories {sorted(unknown)}")

    def augmentation(self, category: str) -> Augmentation:
        """The base with a category's overrides."""
        from dataclasses import replace

        return replace(self.augment, **self.per_category.get(category, {}))


def rng_of(seed: int, category_index: int, image_idx: int, epoch: int, policy: str) -> np.random.Generator:
    """The generator of one image: the same in every pass under pass_consistent."""
    return np.random.default_rng([seed + category_index * EPOCH_SEED, image_idx, 0 if policy == "pass_consistent" else epoch])


def _bilinear(x: np.ndarray, to: tuple[int, int]) -> np.ndarray:
    from ..functions.kernels import bilinear_weights

    return np.einsum("ij,jkc,lk->ilc", bilinear_weights(x.shape[0], to[0]), x, bilinear_weights(x.shape[1], to[1]))


def _nearest(x: np.ndarray, to: tuple[int, int]) -> np.ndarray:
    r = (np.arange(to[0]) * x.shape[0] // to[0]).clip(0, x.shape[0] - 1)
    c = (np.arange(to[1]) * x.shape[1] // to[1]).clip(0, x.shape[1] - 1)
    return x[np.ix_(r, c)]


def _turn(x: np.ndarray, degrees: float) -> np.ndarray:
    h, w = x.shape[:2]
    a = np.deg2rad(degrees)
    r, c = np.mgrid[:h, :w]
    y, z = r - (h - 1) / 2, c - (w - 1) / 2
    sr = np.rint(np.cos(a) * y - np.sin(a) * z + (h - 1) / 2).astype(int)
    sc = np.rint(np.sin(a) * y + np.cos(a) * z + (w - 1) / 2).astype(int)
    ok = (sr >= 0) & (sr < h) & (sc >= 0) & (sc < w)
    return np.where(ok.reshape(h, w, *[1] * (x.ndim - 2)), x[sr.clip(0, h - 1), sc.clip(0, w - 1)], 0)


def shift_hue(image: np.ndarray, turn: float) -> np.ndarray:
    """Colours (..., 3) in [0, 1] with their hue turned by a share of the circle; value and saturation stay."""
    hi, lo = image.max(-1), image.min(-1)
    span = np.where(hi > lo, hi - lo, 1.0)
    r, g, b = (image[..., k] for k in range(3))
    hue = np.where(hi == r, (g - b) / span % 6, np.where(hi == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    at = (hue + turn) % 1.0 * 6
    ramp = lambda k: np.clip(np.minimum((k + at) % 6, 4 - (k + at) % 6), 0, 1)
    return np.stack([hi - (hi - lo) * ramp(k) for k in (5, 3, 1)], -1)


def augment(image: np.ndarray, mask: np.ndarray, a: Augmentation, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One joint draw for image (H, W, 3 in [0, 1]) and mask; colours of the image only."""
    if rng.random() < a.hflip:
        image, mask = image[:, ::-1], mask[:, ::-1]
    if rng.random() < a.vflip:
        image, mask = image[::-1], mask[::-1]
    if rng.random() < a.rotate:
        d = rng.uniform(-a.degrees, a.degrees)
        image, mask = _turn(image, d), _turn(mask, d)
    if rng.random() < a.random90:
        k = int(rng.integers(4))
        image, mask = np.rot90(image, k), np.rot90(mask, k)
    if rng.random() < a.jitter:
        b, c, s, h = a.strengths
        image = image * rng.uniform(1 - b, 1 + b)
        image = (image - image.mean()) * rng.uniform(1 - c, 1 + c) + image.mean()
        grey = image.mean(2, keepdims=True)
        image = np.clip((image - grey) * rng.uniform(1 - s, 1 + s) + grey, 0, 1)
        image = shift_hue(image, rng.uniform(-h, h))
    return image, mask


def prepare(image: np.ndarray, mask: np.ndarray, c: LoaderConfig) -> tuple[np.ndarray, np.ndarray]:
    """Resize, centre crop, normalise: ([3, h, w] floats, [h, w] of 0 and 1)."""
    image, mask = _bilinear(image, c.resize), _nearest(mask, c.resize)
    top, left = (c.resize[0] - c.crop[0]) // 2, (c.resize[1] - c.crop[1]) // 2
    image = image[top : top + c.crop[0], left : left + c.crop[1]]
    mask = mask[top : top + c.crop[0], left : left + c.crop[1]]
    return ((image - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1), (mask > 0).astype(np.int8)


def load_images(spark: SparkSession, c: LoaderConfig, split: str, train: bool = False, epoch: int = 1) -> DataFrame:
    """(dataset, split, image_idx, batch_idx, path, label, image, mask, h, w): normalised images, channel
    by channel, with masks. Calibration reads the train split with train=False, unaugmented."""
    x = with_masks(image_files(spark, c.root, list(c.categories), split), spark, c.root)
    cols = ["dataset", "split", "image_idx", "path", "h", "w", "channels", "data", "mask_data", "mask_channels"]
    schema = "dataset string, split string, image_idx long, batch_idx long, path string, label int, image array<float>, mask array<tinyint>, h int, w int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                image = np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"], -1)
                image = (np.repeat(image, 3, 2) if r["channels"] == 1 else image[..., 2::-1]) / 255.0  # the source gives BGR
                mask = np.zeros(image.shape[:2]) if r["mask_data"] is None else np.frombuffer(r["mask_data"], np.uint8).reshape(r["h"], r["w"], -1)[..., 0]
                if train and c.policy != "none":
                    image, mask = augment(image, mask, c.augmentation(r["dataset"]), rng_of(c.seed, c.categories.index(r["dataset"]), r["image_idx"], epoch, c.policy))
                image, mask = prepare(image, mask, c)
                row = {"dataset": [r["dataset"]], "split": [r["split"]], "image_idx": [r["image_idx"]], "batch_idx": [r["image_idx"] // c.batch_size], "path": [r["path"]], "label": pa.array([int(mask.max() > 0)], pa.int32()), "image": pa.array([image.astype(np.float32).ravel()], pa.list_(pa.float32())), "mask": pa.array([mask.ravel()], pa.list_(pa.int8())), "h": pa.array([c.crop[0]], pa.int32()), "w": pa.array([c.crop[1]], pa.int32())}
                yield pa.RecordBatch.from_pydict(row)

    return x.select(*cols).mapInArrow(read, schema)


#: layer names of the two backbone families to their module names
LAYERS = {"wideresnet50": {f"layer{i}": f"layer{i}" for i in range(1, 5)}, "resnetv2_50_21k": {f"layer{i}": f"stages.{i - 1}" for i in range(1, 5)}}


def resolve_layers(backbone: str, layers: list[str]) -> list[str]:
    if backbone not in LAYERS:
        raise ValueError(f"unknown backbone {backbone}")
    return [LAYERS[backbone].get(x, x) for x in layers]


class LayerExtractor:
    """A backbone of named stages, called one after another: image to {layer: map}. It stops behind the last layer asked
    for; ``hooks`` are called with (layer, map) for every stage that runs."""

    def __init__(self, stages: list[tuple[str, object]], layers: list[str], hooks: tuple = ()):
        names = [n for n, _ in stages]
        missing = [x for x in layers if x not in names]
        if missing or not layers:
            raise ValueError(f"no stages {missing}" if missing else "no layers")
        self.stages, self.layers, self.hooks = stages[: max(map(names.index, layers)) + 1], list(layers), hooks

    def __call__(self, image: np.ndarray) -> dict[str, np.ndarray]:
        out, x = {}, image
        for name, stage in self.stages:
            x = stage(x)
            for hook in self.hooks:
                hook(name, x)
            if name in self.layers:
                out[name] = x
        return out


def filter_bank(image: np.ndarray) -> dict[str, np.ndarray]:
    """The default projection, without weights to download: local means and gradients at two scales."""
    out = {}
    for name, step in (("layer2", 8), ("layer3", 16)):
        c, h, w = image.shape
        x = image[:, : h // step * step, : w // step * step].reshape(c, h // step, step, w // step, step)
        m = x.mean((2, 4))
        out[name] = np.concatenate([m, x.std((2, 4)), np.gradient(m, axis=1), np.gradient(m, axis=2)])
    return out


def embed_images(images: DataFrame, backbone=filter_bank, layers: tuple[str, ...] = ("layer2", "layer3"), patch: int = 3, stride: int = 1, pre_dim: int = 64, dim: int = 64) -> DataFrame:
    """Patch features (dataset, split, image_idx, patch_pos, row, col, batch_idx, label, features).

    backbone: [3, h, w] to {layer: [C, H, W]}; its maps are patchified, resized to the first layer's
    grid, pooled to pre_dim each, and pooled together to dim."""
    from ..functions import arrow as A
    from ..functions import kernels as N

    schema = "dataset string, split string, image_idx long, patch_pos int, row int, col int, batch_idx long, label int, features array<double>"
    keys = ["dataset", "split", "image_idx", "batch_idx", "label", "h", "w"]

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                maps = backbone(np.array(r["image"], float).reshape(3, r["h"], r["w"]))
                parts, grid = [], None
                for name in layers:
                    m = maps[name]
                    p = N.patchify(m[None], patch, stride)[0]
                    side = (m.shape[1] + 2 * ((patch - 1) // 2) - patch) // stride + 1, (m.shape[2] + 2 * ((patch - 1) // 2) - patch) // stride + 1
                    p = p.reshape(*side, -1)
                    if grid is None:
                        grid = side
                    elif side != grid:
                        p = _bilinear(p, grid)
                    parts.append(N.adaptive_mean(p.reshape(grid[0] * grid[1], -1), pre_dim))
                x = N.adaptive_mean(np.concatenate(parts, 1), dim)
                n = len(x)
                pos = np.arange(n, dtype=np.int32)
                full = lambda v, t: pa.array([v] * n, t)
                yield pa.RecordBatch.from_arrays([full(r["dataset"], pa.string()), full(r["split"], pa.string()), full(r["image_idx"], pa.int64()), pa.array(pos), pa.array(pos // grid[1]), pa.array(pos % grid[1]), full(r["batch_idx"], pa.int64()), full(r["label"], pa.int32()), A.lists(x)], names=["dataset", "split", "image_idx", "patch_pos", "row", "col", "batch_idx", "label", "features"])

    return images.select(*keys, "image").mapInArrow(embed, schema)
