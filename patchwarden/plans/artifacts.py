"""Which images to write out, and the rasters that are written: PNG by the standard library."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: channel means and deviations of the usual image normalisation
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def select_artifacts(df: DataFrame, mode: str, limit: int, label: str, score: str, order: str) -> DataFrame:
    """all (in order), anomalous (in order) or top_k (by score); at most limit rows."""
    if mode == "all":
        return df.orderBy(order).limit(limit)
    if mode == "anomalous":
        return df.where(F.col(label) > 0).orderBy(order).limit(limit)
    if mode != "top_k":
        raise ValueError(f"unknown mode {mode}")
    return df.orderBy(F.desc(score), order).limit(limit)


def denormalize(image: np.ndarray) -> np.ndarray:
    """[3, H, W] normalised floats to [H, W, 3] bytes."""
    x = image * np.array(CHANNEL_STD)[:, None, None] + np.array(CHANNEL_MEAN)[:, None, None]
    return (np.clip(x, 0, 1) * 255).round().astype(np.uint8).transpose(1, 2, 0)


def heatmap(values: np.ndarray) -> np.ndarray:
    """Min-max scaled values in a blue to red colour ramp, [H, W, 3] bytes."""
    lo, hi = float(values.min()), float(values.max())
    t = (values - lo) / (hi - lo) if hi > lo else np.zeros_like(values, float)
    ramp = lambda centre: np.clip(1.5 - np.abs(4 * t - centre), 0, 1)
    return (np.stack([ramp(3), ramp(2), ramp(1)], -1) * 255).round().astype(np.uint8)


def blend(image: np.ndarray, over: np.ndarray, alpha: float) -> np.ndarray:
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be in [0, 1]")
    return ((1 - alpha) * image + alpha * over).round().astype(np.uint8)


def mask_overlay(image: np.ndarray, mask: np.ndarray, alpha: float) -> np.ndarray:
    """The masked pixels tinted red."""
    red = np.zeros_like(image)
    red[..., 0] = 255
    return np.where((mask > 0)[..., None], blend(image, red, alpha), image)


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG of grey [H, W] or colour [H, W, 3] bytes."""
    h, w = image.shape[:2]
    kind = 2 if image.ndim == 3 else 0
    rows = b"".join(b"\0" + image[r].astype(np.uint8).tobytes() for r in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_artifacts(folder: str, name: str, image: np.ndarray, mask: np.ndarray, scores: np.ndarray, threshold: float, alpha: float = 0.4, save=None) -> list[str]:
    """Image, mask, heatmap, both overlays and the binary prediction of one image; save(path, bytes) writes them, by
    default as local files."""
    save = save or _save
    heat = heatmap(scores)
    rasters = {"image": image, "gt": (mask > 0) * np.uint8(255), "heatmap": heat, "heatmap_overlay": blend(image, heat, alpha), "mask_overlay": mask_overlay(image, mask, alpha), "pred_mask": (scores >= threshold) * np.uint8(255)}
    paths = []
    for k, v in rasters.items():
        paths.append(os.path.join(folder, f"{name}_{k}.png"))
        save(paths[-1], png_bytes(np.asarray(v)))
    return paths


def _save(path: str, data: bytes) -> None:
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
