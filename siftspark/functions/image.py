"""Image descriptors: HSV histogram, perceptual hash and edge directions of an image and of its grid patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bins of hue, saturation and value; sides of the reduced image and of its kept frequencies.
H_BINS, S_BINS, V_BINS = 8, 8, 4
SIDE, KEPT = 32, 8
EDGE_LEAST = 0.04
LUMA = (0.299, 0.587, 0.114)

FEATURES = "struct<width:int,height:int,vector:array<float>,patches:array<struct<grid_row:int,grid_col:int,bbox:array<double>,vector:array<float>>>>"


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue, saturation and value in 0..1 of values 0..1; equal maxima count as red, then green."""
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    v, low = rgb.max(axis=-1), rgb.min(axis=-1)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.select([v == r, v == g], [(g - b) / safe + np.where(g < b, 6, 0), (b - r) / safe + 2], (r - g) / safe + 4) / 6
    return np.where(d == 0, 0, np.where(h < 0, h + 1, h)), np.where(v == 0, 0, d / np.where(v == 0, 1, v)), v


def color_histogram(rgb: np.ndarray) -> np.ndarray:
    h, s, v = hsv(rgb)
    cut = lambda x, n: np.minimum((x * n).astype(int), n - 1)
    bins = cut(h, H_BINS) * S_BINS * V_BINS + cut(s, S_BINS) * V_BINS + cut(v, V_BINS)
    return np.bincount(bins.ravel(), minlength=H_BINS * S_BINS * V_BINS) / max(1, bins.size)


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    m = np.cos(np.pi * (2 * np.arange(n) + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(gray: np.ndarray) -> np.ndarray:
    """Low frequencies without the mean (a zero behind), then 64 signs: above the mean of those or not."""
    h, w = gray.shape
    small = gray[np.ix_(np.arange(SIDE) * h // SIDE, np.arange(SIDE) * w // SIDE)]
    d = _dct(SIDE)
    low = (d @ small @ d.T)[:KEPT, :KEPT].ravel()
    return np.concatenate([low[1:], [0.0], np.where(low > low[1:].mean(), 1.0, -1.0)])


def edge_directions(gray: np.ndarray) -> np.ndarray:
    out = np.zeros(16)
    if min(gray.shape) > 2:
        gx, gy = gray[1:-1, 2:] - gray[1:-1, :-2], gray[2:, 1:-1] - gray[:-2, 1:-1]
        mag = np.hypot(gx, gy)
        on = mag >= EDGE_LEAST
        ang = np.arctan2(gy[on], gx[on])
        ang = np.where(ang < 0, ang + np.pi, ang)
        out[:8] = np.bincount(np.minimum((ang / np.pi * 8).astype(int), 7), mag[on], 8)
        if (energy := out[:8].sum()) > 0:
            out[:8] /= energy
            out[8] = energy / on.sum()
    out[9], out[10] = np.clip(out[0] + out[4], 0, 1), np.clip(out[2] + out[6], 0, 1)
    return out


def descriptor(rgb: np.ndarray, dim: int) -> np.ndarray:
    gray = rgb @ np.array(LUMA)
    f = np.concatenate([color_histogram(rgb), perceptual_hash(gray), edge_directions(gray)])
    f = f[:dim] if len(f) >= dim else np.concatenate([f, 0.15 * np.resize(f, dim)[len(f):]])
    return (f / (np.linalg.norm(f) or 1)).astype(np.float32)


def describe(rgb: np.ndarray, dim: int = 1024, grid: int = 3) -> dict:
    """Descriptor of an image (h, w, 3 values in 0..1) and of its grid's patches of at least 4 pixels a side."""
    h, w = rgb.shape[:2]
    patches = []
    for i in range(grid):
        for j in range(grid):
            y, x = (int(i * h / grid), int((i + 1) * h / grid)), (int(j * w / grid), int((j + 1) * w / grid))
            if y[1] - y[0] >= 4 and x[1] - x[0] >= 4:
                box = [j / grid, i / grid, 1 / grid, 1 / grid]
                patches.append({"grid_row": i, "grid_col": j, "bbox": box, "vector": descriptor(rgb[y[0] : y[1], x[0] : x[1]], dim)})
    return {"width": w, "height": h, "vector": descriptor(rgb, dim), "patches": patches}


def image_features(image: Column, dim: int = 1024, grid: int = 3, least: int = 8, most_pixels: int = 25_000_000) -> Column:
    """Features of a column of Spark's image source; null for images too small, too large or not read."""

    @F.pandas_udf(FEATURES)
    def run(s: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data in zip(s["height"], s["width"], s["nChannels"], s["data"]):
            if data is None or min(h, w) < least or h * w > most_pixels:
                out.append({"width": None, "height": None, "vector": None, "patches": None})
                continue
            px = np.frombuffer(data, np.uint8).reshape(h, w, c)
            rgb = px[..., [2, 1, 0]] if c >= 3 else np.repeat(px[..., :1], 3, axis=2)
            out.append(describe(rgb / 255.0, dim, grid))
        return pd.DataFrame(out)

    return run(image)
