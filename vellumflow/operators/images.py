"""Clean-up of grey page images: deskewing, local contrast, Sauvola thresholds.

An image is a struct of height, width and data, row by row, a byte per pixel.
Everything is numpy on whole batches of rows that Arrow brings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<height:int,width:int,data:binary>"


def _checked(image: np.ndarray) -> np.ndarray:
    if image.ndim != 2:
        raise ValueError(f"a grey image has two dimensions, not {image.ndim}")
    return image


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, by monotone chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(ps: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def skew_angle(image: np.ndarray, dark: int = 128) -> float:
    """Degrees, in (-45, 45], by which the least rectangle round the dark pixels is turned; 0 without any."""
    rows, cols = np.nonzero(_checked(image) < dark)
    if not len(rows):
        return 0.0
    first = np.unique(rows, return_index=True)[1]
    last = np.append(first[1:], len(rows)) - 1  # a row's outermost pixels suffice for the hull
    hull = _hull(np.concatenate([np.stack([cols[first], rows[first]], 1), np.stack([cols[last], rows[last]], 1)]).astype(float))
    if len(hull) < 3:
        return 0.0
    edges = np.roll(hull, -1, axis=0) - hull
    angles = np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 9))
    c, s = np.cos(angles), np.sin(angles)
    x, y = np.outer(c, hull[:, 0]) + np.outer(s, hull[:, 1]), np.outer(-s, hull[:, 0]) + np.outer(c, hull[:, 1])
    area = np.ptp(x, axis=1) * np.ptp(y, axis=1)
    turn = float(np.degrees(angles[np.argmin(area)]))
    return turn - 90 if turn > 45 else turn


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return np.where(t <= 1, near, np.where(t < 2, far, 0))


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """Turn about the centre, bicubic, edges repeated, same shape."""
    h, w = image.shape
    cy, cx, r = h // 2, w // 2, np.radians(degrees)
    y, x = np.mgrid[:h, :w]
    sx = np.cos(r) * (x - cx) - np.sin(r) * (y - cy) + cx
    sy = np.sin(r) * (x - cx) + np.cos(r) * (y - cy) + cy
    fx, fy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((h, w))
    for j in range(-1, 3):
        wy = _cubic(sy - (fy + j))
        for i in range(-1, 3):
            out += wy * _cubic(sx - (fx + i)) * image[np.clip(fy + j, 0, h - 1), np.clip(fx + i, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def deskew(image: np.ndarray) -> np.ndarray:
    angle = skew_angle(image)
    return image.copy() if angle == 0 else rotate(image, angle)


def apply_clahe(image: np.ndarray, clip_limit: float = 2.0, tiles: tuple[int, int] = (8, 8)) -> np.ndarray:
    """Histogram equalisation per tile with clipped counts, interpolated between tiles."""
    h, w = _checked(image).shape
    ty, tx = -(-h // tiles[1]), -(-w // tiles[0])
    padded = np.pad(image, ((0, ty * tiles[1] - h), (0, tx * tiles[0] - w)), mode="reflect" if min(h, w) > max(ty * tiles[1] - h, tx * tiles[0] - w) else "edge")
    maps = np.empty((tiles[1], tiles[0], 256))
    area = ty * tx
    most = max(1, int(clip_limit * area / 256))
    for j in range(tiles[1]):
        for i in range(tiles[0]):
            counts = np.bincount(padded[j * ty : (j + 1) * ty, i * tx : (i + 1) * tx].ravel(), minlength=256)
            cut = np.minimum(counts, most)
            each, rest = divmod(int((counts - cut).sum()), 256)
            cut = cut + each
            if rest:
                cut[:: max(1, 256 // rest)][:rest] += 1
            maps[j, i] = np.clip(np.rint(np.cumsum(cut) * (255.0 / area)), 0, 255)
    gy, gx = (np.arange(h) + 0.5) / ty - 0.5, (np.arange(w) + 0.5) / tx - 0.5
    y0, x0 = np.floor(gy).astype(int), np.floor(gx).astype(int)
    wy, wx = (gy - y0)[:, None], (gx - x0)[None, :]
    ya, yb = np.clip(y0, 0, tiles[1] - 1)[:, None], np.clip(y0 + 1, 0, tiles[1] - 1)[:, None]
    xa, xb = np.clip(x0, 0, tiles[0] - 1)[None, :], np.clip(x0 + 1, 0, tiles[0] - 1)[None, :]
    top = maps[ya, xa, image] * (1 - wx) + maps[ya, xb, image] * wx
    low = maps[yb, xa, image] * (1 - wx) + maps[yb, xb, image] * wx
    return np.clip(np.rint(top * (1 - wy) + low * wy), 0, 255).astype(np.uint8)


def sauvola_threshold(image: np.ndarray, window: int = 25, k: float = 0.2, spread: float = 127.5) -> np.ndarray:
    """mean * (1 + k * (deviation / spread - 1)) over a window, by summed-area tables."""
    r = window // 2
    padded = np.pad(image.astype(float), r, mode="reflect" if min(image.shape) > r else "edge")

    def window_sum(a: np.ndarray) -> np.ndarray:
        s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]

    mean = window_sum(padded) / window**2
    deviation = np.sqrt(np.maximum(window_sum(padded**2) / window**2 - mean**2, 0))
    return mean * (1 + k * (deviation / spread - 1))


def binarize_sauvola(image: np.ndarray, window_size: int = 25, k: float = 0.2) -> np.ndarray:
    """255 above the threshold, else 0."""
    _checked(image)
    if window_size % 2 == 0:
        raise ValueError(f"the window must be odd, not {window_size}")
    return np.where(image > sauvola_threshold(image, window_size, k), 255, 0).astype(np.uint8)


def preprocess_page(image: np.ndarray, sauvola_k: float = 0.2) -> dict[str, np.ndarray]:
    straight = deskew(image)
    clear = apply_clahe(straight)
    return {"original": image, "deskewed": straight, "clahe": clear, "binary": binarize_sauvola(clear, k=sauvola_k)}


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x0, y0, x1, y1 = box
    return image[y0:y1, x0:x1]


def preprocess_images(df: DataFrame, image_col: str = "image", *, sauvola_k: float = 0.2) -> DataFrame:
    """``df`` and deskewed, clahe, binary: one pass over each image; null for null images."""

    @F.pandas_udf(f"deskewed {IMAGE}, clahe {IMAGE}, binary {IMAGE}")
    def run(images: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for h, w, data in zip(images["height"], images["width"], images["data"], strict=True):
            done = {} if data is None else preprocess_page(np.frombuffer(data, np.uint8).reshape(int(h), int(w)), sauvola_k)
            rows.append({n: {"height": done[n].shape[0], "width": done[n].shape[1], "data": done[n].tobytes()} if n in done else None for n in ("deskewed", "clahe", "binary")})
        return pd.DataFrame(rows, columns=["deskewed", "clahe", "binary"])

    return df.withColumn("_done", run(F.col(image_col))).select(*df.columns, "_done.*")
