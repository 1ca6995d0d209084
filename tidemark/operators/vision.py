"""Pictures: static regions, presence, perceptual hashes. NumPy on small arrays, in Arrow or grouped functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import iou

# Thresholds of region detection.
CLOSE, OPEN, LEAST_FILL, LEAST_SIDE, LEAST_AREA = 9, 3, 0.8, 0.15, 0.05
REFINE_CLOSE, REFINE_OVERLAP = 3, 0.5
BORDER_LEVEL, BORDER_LINE, LEAST_SAMPLE = 0.15, 0.5, 3
PRESENCE_RATIO, HASH_SIZE = 0.4, 16


def _spread(mask: np.ndarray, size: int, grow: bool) -> np.ndarray:
    """Dilation or erosion by a square: a running extreme along either axis. Outside counts as neither."""
    r = size // 2
    out = mask
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, constant_values=not grow)
        n = out.shape[axis]
        parts = [wide[k : k + n] if axis == 0 else wide[:, k : k + n] for k in range(2 * r + 1)]
        out = np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)
    return out


def closed(mask: np.ndarray, size: int = CLOSE) -> np.ndarray:
    return _spread(_spread(mask, size, True), size, False)


def opened(mask: np.ndarray, size: int = OPEN) -> np.ndarray:
    return _spread(_spread(mask, size, False), size, True)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected areas (0: none): each pixel takes the smallest label around it until none changes."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    big = h * w + 1
    while True:
        wide = np.pad(np.where(mask, labels, big), 1, constant_values=big)
        around = np.minimum.reduce([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)])
        new = np.where(mask, around, 0)
        root = new.ravel()
        jump = np.where(mask.ravel(), root[np.maximum(root, 1) - 1], 0).reshape(h, w)
        new = np.where(mask, np.minimum(new, np.where(jump > 0, jump, new)), 0)
        if (new == labels).all():
            return labels
        labels = new


def mask_region(mask: np.ndarray, close: int = CLOSE) -> tuple[tuple[int, int, int, int] | None, str]:
    """(x, y, width, height) of the largest area's box after closing and opening, or None, and why."""
    clean = opened(closed(mask, close))
    labels = components(clean)
    if not clean.any():
        return None, "nothing static and bright"
    ids, counts = np.unique(labels[labels > 0], return_counts=True)
    area = labels == ids[np.argmax(counts)]
    ys, xs = np.flatnonzero(area.any(axis=1)), np.flatnonzero(area.any(axis=0))
    x, y, w, h = int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)
    if area.sum() / (w * h) < LEAST_FILL:
        return None, "not a rectangle"
    if w * h < LEAST_AREA * mask.size:
        return None, "too small"
    if w < LEAST_SIDE * mask.shape[1] or h < LEAST_SIDE * mask.shape[0]:
        return None, "too narrow"
    return (x, y, w, h), "found"


def grown(brightness: np.ndarray, rect: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """A region extended line by line while at least half of a line is much nearer to the inside than to the background."""
    x, y, w, h = rect
    inside = np.zeros(brightness.shape, bool)
    inside[y : y + h, x : x + w] = True
    core = float(np.median(brightness[inside]))
    back = float(np.median(brightness[~inside])) if (~inside).any() else core
    near = brightness >= back + (core - back) * (1 - BORDER_LEVEL) if core > back else inside
    x0, y0, x1, y1 = x, y, x + w, y + h
    while y0 > 0 and near[y0 - 1, x0:x1].mean() >= BORDER_LINE:
        y0 -= 1
    while y1 < brightness.shape[0] and near[y1, x0:x1].mean() >= BORDER_LINE:
        y1 += 1
    while x0 > 0 and near[y0:y1, x0 - 1].mean() >= BORDER_LINE:
        x0 -= 1
    while x1 < brightness.shape[1] and near[y0:y1, x1].mean() >= BORDER_LINE:
        x1 += 1
    return x0, y0, x1 - x0, y1 - y0


REGION = "x int, y int, width int, height int, reason string"


def find_regions(stats: DataFrame, keys: list[str], y: str, x: str, brightness: str, static: str, closes: tuple[int, ...] = (CLOSE,)) -> DataFrame:
    """keys, attempt (from 0, if there are several sizes of closing) with region columns and reason: a grouped function over one picture's pixel statistics (a picture fits a task)."""
    names = [*keys, y, x, brightness, static]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf[y].max()) + 1, int(pdf[x].max()) + 1
        level, mask = np.zeros((h, w)), np.zeros((h, w), bool)
        level[pdf[y], pdf[x]] = pdf[brightness]
        mask[pdf[y], pdf[x]] = pdf[static]
        rows = []
        for n, size in enumerate(closes):
            rect, why = mask_region(mask, size)
            if rect:
                rect = grown(level, rect)
            rows.append(dict(zip(keys, key, strict=True)) | {"attempt": n} | dict(zip(("x", "y", "width", "height"), rect or (None,) * 4, strict=True)) | {"reason": why})
        return pd.DataFrame(rows).astype({c: "Int32" for c in ("x", "y", "width", "height")})

    kinds = ", ".join(f"{k} {dict(stats.dtypes)[k]}" for k in keys)
    made = stats.select(*names).groupBy(*keys).applyInPandas(run, f"{kinds}, attempt int, {REGION}")
    return made if len(closes) > 1 else made.drop("attempt")


def present(pixels: Column, least: float = 150.0, ratio: float = PRESENCE_RATIO) -> Column:
    """A region's pixels (array): bright enough in a large enough share. Null or empty: false."""
    bright = F.aggregate(pixels, F.lit(0), lambda n, p: n + F.when(p >= least, 1).otherwise(0))
    return F.coalesce((F.size(pixels) > 0) & (bright / F.size(pixels) >= ratio), F.lit(False))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(k)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def phash(gray: np.ndarray, size: int = HASH_SIZE) -> np.ndarray:
    """size * size bits: the low frequencies of a picture (shrunk to four times that side) above their median."""
    side = 4 * size
    ys, xs = (np.arange(side + 1) * s / side for s in gray.shape)
    total = np.pad(gray.astype(np.float64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    low_y, low_x = np.floor(ys).astype(int)[:-1], np.floor(xs).astype(int)[:-1]
    y0, y1, x0, x1 = low_y, np.maximum(np.ceil(ys).astype(int)[1:], low_y + 1), low_x, np.maximum(np.ceil(xs).astype(int)[1:], low_x + 1)
    small = (total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    c = _cosines(side, size)
    low = c @ small @ c.T
    return (low > np.median(low)).ravel()


def packed(bits: np.ndarray) -> list[int]:
    """Bits as signed 64-bit numbers."""
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def hash_pictures(df: DataFrame, pixels: str, width: str, height: str, size: int = HASH_SIZE) -> DataFrame:
    """Adds hash (array<bigint>) of gray pictures given as arrays of numbers, in Arrow batches."""
    def of(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else packed(phash(np.asarray(x, dtype=np.float64).reshape(int(b), int(a)), size)) for x, a, b in zip(p, w, h, strict=True)])

    return df.withColumn("hash", F.pandas_udf(of, "array<bigint>")(pixels, width, height))


def last_frames(frames: DataFrame, keys: list[str], time: str, n: int = 5) -> DataFrame:
    """The last n frames of each group, on which its region is looked for again."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time))
    return frames.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def enough(stats: DataFrame, size: str = "sample_size", least: int = LEAST_SAMPLE) -> DataFrame:
    """Statistics of samples large enough that 'static' means something; a region is not looked for in others."""
    return stats.where(F.col(size) >= least)


def refine_regions(groups: DataFrame, stats: DataFrame, keys: list[str], rect: str, y: str, x: str, brightness: str, static: str, closes: tuple[int, ...] = (REFINE_CLOSE, CLOSE)) -> DataFrame:
    """groups (keys, rect, ...) with rect looked for again on statistics of their last frames, and refined (false: the group's
    own stays). A weak closing is tried first, then the usual one; the first region that overlaps the group's enough counts."""
    found = find_regions(stats, keys, y, x, brightness, static, closes)
    found = found.where(F.col("x").isNotNull()).select(*keys, F.struct("attempt", F.struct("x", "y", "width", "height").alias("r")).alias("_t"))
    tries = found.groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias("_tries"))
    fits = F.filter("_tries", lambda t: iou(t["r"], F.col(rect)) >= REFINE_OVERLAP)
    best = F.get(fits, F.lit(0))["r"]
    out = groups.join(tries, keys, "left").withColumn("refined", F.coalesce(F.size(fits) > 0, F.lit(False)))
    return out.withColumn(rect, F.coalesce(best.cast(groups.schema[rect].dataType), F.col(rect))).drop("_tries")


def refined(group_rect: Column, found: Column, overlap: Column, least: float = REFINE_OVERLAP) -> Column:
    """The region found at a group's last frames if it overlaps the group's enough, else the group's."""
    return F.when(found.isNotNull() & (overlap >= least), found).otherwise(group_rect)
