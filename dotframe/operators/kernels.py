"""Pixel kernels over small grey or RGB patches held as arrays of rows.

Each runs on Arrow batches in numpy; the geometry around them stays in
column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dotframe.functions.geom import DOT_OFFSETS
from dotframe.params import PARAMS

SAMPLE_RADIUS = 0.10
# Channel means and deviations of the classifier's training.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def paper_levels(grey: np.ndarray, cx: float, cy: float, w: float, h: float) -> tuple[float, float] | None:
    """25th and 75th percentile of the cell's pixels; None if it has none."""
    rows, cols = grey.shape
    part = grey[max(0, int(cy - h / 2)) : min(rows, int(cy + h / 2)), max(0, int(cx - w / 2)) : min(cols, int(cx + w / 2))]
    return tuple(np.percentile(part, (25, 75))) if part.size else None


def _windows(grey: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, range) of the square of 2r pixels around every place where it
    fits: row y - r of the result is for centre y."""
    squares = np.lib.stride_tricks.sliding_window_view(grey.astype(float), (2 * r, 2 * r))
    return squares.mean(axis=(2, 3)), squares.max(axis=(2, 3)) - squares.min(axis=(2, 3))


def dot_strengths(grey: np.ndarray, xs: np.ndarray, ys: np.ndarray, w: float, h: float) -> np.ndarray:
    """Six signals of a cell at each of the given centres: the largest of
    brighter than paper, darker than paper and contrast, in the patch at each
    dot; 0 where the patch leaves the image, and where no pixel is the cell's.
    Patches of all centres are taken from one table of windows."""
    rows, cols = grey.shape
    r = max(2, int(min(w, h) * SAMPLE_RADIUS * 1.5))
    out = np.zeros((len(xs), 6))
    level = [paper_levels(grey, x, y, w, h) for x, y in zip(xs, ys)]
    some = np.array([p is not None for p in level], dtype=bool)
    if not some.any() or rows < 2 * r or cols < 2 * r:
        return out
    paper = np.array([p or (0.0, 0.0) for p in level])
    dx, dy = np.array(DOT_OFFSETS).T
    at_x, at_y = np.trunc(xs[:, None] + dx * w).astype(int), np.trunc(ys[:, None] + dy * h).astype(int)
    ok = some[:, None] & (at_x >= r) & (at_x < cols - r) & (at_y >= r) & (at_y < rows - r)
    if not ok.any():
        return out
    y0, y1, x0, x1 = at_y[ok].min() - r, at_y[ok].max() + r, at_x[ok].min() - r, at_x[ok].max() + r
    mean, spread = _windows(grey[y0:y1, x0:x1], r)
    k, dot = np.nonzero(ok)
    m, s = (v[at_y[ok] - r - y0, at_x[ok] - r - x0] for v in (mean, spread))
    out[k, dot] = np.max([m - paper[k, 0], paper[k, 1] - m, s], axis=0)
    return out


def dot_strength(grey: np.ndarray, cx: float, cy: float, w: float, h: float) -> np.ndarray:
    return dot_strengths(grey, np.array([cx], dtype=float), np.array([cy], dtype=float), w, h)[0]


def snap(grey: np.ndarray, ex: float, ey: float, w: float, h: float) -> tuple[float, float, float, float]:
    """Best centre near (ex, ey): the offset, row by row, whose six signals
    have the largest sum (the first of equals); with that sum and their peak."""
    step = max(2, int(min(w, h) * 0.06))
    along = lambda reach: np.arange(-reach, reach + 1, step)
    dy, dx = (v.ravel() for v in np.meshgrid(along(int(h * 0.15)), along(int(w * 0.20)), indexing="ij"))
    signals = dot_strengths(grey, ex + dx, ey + dy, w, h)
    total = signals.sum(axis=1)
    k = int(total.argmax())
    return float(ex + dx[k]), float(ey + dy[k]), float(total[k]), float(signals[k].max())


def cell_present(signals: np.ndarray, threshold: float, least: int = 2) -> bool:
    """Whether so many dots stand out."""
    return int((signals > threshold).sum()) >= least


def resize(src: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Bilinear with half-pixel centres, clamped at the edges."""

    def axis(n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n_out) + 0.5) * (n_in / n_out) - 0.5, 0, n_in - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, n_in - 1), at - lo

    (y0, y1, wy), (x0, x1, wx) = axis(src.shape[0], out_h), axis(src.shape[1], out_w)
    tail = (1,) * (src.ndim - 2)
    wx, wy = wx.reshape(1, -1, *tail), wy.reshape(-1, 1, *tail)
    upper = src[y0][:, x0] + (src[y0][:, x1] - src[y0][:, x0]) * wx
    lower = src[y1][:, x0] + (src[y1][:, x1] - src[y1][:, x0]) * wx
    return upper + (lower - upper) * wy


def planar(rgb: np.ndarray, standardise: bool = False) -> np.ndarray:
    """(h, w, 3) in 0..255 to (3, h, w) in 0..1, standardised on request."""
    out = np.moveaxis(rgb / 255.0, -1, 0)
    if standardise:
        out = (out - np.reshape(CHANNEL_MEAN, (3, 1, 1))) / np.reshape(CHANNEL_STD, (3, 1, 1))
    return out


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luma of an RGB image."""
    return rgb @ np.array([0.299, 0.587, 0.114])


def contrast(rgb: np.ndarray, factor: float) -> np.ndarray:
    """Blend with the mean grey, factor 1 leaving the image as it is."""
    mean = int(grey(rgb).mean() + 0.5)
    return np.clip(mean + (rgb - mean) * factor, 0, 255)


def letterboxed(rgb: np.ndarray, size: int = PARAMS.tile_size, stride: int = 32, pad: float = 114.0) -> np.ndarray:
    """Image fitted into ``size``, padded to a multiple of the stride only."""
    h, w = rgb.shape[:2]
    scale = min(size / h, size / w)
    up = lambda x: int(np.floor(x + 0.5))
    uh, uw = up(h * scale), up(w * scale)
    dh, dw = ((size - uh) % stride) / 2, ((size - uw) % stride) / 2
    out = np.full((uh + up(dh - 0.1) + up(dh + 0.1), uw + up(dw - 0.1) + up(dw + 0.1), rgb.shape[2]), pad)
    out[up(dh - 0.1) : up(dh - 0.1) + uh, up(dw - 0.1) : up(dw - 0.1) + uw] = resize(rgb, uh, uw)
    return out


def classifier_crop(rgb: np.ndarray, cx: float, cy: float, w: float, h: float, size: int = 64) -> np.ndarray:
    """Padded, clamped crop of a cell, resized and standardised."""
    up = lambda x: int(np.floor(x + 0.5))
    rows, cols = rgb.shape[:2]
    px, py = w * PARAMS.crop_pad, h * PARAMS.crop_pad
    x0, y0 = min(cols - 1, max(0, up(cx - w / 2 - px))), min(rows - 1, max(0, up(cy - h / 2 - py)))
    x1, y1 = max(x0 + 1, min(cols, up(cx + w / 2 + px))), max(y0 + 1, min(rows, up(cy + h / 2 + py)))
    return planar(resize(rgb[y0:y1, x0:x1].astype(float), size, size), standardise=True)


def _images(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    for rows in pdf["image"]:
        yield np.array([np.asarray(r, dtype=float) for r in rows])


def dot_signals(patches: DataFrame, key: str) -> DataFrame:
    """(key, dot 1..6, strength) of patches with image, cx, cy, w, h."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = [dot_strength(im, *xs) for im, xs in zip(_images(pdf), pdf[["cx", "cy", "w", "h"]].to_numpy(float))]
            yield pd.DataFrame({key: pdf[key], "signals": s})

    got = patches.select(key, "image", "cx", "cy", "w", "h").mapInPandas(run, T.StructType().add(patches.schema[key]).add("signals", T.ArrayType(T.DoubleType())))
    return got.select(key, F.posexplode("signals").alias("dot", "strength")).withColumn("dot", F.col("dot") + 1)


def snapped(patches: DataFrame, key: str) -> DataFrame:
    """(key, sx, sy, total, peak) of the snap search of each patch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            s = [snap(im, *xs) for im, xs in zip(_images(pdf), pdf[["cx", "cy", "w", "h"]].to_numpy(float))]
            yield pd.DataFrame(s, columns=["sx", "sy", "total", "peak"]).assign(**{key: pdf[key].to_numpy()})[[key, "sx", "sy", "total", "peak"]]

    schema = T.StructType().add(patches.schema[key])
    for c in ("sx", "sy", "total", "peak"):
        schema = schema.add(c, "double")
    return patches.select(key, "image", "cx", "cy", "w", "h").mapInPandas(run, schema)


def resized(patches: DataFrame, key: str, out_h: int, out_w: int) -> DataFrame:
    """(key, y, x, value) of bilinearly resized grey patches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        y, x = np.divmod(np.arange(out_h * out_w), out_w)
        for pdf in it:
            for k, im in zip(pdf[key], _images(pdf)):
                yield pd.DataFrame({key: k, "y": y, "x": x, "value": resize(im, out_h, out_w).ravel()})

    schema = T.StructType().add(patches.schema[key]).add("y", "integer").add("x", "integer").add("value", "double")
    return patches.select(key, "image").mapInPandas(run, schema)


def normalised(patches: DataFrame, key: str) -> DataFrame:
    """(key, channel, y, x, value) of grey patches as the classifier takes
    them: grey in all three channels, planar and standardised."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for k, im in zip(pdf[key], _images(pdf)):
                out = planar(np.repeat(im[:, :, None], 3, axis=2), standardise=True)
                channel, y, x = (a.ravel() for a in np.indices(out.shape))
                yield pd.DataFrame({key: k, "channel": channel, "y": y, "x": x, "value": out.ravel()})

    schema = T.StructType().add(patches.schema[key]).add("channel", "integer").add("y", "integer").add("x", "integer").add("value", "double")
    return patches.select(key, "image").mapInPandas(run, schema)


def present_cells(signals: DataFrame, key: str, threshold: float, least: int = 2) -> DataFrame:
    """(key, present) of dot signals: see cell_present."""
    return signals.groupBy(key).agg((F.count_if(F.col("strength") > threshold) >= least).alias("present"))


def pixel_levels(patches: DataFrame, key: str) -> DataFrame:
    """(key, paper_low, paper_high): quartiles of a patch's pixels."""
    px = patches.select(key, F.explode(F.flatten("image")).alias("_v"))
    q = lambda p, n: F.percentile("_v", F.lit(p)).alias(n)
    return px.groupBy(key).agg(q(0.25, "paper_low"), q(0.75, "paper_high"))


def contrasted(patches: DataFrame, key: str, factor: float) -> DataFrame:
    """(key, y, x, value) of grey patches with their contrast changed, as
    ``contrast`` does it: about the whole number nearest to their mean."""
    px = patches.select(key, F.posexplode("image").alias("y", "_row")).select(key, "y", F.posexplode("_row").alias("x", "_v"))
    mean = px.groupBy(key).agg(F.floor(F.avg("_v") + 0.5).alias("_m"))
    changed = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("_m") + (F.col("_v") - F.col("_m")) * factor))
    return px.join(mean, key).select(key, "y", "x", changed.alias("value"))


def dot_threshold(signals: DataFrame, by: str) -> DataFrame:
    """Per group: 25th percentile of the strengths of present dots, at least
    5, and 20 without any. ``present`` tells the dots."""
    q = F.percentile(F.when(F.col("present"), F.col("strength")), F.lit(0.25))
    return signals.groupBy(by).agg(
        F.coalesce(F.greatest(q, F.lit(PARAMS.min_dot_threshold)), F.lit(PARAMS.default_dot_threshold)).alias("threshold")
    )
