"""Photo enhancement and the search for containers (labels, plates, boxes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from dotframe.operators.kernels import grey
from dotframe.params import PARAMS

CONTAINERS = "photo_id long, x0 int, y0 int, x1 int, y1 int, area double, rectangularity double, circularity double"


def equalise(lightness: np.ndarray, clip: float = 3.0, grid: tuple[int, int] = (16, 16)) -> np.ndarray:
    """Contrast-limited equalisation of an 8-bit channel: a clipped histogram
    per tile gives a lookup table, and every pixel blends those of the four
    nearest tiles."""
    h, w = lightness.shape
    gy, gx = (min(g, n) for g, n in zip(grid, (h, w)))
    rows, cols = (np.minimum(np.arange(n) * g // n, g - 1) for n, g in ((h, gy), (w, gx)))
    value = np.clip(lightness, 0, 255).astype(np.intp)
    tile = rows[:, None] * gx + cols
    hist = np.bincount((tile * 256 + value).ravel(), minlength=gy * gx * 256).reshape(-1, 256).astype(float)
    size = hist.sum(axis=1, keepdims=True)
    top = np.maximum(1, clip * size / 256)
    over = np.maximum(hist - top, 0).sum(axis=1, keepdims=True)
    tables = (np.cumsum(np.minimum(hist, top) + over / 256, axis=1) / size * 255).reshape(gy, gx, 256)

    def blend(n: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * g / n - 0.5, 0, g - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, g - 1), at - lo

    (a, b, fy), (c, d, fx) = blend(h, gy), blend(w, gx)
    look = lambda r, k: tables[r[:, None], k[None, :], value]
    upper = look(a, c) * (1 - fx) + look(a, d) * fx
    lower = look(b, c) * (1 - fx) + look(b, d) * fx
    return np.rint(upper * (1 - fy[:, None]) + lower * fy[:, None])


def edges(image: np.ndarray, sigma: float = 0.33) -> np.ndarray:
    """Edge mask with thresholds around the median: gradient maxima above the
    upper one, and those above the lower one that touch them."""
    middle = float(np.median(image))
    low, high = int(max(0, (1 - sigma) * middle)), int(min(255, (1 + sigma) * middle))
    p = np.pad(image.astype(float), 1, mode="edge")
    smooth = lambda m, ax: np.apply_along_axis(lambda v: np.convolve(v, (1, 2, 1), "valid"), ax, m)
    gx = smooth(p[:, 2:] - p[:, :-2], 0)
    gy = smooth(p[2:] - p[:-2], 1)
    size = np.abs(gx) + np.abs(gy)
    q = np.pad(size, 1)
    at = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    flat, steep = np.abs(gy) < 0.4142 * np.abs(gx), np.abs(gy) > 2.4142 * np.abs(gx)
    falls = gx * gy > 0
    before = np.select([flat, steep, falls], [at(0, -1), at(-1, 0), at(-1, -1)], at(-1, 1))
    after = np.select([flat, steep, falls], [at(0, 1), at(1, 0), at(1, 1)], at(1, -1))
    peak = (size > before) & (size >= after)
    weak, strong = peak & (size > low), peak & (size > high)
    of = regions(weak)
    return weak & np.isin(of, np.unique(of[strong]))


def dilate(mask: np.ndarray, times: int = 2) -> np.ndarray:
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = np.logical_or.reduce([p[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)])
    return mask


def regions(mask: np.ndarray) -> np.ndarray:
    """Number of each pixel's 8-connected region from 1, 0 outside: smallest
    neighbouring label until nothing changes, with pointer jumping."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        p = np.pad(np.where(mask, label, big), 1, constant_values=big)
        least = np.minimum.reduce([p[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3)])
        new = np.where(mask, least, 0)
        flat = np.concatenate([[0], new.ravel()])
        new = np.where(mask, flat[new], 0)
        if np.array_equal(new, label):
            return np.unique(label, return_inverse=True)[1].reshape(mask.shape) + (0 if not mask.all() else 1)
        label = new


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask and what it encloses."""
    outside = ~np.pad(mask, 1)
    reach = np.zeros_like(outside)
    reach[0] = True
    while True:
        p = np.pad(reach, 1)
        grown = outside & (p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:])
        if np.array_equal(grown, reach):
            return ~reach[1:-1, 1:-1]
        reach = grown


def containers(image: np.ndarray) -> list[tuple]:
    """Candidate boxes (x0, y0, x1, y1, area, rectangularity, circularity) of a
    grey photo, largest first: closed outlines of a fair size that fill their
    bounding box or are round, each overlapping no larger one too much."""
    of = regions(dilate(edges(image)))
    found = []
    for k in range(1, int(of.max()) + 1):
        ys, xs = np.nonzero(of == k)
        x0, y0, x1, y1 = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1
        if (x1 - x0) * (y1 - y0) < PARAMS.contour_min_area * image.size:
            continue
        solid = filled(of[y0:y1, x0:x1] == k)
        area = float(solid.sum())
        p = np.pad(solid, 1)
        rim = solid & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
        perimeter = float(rim.sum())
        rect, circ = area / ((x1 - x0) * (y1 - y0)), min(1.0, 4 * np.pi * area / perimeter**2) if perimeter else 0.0
        inside = PARAMS.contour_min_area <= area / image.size <= PARAMS.contour_max_area
        if inside and max(rect, circ) >= PARAMS.contour_min_shape:
            found.append((x0, y0, x1, y1, area, rect, circ))
    kept: list[tuple] = []
    for box in sorted(found, key=lambda b: -b[4]):
        if all(_overlap(box, k) <= PARAMS.container_merge_iou for k in kept):
            kept.append(box)
    return kept


def _overlap(a: tuple, b: tuple) -> float:
    iw, ih = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if iw <= 0 or ih <= 0:
        return 0.0
    return iw * ih / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - iw * ih)


def find_containers(photos: DataFrame) -> DataFrame:
    """Containers of photos (photo_id, image as rows of grey or RGB pixels)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, im in zip(pdf["photo_id"], pdf["image"]):
                a = np.array([[np.asarray(x) for x in r] for r in im], dtype=float)
                rows += [(k, *b) for b in containers(grey(a) if a.ndim == 3 else a)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTAINERS.split(", ")])

    return photos.select("photo_id", "image").mapInPandas(run, CONTAINERS)
