"""Passes that look again where a cell ought to be."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.operators import kernels, photo
from dotframe.operators.layout import indicator_targets, line_groups
from dotframe.operators.recover import not_near_known
from dotframe.params import PARAMS

PLACE = ("ex", "ey", "w", "h")
CELL = ("page_id", "det_id", "cx", "cy", "w", "h", "conf", "bits", "rescued")


def _reading(image: np.ndarray, place, model) -> tuple | None:
    """What the detector makes of a place: of all contrasts of its enlarged
    surroundings the most confident find close to it, the first of equals."""
    ex, ey, w, h = (place[k] for k in PLACE)
    rows, cols = image.shape[:2]
    x0, x1 = max(0, int(ex - 2 * w)), min(cols, int(ex + 2 * w))
    y0, y1 = max(0, int(ey - 1.5 * h)), min(rows, int(ey + 1.5 * h))
    if x1 <= x0 or y1 <= y0:
        return None
    part, scale = image[y0:y1, x0:x1].astype(float), max(1.0, 96.0 / w)
    shape = max(1, int((y1 - y0) * scale)), max(1, int((x1 - x0) * scale))
    seen = []
    for c in photo.CONTRASTS:
        f = photo.found(model, kernels.resize(kernels.contrast(part, c), *shape), PARAMS.crop_conf, 20)
        off = np.abs(f[:, 0] - (ex - x0) * scale) + np.abs(f[:, 1] - (ey - y0) * scale)
        seen.append(f[off < 0.6 * w * scale])
    every = np.concatenate(seen)
    if not len(every):
        return None
    best = every[int(every[:, 4].argmax())]
    return float(ex), float(ey), float(w), float(h), float(best[4]), photo.bits_of(best[5])


def crop_recovery(photos: DataFrame, places: DataFrame, open_model: Callable) -> DataFrame:
    """Cells found at places (page_id, ex, ey, w, h) by a search over
    contrasts: cx and cy are the place's."""
    got = photo.look_at(photos, places, PLACE, _reading, "cx double, cy double, w double, h double, conf double, bits string", open_model)
    return got.where(F.col("conf") >= PARAMS.crop_conf).withColumn("rescued", F.lit(True))


def page_threshold(photos: DataFrame, cells: DataFrame) -> DataFrame:
    """(page_id, threshold): how strong a dot must stand out on each page, by
    the raised dots of its reliable cells."""

    def signals(image: np.ndarray, place, _) -> tuple:
        s = kernels.dot_strength(kernels.grey(image.astype(float)), *(place[k] for k in ("cx", "cy", "w", "h")))
        return ([float(x) for x in s], place["bits"])

    sure = cells.where(F.col("conf") >= PARAMS.high_conf)
    each = photo.look_at(photos, sure, ("cx", "cy", "w", "h", "bits"), signals, "strengths array<double>, bits string")
    dots = each.select("page_id", "bits", F.posexplode("strengths").alias("_at", "strength")).withColumn("present", F.expr("substring(bits, _at + 1, 1) = '1'"))
    return kernels.dot_threshold(dots, "page_id")


def gap_recovery(photos: DataFrame, places: DataFrame, known: DataFrame, thresholds: DataFrame, open_model: Callable) -> DataFrame:
    """Cells at empty places within lines (page_id, ex, ey, w, h): moved to
    where the dots stand out most, left out where a known cell is near or fewer
    than two dots stand out (a word space), then read as in crop_recovery."""

    def snapped(image: np.ndarray, place, _) -> tuple | None:
        grey = kernels.grey(image.astype(float))
        x, y, _, _ = kernels.snap(grey, *(place[k] for k in PLACE))
        if not kernels.cell_present(kernels.dot_strength(grey, x, y, place["w"], place["h"]), place["threshold"]):
            return None
        return x, y, float(place["w"]), float(place["h"])

    at = places.join(thresholds, "page_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(PARAMS.default_dot_threshold)))
    there = photo.look_at(photos, at, (*PLACE, "threshold"), snapped, "ex double, ey double, w double, h double")
    return crop_recovery(photos, not_near_known(there, known), open_model)


def indicator_recovery(photos: DataFrame, cells: DataFrame, open_model: Callable) -> DataFrame:
    """Cells found right after indicators whose partner is missing."""
    return crop_recovery(photos, indicator_targets(line_groups(cells)).select("page_id", *PLACE), open_model)


def local_retry(photos: DataFrame, clusters: DataFrame, open_model: Callable, known: DataFrame) -> DataFrame:
    """Cells of high confidence on an equalised patch around each small cluster
    (page_id, lo_x, lo_y, hi_x, hi_y: its bounds with a margin), inside those
    bounds and at no whole pixel where a known cell is."""

    names = ("cx", "cy", "w", "h", "conf", "bits")

    def look(image: np.ndarray, place, model) -> tuple:
        lo_x, lo_y, hi_x, hi_y = (place[k] for k in ("lo_x", "lo_y", "hi_x", "hi_y"))
        x0, y0 = max(0, int(lo_x)), max(0, int(lo_y))
        part = image[y0 : int(hi_y), x0 : int(hi_x)]
        rows = photo.found(model, photo.equalised(part, 4.0, (4, 4)), PARAMS.high_conf).tolist() if part.size else []
        cells = [(x + x0, y + y0, w, h, c, photo.bits_of(p)) for x, y, w, h, c, p in rows]
        return ([dict(zip(names, c)) for c in cells if lo_x <= c[0] <= hi_x and lo_y <= c[1] <= hi_y],)

    out = "cells array<struct<cx: double, cy: double, w: double, h: double, conf: double, bits: string>>"
    got = photo.look_at(photos, clusters, ("lo_x", "lo_y", "hi_x", "hi_y"), look, out, open_model)
    new = got.select("page_id", F.explode("cells").alias("_c")).select("page_id", "_c.*").withColumn("_x", F.rint("cx")).withColumn("_y", F.rint("cy"))
    at = known.select("page_id", F.rint("cx").alias("_x"), F.rint("cy").alias("_y")).distinct()
    first = F.max_by(F.struct(*names), F.struct("conf", "cx", "cy")).alias("_b")
    return new.join(at, ["page_id", "_x", "_y"], "left_anti").groupBy("page_id", "_x", "_y").agg(first).select("page_id", "_b.*").withColumn("rescued", F.lit(True))
