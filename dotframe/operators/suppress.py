"""Overlap suppression, tile edges and containers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.functions.geom import corners, inside, iou, shape_scores
from dotframe.operators.near import meet
from dotframe.params import PARAMS
from dotframe.session import spread


def with_corners(cells: DataFrame) -> DataFrame:
    return cells.select("*", *corners(*(F.col(c) for c in ("cx", "cy", "w", "h"))))


def pairs(cells: DataFrame, threshold: float, key: str = "page_id") -> DataFrame:
    """Pairs of cells of one page with an IoU above the threshold, the one
    that suppresses first: (key, hi, lo, iou)."""
    boxed = with_corners(cells).select(key, "det_id", "conf", "cx", "cy", "w", "h", "x0", "y0", "x1", "y1")
    side = lambda p, k: boxed.select(F.col(key).alias(k), *[F.col(c).alias(p + c) for c in boxed.columns[1:]])
    first = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_det_id") < F.col("b_det_id")))
    # Boxes that overlap have centres nearer than the widest and highest box.
    met = meet(side("a_", key), side("b_", "_k"), first, (F.col("a_cx"), F.col("a_cy")), (F.col("a_w"), F.col("a_h")), ("b_cx", "b_cy"), key=key)
    return (
        met.withColumn("iou", iou("a_", "b_")).where(F.col("iou") > threshold)
        .select(key, F.col("a_det_id").alias("hi"), F.col("b_det_id").alias("lo"), "iou")
    )


def row_context(conflicts: DataFrame, cells: DataFrame, reliable: DataFrame) -> DataFrame:
    """Per conflict (page_id, hi, lo) the number n_row of other reliable cells
    on the row of the two: within 0.55 of the larger height of their middle."""
    at = lambda k: cells.select("page_id", F.col("det_id").alias(k), F.col("cy").alias(f"_{k}_cy"), F.col("h").alias(f"_{k}_h"))
    ctx = conflicts.join(at("hi"), ["page_id", "hi"]).join(at("lo"), ["page_id", "lo"])
    middle, band = (F.col("_hi_cy") + F.col("_lo_cy")) / 2, F.greatest("_hi_h", "_lo_h") * PARAMS.line_band
    others = reliable.select(F.col("page_id").alias("_k"), F.col("det_id").alias("_other"), F.col("cy").alias("_y"), F.lit(0.0).alias("_x"))
    row = (F.abs(F.col("_y") - middle) < band) & ~F.col("_other").isin(F.col("hi"), F.col("lo"))
    met = meet(ctx, others, row, (F.lit(0.0), middle), (F.lit(1.0), band), ("_x", "_y"), "left")
    return met.groupBy("page_id", "hi", "lo").agg(F.count("_other").alias("n_row"))


def nms(cells: DataFrame, threshold: float = PARAMS.tile_dedupe_iou, max_det: int | None = None, key: str = "page_id") -> DataFrame:
    """Greedy suppression in the order of conf (ties: det_id): a cell goes if a
    surviving one before it overlaps it more than the threshold. Only cells in
    conflict are folded; all others survive without being looked at."""
    found = pairs(cells, threshold, key)
    conf = cells.select(key, F.col("det_id").alias("lo"), "conf")
    against = found.groupBy(key, "lo").agg(F.collect_list("hi").alias("his")).join(conf, [key, "lo"])
    rows = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("c"), F.col("lo").alias("id"), "his")))
    dead = F.aggregate(
        rows, F.expr("cast(array() as array<bigint>)"),
        lambda dead, e: F.when(F.exists(e["his"], lambda x: ~F.array_contains(dead, x)), F.array_append(dead, e["id"].cast("bigint"))).otherwise(dead),
    )
    gone = against.groupBy(key).agg(dead.alias("dead")).select(key, F.explode("dead").alias("det_id"))
    kept = cells.join(gone, [key, "det_id"], "left_anti")
    if max_det is None:
        return kept
    best = W.partitionBy(key).orderBy(F.col("conf").desc(), "det_id")
    return kept.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max_det).drop("_r")


def tile_edge_filter(cells: DataFrame, margin: float = PARAMS.tile_edge_margin) -> DataFrame:
    """Drops cells (in page pixels, with their tile tx0, ty0, tx1, ty1, the
    tile size and img_w, img_h) that an inner edge of their tile may cut."""
    c = with_corners(cells)
    m = F.col("tile") * margin
    cut = (
        ((F.col("x0") - F.col("tx0") < m) & (F.col("tx0") > 0)) | ((F.col("x1") > F.col("tx1") - m) & (F.col("tx1") < F.col("img_w")))
        | ((F.col("y0") - F.col("ty0") < m) & (F.col("ty0") > 0)) | ((F.col("y1") > F.col("ty1") - m) & (F.col("ty1") < F.col("img_h")))
    )
    return c.where(~cut).select(*cells.columns)


def containers_with_cells(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """Boxes (page_id, bx0 .. by1) that hold the centre of a cell."""
    c = F.col
    some = cells.select(c("page_id").alias("_k"), c("cx").alias("_x"), c("cy").alias("_y"))
    hit = inside(c("_x"), c("_y"), *(c(k) for k in ("bx0", "by0", "bx1", "by1")))
    middle, half = ((c("bx0") + c("bx1")) / 2, (c("by0") + c("by1")) / 2), ((c("bx1") - c("bx0")) / 2, (c("by1") - c("by0")) / 2)
    return meet(boxes, some, hit, middle, half, ("_x", "_y"), "left_semi")


def fair_contours(contours: DataFrame) -> DataFrame:
    """Contours (area, perimeter, w, h, whole: the photo's area) of a fair size
    that fill their bounding box or are round."""
    c = F.col
    scored = contours.select("*", *shape_scores(c("area"), c("perimeter"), c("w"), c("h")))
    size = (c("area") / c("whole")).between(PARAMS.contour_min_area, PARAMS.contour_max_area)
    return scored.where(size & (F.greatest("rectangularity", "circularity") >= PARAMS.contour_min_shape))


def large_enough(boxes: DataFrame) -> DataFrame:
    """Containers (bx0 .. by1) that can hold a cell at all."""
    c = F.col
    return boxes.where((c("bx1") - c("bx0") >= PARAMS.container_min_side) & (c("by1") - c("by0") >= PARAMS.container_min_side))


def _settle(cells: np.ndarray, pair: np.ndarray, alive: np.ndarray) -> int | None:
    """Which of two overlapping cells fits its row's grid better; by confidence
    without a row, None if neither fits. Columns: cx cy w h conf. Both are
    scored at once, against slots of the row's pitch from its middle phase."""
    two = cells[pair]
    more_sure = int(pair[0] if two[0, 4] >= two[1, 4] else pair[1])
    off_line = np.abs(cells[:, 1] - two[:, 1].mean())
    row = alive & (off_line < two[:, 3].max() * PARAMS.line_band) & (cells[:, 4] >= PARAMS.high_conf)
    row[pair] = False
    if not row.any():
        return more_sure
    x = np.sort(cells[row, 0])
    pitch = np.median(np.diff(x)) if x.size > 1 else 1.7 * two[:, 2].max()
    if not pitch > 0:
        return None

    def from_slot(v: np.ndarray, origin: float) -> np.ndarray:
        return v - origin - pitch * np.floor((v - origin) / pitch + 0.5)

    phase = x[0] + np.median(from_slot(x, x[0]))
    off = np.abs(from_slot(two[:, 0], phase))
    cost = np.where(off <= PARAMS.slot_tolerance * pitch, off + np.abs(two[:, 1] - np.median(cells[row, 1])), np.inf)
    return int(pair[cost.argmin()]) if np.isfinite(cost).any() else None


def surviving(cells: np.ndarray, threshold: float = PARAMS.residual_iou) -> np.ndarray:
    """Mask of the cells left after the pair with the largest IoU above the
    threshold has been settled again and again; undecidable pairs stay."""
    n = len(cells)
    half = cells[:, 2:4] / 2
    lo, hi = cells[:, :2] - half, cells[:, :2] + half
    order = np.argsort(lo[:, 0], kind="stable")
    reach = np.searchsorted(lo[order, 0], hi[order, 0])
    found = []
    for k in range(n):  # neighbours along x only
        i = order[k]
        js = order[k + 1 : reach[k]]
        side = np.minimum(hi[i], hi[js]) - np.maximum(lo[i], lo[js])
        inter = np.where((side > 0).all(axis=1), side.prod(axis=1), 0.0)
        value = inter / np.maximum(cells[i, 2] * cells[i, 3] + cells[js, 2] * cells[js, 3] - inter, 1e-12)
        found += [(-v, min(i, j), max(i, j)) for v, j in zip(value, js) if v > threshold]
    alive = np.ones(n, dtype=bool)
    for _, a, b in sorted(found):
        if alive[a] and alive[b]:
            best = _settle(cells, np.array([a, b]), alive)
            if best is not None:
                alive[b if best == a else a] = False
    return alive


def resolve_overlaps(cells: DataFrame, threshold: float = PARAMS.residual_iou) -> DataFrame:
    """Cells that survive the settling of residual overlaps, per page."""
    cols = ["page_id", "det_id", "cx", "cy", "w", "h", "conf"]

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("det_id", ignore_index=True)
        return pdf[surviving(pdf[["cx", "cy", "w", "h", "conf"]].to_numpy(float), threshold)]

    some = cells.select(*cols)
    return spread(some, "page_id").groupBy("page_id").applyInPandas(page, some.schema)
