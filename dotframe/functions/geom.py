"""Boxes, centres and tiles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dotframe.params import PARAMS

# Centres of dots 1 to 6 as fractions of a cell's width and height.
DOT_OFFSETS = ((-0.28, -0.35), (-0.28, 0.0), (-0.28, 0.35), (0.28, -0.35), (0.28, 0.0), (0.28, 0.35))


def half_even(x: Column) -> Column:
    return F.rint(x)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [(cx - w / 2).alias("x0"), (cy - h / 2).alias("y0"), (cx + w / 2).alias("x1"), (cy + h / 2).alias("y1")]


def centre(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("w"), (y1 - y0).alias("h")]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes with columns {a}x0 .. {b}y1;
    boxes that only touch have 0."""
    c = lambda s, k: F.col(f"{s}{k}")
    iw = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    ih = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    area = lambda s: (c(s, "x1") - c(s, "x0")) * (c(s, "y1") - c(s, "y0"))
    inter = iw * ih
    union = area(a) + area(b) - inter
    return F.when((iw <= 0) | (ih <= 0) | (union <= 0), 0.0).otherwise(inter / union)


def distance_l1(dx: Column, dy: Column) -> Column:
    return F.abs(dx) + F.abs(dy)


def distance_l2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def inside(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return x.between(x0, x1) & y.between(y0, y1)


def frac_to_centre(box: str, img_w: Column, img_h: Column) -> list[Column]:
    b = lambda k: F.col(f"{box}.{k}")
    return [
        ((b("l") + b("r")) / 2 * img_w).alias("cx"), ((b("t") + b("b")) / 2 * img_h).alias("cy"),
        ((b("r") - b("l")) * img_w).alias("w"), ((b("b") - b("t")) * img_h).alias("h"),
    ]


def padded_box(box: str, img_w: Column, img_h: Column, pad: float = PARAMS.crop_pad) -> list[Column]:
    """Pixel box of a fractional one, grown on each side and kept in the image."""
    b = lambda k: F.col(f"{box}.{k}")
    pw, ph = (b("r") - b("l")) * img_w * pad, (b("b") - b("t")) * img_h * pad
    zero = F.lit(0.0)
    return [
        F.greatest(zero, b("l") * img_w - pw).alias("x0"), F.greatest(zero, b("t") * img_h - ph).alias("y0"),
        F.least(img_w.cast("double"), b("r") * img_w + pw).alias("x1"), F.least(img_h.cast("double"), b("b") * img_h + ph).alias("y1"),
    ]


def crop_corners(cx: Column, cy: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> list[Column]:
    """Whole-pixel crop of a padded cell: at least one pixel, inside the image."""
    px, py = w * PARAMS.crop_pad, h * PARAMS.crop_pad
    x0 = F.least(img_w - 1, F.greatest(F.lit(0), half_up(cx - w / 2 - px)))
    y0 = F.least(img_h - 1, F.greatest(F.lit(0), half_up(cy - h / 2 - py)))
    x1 = F.greatest(x0 + 1, F.least(img_w, half_up(cx + w / 2 + px)))
    y1 = F.greatest(y0 + 1, F.least(img_h, half_up(cy + h / 2 + py)))
    return [x.cast("long").alias(k) for x, k in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))]


def clipped_corners(cx: Column, cy: Column, w: Column, h: Column, img_w: Column, img_h: Column) -> list[Column]:
    """Corners clamped to the image and then truncated toward zero."""
    return [
        F.greatest(F.lit(0.0), cx - w / 2).cast("long").alias("x0"), F.greatest(F.lit(0.0), cy - h / 2).cast("long").alias("y0"),
        F.least(img_w.cast("double"), cx + w / 2).cast("long").alias("x1"), F.least(img_h.cast("double"), cy + h / 2).cast("long").alias("y1"),
    ]


def native_tile(median_w: Column) -> Column:
    return F.greatest(F.lit(float(PARAMS.min_tile)), half_even(median_w * PARAMS.tile_size / PARAMS.target_width)).cast("long")


def upscale(w: Column) -> Column:
    """Factor that brings a crop's cell to 96 pixels, never below 1."""
    return F.greatest(F.lit(1.0), F.lit(96.0) / w)


def axis_starts(size: Column, tile: Column, overlap: float = PARAMS.tile_overlap) -> Column:
    """Starts of the tiles along one axis: every stride, the last one flush."""
    stride = F.greatest(F.lit(1), tile - half_even(tile * overlap).cast("long"))
    last = F.greatest(size - tile, F.lit(0)).cast("long")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(last / stride)), lambda i: i * stride)
    short = F.element_at(steps, -1) + tile < size
    return F.when(short, F.array_append(steps, last)).otherwise(steps)


def tile_boxes(img_w: Column, img_h: Column, tile: Column, overlap: float = PARAMS.tile_overlap) -> Column:
    """Row-major array of struct(x0, y0, x1, y1); the image itself if it fits."""
    w, h = img_w.cast("long"), img_h.cast("long")

    def box(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x0"), y.alias("y0"), F.least(x + tile, w).alias("x1"), F.least(y + tile, h).alias("y1"))

    grid = F.flatten(F.transform(axis_starts(h, tile, overlap), lambda y: F.transform(axis_starts(w, tile, overlap), lambda x: box(x, y))))
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("x0"), zero.alias("y0"), w.alias("x1"), h.alias("y1")))
    return F.when((w <= tile) & (h <= tile), whole).otherwise(grid)


def letterbox(src_w: Column, src_h: Column, size: int = PARAMS.tile_size, stride: int = 32) -> list[Column]:
    """Scale, unpadded and output size and padding of an aspect-true fit."""
    scale = F.least(F.lit(float(size)) / src_h, F.lit(float(size)) / src_w)
    uw, uh = half_up(src_w * scale), half_up(src_h * scale)
    dw, dh = ((F.lit(size) - uw) % stride) / 2, ((F.lit(size) - uh) % stride) / 2
    left, top = half_up(dw - 0.1), half_up(dh - 0.1)
    return [
        scale.alias("scale"), uw.cast("long").alias("unpad_w"), uh.cast("long").alias("unpad_h"),
        left.cast("long").alias("pad_left"), top.cast("long").alias("pad_top"),
        (uw + left + half_up(dw + 0.1)).cast("long").alias("out_w"), (uh + top + half_up(dh + 0.1)).cast("long").alias("out_h"),
    ]


def shape_scores(area: Column, perimeter: Column, w: Column, h: Column) -> list[Column]:
    """Share of the bounding box that is filled, and roundness; 0 if degenerate."""
    return [
        F.when(w * h > 0, area / (w * h)).otherwise(0.0).alias("rectangularity"),
        F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter)).otherwise(0.0).alias("circularity"),
    ]


def conf_colour(conf: Column, rescued: Column) -> list[Column]:
    """Red to green by confidence; rescued cells are cyan."""
    return [
        F.when(rescued, 0).otherwise((255 * (1 - conf)).cast("int")).alias("red"),
        F.when(rescued, 220).otherwise((255 * conf).cast("int")).alias("green"),
        F.when(rescued, 220).otherwise(0).alias("blue"),
    ]
