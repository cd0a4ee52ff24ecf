"""Cutting pages that are taller than a limit at gaps between lines of cells.

A page is handled as a long strip of pixel rows that no task loads whole.
Ranges of 64 rows are examined apart from each other: each cell marks, in every
range it reaches (a cell over a range's end is seen by both, the halo), the
cut positions it crosses, as bits of a 64-bit mask; masks of a range combine
by OR. Stitched in order they are the page's boundary table, whose running
offsets give the pieces without the cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = 64


def usable_boxes(cells: DataFrame) -> DataFrame:
    """(page_id, t, b) of boxes with 0 <= l < r <= 1 and 0 <= t < b <= 1."""
    box = F.col("frac_bbox")
    ok = (
        (box["l"] >= 0) & (box["l"] < box["r"]) & (box["r"] <= 1)
        & (box["t"] >= 0) & (box["t"] < box["b"]) & (box["b"] <= 1)
        & F.col("page_id").isNotNull()
    )
    # NaN sorts above every number, so r <= 1 and b <= 1 exclude it.
    return cells.where(ok).select("page_id", box["t"].alias("t"), box["b"].alias("b"))


def page_extents(cells: DataFrame, page_images: DataFrame, limits: DataFrame) -> DataFrame:
    """Per page with a usable box: top and bottom as fractions, img_h, the
    source's limits and whether its text is taller than max_piece_px. Pages
    that page_images lacks, or whose source has no limit, are not cut."""
    extent = usable_boxes(cells).groupBy("page_id").agg(F.min("t").alias("top"), F.max("b").alias("bottom"))
    of_page = page_images.groupBy("page_id").agg(F.min("source").alias("source"), F.min("img_h").alias("img_h"))
    of_source = limits.groupBy("source").agg(
        F.min("max_piece_px").alias("max_piece_px"), F.max(F.coalesce("overlap_px", F.lit(0))).alias("overlap_px")
    )
    return (
        extent.join(of_page, "page_id")
        .join(of_source, "source", "left")
        .withColumn("too_tall", F.coalesce(F.expr("(bottom - top) * img_h > max_piece_px"), F.lit(False)))
    )


def _masks(cells: DataFrame, tall: DataFrame) -> DataFrame:
    """(page_id, ranges: [(range, mask)]) of the cut positions that cells cross.
    Cutting at row y crosses a cell with t * img_h < y < b * img_h."""
    lo, hi = F.floor(F.col("t") * F.col("img_h")) + 1, F.ceil(F.col("b") * F.col("img_h")) - 1
    marked = (
        usable_boxes(cells)
        .join(tall.select("page_id", "img_h"), "page_id")
        .select("page_id", lo.alias("lo"), hi.alias("hi"))
        .where("lo <= hi")
        .withColumn("at", F.explode(F.expr(f"sequence(lo div {RANGE}, hi div {RANGE})")))
        .withColumn("from", F.expr(f"cast(greatest(lo - at * {RANGE}, 0) as int)"))
        .withColumn("to", F.expr(f"cast(least(hi - at * {RANGE}, {RANGE - 1}) as int)"))
        # ones at from..to, without a shift by 64
        .withColumn("mask", F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (to - from)), from)"))
    )
    by_range = marked.groupBy("page_id", "at").agg(F.bit_or("mask").alias("mask"))
    return by_range.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("ranges"))


def cut_page(top: int, bottom: int, most: int, overlap: int, crossed: np.ndarray) -> list[tuple[int, int, bool]]:
    """(y0, y1, natural) of the pieces of rows top..bottom. crossed[y - top]:
    whether a cut at y goes through a cell. A piece ends at the last free row
    within reach, else at the limit; the next starts ``overlap`` rows before."""
    # The last free row up to each row: a running maximum over the whole strip.
    free = np.maximum.accumulate(np.where(crossed, -1, np.arange(len(crossed))))
    most = max(1, most)
    overlap = max(0, min(overlap, most - 1))
    out, y0 = [], top
    while bottom - y0 > most:
        at = int(free[y0 + most - top])
        y = at + top if at >= 0 else y0
        natural = y > y0 + overlap
        y = y if natural else y0 + most
        out.append((y0, y, natural))
        y0 = y - overlap
    out.append((y0, bottom, True))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "piece_no", "n_pieces", "y0", "y1", "natural_end"]
    for batch in batches:
        cols = {k: [] for k in names}
        for r in batch.to_pylist():
            top, bottom = r["y_top"], r["y_bottom"]
            crossed = np.zeros(bottom - top + 1, dtype=bool)
            for x in r["ranges"] or []:
                bits = np.unpackbits(np.array([x["mask"]], dtype="<i8").view(np.uint8), bitorder="little").astype(bool)
                start = x["at"] * RANGE - top
                lo, hi = max(0, start), min(len(crossed), start + RANGE)
                if lo < hi:
                    crossed[lo:hi] |= bits[lo - start : hi - start]
            pieces = cut_page(top, bottom, r["max_piece_px"], r["overlap_px"], crossed)
            for i, (y0, y1, natural) in enumerate(pieces):
                for k, v in zip(names, (r["page_id"], i, len(pieces), y0, y1, natural)):
                    cols[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[k], t) for k, t in zip(names, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], names
        )


def pieces(cells: DataFrame, page_images: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every page whose text is too tall: page_id, piece_no from 0,
    n_pieces, y0 and y1 in image rows, natural_end (false where no gap between
    lines was within reach and a line had to be cut). No piece is taller than
    the limit, and each starts overlap_px above the end of the one before.

    Rows that occur twice change nothing. Unusable boxes (null, partly null,
    out of order or range) are left out, and pages without others with them.
    """
    tall = page_extents(cells, page_images, limits).where("too_tall")
    ready = tall.join(_masks(cells, tall), "page_id", "left").select(
        "page_id", "ranges", F.col("max_piece_px").cast("long"), F.col("overlap_px").cast("long"),
        F.floor(F.expr("top * img_h")).alias("y_top"), F.ceil(F.expr("bottom * img_h")).alias("y_bottom"),
    )
    return ready.mapInArrow(
        _cut, "page_id long, piece_no int, n_pieces int, y0 long, y1 long, natural_end boolean"
    )


def page_stem(path: Column) -> Column:
    """Image name in a crop path: without folders and cell number."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"_\d+\.[A-Za-z0-9]+$", "")


def named_pieces(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The pieces with the image name from manifest.path (the page_id where
    the manifest lacks the page) and a file name of their own."""
    names = (
        manifest.where("page_id is not null and path is not null")
        .join(found.select("page_id").distinct(), "page_id", "left_semi")
        .groupBy("page_id").agg(F.min(page_stem(F.col("path"))).alias("stem"))
    )
    stem = F.coalesce("stem", F.concat(F.lit("page"), F.col("page_id").cast("string")))
    return found.join(names, "page_id", "left").withColumn("stem", stem).withColumn("name", F.format_string("%s_piece%03d", "stem", "piece_no"))
