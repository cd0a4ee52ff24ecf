"""Photographs to text, and photographs to quality measures, step by step.

Every step is an operator of its own over all photos at once; what several
steps read, and what costs a model's work, is written once in between.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.operators import evalm, gridfill, layout, photo, recover, rescue, suppress, translate
from dotframe.params import PARAMS
from dotframe.session import staged

#: Regions of a photo are numbered below this.
REGIONS = 4096


@dataclass(frozen=True)
class Options:
    """What to do without: each step can be left out."""

    search_containers: bool = True
    search_contrast: bool = True
    normalise_scale: bool = True
    exclude_markout: bool = False
    residual_overlaps: bool = False
    max_det: int = 2000


def tiled_cells(photos: DataFrame, tile, open_detector: Callable, options: Options) -> DataFrame:
    """Detections on overlapping tiles: what an inner tile edge may have cut
    goes, and of cells seen twice the more confident stays."""
    raw = staged(photo.detect_tiled(photos, tile, open_detector, PARAMS.low_conf, options.max_det), "detections")
    return renumbered(suppress.nms(suppress.tile_edge_filter(renumbered(raw, "tile_no", "det_id"))))


def renumbered(cells: DataFrame, *order: str) -> DataFrame:
    """Cells with det_id 0, 1, … of each page, in the given order."""
    by = order or ("det_id",)
    n = F.row_number().over(W.partitionBy("page_id").orderBy(*by, "cy", "cx", F.desc("conf"))) - 1
    return cells.withColumn("det_id", n.cast("long"))


def candidates(photos: DataFrame, open_detector: Callable, options: Options) -> DataFrame:
    """All detections of photos. With scale normalisation a first pass on tiles
    of the usual size measures the cells, and photos whose cells are much larger
    or smaller get a second one; photos with hardly a cell give none."""
    if not options.normalise_scale:
        return renumbered(suppress.nms(photo.detect_tiled(photos, F.greatest("img_w", "img_h"), open_detector, PARAMS.low_conf, options.max_det), PARAMS.container_merge_iou))
    first = staged(recover.enough_candidates(tiled_cells(photos, PARAMS.tile_size, open_detector, options)), "first-pass")
    decision = recover.scale_decision(first).where("again").select("page_id", F.col("tile").alias("_tile"))
    again = photos.join(decision, "page_id")
    second = tiled_cells(again, F.col("_tile"), open_detector, options)
    settled = first.join(decision, "page_id", "left_anti")
    return settled.select(*rescue.CELL).unionByName(second.select(*rescue.CELL))


def read_cells(found: DataFrame, residual_overlaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cells, empty places) of detections: residual overlaps settled if asked
    for, then the rows' grid filled. Empty places have stage gap or edge, ex,
    ey, w, h; cells what rescue.CELL names."""
    if residual_overlaps:
        found = found.join(suppress.resolve_overlaps(found).select("page_id", "det_id"), ["page_id", "det_id"], "left_semi")
    filled = staged(gridfill.grid_fill(found), "filled")
    empty = filled.where(F.col("stage").isin("gap", "edge")).select("page_id", "stage", "ex", "ey", "w", "h")
    cells = filled.where(~F.col("stage").isin("gap", "edge")).withColumn("rescued", F.col("stage") == "rescued")
    return cells.select(*rescue.CELL), empty


def _more(cells: DataFrame, *found: DataFrame) -> DataFrame:
    """The cells and further ones without a det_id, numbered after them."""
    out = cells
    for part in found:
        out = out.unionByName(part.withColumn("det_id", F.lit(None).cast("long")).select(*rescue.CELL))
    return renumbered(out.withColumn("_new", F.col("det_id").isNull()), "_new", "det_id").drop("_new")


def page_lines(cells: DataFrame, exclude_markout: bool = False) -> DataFrame:
    """(page_id, line_id, text) of the dot characters of pages."""
    lines = layout.line_groups(cells)
    return layout.line_strings(layout.strip_markout(lines) if exclude_markout else lines)


def recognise(photos: DataFrame, open_detector: Callable, open_classifier: Callable | None = None, options: Options = Options()) -> DataFrame:
    """The final cells of photos: contrast, detection, grid filling, the three
    rescue passes, margins, indicators and classification."""
    if options.search_contrast:
        photos = staged(photo.best_contrast(photos, open_detector, options.max_det), "contrast")
    found = staged(candidates(photos, open_detector, options), "candidates")
    cells, empty = read_cells(found, options.residual_overlaps)
    edge = staged(rescue.crop_recovery(photos, empty.where("stage = 'edge'"), open_detector), "edge-cells")
    cells = staged(_more(cells, edge), "cells")
    thresholds = rescue.page_threshold(photos, found)
    gap = rescue.gap_recovery(photos, empty.where("stage = 'gap'"), cells, thresholds, open_detector)
    cells = staged(evalm.margin_filter(_more(cells, gap)), "cells")
    cells = staged(_more(cells, rescue.indicator_recovery(photos, cells, open_detector)), "cells")
    return photo.reclassified(photos, cells, open_classifier) if open_classifier else cells


def regions(photos: DataFrame, open_detector: Callable, options: Options) -> DataFrame:
    """Photos cut to their containers that hold a cell, as photos with a
    page_id of their own; whole where there is no such container."""
    whole = photos.select("page_id", F.lit(0).cast("long").alias("region_no"), *[F.lit(0.0).alias(k) for k in ("bx0", "by0")], F.col("img_w").cast("double").alias("bx1"), F.col("img_h").cast("double").alias("by1"))
    if options.search_containers:
        boxes = staged(suppress.large_enough(photo.container_boxes(photos)), "containers")
        some = photos.join(boxes.select("page_id").distinct(), "page_id", "left_semi")
        rough = photo.detect_tiled(some, F.greatest("img_w", "img_h"), open_detector, PARAMS.low_conf, options.max_det)
        held = suppress.containers_with_cells(boxes, rough)
        no = (F.row_number().over(W.partitionBy("page_id").orderBy("region_no")) - 1).cast("long")
        whole = recover.or_else(held.withColumn("region_no", no).select(*whole.columns), whole)
    cut = photo.cut_out(photos, whole)
    return cut.withColumn("page_id", F.col("page_id") * REGIONS + F.col("region_no")).drop("region_no")


def process(
    photos: DataFrame, open_detector: Callable, open_classifier: Callable | None = None, translator: Callable | None = None, options: Options = Options()
) -> DataFrame:
    """(page_id, region_no, text) of every region of a photo with text: its
    lines, translated and cleaned, joined by newlines; dot characters without a
    translator. A photo none of whose containers has text is tried once more as
    a whole. Photos without text give no row."""

    def text_of(parts: DataFrame) -> DataFrame:
        lines = page_lines(recognise(parts, open_detector, open_classifier, options), options.exclude_markout)
        if translator:
            lines = translate.with_translator(lines, translator).withColumn("text", translate.clean(F.col("translated"))).drop("translated")
        page = layout.joined_lines(lines).where(F.length("text") > 0)
        return page.select(F.expr(f"page_id div {REGIONS}").alias("page_id"), (F.col("page_id") % REGIONS).alias("region_no"), "text")

    parts = staged(regions(photos, open_detector, options), "regions")
    got = staged(text_of(parts), "texts")
    if not options.search_containers:
        return got
    # Photos that were cut, in vain: their regions aren't the whole photo.
    size = lambda df, n: df.groupBy("page_id").agg(F.sum(F.col("img_w").cast("long") * F.col("img_h")).alias(n))
    cut = parts.withColumn("page_id", F.expr(f"page_id div {REGIONS}"))
    vain = size(cut, "_part").join(size(photos, "_all"), "page_id").where("_part <> _all").join(got, "page_id", "left_anti").select("page_id")
    rest = photos.join(vain, "page_id", "left_semi").select("page_id", "img_w", "img_h", "pixels")
    return got.unionByName(text_of(staged(rest.withColumn("page_id", F.col("page_id") * REGIONS), "whole")))


def evaluate(
    photos: DataFrame, truth: DataFrame, open_detector: Callable, open_classifier: Callable | None = None, max_det: int = 2000
) -> DataFrame:
    """Per photo n_gt, n_pred, tp and class_ok of the evaluation's own chain:
    contrast search, one pass over the whole photo, grid filling, edge and gap
    recovery, the stricter margins, and classification, against truth cells
    (page_id, det_id, cx, cy, w, h, bits). ``evalm`` has the report of it."""
    options = Options(normalise_scale=False, max_det=max_det)
    photos = staged(photo.best_contrast(photos, open_detector, max_det), "contrast")
    found = staged(candidates(photos, open_detector, options), "candidates")
    cells, empty = read_cells(found)
    cells = staged(_more(cells, rescue.crop_recovery(photos, empty.where("stage = 'edge'"), open_detector)), "cells")
    gap = rescue.gap_recovery(photos, empty.where("stage = 'gap'"), cells, rescue.page_threshold(photos, found), open_detector)
    cells = evalm.margin_filter_strict(_more(cells, gap))
    cells = staged(photo.reclassified(photos, cells, open_classifier) if open_classifier else cells, "cells")
    return evalm.page_counts(cells, truth, evalm.match_cells(cells, truth))


def text_of_detections(found: DataFrame, exclude_markout: bool = False) -> DataFrame:
    """(page_id, text) of raw detections without their photos: suppression,
    grid filling, margins and layout, as process does them."""
    kept = suppress.nms(found)
    cells, _ = read_cells(kept)
    lines = page_lines(evalm.margin_filter(staged(cells, "cells")), exclude_markout)
    return layout.joined_lines(lines)
