"""One frozen set of thresholds shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values of the recognition pipeline.
    low_conf: float = 0.05
    high_conf: float = 0.30
    crop_conf: float = 0.001
    all_dots_min_conf: float = 0.15
    container_min_candidates: int = 3
    container_min_side: int = 20
    container_merge_iou: float = 0.7
    contour_min_area: float = 0.005
    contour_max_area: float = 0.95
    contour_min_shape: float = 0.6
    tile_dedupe_iou: float = 0.5
    tile_edge_margin: float = 0.05
    tile_size: int = 640
    target_width: float = 30.0
    min_tile: int = 100
    tile_overlap: float = 0.2
    line_band: float = 0.55
    space_extra: float = 0.5
    crop_pad: float = 0.10
    grid_pad: float = 0.15
    residual_iou: float = 0.15
    slot_tolerance: float = 0.25
    match_frac: float = 0.5
    default_dot_threshold: float = 20.0
    min_dot_threshold: float = 5.0
    split_seed: int = 42


PARAMS = Params()
