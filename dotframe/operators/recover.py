"""Decisions around detection passes: which cells, variants and passes to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.functions.geom import native_tile
from dotframe.operators.near import meet
from dotframe.params import PARAMS


def split_by_confidence(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    hi = F.col("conf") >= PARAMS.high_conf
    return cells.where(hi), cells.where(~hi)


def best_of(rows: DataFrame, key: str, score: str, order: str, *keep: str) -> DataFrame:
    """Per key the row with the highest score, the first of equals."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*keep, score), F.struct(score, (-F.col(order)).alias("o"))).alias("_b")).select(key, "_b.*")


def enough_candidates(cells: DataFrame, least: int = PARAMS.container_min_candidates) -> DataFrame:
    n = cells.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("page_id")
    return cells.join(n, "page_id", "left_semi")


def scale_decision(cells: DataFrame, tile: int = PARAMS.tile_size) -> DataFrame:
    """Per page: median width (of high-confidence cells if there are three),
    the tile size that follows, and whether a second pass pays."""
    hi = F.when(F.col("conf") >= PARAMS.high_conf, F.col("w"))
    mw = F.when(F.count(hi) >= 3, F.median(hi)).otherwise(F.median("w"))
    return (
        cells.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), mw.alias("median_w")).where(F.col("n") >= PARAMS.container_min_candidates)
        .withColumn("tile", native_tile(F.col("median_w"))).withColumn("ratio", F.lit(float(tile)) / F.col("tile"))
        .withColumn("again", (F.col("ratio") > 1.5) | (F.col("ratio") < 0.67))
    )


def not_near_known(slots: DataFrame, known: DataFrame) -> DataFrame:
    """Places (page_id, ex, ey, w, h) with no known cell within 0.7 of the size."""
    k = known.select(F.col("page_id").alias("_k"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    c = F.col
    near = (F.abs(c("ex") - c("_x")) < 0.7 * c("w")) & (F.abs(c("ey") - c("_y")) < 0.7 * c("h"))
    return meet(slots, k, near, (c("ex"), c("ey")), (0.7 * c("w"), 0.7 * c("h")), ("_x", "_y"), "left_anti")


def new_by_rounding(found: DataFrame, known: DataFrame) -> DataFrame:
    """Cells whose whole-pixel centre no known cell of the page has."""
    at = lambda df, p: df.select("*", F.rint("cx").alias(f"{p}x"), F.rint("cy").alias(f"{p}y"))
    k = at(known, "_").select("page_id", "_x", "_y").distinct()
    return at(found, "_").join(k, ["page_id", "_x", "_y"], "left_anti").drop("_x", "_y")


def or_else(first: DataFrame, second: DataFrame, key: str = "page_id") -> DataFrame:
    """``first``, and ``second`` for the keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))
