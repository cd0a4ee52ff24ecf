"""Training-set preparation: splits, tiles, label lines and flips."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dotframe.functions.encode import bits_to_label, mirror_bits
from dotframe.functions.geom import native_tile, tile_boxes
from dotframe.operators.near import meet
from dotframe.params import PARAMS


def tiles_of(pages: DataFrame, cells: DataFrame) -> DataFrame:
    """Tiles of every page (page_id, img_w, img_h), sized so that its median
    cell (frac_bbox) comes out at the detector's width: page_id, img_w, img_h,
    tile, tile_no, x0, y0, x1, y1. A page without cells counts one of 640."""
    width = cells.groupBy("page_id").agg(F.median(F.col("frac_bbox.r") - F.col("frac_bbox.l")).alias("_fw"))
    sized = pages.join(width, "page_id", "left").withColumn(
        "tile", native_tile(F.coalesce(F.col("_fw") * F.col("img_w"), F.lit(float(PARAMS.tile_size))))
    )
    return sized.select(
        "page_id", "img_w", "img_h", "tile", F.posexplode(tile_boxes(F.col("img_w"), F.col("img_h"), F.col("tile"))).alias("tile_no", "_b")
    ).select("page_id", "img_w", "img_h", "tile", "tile_no", *[F.col(f"_b.{k}").alias(k) for k in ("x0", "y0", "x1", "y1")])


def cells_in_tiles(tiles: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells by each tile that holds their centre, with the box as fractions
    of the tile (l, t, r, b, cut to 0..1). Tiles without cells vanish."""
    b = F.col("frac_bbox")
    cx, cy = (b["l"] + b["r"]) / 2, (b["t"] + b["b"]) / 2
    c = F.col
    hit = cx.between(c("x0") / c("img_w"), c("x1") / c("img_w")) & cy.between(c("y0") / c("img_h"), c("y1") / c("img_h"))
    tw, th = c("x1") - c("x0"), c("y1") - c("y0")
    zero, one = F.lit(0.0), F.lit(1.0)
    # Tiles of a page are of one size, so that a cell meets those around it only.
    keyed = cells.where("frac_bbox is not null").withColumnRenamed("page_id", "_k")
    half = (c("x1") - c("x0")) / 2 + 1, (c("y1") - c("y0")) / 2 + 1
    sizes = tiles.select(c("page_id").alias("_k"), c("img_w").alias("_iw"), c("img_h").alias("_ih")).distinct()
    placed = keyed.join(sizes, "_k").withColumn("_px", cx * c("_iw")).withColumn("_py", cy * c("_ih")).drop("_iw", "_ih")
    met = meet(tiles, placed, hit, ((c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2), half, ("_px", "_py")).drop("_px", "_py")
    return (
        met
        .withColumn("l", F.greatest(zero, (b["l"] * c("img_w") - c("x0")) / tw))
        .withColumn("t", F.greatest(zero, (b["t"] * c("img_h") - c("y0")) / th))
        .withColumn("r", F.least(one, (b["r"] * c("img_w") - c("x0")) / tw))
        .withColumn("b", F.least(one, (b["b"] * c("img_h") - c("y0")) / th))
    )


def label_line(cls: Column, l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    """Class, centre and size of a box within 0..1, six decimals (in whole
    millionths, so that ties round alike everywhere)."""

    def six(x: Column) -> list[Column]:
        millionths = F.floor(x * 1e6 + 0.5)
        return [F.floor(millionths / 1e6), millionths % 1_000_000]

    parts = [p for x in ((l + r) / 2, (t + b) / 2, r - l, b - t) for p in six(x)]
    return F.format_string("%d %d.%06d %d.%06d %d.%06d %d.%06d", cls, *parts)


def class_names(spark: SparkSession, single: bool = False) -> DataFrame:
    if single:
        return spark.createDataFrame([(0, "cell")], "cls int, name string")
    return spark.range(64).select(F.col("id").cast("int").alias("cls"), F.reverse(F.lpad(F.bin("id"), 6, "0")).alias("name"))


def with_flips(crops: DataFrame) -> DataFrame:
    """The rows and their mirror images (flip, bits6, label_int of the flipped)."""
    flipped = crops.withColumn("bits6", mirror_bits(F.col("bits6"))).withColumn("label_int", bits_to_label(F.col("bits6")))
    return crops.withColumn("flip", F.lit(False)).unionByName(flipped.withColumn("flip", F.lit(True)))


def seeded_split(names: list[str], seed: int = PARAMS.split_seed, share: float = 0.15) -> dict[str, str]:
    """val, test and train of a list of names by a seeded shuffle on the driver
    (the list of files of one folder)."""
    order = sorted(names)
    random.Random(seed).shuffle(order)
    n = max(1, round(len(order) * share))
    return {x: "val" if i < n else "test" if i < 2 * n else "train" for i, x in enumerate(order)}


def image_splits(images: DataFrame) -> DataFrame:
    """(page_id, source, path, split) of page images: the different paths of a
    source by ``seeded_split``. Sources are compared without case and
    surrounding blanks, unknown ones make one source; images without a path
    are left out. A task holds the paths of a source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(split=pdf["path"].map(seeded_split(list(pdf["path"].unique()))))

    source = F.lower(F.trim("source"))
    some = images.where("path is not null").select("page_id", F.when(source != "", source).alias("source"), "path")
    return some.groupBy("source").applyInPandas(run, some.withColumn("split", F.lit("")).schema)
