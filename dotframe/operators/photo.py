"""Photographs as rows: page_id, img_w, img_h and pixels (RGB bytes by rows).

Steps that look at pixels take a photo and the places to look at in one row, so
that an image moves to its places' task once; places come in chunks, so that a
page with many of them is more than one task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dotframe.functions.geom import tile_boxes
from dotframe.operators import kernels
from dotframe.operators.enhance import containers, equalise
from dotframe.params import PARAMS

# Contrasts that are tried.
CONTRASTS = (0.7, 1.0, 1.4, 2.0, 3.0)
PHOTO = "page_id long, img_w int, img_h int, pixels binary"
CHUNK = 256


def pixels_of(row) -> np.ndarray:
    return np.frombuffer(row.pixels, dtype=np.uint8).reshape(row.img_h, row.img_w, 3)


def as_pixels(rgb: np.ndarray) -> bytes:
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8).tobytes()


# Reading -------------------------------------------------------------------


def exif_orientation(content: bytes) -> int:
    """Orientation 1..8 in a JPEG file's EXIF data, 1 without."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        block = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and block[:6] == b"Exif\0\0" and len(block) > 14:
            tiff = block[6:]
            order = "<" if tiff[:2] == b"II" else ">"
            try:
                (first,) = struct.unpack_from(order + "I", tiff, 4)
                (n,) = struct.unpack_from(order + "H", tiff, first)
                for k in range(n):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, first + 2 + 12 * k)
                    if tag == 0x0112 and 1 <= value <= 8:
                        return value
            except struct.error:
                pass
            return 1
        at += 2 + size
    return 1


def orient(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The image as its EXIF orientation wants it shown."""
    if orientation >= 5:  # rows are columns
        rgb = rgb.swapaxes(0, 1)
    down, right = orientation in (3, 4, 7, 8), orientation in (2, 3, 6, 7)
    return rgb[:: -1 if down else 1, :: -1 if right else 1]


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """path and the photo of every image file that can be decoded: by Spark's
    own image source, turned by EXIF, as RGB. Grey images count as RGB of equal
    channels; an alpha channel is dropped."""
    files = spark.read.format("binaryFile").load(path)
    decoded = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("_origin"), "image.width", "image.height", "image.nChannels", "image.data")

    def heads(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "turn": [exif_orientation(bytes(x)) for x in pdf["content"]]})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                image = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.nChannels)
                rgb = np.repeat(image, 3, axis=2) if r.nChannels == 1 else image[:, :, 2::-1]
                rgb = orient(rgb, r.turn)
                rows.append((r.path, rgb.shape[1], rgb.shape[0], np.ascontiguousarray(rgb).tobytes()))
            yield pd.DataFrame(rows, columns=["path", "img_w", "img_h", "pixels"])

    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    turned = files.select("path", "content").mapInPandas(heads, "path string, turn int")
    both = decoded.join(turned, plain(F.col("_origin")) == plain(F.col("path"))).select("path", "turn", "width", "height", "nChannels", "data")
    return both.mapInPandas(run, "path string, img_w int, img_h int, pixels binary")


# Enhancement ---------------------------------------------------------------

# Primaries and white of the sRGB colour space.
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def to_lab(rgb: np.ndarray) -> np.ndarray:
    """Lightness 0..255 and two colour channels of an RGB image."""
    v = rgb / 255.0
    linear = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    x = linear @ TO_XYZ.T / WHITE
    f = np.where(x > 0.008856, np.cbrt(x), 7.787 * x + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] / 2.55 + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    x = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) * WHITE
    linear = np.clip(x @ np.linalg.inv(TO_XYZ).T, 0, 1)
    return np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear) * 255


def equalised(rgb: np.ndarray, clip: float = 3.0, grid: tuple[int, int] = (16, 16)) -> np.ndarray:
    """Contrast-limited equalisation of the lightness, colours kept."""
    lab = to_lab(rgb.astype(float))
    lab[..., 0] = equalise(np.rint(lab[..., 0]), clip, grid)
    return np.clip(np.rint(from_lab(lab)), 0, 255)


def variants(rgb: np.ndarray) -> list[tuple[str, np.ndarray]]:
    return [("equalised", equalised(rgb)), *((f"contrast {c}", kernels.contrast(rgb.astype(float), c)) for c in CONTRASTS)]


def best_contrast(photos: DataFrame, open_model: Callable, max_det: int = 2000) -> DataFrame:
    """Photos as the variant (equalised, or of one of the contrasts) on which
    the detector finds most cells of high confidence, the first of equals; with
    ``variant`` and its number of cells ``n_high``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                tried = [(min(max_det, len(found(model, image, PARAMS.high_conf))), name, image) for name, image in variants(pixels_of(r))]
                n, name, image = max(tried, key=lambda t: t[0])
                rows.append((r.page_id, r.img_w, r.img_h, as_pixels(image), name, n))
            yield pd.DataFrame(rows, columns=["page_id", "img_w", "img_h", "pixels", "variant", "n_high"])

    return photos.select("page_id", "img_w", "img_h", "pixels").mapInPandas(run, PHOTO + ", variant string, n_high long")


# Detection -----------------------------------------------------------------


def found(model, image: np.ndarray, least: float, max_det: int = 2000) -> np.ndarray:
    """Rows cx, cy, w, h, conf and pattern (-1 of a detector without any) of
    what the model finds, the most confident first."""
    rows = np.asarray(model.detect(image, least), dtype=float)
    rows = rows.reshape(-1, rows.shape[1] if rows.ndim == 2 else 5)
    if rows.shape[1] == 5:
        rows = np.column_stack([rows, np.full(len(rows), -1.0)])
    rows = rows[rows[:, 4] >= least]
    return rows[np.argsort(-rows[:, 4], kind="stable")][:max_det]


def bits_of(pattern: float) -> str:
    return "000000" if pattern < 0 else format(int(pattern), "06b")[::-1]


TILED = "page_id long, tile int, tile_no int, tx0 long, ty0 long, tx1 long, ty1 long, img_w int, img_h int, cx double, cy double, w double, h double, conf double, bits string"


def detect_tiled(photos: DataFrame, tile: Column | int, open_model: Callable, least: float = PARAMS.low_conf, max_det: int = 2000) -> DataFrame:
    """What the detector finds on each tile of ``tile`` pixels, in the photo's
    pixels, with the tile's bounds; numbered by det_id in the order of tiles
    and confidence."""
    size = F.lit(tile) if isinstance(tile, int) else tile
    ready = photos.withColumn("tile", size.cast("int")).withColumn("tiles", tile_boxes(F.col("img_w"), F.col("img_h"), F.col("tile").cast("long")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                image = pixels_of(r)
                for no, t in enumerate(r.tiles):
                    box = t["x0"], t["y0"], t["x1"], t["y1"]
                    for x, y, w, h, conf, pattern in found(model, image[box[1] : box[3], box[0] : box[2]], least, max_det):
                        rows.append((r.page_id, r.tile, no, *box, r.img_w, r.img_h, x + box[0], y + box[1], w, h, conf, bits_of(pattern)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILED.split(", ")]).assign(det_id=range(len(rows)))

    got = ready.select("page_id", "img_w", "img_h", "pixels", "tile", "tiles").mapInPandas(run, TILED + ", det_id long")
    return got.withColumn("rescued", F.lit(False))


def with_places(photos: DataFrame, places: DataFrame, *columns: str) -> DataFrame:
    """Photos with ``places``: arrays of at most about CHUNK structs of the
    columns."""
    n = places.groupBy("page_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n"))
    dealt = places.join(n, "page_id").withColumn("_c", F.pmod(F.xxhash64(*columns), F.col("_n")))
    lists = dealt.groupBy("page_id", "_c").agg(F.collect_list(F.struct(*columns)).alias("places")).drop("_c")
    return photos.select("page_id", "img_w", "img_h", "pixels").join(lists, "page_id")


def look_at(photos: DataFrame, places: DataFrame, columns: tuple[str, ...], look: Callable, out: str, open_model: Callable | None = None) -> DataFrame:
    """(page_id, ...) of ``look(image, place, model)`` at every place, which
    gives the further columns of ``out``, or None where there is nothing."""
    names = T.StructType.fromDDL(out).names

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model() if open_model else None
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                image = pixels_of(r)
                for place in r.places:
                    got = look(image, place, model)
                    if got is not None:
                        rows.append((r.page_id, *got))
            yield pd.DataFrame(rows, columns=["page_id", *names])

    return with_places(photos, places, *columns).mapInPandas(run, "page_id long, " + out)


def reclassified(photos: DataFrame, cells: DataFrame, open_model: Callable) -> DataFrame:
    """Cells with the pattern that a classifier of crops reads; all crops of a
    chunk go through the model together."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = open_model()
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                image = pixels_of(r).astype(float)
                crops = [kernels.classifier_crop(image, p["cx"], p["cy"], p["w"], p["h"]) for p in r.places]
                logits = np.asarray(model(np.stack(crops).astype(np.float32)))
                rows += [(r.page_id, p["det_id"], "".join("1" if v > 0 else "0" for v in x)) for p, x in zip(r.places, logits)]
            yield pd.DataFrame(rows, columns=["page_id", "det_id", "_bits"])

    read = with_places(photos, cells, "det_id", "cx", "cy", "w", "h").mapInPandas(run, "page_id long, det_id long, _bits string")
    return cells.join(read, ["page_id", "det_id"], "left").withColumn("bits", F.coalesce("_bits", "bits")).drop("_bits")


# Containers ----------------------------------------------------------------


def container_boxes(photos: DataFrame) -> DataFrame:
    """(page_id, region_no, bx0 .. by1) of containers, the largest first."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(r.page_id, i, *map(float, b[:4])) for r in pdf.itertuples() for i, b in enumerate(containers(kernels.grey(pixels_of(r).astype(float))))]
            yield pd.DataFrame(rows, columns=["page_id", "region_no", "bx0", "by0", "bx1", "by1"])

    return photos.select("page_id", "img_w", "img_h", "pixels").mapInPandas(run, "page_id long, region_no long, bx0 double, by0 double, bx1 double, by1 double")


def cut_out(photos: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes (page_id, region_no, bx0 .. by1) of photos, as photos."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for r in pdf.itertuples():
                part = pixels_of(r)[int(r.by0) : int(r.by1), int(r.bx0) : int(r.bx1)]
                rows.append((r.page_id, r.region_no, part.shape[1], part.shape[0], np.ascontiguousarray(part).tobytes()))
            yield pd.DataFrame(rows, columns=["page_id", "region_no", "img_w", "img_h", "pixels"])

    both = photos.select("page_id", "img_w", "img_h", "pixels").join(boxes, "page_id")
    return both.mapInPandas(run, "page_id long, region_no long, img_w int, img_h int, pixels binary")
