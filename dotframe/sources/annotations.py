"""Readers of annotation files and image folders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dotframe.functions.encode import bits_to_label, label_to_bits
from dotframe.operators.badrows import INT, NUMBER
from dotframe.params import PARAMS

VOC_SCHEMA = (
    "size struct<width double, height double>, "
    "object array<struct<bndbox struct<xmin double, ymin double, xmax double, ymax double>>>"
)


def cell_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Boxes of ``l;t;r;b;label`` lines: short rows skipped, further fields
    ignored, rows of five fields with a malformed number an error."""
    f = F.split(F.regexp_replace(text, r"\r$", ""), ";")
    part = lambda i: F.trim(F.element_at("_f", i))
    ok = F.lit(True)
    for i in range(1, 5):
        ok = ok & part(i).rlike(NUMBER)
    ok = ok & part(5).rlike(INT)
    num = lambda i, t: F.when(ok, part(i).cast(t)).otherwise(F.raise_error(F.concat(F.lit("malformed number: "), F.col(text))).cast(t))
    rows = lines.withColumn("_f", f).where(F.size("_f") >= 5)
    return (
        rows.withColumns({k: num(i, "double") for i, k in enumerate("ltrb", 1)} | {"label": num(5, "int")})
        .withColumn("bits6", label_to_bits(F.col("label"))).drop("_f")
    )


def read_cell_csv(spark: SparkSession, path: str) -> DataFrame:
    return cell_lines(spark.read.text(path).withColumn("path", F.input_file_name())).drop("value")


def grid_boxes(row: Column, col: Column, xs: Column, ys: Column, img_w: Column, img_h: Column, pad: float = PARAMS.grid_pad) -> list[Column]:
    """Box of a grid cell: left and right of its column, top and bottom of its
    row, grown by ``pad`` and kept in the image; null for places the headers
    lack."""
    at = lambda v, i: F.try_element_at(v, F.when(i > 0, i.cast("int")))
    x0, x1 = at(xs, 2 * col - 1), at(xs, 2 * col)
    y0, y1 = at(ys, 3 * row - 2), at(ys, 3 * row)
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    known = x1.isNotNull() & y1.isNotNull() & (row >= 1) & (col >= 1)
    return [
        F.when(known, v).alias(k)
        for k, v in (("x0", clamp(x0 - px, img_w)), ("y0", clamp(y0 - py, img_h)), ("x1", clamp(x1 + px, img_w)), ("y1", clamp(y1 + py, img_h)))
    ]


def grid_cells(texts: DataFrame, img_w: Column, img_h: Column, text: str = "value") -> DataFrame:
    """Cells of whole grid files (one row a file): the third header gives the
    rows, the second the columns, the rest one cell a line. Lines of fewer
    than eight fields and places outside the headers are skipped."""
    ints = lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda x: F.expr("0.0D") + x.cast("double"))
    lines = texts.withColumn("_l", F.split(text, r"\r?\n")).withColumn("_xs", ints(F.element_at("_l", 2))).withColumn("_ys", ints(F.element_at("_l", 3)))
    cells = (
        lines.withColumn("_line", F.explode(F.slice("_l", F.lit(4), F.greatest(F.size("_l") - 3, F.lit(0)))))
        .withColumn("_f", F.split(F.trim("_line"), r"\s+")).where(F.size("_f") >= 8)
        .withColumn("row", F.try_element_at("_f", F.lit(1)).cast("int")).withColumn("col", F.try_element_at("_f", F.lit(2)).cast("int"))
        .withColumn("bits6", F.array_join(F.slice("_f", 3, 6), ""))
    )
    boxes = grid_boxes(F.col("row"), F.col("col"), F.col("_xs"), F.col("_ys"), img_w, img_h)
    return cells.select("*", *boxes).where("x0 is not null").withColumn("label", bits_to_label(F.col("bits6"))).drop("_l", "_xs", "_ys", "_line", "_f", text)


def read_grid_txt(spark: SparkSession, path: str, img_w: int, img_h: int) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return grid_cells(texts, F.lit(img_w), F.lit(img_h))


def voc_boxes(annotations: DataFrame) -> DataFrame:
    """Fractional boxes of parsed annotations (columns size and object)."""
    rest = [c for c in annotations.columns if c not in ("size", "object")]
    b, w, h = "_o.bndbox", F.col("size.width"), F.col("size.height")
    return annotations.select(*rest, "size", F.explode("object").alias("_o")).select(
        *rest, (F.col(f"{b}.xmin") / w).alias("l"), (F.col(f"{b}.ymin") / h).alias("t"), (F.col(f"{b}.xmax") / w).alias("r"), (F.col(f"{b}.ymax") / h).alias("b"),
        F.lit(None).cast("int").alias("label"), F.lit(None).cast("string").alias("bits6"),
    )


def read_voc_xml(spark: SparkSession, path: str) -> DataFrame:
    """Boxes without patterns. The schema is given: an annotation with one
    object would be inferred as a struct."""
    found = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).load(path)
    return voc_boxes(found.withColumn("path", F.input_file_name()))


def page_list(lines: DataFrame, text: str = "value") -> DataFrame:
    """Entries of a page list: trimmed, blank ones gone, \\ as /."""
    return lines.withColumn(text, F.translate(F.regexp_replace(text, r"^\s+|\s+$", ""), "\\", "/")).where(F.col(text) != "")


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Image files: path, length and content of a folder's .jpeg and .jpg, or
    of the one file that ``path`` names, whatever its type. ``rank`` and
    ``path`` are their order (.jpeg first, each by path); the rows themselves
    aren't sorted, as that would move every image's bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if not re.search(r"\.[A-Za-z0-9]{1,5}$", path):
        found = found.option("pathGlobFilter", "*.{jpeg,jpg}")
    return found.load(path).withColumn("rank", F.when(F.lower("path").endswith(".jpeg"), 0).otherwise(1))


def with_annotation(files: DataFrame, annotations: DataFrame, suffix: str) -> DataFrame:
    """Images whose annotation of the same stem exists and isn't empty."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]+$", "")
    there = annotations.where((F.col("length") > 0) & F.col("path").endswith(suffix)).select(stem("path").alias("_stem"))
    return files.withColumn("_stem", stem("path")).join(there, "_stem", "left_semi").drop("_stem")


def sides(pages: DataFrame, column: str = "value") -> DataFrame:
    """Both sides of each page: stem+recto and stem+verso."""
    return pages.withColumn("side", F.explode(F.array(F.lit("recto"), F.lit("verso")))).withColumn(
        "path", F.concat(F.regexp_replace(column, r"\.[^./]+$", ""), F.lit("+"), F.col("side"))
    )


def manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    rows = spark.read.option("header", True).schema("split string, path string, bits6 string, label_int int").csv(path)
    return rows if split is None else rows.where(F.col("split") == split)


# Sources and whether their cells carry patterns.
SOURCES = {"angelina": True, "dsbi": True, "braille_natural": False}


def union_sources(of: dict[str, DataFrame], single_class: bool = False) -> DataFrame:
    """Cells of all sources with their tag; those without patterns only join
    a set of a single class."""
    out = None
    for tag, df in of.items():
        if single_class or SOURCES.get(tag, True):
            tagged = df.withColumn("source", F.lit(tag))
            out = tagged if out is None else out.unionByName(tagged)
    return out
