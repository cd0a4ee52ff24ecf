"""Draw commands and files of results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotframe.functions.encode import dot_char
from dotframe.functions.geom import DOT_OFFSETS, conf_colour
from dotframe.operators import jpeg, photo
from dotframe.operators.kernels import resize
from dotframe.operators.layout import sheet_positions

CELL_PX, DOT_RADIUS, PAD = 60, 7, 6


def _dots() -> Column:
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in DOT_OFFSETS])


def overlay_commands(cells: DataFrame) -> DataFrame:
    """Per cell and dot of an annotated page: the cell's rectangle and colour,
    the dot's centre, radius and whether it is filled. Spaces are not drawn."""
    c = F.col
    box = [
        (c("cx") - c("w") / 2).cast("int").alias("x0"), (c("cy") - c("h") / 2).cast("int").alias("y0"),
        (c("cx") + c("w") / 2).cast("int").alias("x1"), (c("cy") + c("h") / 2).cast("int").alias("y1"),
    ]
    radius = F.greatest(F.lit(2), (F.least("w", "h") * 0.09).cast("int"))
    return (
        cells.select("page_id", "det_id", "cx", "cy", "w", "h", "bits", *box, *conf_colour(c("conf"), c("rescued")), radius.alias("radius"), F.posexplode(_dots()).alias("at", "off"))
        .select(
            "page_id", "det_id", "x0", "y0", "x1", "y1", "red", "green", "blue", "radius", (c("at") + 1).alias("dot"),
            (c("cx") + c("off.dx") * c("w")).cast("int").alias("dot_x"), (c("cy") + c("off.dy") * c("h")).cast("int").alias("dot_y"),
            (F.expr("substring(bits, at + 1, 1)") == "1").alias("filled"),
        )
    )


def sheet_commands(cells: DataFrame) -> DataFrame:
    """Per cell and dot of the debug sheet: centre, state and the character."""
    dw, dh = (CELL_PX - 16) // 2, (CELL_PX - 20) // 3
    c = F.col
    placed = sheet_positions(cells).select("page_id", "det_id", "bits", "rescued", "sheet_row", "sheet_col", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("at"))
    return placed.select(
        "page_id", "det_id", (c("at") + 1).alias("dot"),
        (PAD + c("sheet_col") * CELL_PX + 4 + F.expr("at div 3") * dw + dw // 2).cast("int").alias("dot_x"),
        (PAD + c("sheet_row") * CELL_PX + 4 + c("at") % 3 * dh + dh // 2).cast("int").alias("dot_y"),
        F.concat(F.when(c("rescued"), "rescued").otherwise("plain"), F.when(F.expr("substring(bits, at + 1, 1)") == "1", " raised").otherwise(" flat")).alias("state"),
        dot_char(c("bits")).alias("cell_char"),
    )


def cells_json(cells: DataFrame) -> DataFrame:
    """One JSON document of cells per page."""
    one = F.struct("cx", "cy", "w", "h", "bits")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("det_id", one.alias("c")))), lambda z: z["c"])
    return cells.groupBy("page_id").agg(F.to_json(F.struct(rows.alias("cells"))).alias("json"))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes each row (name, content) to a file of its own under ``folder``,
    which all executors must have mounted. A file appears under its name when it
    is whole, and a task that runs again writes it again."""

    def run(rows: Iterator) -> None:
        for r in rows:
            at = Path(folder) / r["name"]
            at.parent.mkdir(parents=True, exist_ok=True)
            part = at.with_name(f".{at.name}.{uuid.uuid4().hex}.part")
            part.write_bytes(r["content"])
            part.replace(at)

    files.select("name", "content").foreachPartition(run)


def label_files(lines: DataFrame) -> DataFrame:
    """(name, content) of ``labels/<split>/<stem>.txt``: the label lines (split,
    stem, at, line) of each image in the order of ``at``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda z: z["line"])
    text = F.concat(F.array_join(ordered, "\n"), F.lit("\n"))
    return lines.groupBy("split", "stem").agg(text.cast("binary").alias("content")).select(F.concat_ws("/", F.lit("labels"), "split", F.concat("stem", F.lit(".txt"))).alias("name"), "content")


def descriptor(folder: str, names: dict[int, str]) -> str:
    """Text of a dataset's descriptor: its folders and the name of each class."""
    listed = "".join(f"  {k}: '{v}'\n" for k, v in sorted(names.items()))
    return f"path: {folder}\n" + "".join(f"{s}: images/{s}\n" for s in ("train", "val", "test")) + f"names:\n{listed}"


def write_descriptor(folder: str, names: dict[int, str]) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "dataset.yaml").write_text(descriptor(folder, names))


def tile_files(photos: DataFrame, tiles: DataFrame, quality: int = 92) -> DataFrame:
    """(name, content) of ``images/<split>/<stem>.jpg`` for the tiles (page_id,
    split, stem, x0 .. y1) of photos. A page's tiles move to its image."""
    columns = ("split", "stem", "x0", "y0", "x1", "y1")

    def cut(image: np.ndarray, t, _) -> tuple[str, bytes]:
        return f"images/{t['split']}/{t['stem']}.jpg", jpeg.encode(image[int(t["y0"]) : int(t["y1"]), int(t["x0"]) : int(t["x1"])], quality)

    return photo.look_at(photos, tiles, columns, cut, "name string, content binary").drop("page_id")


def crop_files(photos: DataFrame, cells: DataFrame, size: int = 64, quality: int = 92) -> DataFrame:
    """(name, content, split, bits6, label_int) of ``<split>/<stem>_<number>.jpg``
    for cells (page_id, split, stem, cell_idx, x0 .. y1, bits6, label): their box
    in whole pixels, brought to ``size`` by ``size``."""
    columns = ("split", "stem", "cell_idx", "x0", "y0", "x1", "y1", "bits6", "label")

    def cut(image: np.ndarray, c, _) -> tuple:
        x0, y0 = max(0, int(c["x0"])), max(0, int(c["y0"]))
        part = image[y0 : max(y0 + 1, int(c["y1"])), x0 : max(x0 + 1, int(c["x1"]))]
        if not part.size:
            return None
        name = f"{c['split']}/{c['stem']}_{c['cell_idx']:04d}.jpg"
        return name, jpeg.encode(resize(part.astype(float), size, size), quality), c["split"], c["bits6"], c["label"]

    return photo.look_at(photos, cells, columns, cut, "name string, content binary, split string, bits6 string, label_int int").drop("page_id")


def write_manifest(crops: DataFrame, path: str) -> None:
    crops.select("split", "path", "bits6", "label_int").write.mode("overwrite").option("header", True).csv(path)


def append_eval_rows(metrics: DataFrame, path: str) -> None:
    metrics.select("name", "n_gt", "n_pred", "tp", "class_ok").write.mode("append").csv(path)
