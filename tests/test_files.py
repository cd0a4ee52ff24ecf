"""Readers, sinks, models and streaming over real files."""

import json

import numpy as np
import pytest

from dotframe import models
from dotframe.operators import sinks
from dotframe.session import shared_dir, staged
from dotframe.sources import annotations as ann
from dotframe.streaming import photos

CELL = "page_id long, det_id long, cx double, cy double, w double, h double, conf double, bits string, rescued boolean"


def test_cell_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0.1;0.2;0.3;0.4;5\r\n0.1;0.2;0.3\n0.5;0.2;0.6;0.4;63;more\n\n")
    got = ann.read_cell_csv(spark, str(tmp_path)).orderBy("l").collect()
    assert [(r.l, r.label, r.bits6) for r in got] == [(0.1, 5, "101000"), (0.5, 63, "111111")]
    (tmp_path / "b.csv").write_text("0.1;x;0.3;0.4;5\n")
    with pytest.raises(Exception, match="malformed number"):
        ann.read_cell_csv(spark, str(tmp_path)).collect()


def test_grid_txt(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0.5\n10 20 40 50\n5 10 15\n1 1 1 0 0 0 0 0\n1 2 1 1 0 0 0 0\n2 1 1 0 0 0 0 0\n1 9\n")
    got = ann.read_grid_txt(spark, str(tmp_path), 51, 100).orderBy("x0").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.label) for r in got] == [(8.5, 3.5, 21.5, 16.5, 1), (38.5, 3.5, 51.0, 16.5, 3)]


def test_voc_xml(spark, tmp_path):
    box = "<object><bndbox><xmin>{}</xmin><ymin>10</ymin><xmax>40</xmax><ymax>20</ymax></bndbox></object>"
    for name, xs in (("one", [20]), ("two", [20, 30])):
        (tmp_path / f"{name}.xml").write_text("<annotation><size><width>100</width><height>50</height></size>" + "".join(box.format(x) for x in xs) + "</annotation>")
    got = ann.read_voc_xml(spark, str(tmp_path)).collect()
    assert sorted(r.l for r in got) == [0.2, 0.2, 0.3] and all(r.label is None and r.b == 0.4 for r in got)


def test_images_pairs_and_sides(spark, tmp_path):
    for n in ("b.jpg", "a.jpeg", "c.jpg", "d.png"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "b.csv").write_text("1")
    (tmp_path / "c.csv").write_text("")
    found = ann.images(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.orderBy("rank", "path").collect()] == ["a.jpeg", "b.jpg", "c.jpg"]
    assert [r.rank for r in ann.images(spark, str(tmp_path / "d.png")).collect()] == [1]
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in ann.with_annotation(found, files, ".csv").collect()] == ["b.jpg"]
    pages = ann.page_list(spark.createDataFrame([(" X\\M+1.jpg \r",), ("  ",)], "value string"))
    assert sorted(r.path for r in ann.sides(pages).collect()) == ["X/M+1+recto", "X/M+1+verso"]


def test_sources(spark):
    one = spark.createDataFrame([(1,)], "label int")
    assert ann.union_sources({"angelina": one, "braille_natural": one}).count() == 1
    assert ann.union_sources({"angelina": one, "braille_natural": one}, single_class=True).count() == 2


def test_sinks(spark, tmp_path):
    crops = spark.createDataFrame([("train", "p,q", "100000", 1), ("val", "r", "110000", 3)], "split string, path string, bits6 string, label_int int")
    sinks.write_manifest(crops, str(tmp_path / "m"))
    assert ann.manifest(spark, str(tmp_path / "m"), "train").first().path == "p,q"
    rows = spark.createDataFrame([("a", 1, 2, 1, 1)], "name string, n_gt int, n_pred int, tp int, class_ok int")
    sinks.append_eval_rows(rows, str(tmp_path / "e"))
    sinks.append_eval_rows(rows, str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e")).count() == 2
    lines = spark.createDataFrame([("train", "s", 1, "0 5 6"), ("train", "s", 0, "0 1 2"), ("val", "t", 0, "3 1 2")], "split string, stem string, at int, line string")
    sinks.write_files(sinks.label_files(lines), str(tmp_path / "set"))
    assert (tmp_path / "set/labels/train/s.txt").read_text() == "0 1 2\n0 5 6\n" and (tmp_path / "set/labels/val/t.txt").read_text() == "3 1 2\n"
    sinks.write_descriptor(str(tmp_path / "set"), {0: "000000", 1: "100000"})
    assert (tmp_path / "set/dataset.yaml").read_text().endswith("names:\n  0: '000000'\n  1: '100000'\n")
    cells = spark.createDataFrame([(1, 2, 5.0, 6.0, 8.0, 9.0, 0.5, "100000", False)], CELL)
    assert json.loads(sinks.cells_json(cells).first().json)["cells"][0]["bits"] == "100000"
    drawn = sinks.overlay_commands(cells).orderBy("dot").collect()
    assert len(drawn) == 6 and drawn[0].filled and (drawn[0].red, drawn[0].green, drawn[0].blue) == (127, 127, 0)
    assert sinks.sheet_commands(cells).count() == 6


def test_resolver(tmp_path):
    with pytest.raises(models.ModelNotFound):
        models.resolve("m.onnx", cache=tmp_path / "cache")
    (tmp_path / "scratch").mkdir()
    (tmp_path / "scratch" / "m.onnx").write_bytes(b"s")
    assert models.resolve("m.onnx", scratch=tmp_path / "scratch", cache=tmp_path / "cache").parent.name == "scratch"
    (tmp_path / "beside").mkdir()
    (tmp_path / "beside" / "m.onnx").write_bytes(b"b")
    assert models.resolve("m.onnx", beside=tmp_path / "beside", scratch=tmp_path / "scratch").parent.name == "beside"
    source = (tmp_path / "beside" / "m.onnx").as_uri()
    got = models.resolve("m.onnx", cache=tmp_path / "cache", url=source)
    assert got.read_bytes() == b"b" and not (tmp_path / "cache" / "m.onnx.part").exists()
    with pytest.raises(models.ModelNotFound):
        models.resolve("n.onnx", cache=tmp_path / "cache", url=source + "x")


def test_pinned_version(tmp_path):
    (tmp_path / "dataset.version").write_text("v0.1.1\n")
    (tmp_path / "cache" / "v0.1.1").mkdir(parents=True)
    (tmp_path / "cache" / "v0.1.1" / "m.onnx").write_bytes(b"c")
    assert models.pinned(tmp_path / "dataset.version", "m.onnx", cache=tmp_path / "cache").read_bytes() == b"c"
    (tmp_path / "dataset.version").write_text("v0.1.2")
    (tmp_path / "there" / "v0.1.2").mkdir(parents=True)
    (tmp_path / "there" / "v0.1.2" / "m.onnx").write_bytes(b"new")
    assert models.pinned(tmp_path / "dataset.version", "m.onnx", (tmp_path / "there").as_uri(), cache=tmp_path / "cache").read_bytes() == b"new"
    (tmp_path / "dataset.version").write_text("../x")
    with pytest.raises(ValueError):
        models.pinned(tmp_path / "dataset.version", "m.onnx")


def test_detector_and_classifier(spark):
    class Stub:
        def detect(self, image, least):
            return np.array([[1, 2, 3, 4, 0.9], [5, 6, 7, 8, 0.01]])

    tiles = spark.createDataFrame([(1, 0, 100, 200, [[0.0, 1.0], [2.0, 3.0]])], "page_id long, tile_no int, x0 int, y0 int, image array<array<double>>")
    got = models.detect(tiles, Stub).collect()
    assert [(r.cx, r.cy, r.conf) for r in got] == [(101.0, 202.0, 0.9)]
    crops = spark.createDataFrame([(7, "000000", [[[1.0]]])], "det_id long, bits string, crop array<array<array<double>>>")
    got = models.classify(crops, lambda: lambda batch: np.tile([1.0, -1, 0, 2, -3, 0.1], (len(batch), 1))).first()
    assert got.bits == "100101"


def test_streaming_page_text(spark, tmp_path):
    rows = [(p, i, 30.0 * i, 100.0, 25.0, 50.0, 0.9, "100000", False) for p in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, CELL)
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for part in ("page_id = 1", "page_id = 2 and det_id < 2", "page_id = 2 and det_id = 2"):  # page 2 comes in parts
        df.where(part).coalesce(1).write.mode("append").parquet(src)
        photos.write_page_text(photos.read_cells(spark, src, df.schema), out, check).awaitTermination(60)
    assert sorted((r.page_id, r.text) for r in photos.current_text(spark, out).collect()) == [(1, "⠁⠁⠁"), (2, "⠁⠁⠁")]
    assert sorted(r.text for r in spark.read.parquet(f"{out}/text").where("page_id = 2").collect()) == ["⠁⠁", "⠁⠁⠁"]


def test_staging(spark):
    class Session:
        class conf:
            @staticmethod
            def get(name, default):
                return {"spark.checkpoint.dir": "file:///shared/"}.get(name, default)

    assert shared_dir(Session) == "file:///shared"
    assert staged(spark.range(3), "x").count() == 3
    assert all(shared_dir(spark).removeprefix("file:").lstrip("/") in f for f in staged(spark.range(3)).inputFiles())
