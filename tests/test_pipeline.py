"""Photographs to text with a detector that finds dark blocks."""

import struct

import numpy as np
import pytest

from dotframe import pipeline
from dotframe.operators import evalm, kernels, photo, rescue

PLACES = "page_id long, ex double, ey double, w double, h double"


def opener(pattern=1):
    """A detector of dark blocks, defined here so that it travels to workers."""

    def open_model():
        class Blocks:
            def detect(self, image, least):
                grey = np.asarray(image, dtype=float).mean(axis=2)
                dark = (grey < 120) | ((grey > 195) & (grey < 215))  # what is in between is the table a plate lies on
                rows = []
                while dark.any():
                    y, x = (int(v[0]) for v in np.nonzero(dark))
                    x1, y1 = x, y
                    while x1 < dark.shape[1] and dark[y, x1]:
                        x1 += 1
                    while y1 < dark.shape[0] and dark[y1, x]:
                        y1 += 1
                    dark[y:y1, max(0, x - 1) : x1 + 1] = False
                    conf = (255 - grey[y:y1, x:x1].mean()) / 255
                    if conf >= least and 10 <= x1 - x <= 150 and 10 <= y1 - y <= 200:
                        rows.append(((x + x1) / 2, (y + y1) / 2, x1 - x, y1 - y, conf, pattern))
                return np.array(rows).reshape(-1, 6)

        return Blocks()

    return open_model


def sheet(faint=(), missing=(), h=300, w=420, lines=3, columns=8, shade=60):
    image = np.full((h, w, 3), 255, dtype=np.uint8)
    for r in range(lines):
        for c in range(columns):
            if (r, c) not in missing:
                image[40 + 80 * r : 70 + 80 * r, 30 + 40 * c : 50 + 40 * c] = 205 if (r, c) in faint else shade
    return image


def photos(spark, *images):
    return spark.createDataFrame([(i, im.shape[1], im.shape[0], im.tobytes()) for i, im in enumerate(images, 1)], photo.PHOTO)


PLAIN = pipeline.Options(search_containers=False, search_contrast=False)


def test_text_of_a_sheet(spark):
    blank = np.full((200, 200, 3), 255, dtype=np.uint8)
    got = pipeline.process(photos(spark, sheet(), sheet(faint={(1, 4)}), blank), opener(), options=PLAIN).collect()
    assert {(r.page_id, r.region_no): r.text for r in got} == {(1, 0): "\n".join(["⠁" * 8] * 3), (2, 0): "\n".join(["⠁" * 8] * 3)}


def test_translator_and_classifier(spark):
    options = pipeline.Options(search_containers=False, search_contrast=True)
    got = pipeline.process(
        photos(spark, sheet(lines=2)), opener(), lambda: lambda batch: np.tile([1.0, 1, -1, -1, -1, -1], (len(batch), 1)), lambda lines: [f"{len(x)}{x[0]}" for x in lines], options
    ).collect()
    assert [r.text for r in got] == ["8⠃\n8⠃"]


def test_containers_and_whole_photo(spark):
    plate = np.full((460, 620, 3), 150, dtype=np.uint8)
    plate[80:380, 100:520] = sheet()
    got = pipeline.process(photos(spark, plate, sheet()), opener(), options=pipeline.Options(search_contrast=False)).collect()
    assert {r.page_id for r in got} == {1, 2} and all(r.text.count("⠁") >= 24 for r in got)


def test_small_cells_get_a_second_pass(spark):
    image = sheet(h=1400, w=1400, lines=12, columns=30)
    first = pipeline.tiled_cells(photos(spark, image), 640, opener(), PLAIN)
    assert first.count() == 360  # none twice, none cut
    small = np.repeat(np.repeat(sheet(), 3, axis=0), 3, axis=1)
    again = pipeline.candidates(photos(spark, image, small), opener(), PLAIN).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in again} == {1: 360, 2: 24}


def test_rescue_passes(spark):
    image = sheet(faint={(0, 3)}, missing={(2, 5)})
    places = spark.createDataFrame([(1, 160.0, 55.0, 20.0, 30.0), (1, 240.0, 215.0, 20.0, 30.0), (1, 900.0, 900.0, 20.0, 30.0)], PLACES)
    got = rescue.crop_recovery(photos(spark, image), places, opener()).collect()
    assert [(r.cx, r.cy, r.bits, r.rescued) for r in got] == [(160.0, 55.0, "100000", True)]


def dotted(cells, h=200, w=400):
    image = np.full((h, w, 3), 120, dtype=np.uint8)
    for x, y in cells:
        for dx, dy in kernels.DOT_OFFSETS:
            a, b = int(x + dx * 40), int(y + dy * 60)
            image[b - 3 : b + 3, a - 3 : a + 3] = 250
    return image - np.random.default_rng(0).integers(0, 9, image.shape).astype(np.uint8)


def test_gap_recovery(spark):
    def sees_all():
        class All:
            def detect(self, image, least):
                return np.array([[image.shape[1] / 2, image.shape[0] / 2, 40, 60, 0.5]])

        return All()

    image = dotted([(100, 100), (200, 100)])
    cells = spark.createDataFrame([(1, 0, 100.0, 100.0, 40.0, 60.0, 0.9, "111111", False)], "page_id long, det_id long, cx double, cy double, w double, h double, conf double, bits string, rescued boolean")
    threshold = rescue.page_threshold(photos(spark, image), cells)
    assert threshold.first().threshold > 50
    places = spark.createDataFrame([(1, 203.0, 97.0, 40.0, 60.0), (1, 300.0, 100.0, 40.0, 60.0), (1, 103.0, 100.0, 40.0, 60.0)], PLACES)
    got = rescue.gap_recovery(photos(spark, image), places, cells, threshold, sees_all).collect()
    assert len(got) == 1 and abs(got[0].cx - 200) <= 4 and abs(got[0].cy - 100) <= 9  # neither the space nor the known cell


def test_indicator_recovery(spark):
    image = sheet(faint={(0, 4)})
    rows = [(1, i, 40.0 + 40 * i, 55.0, 20.0, 30.0, 0.9, "001111" if i == 3 else "100000", False) for i in (0, 1, 2, 3, 5, 6)]
    cells = spark.createDataFrame(rows, "page_id long, det_id long, cx double, cy double, w double, h double, conf double, bits string, rescued boolean")
    assert [(r.cx, r.cy) for r in rescue.indicator_recovery(photos(spark, image), cells, opener()).collect()] == [(200.0, 55.0)]


def test_local_retry(spark):
    image = sheet()
    known = spark.createDataFrame([(1, 40.0, 55.0)], "page_id long, cx double, cy double")
    around = spark.createDataFrame([(1, 20.0, 30.0, 110.0, 90.0)], "page_id long, lo_x double, lo_y double, hi_x double, hi_y double")
    got = rescue.local_retry(photos(spark, image), around, opener(), known).collect()
    assert [(r.cx, r.cy) for r in got] == [(80.0, 55.0)]


def test_best_contrast(spark):
    got = photo.best_contrast(photos(spark, sheet(shade=190)), opener()).first()
    assert got.n_high == 24 and got.variant != "contrast 0.7" and len(got.pixels) == 300 * 420 * 3


def test_evaluation(spark):
    truth = [(1, 8 * r + c, 40.0 + 40 * c, 55.0 + 80 * r, 20.0, 30.0, "100000" if c else "010000") for r in range(3) for c in range(8)] + [(1, 99, 390.0, 280.0, 20.0, 30.0, "100000")]
    cells = spark.createDataFrame(truth, "page_id long, det_id long, cx double, cy double, w double, h double, bits string")
    counts = pipeline.evaluate(photos(spark, sheet()), cells, opener())
    assert [(r.n_gt, r.n_pred, r.tp, r.class_ok) for r in counts.collect()] == [(25, 24, 24, 21)]
    lines = [r.line for r in evalm.aggregate_lines(counts).orderBy("line_no").collect()]
    assert lines == ["AGGREGATE gt=25 pred=24 tp=24", "Precision : 1.000", "Recall    : 0.960", "F1        : 0.979", "Class acc : 0.875"]


@pytest.mark.parametrize("turn", range(1, 9))
def test_orientation(turn):
    image = np.arange(24).reshape(2, 4, 3)
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHII", 8, 1, 0x0112, 3, 1, turn)
    content = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda"
    assert photo.exif_orientation(content) == turn and photo.exif_orientation(b"\x89PNG") == 1 and photo.exif_orientation(b"\xff\xd8\xff\xe1\0\x05Ex") == 1
    shown = photo.orient(image, turn)
    corner = {1: (0, 0), 2: (0, 3), 3: (1, 3), 4: (1, 0), 5: (0, 0), 6: (1, 0), 7: (1, 3), 8: (0, 3)}[turn]  # what comes to the upper left
    assert (shown[0, 0] == image[corner]).all() and shown.shape[:2] == ((2, 4) if turn < 5 else (4, 2))


def test_colour_space_round_trip(rng):
    rgb = rng.integers(0, 256, (20, 20, 3))
    assert np.abs(photo.from_lab(photo.to_lab(rgb.astype(float))) - rgb).max() < 0.5
    assert photo.equalised(rgb).shape == rgb.shape and np.allclose(photo.to_lab(np.full((1, 1, 3), 255.0)), [[[255, 0, 0]]], atol=0.1)
