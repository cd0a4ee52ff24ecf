import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dotframe.llm import pieces

CELLS = "page_id long, cell_idx int, frac_bbox struct<l:double,t:double,r:double,b:double>, label int, bits6 string, source string"
IMAGES = "page_id long, source string, path string, img_w int, img_h int"
LIMITS = "source string, max_piece_px int, overlap_px int"


def cells(spark, page, spans, h, extra=()):
    rows = [(page, i, (0.1, t / h, 0.2, b / h), 1, "100000", "s") for i, (t, b) in enumerate(spans)]
    return spark.createDataFrame([*rows, *extra], CELLS)


def test_cuts_between_lines(spark):
    h, spans = 1000, [(y, y + 30) for y in range(20, 950, 50)]
    df = cells(spark, 1, spans * 2, h, [(1, 99, None, 1, None, "s"), (1, 98, (0.1, None, 0.2, 0.9), 1, None, "s"), (1, 97, (0.1, 0.5, 0.2, 0.4), 1, None, "s"), (1, 96, (0.1, 0.0, 0.2, float("nan")), 1, None, "s"), (None, 1, (0.1, 0.0, 0.2, 1.0), 1, None, "s"), (2, 1, (0.1, 0.0, 0.2, 1.0), 1, None, "s")])
    pages = spark.createDataFrame([(1, "s", "a.jpg", 100, h), (2, "unlimited", "b.jpg", 100, 9000)], IMAGES)
    got = sorted(pieces.pieces(df, pages, spark.createDataFrame([("s", 300, 40)], LIMITS)).collect(), key=lambda r: r.piece_no)
    assert {r.page_id for r in got} == {1} and got[0].y0 == 20 and got[-1].y1 == 950
    for a, b in zip(got, got[1:]):
        assert b.y0 == a.y1 - 40
    for r in got:
        assert r.y1 - r.y0 <= 300 and r.n_pieces == len(got) and r.natural_end
        assert not any(t < r.y1 < b for t, b in spans)


def test_hard_cut_through_a_tall_cell(spark):
    df = cells(spark, 1, [(0, 1000)], 1000)
    pages = spark.createDataFrame([(1, "s", "a.jpg", 100, 1000)], IMAGES)
    got = pieces.pieces(df, pages, spark.createDataFrame([("s", 400, 500)], LIMITS)).orderBy("piece_no").collect()
    assert all(r.y1 - r.y0 <= 400 for r in got) and got[-1].y1 == 1000 and not got[0].natural_end


def test_touching_lines_and_limit_not_passed(spark):
    pages = spark.createDataFrame([(1, "s", "a.jpg", 100, 100)], IMAGES)
    df = cells(spark, 1, [(0, 25), (25, 50), (50, 75), (75, 100)], 100)
    got = pieces.pieces(df, pages, spark.createDataFrame([("s", 60, 0)], LIMITS)).orderBy("piece_no").collect()
    assert [(r.y0, r.y1, r.natural_end) for r in got] == [(0, 50, True), (50, 100, True)]
    assert pieces.pieces(df, pages, spark.createDataFrame([("s", 100, 0)], LIMITS)).count() == 0
    empty = [spark.createDataFrame([], s) for s in (CELLS, IMAGES, LIMITS)]
    assert pieces.pieces(*empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 50), st.integers(1, 400), st.integers(1, 90), st.integers(0, 100), st.integers(0, 2**32 - 1))
def test_cut_page_properties(top, height, most, overlap, seed):
    crossed = np.random.default_rng(seed).random(height + 1) < 0.8
    got = pieces.cut_page(top, top + height, most, overlap, crossed)
    assert got[0][0] == top and got[-1][1] == top + height
    step = min(overlap, most - 1)
    for (a0, a1, natural), (b0, _, _) in zip(got, got[1:]):
        assert 0 < a1 - a0 <= most and b0 == a1 - step
        assert natural == (not crossed[a1 - top]) or not natural
        later = [y for y in range(a1 + 1, a0 + most + 1) if not crossed[y - top]]
        assert not natural or not later
        if not natural:
            assert all(crossed[y - top] for y in range(a0 + step + 1, a0 + most + 1))


def test_masks_as_brute_force(spark, rng):
    h = 700
    spans = [(float(a), float(a + w)) for a, w in zip(rng.random(60) * 500, rng.random(60) * 190)]
    df = cells(spark, 1, spans, h)
    tall = spark.createDataFrame([(1, h)], "page_id long, img_h int")
    row = pieces._masks(df, tall).first()
    got = {x["at"] * 64 + k for x in row.ranges for k in range(64) if x["mask"] >> k & 1}
    usable = pieces.usable_boxes(df).collect()
    assert got == {y for y in range(h + 1) if any(r.t * h < y < r.b * h for r in usable)}


@pytest.mark.parametrize("page, name", [(1, "a_piece000"), (2, "page2_piece000")])
def test_names(spark, page, name):
    found = spark.createDataFrame([(page, 0, 1)], "page_id long, piece_no int, n_pieces int")
    manifest = spark.createDataFrame([(1, "/data/crops/train/a_0001.jpg"), (None, None)], "page_id long, path string")
    assert pieces.named_pieces(found, manifest).first().name == name
