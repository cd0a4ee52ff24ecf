"""Golden vectors of line layout, and brute force."""

import itertools
import random
import statistics

import pytest

from dotframe.operators import gridfill, layout, suppress

CELL = "page_id long, det_id long, cx double, cy double, w double, h double, conf double, bits string, rescued boolean"


def page(rows, page_id=1):
    out = []
    for i, r in enumerate(rows):
        d = dict(cx=0.0, cy=100.0, w=25.0, h=50.0, conf=0.9, bits="100000") | r
        out.append((page_id, i, *(float(d[k]) for k in ("cx", "cy", "w", "h", "conf")), d["bits"], False))
    return out


def lines_of(spark, rows):
    return layout.line_groups(spark.createDataFrame(page(rows), CELL))


@pytest.mark.parametrize(
    "ys, want",
    [([100, 125, 150, 175], [[100, 125, 150, 175]]), ([100, 110, 250, 260], [[100, 110], [250, 260]]), ([5], [[5]])],
)
def test_lines(spark, ys, want):
    rows = lines_of(spark, [{"cy": y, "cx": i} for i, y in enumerate(ys)]).collect()
    got = [sorted(r.cy for r in g) for _, g in itertools.groupby(sorted(rows, key=lambda r: (r.line_id, r.cy)), lambda r: r.line_id)]
    assert got == want


@pytest.mark.parametrize("xs, w, want", [([0, 30, 60, 200, 230], 25, [0, 0, 0, 4, 0]), ([7], 25, [0]), ([0, 30, 160], 20, [0, 0, 2])])
def test_spaces(spark, xs, w, want):
    got = layout.spaced(lines_of(spark, [{"cx": x, "w": w} for x in xs])).orderBy("cx").collect()
    assert [r.n_spaces for r in got] == want


def test_space_has_height_of_the_cell_after(spark):
    rows = [{"cx": 0}, {"cx": 30}, {"cx": 200, "cy": 108}]
    got = layout.insert_spaces(lines_of(spark, rows)).where("is_space").collect()
    assert got and all(r.cy == 108 and r.cx is None and r.bits == "000000" for r in got)


def test_page_text(spark):
    rows = [{"cx": x} for x in (0, 30, 60, 200, 230)] + [{"cx": x, "cy": 300, "bits": "000001"} for x in (0, 30)]
    got = layout.page_text(spark.createDataFrame(page(rows), CELL)).first().text
    assert got == "⠁⠁⠁⠀⠀⠀⠀⠁⠁\n⠠⠠"


def test_markout_runs(spark):
    bits = ["100000", "111111", "110000", "111111", "111111", "101000"]
    rows = [{"cx": 30 * i, "bits": b} for i, b in enumerate(bits)]
    got = layout.strip_markout(lines_of(spark, rows)).orderBy("det_id").collect()
    assert [r.det_id for r in got] == [0, 1, 2, 5]


def test_gap_and_edge_slots(spark):
    full = [{"cx": 10 + 30 * i, "cy": 100} for i in range(8)]
    holes = [{"cx": 10 + 30 * i, "cy": 300} for i in (2, 3, 5)]
    lines = lines_of(spark, full * 1 + holes + [{"cx": 10 + 30 * i, "cy": 500} for i in range(8)])
    assert [(r.line_id, r.ex) for r in layout.gap_slots(lines).collect()] == [(1, 130.0)]
    got = sorted((r.side, r.ex) for r in layout.edge_slots(lines).where("line_id = 1").collect())
    assert got == [("left", 10.0), ("left", 40.0), ("right", 190.0), ("right", 220.0)]


def test_indicator_targets(spark):
    rows = [{"cx": 0, "bits": "000001"}, {"cx": 30}, {"cx": 60, "bits": "001111"}, {"cx": 150}, {"cx": 180, "bits": "000001"}]
    got = layout.indicator_targets(lines_of(spark, rows)).orderBy("ex").collect()
    assert [r.det_id for r in got] == [2, 4]


ROW = [0, 50, 100, 150, 200]


@pytest.mark.parametrize(
    "xs, a, b, gone",
    [
        ([0, 50, 100, 200, 250], (150, 0.3), (165, 0.9), 165), ([], (150, 0.3), (165, 0.9), 150), ([0, 50, 250, 300], (150, 0.2), (165, 0.9), 165),
        ([0, 55, 260, 320], (150, 0.5), (165, 0.9), None), ([0, 50, 100, 200], (150, 0.9), None, None),
    ],
)
def test_residual_overlaps(spark, xs, a, b, gone):
    rows = [{"cx": x, "w": 30} for x in xs] + [{"cx": x, "conf": c, "w": 30} for x, c in (p for p in (a, b) if p)]
    got = {r.cx for r in suppress.resolve_overlaps(spark.createDataFrame(page(rows), CELL)).collect()}
    assert {r["cx"] for r in rows} - got == ({gone} if gone is not None else set())


def overlap(a, b):
    iw = min(a[2] + a[4] / 2, b[2] + b[4] / 2) - max(a[2] - a[4] / 2, b[2] - b[4] / 2)
    ih = min(a[3] + a[5] / 2, b[3] + b[5] / 2) - max(a[3] - a[5] / 2, b[3] - b[5] / 2)
    return iw * ih / (a[4] * a[5] + b[4] * b[5] - iw * ih) if iw > 0 and ih > 0 else 0.0


@pytest.mark.parametrize("seed", range(3))
def test_suppression_chains(spark, seed):
    rnd = random.Random(seed)
    rows = [r for p in range(4) for r in page([{"cx": rnd.random() * 90, "cy": rnd.random() * 90, "w": 10 + rnd.random() * 30, "h": 20 + rnd.random() * 20, "conf": rnd.randint(0, 9) / 10} for _ in range(40)], p)]
    want = set()
    for p in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[6], r[1])):
            if all(overlap(r, k) <= 0.5 for k in kept):
                kept.append(r)
        want |= {(p, r[1]) for r in kept}
    got = {(r.page_id, r.det_id) for r in suppress.nms(spark.createDataFrame(rows, CELL)).collect()}
    assert got == want


def test_grid_fill(spark):
    rows = [{"cx": 10 + 30 * i} for i in (0, 1, 2, 4, 5)] + [{"cx": 101, "conf": 0.1}, {"cx": 99, "conf": 0.2}, {"cx": 700, "conf": 0.2}]
    rows += [{"cx": 10 + 30 * i, "cy": 300} for i in (0, 1, 3, 4, 5)] + [{"cx": 70, "cy": 300, "conf": 0.1, "bits": "111111"}]
    got = gridfill.grid_fill(spark.createDataFrame(page(rows), CELL)).collect()
    stages = {s: sorted(r.det_id if r.det_id is not None else -1 for r in got if r.stage == s) for s in ("rescued", "gap", "edge", "unfiltered")}
    assert stages == {"rescued": [6], "gap": [-1], "edge": [], "unfiltered": []}
    low = spark.createDataFrame(page([{"conf": 0.1}]), CELL)
    assert [r.stage for r in gridfill.grid_fill(low).collect()] == ["unfiltered"]


def test_empty(spark):
    none = spark.createDataFrame([], CELL)
    assert layout.page_text(none).count() == 0 and suppress.nms(none).count() == 0
    assert suppress.resolve_overlaps(none).count() == 0 and gridfill.grid_fill(none).count() == 0


def test_median_matches_the_library(spark):
    rnd = random.Random(4)
    rows = [{"cx": rnd.random() * 500, "w": rnd.random() * 9} for _ in range(30)]
    got = layout.char_spacing(lines_of(spark, rows)).first()
    xs = sorted(r["cx"] for r in rows)
    gaps = sorted(b - a for a, b in zip(xs, xs[1:]))
    assert got.spacing == pytest.approx(gaps[len(gaps) // 10]) and got.median_w == pytest.approx(statistics.median(r["w"] for r in rows))
