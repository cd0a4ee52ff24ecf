import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dotframe.llm import sample

MANIFEST = "crop_id long, page_id long, cell_idx int, source string, split string, path string, bits6 string, label_int int, n_bytes long"


@pytest.fixture(scope="module")
def crops(spark):
    rows = [(i, 1 if i % 3 else 2 + i % 5) for i in range(3000)]  # pattern 1 holds two thirds
    return spark.createDataFrame(rows, "crop_id long, label_int int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "label_int int, target_bp int, min_rows int")


@pytest.mark.parametrize(
    "bits, label, want",
    [
        ("100000", 1, 1), ("100000", None, 1), (None, 1, 1), ("100000", 2, None), ("000000", 5, 5), ("000000", None, None), ("1o0000", 3, 3),
        ("1000000", 3, 3), ("100000\n", None, None), ("", 0, None), (None, 64, None), ("111111", 0, 63), (None, None, None),
    ],
)
def test_pattern(spark, bits, label, want):
    df = spark.createDataFrame([(bits, label)], "bits6 string, label_int int")
    assert df.select(sample.pattern_column()).first()[0] == want


def test_report_and_draw_agree(spark, crops):
    t = targets(spark, [(1, 5000, 3), (2, 2500, 3), (3, 2500, 700), (9, 0, 4), (8, None, None)])
    rep = {r.label_int: r for r in sample.report(crops, {"label_int": t}, "label_int").collect()}
    drawn = {r.label_int: r["count"] for r in sample.draw(crops, {"label_int": t}).groupBy("label_int").count().collect()}
    assert sum(drawn.values()) == 600
    assert {k: r.drawn for k, r in rep.items() if r.drawn} == drawn
    assert {k for k, r in rep.items() if r.named and not r.met} == {3, 9}
    got = sample.draw(crops, {"label_int": t})
    assert got.count() == got.distinct().count()
    assert sample.draw(crops, {"label_int": t}, seed=1).exceptAll(got).count() > 0


def test_targets_met_when_they_can_be(spark, crops):
    t = targets(spark, [(1, 4000, 1), (2, 2000, 1), (3, 2000, 1), (4, 1000, 1), (5, 1000, 50)])
    rep = {r.label_int: r.drawn for r in sample.report(crops, {"label_int": t}, "label_int").collect()}
    assert rep == {1: 240, 2: 120, 3: 120, 4: 60, 5: 60, 6: 0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(0, 300), st.integers(0, 20)), min_size=1, max_size=12), st.integers(0, 1500), st.integers(0, 3))
def test_swap_repair_is_optimal(rows, size, seed):
    have, want, floor = (np.array(x) for x in zip(*rows))
    out = sample.swap_repair(have, want, floor, size, seed)
    assert out.sum() == min(size, have.sum()) and (out <= have).all()
    if np.minimum(floor, have).sum() <= size:
        assert (out >= np.minimum(floor, have)).all()
        last = np.where(want > 0, 0, have.sum() + 1)
        over = out - want + last
        for a in np.flatnonzero(out > np.minimum(floor, have)):
            for b in np.flatnonzero(out < have):
                assert a == b or over[a] - over[b] <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=9, max_size=9), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 8)), min_size=6, max_size=6), st.integers(0, 200))
def test_two_columns_no_single_exchange_helps(have, goals, size):
    have = np.array(have)
    sig = np.array([[i // 3, 3 + i % 3] for i in range(9)])
    want, floor = (np.array(x) for x in zip(*goals))
    out = sample.swap_repair(have, want, floor, size, 1, sig)
    assert out.sum() == min(size, have.sum()) and (out >= 0).all() and (out <= have).all()
    count = lambda x: np.bincount(sig.ravel(), np.repeat(x, 2), minlength=6)
    last = np.where(want > 0, 0, have.sum() + 1)
    cost = lambda x: float(((count(x) - want + last) ** 2).sum())
    least = np.minimum(np.minimum(floor, count(have)), count(out))
    for a in range(9):
        for b in range(9):
            if a != b and out[a] and out[b] < have[b]:
                other = out.copy()
                other[a] -= 1
                other[b] += 1
                assert cost(other) >= cost(out) or (count(other) < least).any()


@pytest.mark.parametrize("seed", range(40))
def test_pairs_beyond_the_first_block(monkeypatch, seed):
    monkeypatch.setattr(sample, "PAIRS", 2)
    rng = np.random.default_rng(seed)
    sig = np.array([(a, 4 + b) for a in range(4) for b in range(4)])
    have, want, floor = rng.integers(0, 9, 16), rng.integers(0, 12, 8), rng.integers(0, 4, 8)
    out = sample.swap_repair(have, want, floor, int(have.sum() // 2), seed, sig)
    count = lambda x: np.bincount(sig.ravel(), np.repeat(x, 2), minlength=8)
    least = np.minimum(np.minimum(floor, count(have)), count(out))
    weight = np.where(want > 0, 0, int(have.sum()) + 1)
    cost = lambda x: ((count(x) - want) ** 2 + weight * count(x)).sum()
    for i in range(16):
        for j in range(16):
            if i != j and out[i] > 0 and out[j] < have[j]:
                other = out.copy()
                other[i] -= 1
                other[j] += 1
                assert (count(other) < least).any() or cost(other) >= cost(out)


def test_blocks_hold_every_pair(monkeypatch):
    monkeypatch.setattr(sample, "PAIRS", 2)
    assert sorted(sample._blocks(5, 3)) == [(a, b) for a in (0, 2, 4) for b in (0, 2)] and not list(sample._blocks(0, 3))


def test_too_many_targets(spark, crops, monkeypatch):
    monkeypatch.setattr(sample, "MAX_SIGNATURES", 10)
    with pytest.raises(ValueError, match="targets"):
        sample.plan_sample(crops, {"label_int": targets(spark, [(i, 10, 0) for i in range(11)])})


def test_two_columns(spark):
    rows = [(i, i % 2, "x" if i % 5 else "y") for i in range(2000)]
    crops = spark.createDataFrame(rows, "crop_id long, a int, b string")
    ta = spark.createDataFrame([(0, 2500, 0), (1, 7500, 0)], "a int, target_bp int, min_rows int")
    tb = spark.createDataFrame([("x", 6000, 0), ("y", 4000, 0), ("z", 0, 5)], "b string, target_bp int, min_rows int")
    got = sample.draw(crops, {"a": ta, "b": tb})
    assert {r.a: r["count"] for r in got.groupBy("a").count().collect()} == {0: 100, 1: 300}
    assert {r.b: r["count"] for r in got.groupBy("b").count().collect()} == {"x": 240, "y": 160}
    rep = {r.b: r for r in sample.report(crops, {"a": ta, "b": tb}, "b").collect()}
    assert rep["y"].drawn == 160 and not rep["z"].met
    both = {(r.column, r.category): r for r in sample.reports(crops, {"a": ta, "b": tb}).collect()}
    assert {k: r.drawn for k, r in both.items()} == {("a", "0"): 100, ("a", "1"): 300, ("b", "x"): 240, ("b", "y"): 160, ("b", "z"): 0}
    assert all(r.drawn + r.left == r.available for r in both.values())


def test_empty_nulls_and_repeats(spark):
    none = spark.createDataFrame([], MANIFEST)
    c = sample.distinct_crops(none, "bits6", "label_int").select("crop_id", sample.pattern_column().alias("label_int"))
    rep = sample.report(c, {"label_int": targets(spark, [(1, 10000, 2), (None, 5, 5)])}, "label_int").collect()
    assert [(r.label_int, r.available, r.met) for r in rep] == [(1, 0, False)]
    assert sample.draw(c, {"label_int": targets(spark, [(1, 10000, 2)])}).count() == 0
    rows = [(1, 1, 1, "a", "train", "p", "100000", 1, 5)] * 2 + [(None, 1, 2, "a", "train", "q", "100000", 1, 5)] * 2 + [(None, 1, 3, "a", "train", "r", None, 1, 5)]
    assert sample.distinct_crops(spark.createDataFrame(rows, MANIFEST), "bits6", "label_int").count() == 3
