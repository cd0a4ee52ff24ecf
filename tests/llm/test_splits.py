import random

import pytest
from pyspark.sql import functions as F

from dotframe.llm import splits

MANIFEST = "crop_id long, page_id long, cell_idx int, source string, split string, path string, bits6 string, label_int int, n_bytes long"


def rows_of(page, split, labels, first=0, path=None):
    return [
        (page * 10_000 + i, page, i, "s", split, path or f"/data/crops/{split}/img{page}_{i:04d}.jpg", None, x, 1)
        for i, x in enumerate(labels, first)
    ]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def edited(rnd, seq, n):
    seq = list(seq)
    for _ in range(n):
        i = rnd.randrange(len(seq) + 1)
        kind = rnd.random()
        if kind < 0.34:
            seq.insert(i, rnd.randint(1, 4))
        elif seq and kind < 0.67:
            seq.pop(min(i, len(seq) - 1))
        elif seq:
            seq[min(i, len(seq) - 1)] = rnd.randint(1, 4)
    return seq


@pytest.mark.parametrize("seed, alphabet", [(0, 63), (1, 4), (2, 2)])
def test_as_brute_force(spark, seed, alphabet):
    rnd = random.Random(seed)
    pages, no = {}, 0
    for _ in range(60):
        base = [rnd.randint(1, alphabet) for _ in range(rnd.choice([1, 3, 5, 8, 9, 10, 11, 12, 17, 18, 19, 20, 27, 71, 72, 73, 80, 81, 90, 130]))]
        limit = max(1, len(base) // 10)
        for k in (0, limit, limit + 1):
            no += 1
            pages[no] = (rnd.choice(["train", "train", "val", "test"]), edited(rnd, base, k))
    df = spark.createDataFrame([r for p, (s, seq) in pages.items() for r in rows_of(p, s, seq)], MANIFEST)
    got = {(r.train_page, r.eval_page) for r in splits.overlaps(df).collect()}
    want = {
        (p, q)
        for p, (s, a) in pages.items() if s == "train" and a
        for q, (t, b) in pages.items() if t != "train" and b and distance(a, b) <= max(len(a), len(b)) // 10
    }
    assert got == want
    links = {r.page_id: (r.n_eval, r.n_train) for r in splits.page_links(df).collect()}
    assert all(n == (sum(p == a for a, _ in want), sum(p == b for _, b in want)) for p, n in links.items())
    assert {p for pair in want for p in pair} <= set(links)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("x12_tram-stop-026", "X12_TRAM-STOP-026", True), ("x12_tram-stop-026", "X12-TRAMSTOP026 (3)", True), ("x12_tram-stop-026", "x12_tram_stop_26.JPG", True),
        ("x12_tram-stop-026", "x12%20tram-stop-00026", True), ("x12_tram-stop-026", "x12\\tram-stop-026 - copy", True), ("x12_tram-stop-026", "x12_tram-stop-026(2)", True),
        ("x12_tram-stop-026", "x12_tram-stop-027", False), ("x12_tram-stop-026", "x1_tram-stop-026", False), ("x12_tram-stop-026", "x12_hand-rail-026", False),
        ("x1_2", "x12", False), ("x12_tram-stop-026", "x12_tram-stop-0260", False),
    ],
)
def test_names(spark, a, b, same):
    df = spark.createDataFrame([(f"/data/crops/train/{a}_0000.jpg", f"/data/crops/val/{b}_0017.jpg")], "a string, b string")
    x, y = df.select(splits.image_name(F.col("a")), splits.image_name(F.col("b"))).first()
    assert (x == y) == same


def test_pages_without_patterns_go_by_name(spark):
    bare = [(1, 1, 0, None, "train", "/data/crops/train/a-b_01_0000.jpg", None, None, None), (2, 2, 0, None, "val", "/data/crops/val/A_B_1.png_0000.jpg", None, None, None)]
    spoilt = [(3, 3, 0, None, "train", "/data/crops/train/c_0000.jpg", "??????", None, 1), (4, 4, 0, None, "test", "/data/crops/test/c_0000.jpg", "", None, 1)]
    df = spark.createDataFrame(bare + spoilt, MANIFEST)
    assert [(r.train_page, r.eval_page, r.kind) for r in splits.overlaps(df).collect()] == [(1, 2, "name")]
    rep = splits.overlap_report(df, splits.page_links(df)).collect()
    assert sum(r.n_pages for r in rep) == 4 and sum(r.n_overlapping for r in rep) == 2


def test_repeats_order_nulls_and_empty(spark):
    seq = [random.Random(5).randint(1, 63) for _ in range(30)]
    rows = rows_of(1, "train", seq) + rows_of(2, "val", seq)
    rows += rows + [(9, None, 0, "s", "train", "p", None, 5, 1), (10, 7, None, "s", None, None, None, 5, 1)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, MANIFEST).withColumn("n", F.lit(1)).withColumn("cls", F.lit("x"))
    assert [(r.train_page, r.eval_page, r.kind) for r in splits.overlaps(df).collect()] == [(1, 2, "exact")]
    assert splits.overlaps(spark.createDataFrame([], MANIFEST)).count() == 0


def test_long_page_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(splits, "CHUNK", 7)
    rnd = random.Random(3)
    seq = [rnd.randint(1, 63) for _ in range(500)]
    df = spark.createDataFrame(rows_of(1, "train", seq) + rows_of(2, "test", edited(rnd, seq, 40)), MANIFEST)
    assert [(r.train_page, r.eval_page) for r in splits.overlaps(df).collect()] == [(1, 2)]


def test_hot_group_of_copies(spark):
    seq = [random.Random(6).randint(1, 63) for _ in range(40)]
    df = spark.createDataFrame([r for p in range(40) for r in rows_of(p, "train" if p % 2 else "val", seq)], MANIFEST)
    assert splits.overlaps(df).count() == 400
    rows = splits.page_links(df).collect()
    assert len(rows) == 40 and len({r.cls for r in rows}) == 1 and all((r.n_eval, r.n_train) == ((20, 0) if r.in_train else (0, 20)) for r in rows)


def test_hot_class_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(splits, "PAIR_BLOCK", 3)
    seq = [random.Random(6).randint(1, 63) for _ in range(40)]
    df = spark.createDataFrame([r for p in range(40) for r in rows_of(p, "train" if p % 2 else "val", seq)], MANIFEST)
    got = splits.overlaps(df)
    assert got.count() == got.distinct().count() == 400


def test_pages_of_one_repeated_pattern(spark, monkeypatch):
    monkeypatch.setattr(splits, "BLOCK", 16)
    seq = {1: [5] * 200, 2: [5] * 190, 3: [5] * 150 + [7] * 40 + [5] * 10, 4: [5, 6] * 100, 5: [6, 5] * 99}
    df = spark.createDataFrame([r for p, x in seq.items() for s, k in (("train", 0), ("test", 10)) for r in rows_of(p + k, s, x)], MANIFEST)
    got = {(r.train_page, r.eval_page - 10) for r in splits.overlaps(df).collect()}
    assert got == {(p, q) for p in seq for q in seq if distance(seq[p], seq[q]) <= max(len(seq[p]), len(seq[q])) // 10}


def test_page_in_both_roles_does_not_count_itself(spark):
    seq = [random.Random(2).randint(1, 63) for _ in range(20)]
    df = spark.createDataFrame(rows_of(1, "train", seq[:10]) + rows_of(1, "val", seq[10:], 10) + rows_of(2, "train", seq) + rows_of(3, "val", seq), MANIFEST)
    got = {r.page_id: (r.n_eval, r.n_train) for r in splits.page_links(df).collect()}
    assert got == {1: (1, 1), 2: (2, 0), 3: (0, 2)}
