import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dotframe.llm import leakage

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
VOCABULARY = "red green blue one two three four dots line page cell grid".split()


def shared(a, b, n=12):
    grams = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
    return any(tuple(b[i : i + n]) in grams for i in range(len(b) - n + 1))


@pytest.mark.parametrize("seed", [0, 1])
def test_as_brute_force(spark, seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choices(VOCABULARY, k=rnd.choice([5, 11, 12, 13, 40, 60])))) for i in range(12)]
    docs = []
    for d in range(80):
        ws = rnd.choices(VOCABULARY, k=rnd.choice([0, 3, 50, 200]))
        for _ in range(rnd.choice([0, 1, 1, 2])):
            part = leakage.words(rnd.choice(items)[1])
            n = rnd.choice([11, 12, 13, 30])
            at = rnd.randrange(max(1, len(part) - n + 1))
            where = rnd.randrange(len(ws) + 1)
            ws[where:where] = part[at : at + n]
        sep = rnd.choice([" ", "\n", " -- ", "… ", "_"])
        docs.append((d, sep.join(w.upper() if rnd.random() < 0.2 else w for w in ws)))
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id) for r in got.where("longest_run >= 12").collect()}
    want = {(d, i) for d, t in docs for i, s in items if shared(leakage.words(t), leakage.words(s))}
    assert got == want and want


def test_edited_copy_is_scored(spark):
    item = "the quiet lighthouse of old harbour keeps seven hundred brass lanterns whenever the narrow tide turns back to sea"
    edited = item.replace("seven", "nine").replace("narrow ", "")
    got = leakage.leaks(spark.createDataFrame([(1, f"well {edited} then"), (2, "nothing at all")], DOCS), spark.createDataFrame([(5, item)], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)]
    assert got[0].longest_run < 12 and got[0].score > 24 and 5 <= got[0].covered_words < got[0].item_words


def test_edited_copy_beside_a_verbatim_one(spark):
    ws = [f"w{i}" for i in range(16)]
    edited = " ".join([*ws[:7], "other", *ws[8:]])
    docs = [(1, " ".join(ws)), (2, f"well {edited} then"), (3, edited), (4, "nothing at all")]
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, " ".join(ws))], ITEMS)).collect()
    assert {r.doc_id: (r.score, r.longest_run) for r in got} == {1: (32, 16), 2: (29, 8), 3: (29, 8)}


def score_of(a, b):
    """Smith-Waterman, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i, j in ((i, j) for i in range(1, len(a) + 1) for j in range(1, len(b) + 1)):
        m = leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH
        h[i][j] = max(0, h[i - 1][j - 1] + m, h[i - 1][j] + leakage.GAP, h[i][j - 1] + leakage.GAP)
        best = max(best, h[i][j])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.lists(st.integers(-1, 3), min_size=1, max_size=25), min_size=1, max_size=4))
def test_alignment(a, many):
    got = leakage.align_all(np.array(a, dtype=np.int32), [np.array(b, dtype=np.int32) for b in many])
    known = np.concatenate([np.array(b) >= 0 for b in many])
    most = leakage.reachable(known, np.cumsum([0, *map(len, many)])[:-1])
    for b, (score, end, longest, covered), bound in zip(many, got, most):
        assert score == score_of(a, b) == score_of(a, b[:end]) <= bound
        assert not end or score_of(a, b[: end - 1]) < score
        runs = [n for n in range(1, 26) if shared(a, b, n)]
        assert longest == max(runs, default=0)
        hit = {k for i in range(len(a) - 4) if any(a[i : i + 5] == b[j : j + 5] for j in range(len(b))) for k in range(i, i + 5)}
        assert covered == len(hit)


def test_recall_of_edited_copies(spark):
    """Copies with one word in ten changed, dropped or added: a similarity of
    0.8 or more by words. Nine in ten of them must be found, and are."""
    rnd = random.Random(7)
    item = {i: [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([30, 50, 80]))] for i in range(60)}
    docs = []
    for d in range(600):
        ws = []
        for w in item[d % 60]:
            r = rnd.random()
            ws += [] if r < 0.033 else [f"x{rnd.randrange(99)}"] if r < 0.066 else [w, "added"] if r < 0.1 else [w]
        docs.append((d, " ".join([*(f"y{rnd.randrange(500)}" for _ in range(100)), *ws])))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in item.items()], ITEMS)
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, DOCS), items).collect()}
    assert got <= {(d, d % 60) for d, _ in docs} and len(got) >= 0.99 * len(docs)


def test_filter_grows_with_the_shingles():
    assert leakage.bloom_size(0) == leakage.BLOOM_LEAST and leakage.bloom_size(1 << 40) == leakage.BLOOM_MOST
    assert leakage.bloom_size(10**6) >= 16 * 10**6


def test_full_filter_loses_nothing(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(i, item if i % 2 else "a b c d e f g h") for i in range(6)]
    got = leakage.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS), n_bits=64)
    assert {r.doc_id for r in got.collect()} == {1, 3, 5}


def test_nulls_repeats_clashes_and_empty(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (None, item), (4, " \n")], DOCS).selectExpr("*", "1 as gram", "2 as item_id", "3 as passage")
    items = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, "")], ITEMS).selectExpr("*", "1 as gram", "2 as doc_id")
    assert [(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()] == [(1, 1)]
    assert leakage.leaks(docs.limit(0), items).count() == 0
    assert leakage.leaks(docs, items.limit(0)).count() == 0
