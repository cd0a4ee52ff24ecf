import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dotframe.llm import tokenize

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenize.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def merger():
    return tokenize.Merger(tokenize.read_ranks(tokenize.vocabulary_path()))


def encode(texts, merger):
    ids, b = tokenize.encode_texts(texts, merger)
    return [ids[i:j].tolist() for i, j in zip(b, b[1:])]


ALPHABET = [*"  \n\t'ssrevelltdmaSTZ1²½éЖ中 \x85\x1c-_!’　 \0🏫́", "'s", "'re", "'LL", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=8))
def test_like_the_library(reference, merger, texts):
    assert encode(texts, merger) == reference(texts)


def test_every_code_point(reference, merger):
    texts = [f"a{chr(i)}1{chr(i)} {chr(i)}'s" for i in range(0, 0x110000) if not 0xD800 <= i < 0xE000][::7]
    assert encode(texts, merger) == reference(texts)


def test_long_texts_in_segments(reference, merger, monkeypatch):
    monkeypatch.setattr(tokenize, "CHUNK_CHARS", 50)
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(n)) for n in (0, 49, 50, 51, 500, 3)] + [None, "x" * 300, " " * 200 + "y", "'re" * 90]
    assert encode(texts, merger) == reference([t or "" for t in texts])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=8), st.sampled_from([5, 20, 1 << 20]))
def test_offsets_are_where_the_tokens_are(merger, texts, chunk):
    sizes = np.zeros(max(merger.ranks.values()) + 1, dtype=np.int64)
    for token, i in merger.ranks.items():
        sizes[i] = len(token)
    by_id = {i: b for b, i in merger.ranks.items()}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokenize, "CHUNK_CHARS", chunk)
        ids, bounds, begins = tokenize.encode_texts(texts, merger, sizes)
    for text, a, b in zip(texts, bounds, bounds[1:]):
        data, end = text.encode(), 0
        for i, at in zip(ids[a:b].tolist(), begins[a:b].tolist()):
            assert at == end and data[at : at + len(by_id[i])] == by_id[i]
            end = at + len(by_id[i])
        assert end == len(data)


def test_states_as_step_by_step(rng):
    cls = rng.integers(0, 9, 5000).astype(np.uint8)
    state, want = tokenize.FRESH, []
    for c in cls:
        want.append(state)
        state = tokenize.NEXT[c, state]
    assert tokenize.scan_states(cls).tolist() == want


def test_a_very_long_piece_is_fast(reference, merger):
    text = "abcde" * 40_000
    assert encode([text], merger) == reference([text])


def test_table_and_round_trip(spark, reference):
    rows = [(1, "It’s ⠝⠁ 12 cells."), (2, ""), (3, None), (4, "  "), (1, "again"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as ids")
    got = tokenize.token_ids(df)
    assert got.columns == ["doc_id", "ids"]
    have = sorted(((r.doc_id or 0, list(r.ids)) for r in got.collect()))
    assert have == sorted((i or 0, reference([t or ""])[0]) for i, t in rows)
    full = tokenize.encoded(df)
    assert sorted(((r.doc_id or 0, list(r.ids)) for r in full.collect())) == have
    assert sorted(r.text for r in tokenize.decoded(full).collect()) == sorted(t or "" for _, t in rows)
    moved = full.where("doc_id = 1").withColumn("begins", F.transform("begins", lambda x: x + 1))
    assert [r.text for r in tokenize.decoded(moved).collect()] == [None, None]
    assert tokenize.token_ids(df.limit(0)).count() == 0
