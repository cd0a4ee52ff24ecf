import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dotframe.llm import mojibake

DOCS = "doc_id long, text string"
CLEAN = [
    "Der Gärtner zählte Äpfel und öffnete die grüne Tür, “naïve” – sagt’s.", "La señora vio la montaña y el niño leyó la página.", "Młynarz pił wodę, a łódka była żółta.",
    "Проверьте, пожалуйста, чтобы чашка была светлая.", "L’élève a noté la lumière légère à côté.", "A ribbon costs £45 at 12 °C ± ½. ⠝⠁⠊⠧⠑", "NÃO ESTÁ COMPLETA; A REVISÃO", "esta&ccedil;ão e ma&ccedil;ã",
]


def garble(text, *chain):
    for w, r in zip(chain[::2], chain[1::2]):
        text = mojibake.read_as(mojibake.written(text, w), r)
    return text


CASES = [
    (0, "utf-8", "cp1252"), (0, "utf-8", "latin-1"), (0, "utf-8", "mac-roman"), (1, "utf-8", "cp437"), (1, "utf-8", "cp850"), (2, "utf-8", "cp1250"), (3, "utf-8", "cp1251"),
    (3, "utf-8", "cp1252"), (3, "koi8-r", "cp1251"), (3, "cp1251", "cp1252"), (3, "cp866", "cp1251"), (2, "cp1250", "cp1252"), (2, "iso8859-2", "cp1252"), (4, "utf-8", "cp1252", "utf-8", "cp1252"),
    (1, "cp1252", "mac-roman"), (1, "mac-roman", "cp1252"), (1, "cp1252", "utf-8"), (5, "utf-8", "cp1252"),
]


@pytest.fixture(scope="module")
def result(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 40)]
    rows += [(10_000 + i, garble(CLEAN[case[0]], *case[1:])) for i, case in enumerate(CASES)]
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "Nie\xa0było\xa0żółta"), (20_004, "ﬂat ☕️ 👩‍🏫 é Ω≠π"), (20_005, "lost � here")]
    rows += [(20_006, "only grÃ¼ne here"), (20_006, "only grÃ¼ne here")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as token", "'y' as original")
    subs = mojibake.substitutions(docs).cache()
    return {r.doc_id for r in mojibake.affected(docs, subs).collect()}, mojibake.restored(docs, subs).collect()


def test_finds_all_and_only_garbled(result):
    found, _ = result
    assert found == {10_000 + i for i in range(len(CASES))} | {20_005, 20_006}


@pytest.mark.parametrize("i", range(len(CASES)), ids=lambda i: ">".join(CASES[i][1:]))
def test_restores(result, i):
    text = {r.doc_id: r.text for r in result[1]}[10_000 + i]
    assert text == CLEAN[CASES[i][0]]


def test_lost_characters_and_copies(result):
    rows = {r.doc_id: r for r in result[1]}
    assert rows[20_005].text == "lost � here" and rows[20_005].n_lost == 1
    assert rows[20_006].text == "only grüne here" and sum(r.doc_id == 20_006 for r in result[1]) == 2


def test_many_copies_of_a_garbled_document(spark):
    polish, russian = CLEAN[2], CLEAN[3]
    clean = [(i, f"{t} {i}") for i, t in enumerate([polish, russian] * 3)]
    garbled = [(100 + i, garble(polish, "cp1250", "cp1252")) for i in range(20)] + [(200 + i, garble(russian, "cp1251", "latin-1")) for i in range(20)]
    docs = spark.createDataFrame(clean + garbled, DOCS)
    subs = mojibake.substitutions(docs).cache()
    assert {r.doc_id: r.text for r in mojibake.restored(docs, subs).collect()} == {i: polish if i < 200 else russian for i, _ in garbled}
    assert {r.doc_id for r in mojibake.affected(docs, subs).collect()} == {i for i, _ in garbled}


def test_a_word_of_one_text_and_a_long_one(spark):
    long = "ż" + "abcdefgh" * 10 + "ółta"
    docs = spark.createDataFrame([(1, f"{long} łódka"), (2, garble(f"{long} łódka", "cp1250", "cp1252"))], DOCS)
    assert [(r.doc_id, r.text) for r in mojibake.restored(docs, mojibake.substitutions(docs)).collect()] == [(2, f"{long} łódka")]


def test_looks():
    assert all(mojibake.looks(w) == 1 for t in CLEAN for w in re.findall(mojibake.TOKEN, t) if sum(map(str.isalpha, w)) > 2)
    assert not any(mojibake.looks(w) for w in ("M³ynarz", "Ïðîâåðüòå", "оПНБЕПЭРЕ", "seÒora", "абвabc")) and mojibake.looks("°C") == -1


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    subs = mojibake.substitutions(docs)
    assert subs.count() == 0 and mojibake.restored(docs, subs).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab;&é—⠁\xa0Z1 \n.я", "&eacute;", "words and more"]), max_size=25).map("".join))
def test_ascii_runs_hold_no_word(text):
    assert re.findall(mojibake.TOKEN, re.sub(mojibake.ASCII_RUN, " ", text)) == re.findall(mojibake.TOKEN, text)


def test_token_patterns_agree(spark):
    text = "donâ€™t ma&ccedil;ã ab⠝⠁cdé x1yé &amp; é" + "a" * 2000
    docs = spark.createDataFrame([(1, text)], DOCS)
    assert {r.token for r in mojibake.document_tokens(docs).collect()} == set(re.findall(mojibake.TOKEN, text))
