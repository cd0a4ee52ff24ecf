import numpy as np
import pytest
from pyspark.sql import functions as F

from dotframe.functions import encode, geom, text
from dotframe.operators import dataset, evalm, kernels, recover, translate
from dotframe.plans import catalog

CODES = {"111001": 0x2827, "111000": 0x2807, "110100": 0x280B, "111101": 0x282F, "000000": 0x2800, "100000": 0x2801, "000001": 0x2820, "111111": 0x283F}


@pytest.mark.parametrize("bits", CODES)
def test_code_points(spark, bits):
    df = spark.createDataFrame([(bits,)], "bits string")
    label, char, back, flip = df.select(
        encode.bits_to_label(F.col("bits")).alias("l"), encode.dot_char(F.col("bits")), encode.label_to_bits(F.lit(CODES[bits] - 0x2800)), encode.mirror_bits(F.col("bits"))
    ).first()
    assert (label, char, back, flip) == (CODES[bits] - 0x2800, chr(CODES[bits]), bits, bits[3:] + bits[:3])


def test_labels_out_of_range(spark):
    df = spark.createDataFrame([(64,), (-1,), (None,)], "l int")
    assert [r[0] for r in df.select(encode.label_to_bits(F.col("l"))).collect()] == [None] * 3


@pytest.mark.parametrize("w, h, tile, want", [(500, 400, 640, [(0, 0, 500, 400)]), (1500, 700, 640, None), (100, 3000, 100, None)])
def test_tiles(spark, w, h, tile, want):
    df = spark.createDataFrame([(w, h, tile)], "w int, h int, t long")
    got = [(b.x0, b.y0, b.x1, b.y1) for b in df.select(geom.tile_boxes(F.col("w"), F.col("h"), F.col("t")).alias("b")).first().b]
    assert want is None or got == want
    assert max(b[2] for b in got) == w and max(b[3] for b in got) == h and len(set(got)) == len(got)
    covered = np.zeros((h, w), bool)
    for x0, y0, x1, y1 in got:
        covered[y0:y1, x0:x1] = True
    assert covered.all() and got == sorted(got, key=lambda b: (b[1], b[0]))


def test_touching_boxes_do_not_overlap(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0)], "ax0 double, ay0 double, ax1 double, ay1 double, bx0 double, by0 double, bx1 double, by1 double")
    assert df.select(geom.iou("a", "b")).first()[0] == 0.0


@pytest.mark.parametrize("path, stem", [("a/b.c/d.labeled.jpg", "a_b.c_d.labeled"), ("x", "x"), ("a/.hidden", "a_.hidden"), ("a.b/c", "a.b_c")])
def test_stems(spark, path, stem):
    assert spark.createDataFrame([(path,)], "p string").select(text.flat_stem(F.col("p"))).first()[0] == stem


def test_orphans_and_alphabet(spark):
    df = spark.createDataFrame([("\\456/a\\6/ b\\x/",)], "t string")
    assert df.select(text.strip_orphans(F.col("t"))).first()[0] == "a b\\x/"
    a = translate.alphabet()
    assert len(a) == 27 and a["⠁"] == "a" and a["⠺"] == "w" and a["⠵"] == "z" and a["⠞"] == "t"


def test_corrections(spark):
    unknown = spark.createDataFrame([("lanterm",), ("xyzzyxx",), ("",)], "word string")
    dictionary = spark.createDataFrame([("lantern", 5), ("lantana", 50), ("lanterns", 9)], "word string, freq int")
    assert [(r.word, r.correction) for r in translate.corrections(unknown, dictionary).collect()] == [("lanterm", "lantern")]


def test_translator_errors_become_text(spark):
    def fails(_):
        raise RuntimeError("gone")

    got = translate.with_translator(spark.createDataFrame([("x",)], "text string"), fails).first()
    assert got.translated == "(error: gone)"


def test_one_bad_line_spoils_no_other(spark):
    def picky(lines):
        if any("⠿" in x for x in lines):
            raise RuntimeError("no such cell")
        return [x.upper() for x in lines]

    lines = spark.createDataFrame([("⠀a⠀b ",), ("⠿",), ("⠀⠀",), (None,), ("c",)], "text string").coalesce(1)
    assert [r.translated for r in translate.with_translator(lines, picky).collect()] == ["A B", "(error: no such cell)", "", "", "C"]


def test_command_as_translator(tmp_path):
    program = tmp_path / "louder"
    program.write_text('#!/bin/sh\nread x\n[ "$x" = bad ] && { echo cannot >&2; exit 1; }\n[ "$x" = slow ] && sleep 5\necho "$2:$x"\n')
    program.chmod(0o755)
    run = translate.command(str(program), "some.tbl", timeout=1)
    assert run(["x", "bad"]) == ["some.tbl:x", "(err: cannot)"]
    with pytest.raises(Exception, match="timed out"):
        run(["slow"])


def test_kernels(rng=np.random.default_rng(0)):
    image = rng.random((40, 30)) * 255
    for cx, cy, w, h in ((15, 20, 20, 30), (0, 0, 10, 10), (29, 39, 20, 30), (100, 100, 5, 5)):
        got = kernels.dot_strength(image, cx, cy, w, h)
        assert got.shape == (6,) and (got >= 0).all() and np.isfinite(got).all()
    assert not kernels.dot_strength(image, 500, 500, 10, 10).any()
    assert np.allclose(kernels.resize(image, 40, 30), image)
    assert kernels.resize(np.full((3, 5, 3), 7.0), 11, 2).shape == (11, 2, 3)
    crop = kernels.classifier_crop(np.zeros((10, 10, 3)), 10, 10, 4, 4)
    assert crop.size == 3 * 64 * 64 and np.isfinite(crop).all()
    every = [(15 + dx, 20 + dy, kernels.dot_strength(image, 15 + dx, 20 + dy, 20, 30)) for dy in (-4, -2, 0, 2, 4) for dx in (-4, -2, 0, 2, 4)]
    want = max(every, key=lambda e: e[2].sum())  # max takes the first of equals
    assert kernels.snap(image, 15, 20, 20, 30) == (*want[:2], want[2].sum(), want[2].max())
    x, y, total, peak = kernels.snap(image, 15, 20, 20, 30)
    assert abs(x - 15) <= 4 and abs(y - 20) <= 4 and total >= kernels.dot_strength(image, 15, 20, 20, 30).sum() - 1e-9 and peak <= total
    out = kernels.letterboxed(np.zeros((100, 300, 3)))
    assert out.shape[0] % 32 == 0 and out.shape[1] == 640
    assert kernels.planar(np.full((2, 2, 3), 255.0)).max() == 1 and kernels.contrast(np.full((2, 2, 3), 9.0), 3.0).max() == 9


def test_planar_query_has_every_pixel_and_channel(spark, tmp_path):
    vectors = [(i, i, [float(v) for v in np.linspace(-1, 1 - i / 4, 64)]) for i in range(3)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.queries()["chw_norm"](spark, str(tmp_path)).toPandas()
    assert len(got) == 3 * 3 * 32 * 32 and len(got.drop_duplicates(["vec_id", "channel", "y", "x"])) == len(got)
    for r in got[got.index % 97 == 0].itertuples():
        grey = np.floor((float(np.float32(vectors[r.vec_id][2][r.y // 4 * 8 + r.x // 4]) + np.float32(1))) * 127.5)
        assert abs(r.value - (grey / 255 - kernels.CHANNEL_MEAN[r.channel]) / kernels.CHANNEL_STD[r.channel]) < 1e-5


@pytest.mark.parametrize("times", [1, 60])
def test_spelling_takes_all_texts_at_any_size(spark, tmp_path, times):
    rows = [("the curly “margin” holds", "en"), ("margin of a naïvelywritten marginé", " EN "), ("margin with no language", None), ("margins ⠝⠁ here", "en-GB"), ("lumiere", "fr"), (None, "en")] * times
    rows += [("margin " * 500, "en")] * times + [("marginx quaffed", "en")] * (times // 60 or 1)
    spark.createDataFrame(rows, "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda q: {tuple(r) for r in catalog.queries()[q](spark, str(tmp_path)).collect()}
    words = dict(got("spell_candidates"))
    assert words == {"margin": 503 * times, "margins": times, "language": times, "marginx": 1, "quaffed": 1}
    # 'margin' makes up 99 % of the texts and more
    known = translate.dictionary(spark.createDataFrame(list(words.items()), "word string, freq long"), 0.99)
    assert {r.word for r in known.collect()} == {"margin", *translate.DOMAIN}


def test_every_unknown_word_is_corrected(spark, tmp_path):
    text = "language margin " * 30_000 + "languagx tactyle signal qwertyuiop"
    spark.createDataFrame([(text, "EN")], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda q: {tuple(r) for r in catalog.queries()[q](spark, str(tmp_path)).collect()}
    unknown = {"languagx", "tactyle", "qwertyuiop"}  # and words misspelt on purpose
    lost = {w[1:] + "x" for w in ("language", "margin", "languagx", "tactyle", "signal", "qwertyuiop")}
    assert {w for (w,) in got("word_lookup")} == unknown | lost
    fixed = dict(got("spell_correct"))
    assert fixed == {"languagx": "language", "tactyle": "tactile", "anguagex": "language", "arginx": "margin", "ignalx": "signal"}


def test_seeded_split_is_stable():
    names = [f"n{i:02d}" for i in range(20)]
    got = dataset.seeded_split(names)
    assert got == dataset.seeded_split(names[::-1])
    assert sorted(got.values()).count("val") == sorted(got.values()).count("test") == 3


def test_every_page_image_has_a_split(spark, tmp_path):
    rows = [(i, f"{s}/{i:03d}.png", s) for i, s in enumerate(["dsbi", "new_source"] * 20)]
    rows += [(100, "dsbi/000.png", " DSBI "), (101, "x.png", None), (102, None, "dsbi")]
    spark.createDataFrame(rows, "page_id long, path string, source string").write.parquet(f"{tmp_path}/page_images.parquet")
    got = catalog.queries()["image_splits"](spark, str(tmp_path)).collect()
    assert sorted(r.page_id for r in got) == [*range(40), 100, 101]
    for source in ("dsbi", "new_source"):
        want = dataset.seeded_split([p for _, p, s in rows[:40] if s == source])
        assert {r.path: r.split for r in got if r.source == source} == want and set(want.values()) == {"val", "test", "train"}


def test_scores_without_cells(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (2, 4, 1, 1)], "n_gt long, n_pred long, tp long, class_ok long")
    got = evalm.scores(df).orderBy("n_gt").collect()
    assert (got[0].prec, got[0].rec, got[0].f1, got[0].ca) == (0, 0, 0, 0)
    assert (got[1].prec, got[1].rec, got[1].ca) == (0.25, 0.5, 1.0)


def test_fallback_and_first_of_equals(spark):
    a = spark.createDataFrame([(1, "a")], "page_id long, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "page_id long, v string")
    assert sorted((r.page_id, r.v) for r in recover.or_else(a, b).collect()) == [(1, "a"), (2, "b")]
    rows = spark.createDataFrame([(1, 5, 2, "x"), (1, 5, 1, "y"), (1, 4, 0, "z")], "k int, n int, i int, v string")
    assert recover.best_of(rows, "k", "n", "i", "v").first().v == "y"


def match_by_loops(pred, truth):
    limit = 0.5 * sum(t[4] for t in truth) / len(truth) if truth else 0
    used, out = set(), []
    for p in sorted(pred, key=lambda r: r[1]):
        near = [(((t[2] - p[2]) ** 2 + (t[3] - p[3]) ** 2) ** 0.5, t[1]) for t in truth if t[1] not in used]
        if near and min(near)[0] < limit:
            used.add(min(near)[1])
            out.append((p[1], min(near)[1]))
    return set(out)


@pytest.mark.parametrize("seed", range(3))
def test_matching(spark, seed):
    rng = np.random.default_rng(seed)
    make = lambda n: [(1, i, float(x), float(y), 20.0) for i, (x, y) in enumerate(rng.integers(0, 100, (n, 2)))]
    pred, truth = make(30), make(25)
    s = "page_id long, det_id long, cx double, cy double, w double"
    got = evalm.match_cells(spark.createDataFrame(pred, s), spark.createDataFrame(truth, s)).collect()
    assert {(r.pred_id, r.gt_id) for r in got} == match_by_loops(pred, truth)
    assert evalm.match_cells(spark.createDataFrame(pred, s), spark.createDataFrame([], s)).count() == 0
