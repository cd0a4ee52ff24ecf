import pytest
from pyspark.sql import functions as F

from dotframe.llm import mixing, queries

MANIFEST = "crop_id long, page_id long, cell_idx int, source string, split string, path string, bits6 string, label_int int, n_bytes long"
TARGETS = "source string, target_pct int, max_repeats int"


@pytest.fixture(scope="module")
def crops(spark):
    rows = [(i, f"p{i}", 100 + i % 7, "big" if i % 10 else "small") for i in range(2000)]
    return spark.createDataFrame(rows, "crop_id long, path string, size long, source string")


def test_shares_caps_and_order(spark, crops):
    t = spark.createDataFrame([("big", 60, 1), ("small", 30, 2), ("none", 10, 3)], TARGETS)
    mixed = mixing.mix(crops, t).cache()
    rep = {r.source: r for r in mixing.shares(crops, t, mixing.placements(crops, t)).collect()}
    by_source = {r.source: r for r in mixed.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    assert all((r.mixed_bytes, r.mixed_rows) == (by_source[k].s, by_source[k].n) for k, r in rep.items() if k in by_source)
    assert all(r.mixed_bytes + r.withheld_bytes + r.unused_bytes == r.max_repeats * r.available for r in rep.values())
    assert not rep["big"].short and abs(rep["big"].reached_pct - 60) < 0.1
    assert rep["small"].short and rep["small"].mixed_bytes == 2 * rep["small"].available
    assert rep["none"].short and rep["none"].mixed_rows == 0
    assert mixed.groupBy("crop_id").count().agg(F.max("count")).first()[0] == 2
    got = [r.position for r in mixing.ordered(mixed).collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1
    half = mixed.where("position < 0.5").groupBy("source").agg(F.sum("size").alias("s")).collect()
    whole = {r.source: r.mixed_bytes for r in rep.values()}
    assert all(abs(r.s / whole[r.source] - 0.5) < 0.02 for r in half)  # level weights


def test_curriculum_moves_a_source(spark, crops):
    t = spark.createDataFrame([("big", 60, 1), ("small", 10, 1)], TARGETS)
    mixed = mixing.mix(crops, t, {"small": (0.0, 0.0, 4.0)})
    assert mixed.where("source = 'small'").agg(F.min("position")).first()[0] > 0.5


def test_registered_mix_follows_its_schedules(spark, tmp_path):
    manifest = [(i, i % 50, i, s, "train", f"p{i}", None, None, 100) for i, s in enumerate(["synth_render", "dsbi", "field_notes", "museum_labels"] * 500)]
    spark.createDataFrame(manifest, MANIFEST).write.parquet(f"{tmp_path}/manifest.parquet")
    spark.createDataFrame([(1, "dsbi")], "page_id long, source string").write.parquet(f"{tmp_path}/page_images.parquet")
    spark.createDataFrame([("synth_render", 20, 1), ("dsbi", 20, 1), ("field_notes", 40, 1)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    half = {r.source: r.n for r in queries.p4_mix(spark, str(tmp_path)).groupBy("source").agg(F.avg((F.col("position") < 0.5).cast("int")).alias("n")).collect()}
    for source, share in half.items():
        a, b, c = mixing.PRODUCTION_CURRICULUM[source]
        assert abs(share - (a + b) / (a + 2 * b + c)) < 0.01
    got = {r.source: r for r in queries.p4_shares(spark, str(tmp_path)).collect()}
    assert got["field_notes"].fell_short and not got["dsbi"].fell_short and got["synth_render"].first_half_bytes > 0.75 * got["synth_render"].mixed_bytes


def test_short_by_the_bytes_placed(spark):
    crops = spark.createDataFrame([(i, "same" if i < 90 else f"p{i}", 10, "a") for i in range(100)], "crop_id long, path string, size long, source string")
    t = spark.createDataFrame([("a", 90, 2)], TARGETS)
    got = mixing.shares(crops, t, mixing.placements(crops, t)).first()
    assert got.mixed_bytes <= 2 * 11 * 10 < got.wanted and got.fell_short and not got.short


@pytest.mark.parametrize("w", [(1.0, 1.0, 1.0), (0.0, 1.0, 0.0), (2.0, 1.0, 0.0), (0.0, 0.0, 3.0), (3.0, 0.5, 1.5)])
def test_inverse_of_the_integral(spark, w):
    df = spark.range(0, 101).select((F.col("id") / 100).alias("u"))
    rows = df.select("u", mixing.invert_demand(F.col("u"), *map(F.lit, w)).alias("t")).collect()

    def area(t):
        a, b, m = (w[0], w[1], t) if t <= 0.5 else (w[1], w[2], t - 0.5)
        return (0 if t <= 0.5 else (w[0] + w[1]) / 4) + a * m + (b - a) * m * m

    total = area(1.0)
    assert all(abs(area(r.t) / total - r.u) < 1e-6 for r in rows)


def test_paths_share_their_cap(spark):
    rows = [(i, "same", 10, "a") for i in range(5)] + [(9, None, 10, "a"), (10, None, 10, "a")]
    crops = spark.createDataFrame(rows, "crop_id long, path string, size long, source string")
    t = spark.createDataFrame([("a", 100, 3)], TARGETS)
    got = mixing.mix(crops, t)
    assert got.where("path = 'same'").count() <= 3


def test_a_hot_path_and_crops_without_an_id(spark):
    rows = [(None if i % 2 else i, "hot", 10, "a") for i in range(300)] + [(1000 + i, f"p{i}", 10, "a") for i in range(5)]
    crops = spark.createDataFrame(rows, "crop_id long, path string, size long, source string")
    for most in (7, 650):
        t = spark.createDataFrame([("a", 100, most)], TARGETS)
        caps = [r.cap for r in mixing.placements(crops, t).where("path = 'hot'").collect()]
        assert len(caps) == 300 and sum(caps) == most and max(caps) - min(caps) <= 1


def test_sources_sizes_and_repeats(spark):
    rows = [
        (1, 1, 0, " DSBI ", "train", "p1", None, None, 5), (1, 1, 0, " DSBI ", "train", "p1", None, None, 5), (2, 1, 1, None, "train", "p2", None, None, None),
        (3, 2, 2, "  ", "val", "p3", None, None, 7), (4, 99, 3, None, "val", "p4", None, None, 9),
    ]
    pages = spark.createDataFrame([(1, "dsbi"), (2, "Angelina"), (2, "Angelina")], "page_id long, source string")
    got = sorted((r.crop_id, r.source, r["size"]) for r in mixing.sized_crops(spark.createDataFrame(rows, MANIFEST), pages).collect())
    assert got == [(1, "dsbi", 5), (2, "dsbi", 0), (3, "angelina", 7), (4, None, 9)]


def test_empty(spark):
    crops = spark.createDataFrame([], "crop_id long, path string, size long, source string")
    t = spark.createDataFrame([("a", 100, 1), (None, 5, 1)], TARGETS)
    assert mixing.mix(crops, t).count() == 0
    assert [(r.source, r.short, r.reached_pct) for r in mixing.shares(crops, t, mixing.placements(crops, t)).collect()] == [("a", False, 0.0)]
