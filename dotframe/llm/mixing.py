"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the
source's cumulative demand; inverting that at a record's cumulative size gives
the record's training position, and the mix is the records range-sorted by
position. A source too small for its demand repeats, each record at most a
capped number of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.llm.sample import distinct_crops
from dotframe.session import staged

HASH_BUCKETS = 8192
#: Parts in which the crops of one path are numbered.
PATH_PARTS = 64

#: Relative weight at times 0, 1/2 and 1 by source; others are level.
DEFAULT_CURRICULUM: dict[str, tuple[float, float, float]] = {}

#: The schedules of the registered mix: rendered and even pages first, then
#: the large photographed sets, the rough ones last.
PRODUCTION_CURRICULUM: dict[str, tuple[float, float, float]] = {
    "synth_render": (3.0, 1.0, 0.0), "school_sheets": (2.0, 1.0, 0.5), "dsbi": (1.5, 1.0, 0.5), "angelina": (0.5, 1.0, 1.5),
    "press_archive": (0.5, 1.5, 1.0), "braille_natural": (0.0, 1.0, 2.0), "field_notes": (0.0, 1.0, 3.0), "museum_labels": (0.0, 0.5, 2.0),
}


def norm_source(c: str | Column) -> Column:
    """Compared without case and surrounding blanks; empty counts as missing."""
    s = F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    return F.when(s != "", s)


def sized_crops(manifest: DataFrame, page_images: DataFrame, *extra: str) -> DataFrame:
    """One row per crop: crop_id, path, size, ``extra``, rid (a number of its
    own) and source, a missing source
    taken from the page's image. Null sizes count 0. Crops whose source stays
    unknown keep a null source: they count in the total, not in a source. The
    crops are written once; of them only those without a source of their own
    look for their page."""
    size = F.greatest(F.coalesce("n_bytes", F.lit(0)), F.lit(0)).cast("long").alias("size")
    crops = distinct_crops(manifest, "page_id", "path", "n_bytes", "source", *extra)
    crops = staged(crops.select("crop_id", "path", size, *extra, norm_source("source").alias("source"), "page_id", F.monotonically_increasing_id().alias("rid")), "crops")
    pages = page_images.groupBy(F.col("page_id").alias("_page")).agg(F.min(norm_source("source")).alias("_source"))
    found = crops.where("source is null").join(pages, F.col("page_id") == F.col("_page"), "left").select("crop_id", "path", "size", *extra, F.col("_source").alias("source"), "rid")
    return crops.where("source is not null").drop("page_id").unionByName(found)


def demand(crops: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets`` (source, target_pct, max_repeats): bytes there
    are, bytes wanted (target_pct of all bytes), bytes to be supplied (wanted,
    but at most max_repeats times what there is) and whether that falls short.
    Sources not in targets supply nothing; repeated rows of one source add up.
    """
    have = crops.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("n_crops"), F.max("size").alias("largest"))
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    want = (
        targets.groupBy(norm_source("source").alias("source"))
        .agg(F.sum(F.coalesce("target_pct", F.lit(0))).cast("long").alias("target_pct"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats"))
        .where("source is not null")
    )
    return (
        want.join(have, "source", "left").fillna(0, ["available", "n_crops", "largest"])
        .withColumn("total", total.scalar())
        .withColumn("wanted", F.expr("target_pct * total / 100.0e0"))
        .withColumn("short", F.expr("target_pct * total > 100 * max_repeats * available"))
        .withColumn("supplied", F.when(F.col("short"), (F.col("max_repeats") * F.col("available")).cast("double")).otherwise(F.col("wanted")))
    )


def _schedule(curriculum: dict[str, tuple[float, float, float]], at: int) -> Column:
    out = F.lit(1.0)
    for source, weights in sorted(curriculum.items()):
        out = F.when(F.col("source") == source, float(weights[at])).otherwise(out)
    return out


def invert_demand(share: Column, w0: Column, w1: Column, w2: Column) -> Column:
    """Time at which the integral of the piecewise linear weight through
    (0, w0), (1/2, w1), (1, w2) reaches ``share`` of its whole."""
    first, second = (w0 + w1) / 4, (w1 + w2) / 4
    goal = share * (first + second)

    def within(area: Column, a: Column, b: Column) -> Column:
        # a*t + (b-a)*t^2 = area for t in 0..1/2, in the form that is stable for a = b
        root = F.sqrt(F.greatest(a * a + (b - a) * 4 * area, F.lit(0.0)))
        return F.when(area <= 0, 0.0).otherwise(F.least(2 * area / F.greatest(a + root, F.lit(1e-12)), F.lit(0.5)))

    return F.when(goal <= first, within(goal, w0, w1)).otherwise(F.lit(0.5) + within(goal - first, w1, w2))


def _path_caps(crops: DataFrame, plan: DataFrame) -> DataFrame:
    """(rid, cap) of the crops whose path other crops have too: the max_repeats
    uses of the path, dealt out among its crops. They are numbered within parts
    of a path, so that none is one task's work."""
    h = F.xxhash64("path")
    shared = crops.where("path is not null").groupBy(h.alias("_ph")).agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_ph")
    some = crops.where("path is not null").join(shared, h == F.col("_ph"), "left_semi").join(plan, "source")
    some = staged(some.select("rid", "path", "crop_id", "source", "max_repeats", F.pmod(F.xxhash64("crop_id", "source"), F.lit(PATH_PARTS)).alias("part")), "shared-paths")
    upto = W.partitionBy("path").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = (
        some.groupBy("path", "part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("_k", F.sum("_n").over(W.partitionBy("path")))
    )  # at most PATH_PARTS rows a path
    within = F.row_number().over(W.partitionBy("path", "part").orderBy("crop_id", "source", "rid")) - 1
    return (
        some.withColumn("_r", within).join(parts, ["path", "part"]).withColumn("_r", F.col("_r") + F.col("_before"))
        .select("rid", F.expr("cast(max_repeats div _k + if(_r < max_repeats % _k, 1, 0) as long)").alias("_cap"))
    )


def numbered(crops: DataFrame) -> DataFrame:
    """The crops with ``rid``, a number of each row's own, written once."""
    return crops if "rid" in crops.columns else staged(crops.withColumn("rid", F.monotonically_increasing_id()), "crops")


def placements(crops: DataFrame, targets: DataFrame, curriculum: dict | None = None, seed: int = 0) -> DataFrame:
    """One row per record of a source that supplies something: crop_id, path,
    source, size, max_repeats, cap (its share of the max_repeats of its path),
    passes (copies that are placed) and positions (of each copy, 0..1, in
    training time).

    In each pass a source's records come in the order of a hash; the last pass
    ends with the last record that fits. Cumulative sizes come from sums of
    hash buckets, so no task holds a whole source. Crops that share a path
    share the cap of max_repeats: a path is used in at most that many rows.
    """
    curriculum = DEFAULT_CURRICULUM if curriculum is None else curriculum
    crops = numbered(crops)
    plan = demand(crops, targets).select("source", "available", "supplied", "max_repeats").where("supplied > 0")
    hashed = (
        crops.withColumn("_h", F.xxhash64(F.lit(seed), "crop_id", "path"))
        .withColumn("_bucket", F.pmod("_h", F.lit(HASH_BUCKETS)))
    )
    sums = hashed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum").join(plan, "source")
    within = W.partitionBy("source", "_bucket").orderBy("_h", "rid").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        hashed.withColumn("_in", F.sum("size").over(within))
        .join(bases, ["source", "_bucket"])
        .withColumn("_end", F.col("_base") + F.col("_in"))
    )
    placed = placed.join(_path_caps(crops, plan), "rid", "left").withColumn("cap", F.coalesce("_cap", "max_repeats"))
    # Passes in which the record fits: (pass * available + _end) <= supplied.
    fit = F.when(F.col("available") > 0, F.floor((F.col("supplied") - F.col("_end")) / F.col("available")) + 1).otherwise(0)
    passes = F.least(F.greatest(fit, F.lit(0)), F.col("cap")).cast("int")
    w = [_schedule(curriculum, i) for i in range(3)]
    share = lambda copy: (copy * F.col("available") + F.col("_end") - F.col("size") / 2) / F.col("supplied")
    copies = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))
    return placed.withColumn("passes", passes).select(
        "crop_id", "path", "source", "size", "max_repeats", "cap", "passes",
        F.transform(copies, lambda k: F.round(invert_demand(share(k), *w), 12)).alias("positions"),
    )


def mix(crops: DataFrame, targets: DataFrame, curriculum: dict | None = None, seed: int = 0) -> DataFrame:
    """The mixed records: crop_id, path, source, size, copy (0 for the first
    pass over a source), position (0..1, in training time); see placements."""
    placed = placements(crops, targets, curriculum, seed)
    return placed.select("crop_id", "path", "source", "size", F.posexplode("positions").alias("copy", "position"))


def ordered(mixed: DataFrame) -> DataFrame:
    """The mix in training order: a range-partitioned sort by position."""
    return mixed.orderBy("position", "source", "crop_id", "copy")


def shares(crops: DataFrame, targets: DataFrame, placed: DataFrame) -> DataFrame:
    """Per source of ``targets``, by its placements: its target, bytes there
    are, wanted and mixed, the share of the total it was to supply that was
    reached, the bytes placed in the first half of the training time, the bytes
    of repeats that caps of paths withhold and of those left unused.

    ``fell_short``: the bytes placed are fewer than wanted, and either every
    record has all its repeats or more is missing than the largest record.
    ``short``: not even with all withheld and unused repeats is what is wanted
    reached, so that it's the source that is too small and not a path's cap.
    """
    early = F.size(F.filter("positions", lambda x: x < 0.5))
    total = lambda x: F.sum(F.col("size") * x)
    got = placed.groupBy("source").agg(
        total(F.col("passes")).alias("mixed_bytes"), F.sum("passes").alias("mixed_rows"), F.max("passes").cast("long").alias("passes"), total(early).alias("first_half_bytes"),
        total(F.col("max_repeats") - F.col("cap")).alias("withheld_bytes"), total(F.col("cap") - F.col("passes")).alias("unused_bytes"),
    )
    missing = F.col("target_pct") * F.col("total") - 100 * F.col("mixed_bytes")
    sums = ["mixed_bytes", "mixed_rows", "passes", "first_half_bytes", "withheld_bytes", "unused_bytes"]
    return (
        demand(crops, targets).drop("short").join(got, "source", "left").fillna(0, sums)
        .withColumn("fell_short", (missing > 0) & ((F.col("unused_bytes") + F.col("withheld_bytes") <= 0) | (missing > 100 * F.col("largest"))))
        .withColumn("short", missing > 100 * (F.col("withheld_bytes") + F.col("unused_bytes")))
        .withColumn("reached_pct", F.when(F.col("total") > 0, F.round(F.expr("100 * mixed_bytes / total"), 6)).otherwise(0.0))
        .select("source", "target_pct", "max_repeats", "available", "wanted", *sums, "reached_pct", "short", "fell_short")
    )
