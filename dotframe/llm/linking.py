"""Cells of a shot too large for one task, linked by joins alone.

Sized records of one grid cell no wider than half their own size link without
a look at each other: such a bucket is a node, its records are aggregated
before anything is shuffled twice. A record is then compared with the buckets
in reach, of which there are as many as the shot's area holds, not with their
records: a bucket's bounds rule a link out, a few of its records prove one,
and only what neither settles, between components still apart, is compared
record by record. Components come from rounds of smallest labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotframe.session import staged

BUCKET = ["shot_id", "k", "m", "gx", "gy"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each component of edges (u, v); nodes
    without an edge don't occur. Each round takes the smallest label around a
    node and then that label's own label, until nothing changes."""
    both = staged(edges.where("u <> v").select("u", "v").union(edges.where("u <> v").select("v", "u")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).withColumn("label", F.least("node", "label"))
    labels = staged(labels, "labels")
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("least"))
        near = labels.join(around, labels["node"] == around["u"]).select("node", "label", F.least("label", "least").alias("new"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        moved = staged(near.join(up, F.col("new") == F.col("at"), "left").select("node", F.least("new", F.coalesce("up", "new")).alias("label"), F.col("label").alias("was")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def _near(a: str, b: str) -> Column:
    c = lambda p, k: F.col(f"{p}.{k}")
    return (F.abs(c(a, "cx") - c(b, "cx")) < F.greatest(c(a, "hw"), c(b, "hw"))) & (F.abs(c(a, "cy") - c(b, "cy")) < F.greatest(c(a, "hh"), c(b, "hh")))


def link_large(records: DataFrame) -> DataFrame:
    """(pred_id, cell) of records with pred_id, shot_id, det_id, cx, cy, w, h."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    half = lambda c: F.greatest(F.coalesce(known(c), F.lit(0.0)), F.lit(0.0)) / 2
    level = lambda c: F.floor(F.log2(c))
    base = records.select("pred_id", "shot_id", "det_id", known("cx").alias("cx"), known("cy").alias("cy"), half("w").alias("hw"), half("h").alias("hh"))
    located = F.col("cx").isNotNull() & F.col("cy").isNotNull()
    base = base.withColumn("located", located).withColumn("sized", located & (F.col("hw") > 0) & (F.col("hh") > 0))
    side = lambda x, k: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col(k)))
    keyed = (
        base.withColumn("k", F.when(F.col("sized"), level("hw"))).withColumn("m", F.when(F.col("sized"), level("hh")))
        .withColumn("gx", side("cx", "k")).withColumn("gy", side("cy", "m"))
    )
    at = F.struct("cx", "cy", "hw", "hh")
    ends = [F.min_by(at, "cx"), F.max_by(at, "cx"), F.min_by(at, "cy"), F.max_by(at, "cy"), F.max_by(at, "hw"), F.max_by(at, "hh"), F.min_by(at, "pred_id")]
    buckets = staged(
        keyed.where("sized").groupBy(*BUCKET).agg(
            F.min("pred_id").alias("node"), F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"),
            F.max("hw").alias("max_hw"), F.max("hh").alias("max_hh"), F.array(*ends).alias("some"),
        ), "buckets",
    )
    of_bucket = buckets.select(*BUCKET, F.col("node").alias("bucket_node"))
    nodes = staged(
        keyed.join(of_bucket, BUCKET, "left").withColumn("node", F.coalesce("bucket_node", "pred_id")).drop("bucket_node", *BUCKET[1:]), "nodes"
    )
    # One node a det_id: the smallest of those that carry it.
    by_det = nodes.select("shot_id", "det_id", "node").distinct()
    first = by_det.groupBy("shot_id", "det_id").agg(F.min("node").alias("u"))
    edges = by_det.join(first, ["shot_id", "det_id"]).select("u", F.col("node").alias("v"))
    # Records and buckets meet in coarse cells as wide as the shot's reach.
    reach = nodes.groupBy("shot_id").agg(F.greatest(F.max("hw"), F.lit(1e-6)).alias("rw"), F.greatest(F.max("hh"), F.lit(1e-6)).alias("rh"))
    cell = lambda x, r: F.floor(F.col(x) / F.col(r))
    place = nodes.where("located").join(reach, "shot_id").withColumn("X", cell("cx", "rw")).withColumn("Y", cell("cy", "rh"))
    span = lambda lo, hi, r: F.explode(F.sequence(cell(lo, r) - 1, cell(hi, r) + 1))
    wide = buckets.join(reach, "shot_id").withColumn("X", span("x0", "x1", "rw")).withColumn("Y", span("y0", "y1", "rh"))
    gap = lambda x, lo, hi: F.greatest(F.col(lo) - F.col(x), F.col(x) - F.col(hi), F.lit(0.0))
    fits = (gap("a.cx", "q.x0", "q.x1") < F.greatest("a.hw", "q.max_hw")) & (gap("a.cy", "q.y0", "q.y1") < F.greatest("a.hh", "q.max_hh"))
    proven = F.exists(
        "q.some",
        lambda s: (F.abs(F.col("a.cx") - s["cx"]) < F.greatest(F.col("a.hw"), s["hw"])) & (F.abs(F.col("a.cy") - s["cy"]) < F.greatest(F.col("a.hh"), s["hh"])),
    )
    same = [F.col(f"a.{c}") == F.col(f"q.{c}") for c in ("shot_id", "X", "Y")]
    met = place.alias("a").join(wide.alias("q"), same[0] & same[1] & same[2] & (F.col("a.node") != F.col("q.node")) & fits)
    met = staged(met.select(F.col("a.pred_id").alias("rid"), F.col("a.node").alias("u"), F.col("q.node").alias("v"), proven.alias("proven")), "met")
    edges = edges.union(met.where("proven").select("u", "v").distinct())
    # Two records of which one lacks its width and the other its height.
    odd = place.where("not sized and (hw > 0 or hh > 0)")
    edges = edges.union(
        odd.where("hw > 0").alias("a")
        .join(odd.where("hh > 0").withColumn("X", F.explode(F.sequence(F.col("X") - 1, F.col("X") + 1))).withColumn("Y", F.explode(F.sequence(F.col("Y") - 1, F.col("Y") + 1))).alias("b"), ["shot_id", "X", "Y"])
        .where(_near("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    )
    edges = staged(edges, "links")
    label = components(edges)
    mark = lambda df, n: df.join(label.select(F.col("node").alias(n), F.col("label").alias(f"{n}_l")), n, "left").withColumn(f"{n}_l", F.coalesce(f"{n}_l", n))
    apart = mark(mark(met.where("not proven"), "u"), "v").where("u_l <> v_l").select("rid", "u", "v")
    one = nodes.select(F.col("pred_id").alias("rid"), "cx", "cy", "hw", "hh")
    members = nodes.where("sized").select(F.col("node").alias("v"), "cx", "cy", "hw", "hh")
    late = apart.join(one, "rid").alias("a").join(members.alias("b"), F.col("a.v") == F.col("b.v")).where(_near("a", "b"))
    late = staged(late.select(F.col("a.u").alias("u"), F.col("a.v").alias("v")).distinct(), "late")
    if not late.isEmpty():
        label = components(edges.union(late))
    # A component is named by its smallest record, as its nodes are.
    return mark(nodes.select("pred_id", "node"), "node").select("pred_id", F.col("node_l").alias("cell"))
