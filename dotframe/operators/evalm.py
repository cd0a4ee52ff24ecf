"""Matching detections to ground truth, and quality measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.functions.geom import distance_l2
from dotframe.operators.near import meet
from dotframe.params import PARAMS
from dotframe.session import spread


def match_cells(pred: DataFrame, truth: DataFrame, frac: float = PARAMS.match_frac) -> DataFrame:
    """(page_id, pred_id, gt_id): each prediction, in the order of det_id,
    takes the nearest free ground-truth cell closer than frac mean widths
    (ties: the smaller det_id). The order makes it sequential within a page;
    pages are independent."""

    def page(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(g):
            p, g = p.sort_values("det_id"), g.sort_values("det_id")
            limit = g["w"].mean() * frac
            gx, gy, gid = g["cx"].to_numpy(float), g["cy"].to_numpy(float), g["det_id"].to_numpy()
            order = np.argsort(gx, kind="stable")
            sx = gx[order]
            used = np.zeros(len(g), dtype=bool)
            lo, hi = np.searchsorted(sx, p["cx"] - limit), np.searchsorted(sx, p["cx"] + limit, side="right")
            for pid, x, y, a, b in zip(p["det_id"], p["cx"], p["cy"], lo, hi):
                near = np.sort(order[a:b])
                near = near[~used[near]]
                if len(near):
                    d = np.hypot(gx[near] - x, gy[near] - y)
                    k = int(d.argmin())
                    if d[k] < limit:
                        used[near[k]] = True
                        out.append((key[0], pid, gid[near[k]]))
        return pd.DataFrame(out, columns=["page_id", "pred_id", "gt_id"])

    cols = [F.col(k).alias(k) for k in ("page_id", "det_id", "cx", "cy", "w")]
    return (
        spread(pred.select(*cols), "page_id").groupBy("page_id").cogroup(spread(truth.select(*cols), "page_id").groupBy("page_id"))
        .applyInPandas(page, "page_id long, pred_id long, gt_id long")
    )


def nearest_truth(pred: DataFrame, truth: DataFrame, frac: float = PARAMS.match_frac) -> DataFrame:
    """(page_id, det_id, nearest): the det_id of the nearest ground-truth cell
    closer than frac mean widths of the page (ties: the smaller); predictions
    without one are left out."""
    limit = truth.groupBy("page_id").agg((F.avg("w") * frac).alias("_lim"))
    t = truth.select(F.col("page_id").alias("_k"), F.col("det_id").alias("_id"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    dist = distance_l2(F.col("_x") - F.col("cx"), F.col("_y") - F.col("cy"))
    lim = F.col("_lim")
    met = meet(pred.join(limit, "page_id"), t, dist < lim, (F.col("cx"), F.col("cy")), (lim, lim), ("_x", "_y"))
    return met.groupBy("page_id", "det_id").agg(F.min_by("_id", F.struct(dist.alias("d"), "_id")).alias("nearest"))


def report_line(scored: DataFrame, name: Column) -> Column:
    """One page's line of the quality report; shares are cut to two digits."""
    two = lambda k: F.floor(F.col(k) * 100) / 100
    counts = F.format_string("%s gt=%d pred=%d tp=%d ", name, "n_gt", "n_pred", "tp")
    return F.concat(counts, F.format_string("prec=%.2f rec=%.2f f1=%.2f cls=%.2f", two("prec"), two("rec"), two("f1"), two("ca")))


def aggregate_lines(counts: DataFrame) -> DataFrame:
    """(line_no, line): the block over all pages that ends the report."""
    three = lambda label, k: F.concat(F.lit(label), F.format_string("%.3f", F.floor(F.col(k) * 1000) / 1000))
    lines = [
        F.format_string("AGGREGATE gt=%d pred=%d tp=%d", "n_gt", "n_pred", "tp"),
        three("Precision : ", "prec"), three("Recall    : ", "rec"), three("F1        : ", "f1"), three("Class acc : ", "ca"),
    ]
    return micro_metrics(counts).select(F.posexplode(F.array(*lines)).alias("line_no", "line"))


def dot_hits(rows: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Adds a row a dot: dot 1..6, x (its logit), y (whether it is raised in
    ``label``) and hit (1 where the sign of x says so)."""
    one = rows.select("*", F.posexplode(logits).alias("_at", "x")).withColumn("x", F.col("x").cast("double"))
    one = one.withColumn("dot", F.col("_at") + 1).withColumn("y", F.expr(f"shiftright({label}, _at) & 1")).drop("_at")
    return one.withColumn("hit", ((F.col("x") > 0) == (F.col("y") == 1)).cast("int"))


def dot_accuracy(hits: DataFrame, *by: str) -> DataFrame:
    return hits.groupBy(*by).agg(F.count(F.lit(1)).alias("n_dots"), F.avg("hit").alias("dot_acc"))


def cell_accuracy(hits: DataFrame, key: str, *by: str) -> DataFrame:
    """A cell counts if all of its dots do."""
    return hits.groupBy(*by, key).agg(F.min("hit").alias("ok")).groupBy(*by).agg(F.avg("ok").alias("cell_acc"))


def image_range(images: DataFrame, start: int = 0, end: int | None = None, order: tuple[str, ...] = ("path",)) -> DataFrame:
    """The images from place ``start`` (from 0) up to ``end`` of the sorted
    list, as sliced on the command line, with their place ``n``. A bounded
    slice takes the first ``end`` images and sorts no more; without an end all
    are placed by sorted partitions' sizes."""
    if end is not None:
        first = images.orderBy(*order).limit(max(0, end))
        placed = first.withColumn("n", F.row_number().over(W.orderBy(*order)) - 1)  # at most ``end`` rows
    else:
        part = images.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
        part = part.withColumn("_p", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        base = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
        placed = part.join(base.drop("_c"), "_p").withColumn("n", F.col("_base") + F.col("_in")).drop("_p", "_in", "_id", "_base")
    return placed.where(F.col("n") >= start).withColumn("n", F.col("n").cast("long"))


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and class accuracy to n_gt, n_pred, tp, class_ok."""
    c = F.col
    d = counts.withColumn("prec", ratio(c("tp"), c("n_pred"))).withColumn("rec", ratio(c("tp"), c("n_gt")))
    return (
        d.withColumn("f1", ratio(2 * c("prec") * c("rec"), c("prec") + c("rec")))
        .withColumn("ca", ratio(c("class_ok"), c("tp")))
        .withColumns({k: F.round(k, 6) for k in ("prec", "rec", "f1", "ca")})
    )


def page_counts(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Per page: n_gt, n_pred, tp and matches of equal pattern; pages without
    any cell on one side too."""
    n_gt = truth.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_gt"))
    n_pred = pred.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_pred"))
    p = pred.select("page_id", F.col("det_id").alias("pred_id"), F.col("bits").alias("_p"))
    g = truth.select("page_id", F.col("det_id").alias("gt_id"), F.col("bits").alias("_g"))
    hit = (
        matches.join(p, ["page_id", "pred_id"]).join(g, ["page_id", "gt_id"]).groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("tp"), F.count_if(F.col("_p") == F.col("_g")).alias("class_ok"))
    )
    return n_gt.join(n_pred, "page_id", "full").join(hit, "page_id", "left").fillna(0, ["n_gt", "n_pred", "tp", "class_ok"])


def page_metrics(counts: DataFrame) -> DataFrame:
    return scores(counts)


def micro_metrics(counts: DataFrame) -> DataFrame:
    return scores(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_gt", "n_pred", "tp", "class_ok")]))


def bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def margin_filter(cells: DataFrame, least: int = 20) -> DataFrame:
    """Drops cells outside the block of high-confidence cells, three median
    widths and two median heights around it; pages with fewer than ``least``
    such cells stay whole."""
    hi = cells.where(F.col("conf") >= PARAMS.high_conf)
    box = (
        hi.groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.median("w").alias("_w"), F.median("h").alias("_h"),
             F.min("cx").alias("_x0"), F.max("cx").alias("_x1"), F.min("cy").alias("_y0"), F.max("cy").alias("_y1"))
        .where(F.col("_n") >= least)
    )
    inside = F.col("cx").between(F.col("_x0") - 3 * F.col("_w"), F.col("_x1") + 3 * F.col("_w")) & F.col("cy").between(
        F.col("_y0") - 2 * F.col("_h"), F.col("_y1") + 2 * F.col("_h")
    )
    return cells.join(box, "page_id", "left").where(F.col("_n").isNull() | inside).select(*cells.columns)


def margin_filter_strict(cells: DataFrame) -> DataFrame:
    """The evaluation's variant: 5th and 95th percentiles and mean sizes of
    high-confidence cells, strict."""
    hi = cells.where(F.col("conf") >= PARAMS.high_conf)
    q = lambda c, p: F.percentile(c, F.lit(p))
    box = hi.groupBy("page_id").agg(
        q("cx", 0.05).alias("_x0"), q("cx", 0.95).alias("_x1"), q("cy", 0.05).alias("_y0"), q("cy", 0.95).alias("_y1"),
        F.avg("w").alias("_w"), F.avg("h").alias("_h"),
    )
    c = F.col
    inside = (
        (c("cx") > c("_x0") - c("_w")) & (c("cx") < c("_x1") + c("_w")) & (c("cy") > c("_y0") - c("_h")) & (c("cy") < c("_y1") + c("_h"))
    )
    return cells.join(box, "page_id", "left").where(c("_w").isNull() | inside).select(*cells.columns)
