"""Relations that many queries start from, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.functions import geom
from dotframe.functions.encode import bits_to_label
from dotframe.operators.gridfill import reliable
from dotframe.operators.layout import line_groups
from dotframe.params import PARAMS
from dotframe.sources.tables import table


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """All complete detections; a photograph is a page, pred_id breaks ties."""
    whole = " and ".join(f"{c} is not null" for c in ("shot_id", "pred_id", "cx", "cy", "w", "h", "conf"))
    return (
        table(spark, sf, "predicted_cells").where(f"{whole} and not coalesce(is_space, false)")
        .select(
            F.col("shot_id").alias("page_id"), F.col("pred_id").alias("det_id"), "cx", "cy", "w", "h", "conf",
            F.coalesce("bits", F.lit("000000")).alias("bits"), F.coalesce("rescued", F.lit(False)).alias("rescued"),
        )
    )


def rel(spark: SparkSession, sf: str) -> DataFrame:
    return reliable(cells(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_groups(rel(spark, sf))


def shots(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "predicted_cells").where("shot_id is not null and page_id is not null").select("shot_id", "page_id").distinct()


def numbered(boxes: DataFrame) -> DataFrame:
    """Adds n, from 1: the order of a page's annotated cells."""
    b = F.col("frac_bbox")
    order = W.partitionBy("page_id").orderBy("cell_idx", b["l"], b["t"], b["r"], b["b"], F.coalesce("bits6", F.lit("")), F.coalesce("label", F.lit(-1)))
    return boxes.withColumn("n", F.row_number().over(order).cast("long"))


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Ground truth of each photograph: the annotated cells of its page."""
    cells = numbered(boxes(spark, sf)).select("page_id", F.col("n").alias("det_id"), *geom.frac_to_centre("frac_bbox", F.col("img_w"), F.col("img_h")), F.col("bits6").alias("bits"))
    return shots(spark, sf).join(cells, "page_id").drop("page_id").withColumnRenamed("shot_id", "page_id")


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated cells with a sound box and their page's size, each once."""
    b = F.col("frac_bbox")
    sound = (b["l"] >= 0) & (b["l"] < b["r"]) & (b["r"] <= 1) & (b["t"] >= 0) & (b["t"] < b["b"]) & (b["b"] <= 1)
    pages = table(spark, sf, "page_images").select("page_id", "img_w", "img_h")
    return (
        table(spark, sf, "gt_cells").where(sound).select("page_id", "cell_idx", "frac_bbox", "bits6", "label").distinct().join(pages, "page_id")
    )


def crops(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows of agreeing pattern and label, each once."""
    good = F.col("bits6").rlike(r"\A[01]{6}\z") & F.col("label_int").between(1, 63)
    return (
        table(spark, sf, "manifest").where(good).where(bits_to_label(F.col("bits6")) == F.col("label_int"))
        .select("crop_id", "page_id", "cell_idx", "split", "path", "bits6", "label_int").distinct()
    )


def all_crops(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows, each once."""
    return table(spark, sf, "manifest").select("crop_id", "page_id", "cell_idx", "split", "path", "bits6", "label_int").distinct()


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """Grey patches of 32 by 32, each 4 by 4 block a component of a vector,
    with one cell that fills the patch and its dots by the first components."""
    value = lambda i: F.floor((F.element_at("embedding", i + 1) + 1).cast("double") * 127.5)
    row = lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: value((F.floor(y / 4) * 8 + F.floor(x / 4)).cast("int")))
    size = [F.lit(v).alias(k) for k, v in (("cx", 16.0), ("cy", 16.0), ("w", 32.0), ("h", 32.0))]
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", "embedding", F.transform(F.sequence(F.lit(0), F.lit(31)), row).alias("image"), *size
    )


_BAND, _HIGH = PARAMS.line_band, PARAMS.high_conf


def label_sql(bits: str) -> str:
    return "(" + " + ".join(f"{1 << i}*CAST(substr({bits}, {i + 1}, 1) AS INT)" for i in range(6)) + ")"


#: Common table expressions of the oracles; unused ones cost nothing.
PRE = f"""
WITH cells AS (
  SELECT shot_id AS page_id, pred_id AS det_id, cx, cy, w, h, conf, coalesce(bits, '000000') AS bits, coalesce(rescued, false) AS rescued
  FROM predicted_cells
  WHERE shot_id IS NOT NULL AND pred_id IS NOT NULL AND cx IS NOT NULL AND cy IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL
    AND conf IS NOT NULL AND NOT coalesce(is_space, false)),
box AS (SELECT *, cx - w/2 AS x0, cy - h/2 AS y0, cx + w/2 AS x1, cy + h/2 AS y1 FROM cells),
rel AS (SELECT * FROM cells WHERE conf >= {_HIGH}e0),
lines AS (
  SELECT * EXCLUDE (brk), CAST(sum(brk) OVER (PARTITION BY page_id ORDER BY cy, det_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_id FROM (
    SELECT * EXCLUDE (mh), CASE WHEN abs(cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, det_id)) >= {_BAND}e0*mh THEN 1 ELSE 0 END AS brk
    FROM (SELECT *, median(h) OVER (PARTITION BY page_id) AS mh FROM rel))),
gaps AS (SELECT *, cx - lag(cx) OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id) AS gap FROM lines),
spaced AS (
  SELECT * EXCLUDE (mw, mg), CASE WHEN gap - mg > 0.5e0*mw THEN greatest(1, CAST(round_even((gap - mg)/mw, 0) AS INT)) ELSE 0 END AS n_spaces FROM (
    SELECT *, median(w) OVER (PARTITION BY page_id) AS mw, median(gap) OVER (PARTITION BY page_id, line_id) AS mg FROM gaps)),
spacing AS (
  SELECT page_id, line_id, count(*) AS n_cells, min(cx) AS first_cx, max(cx) AS last_cx, median(cy) AS row_y, any_value(mw) AS median_w,
    CASE WHEN count(gap) > 0 THEN list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[CAST((count(*) - 1)//10 AS INT) + 1] ELSE any_value(mw)*1.1e0 END AS spacing
  FROM (SELECT *, median(w) OVER (PARTITION BY page_id) AS mw FROM gaps) GROUP BY page_id, line_id),
usable AS (SELECT * FROM spacing WHERE n_cells >= 2 AND spacing >= 0.6e0*median_w),
gap_slots AS (
  SELECT page_id, line_id, det_id, cx AS "from", k, cx + k*spacing AS ex, row_y AS ey FROM (
    SELECT *, unnest(range(1, n + 1)) AS k FROM (
      SELECT l.page_id, l.line_id, l.det_id, l.cx, u.spacing, u.row_y, CAST(round_even((nx - l.cx)/u.spacing, 0) AS INT) - 1 AS n
      FROM (SELECT *, lead(cx) OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id) AS nx FROM lines) l JOIN usable u USING (page_id, line_id)
      WHERE nx IS NOT NULL) WHERE n >= 1)),
bounds AS (
  SELECT page_id, median(l) AS text_left, median(r) AS text_right FROM (
    SELECT page_id, line_id, min(cx) AS l, max(cx) AS r FROM lines GROUP BY page_id, line_id HAVING count(*) >= 3) GROUP BY page_id),
edge_n AS (
  SELECT *, CAST(ceil((first_cx - text_left)/spacing + 0.5e0) AS INT) - 1 AS nl, CAST(ceil((text_right - last_cx)/spacing + 0.5e0) AS INT) - 1 AS nr
  FROM usable JOIN bounds USING (page_id)),
edge_slots AS (
  SELECT page_id, line_id, 'left' AS side, k, first_cx - k*spacing AS ex, row_y AS ey FROM (SELECT *, unnest(range(1, nl + 1)) AS k FROM edge_n WHERE nl >= 1)
  UNION ALL
  SELECT page_id, line_id, 'right', k, last_cx + k*spacing, row_y FROM (SELECT *, unnest(range(1, nr + 1)) AS k FROM edge_n WHERE nr >= 1)),
gt AS (
  SELECT page_id, cell_idx, l, t, r, b, bits6, label, img_w, img_h FROM (
    SELECT DISTINCT page_id, cell_idx, frac_bbox.l AS l, frac_bbox.t AS t, frac_bbox.r AS r, frac_bbox.b AS b, bits6, label FROM gt_cells
    WHERE 0 <= frac_bbox.l AND frac_bbox.l < frac_bbox.r AND frac_bbox.r <= 1 AND 0 <= frac_bbox.t AND frac_bbox.t < frac_bbox.b AND frac_bbox.b <= 1)
  JOIN page_images USING (page_id)),
truth AS (
  SELECT s.shot_id AS page_id, row_number() OVER (PARTITION BY s.shot_id ORDER BY cell_idx, l, t, r, b, coalesce(bits6, ''), coalesce(label, -1)) AS det_id,
    (l + r)/2*img_w AS cx, (t + b)/2*img_h AS cy, (r - l)*img_w AS w, (b - t)*img_h AS h, bits6 AS bits
  FROM gt JOIN (SELECT DISTINCT shot_id, page_id FROM predicted_cells WHERE shot_id IS NOT NULL AND page_id IS NOT NULL) s USING (page_id)),
crops AS (
  SELECT DISTINCT crop_id, page_id, cell_idx, split, path, bits6, label_int FROM manifest
  WHERE label_int BETWEEN 1 AND 63 AND CASE WHEN regexp_full_match(bits6, '[01]{{6}}') THEN {label_sql("bits6")} = label_int ELSE false END),
px AS (
  SELECT vec_id, label, i//32 AS y, i%32 AS x, floor((CAST(embedding[((i//32)//4)*8 + (i%32)//4 + 1] + 1 AS DOUBLE))*127.5e0) AS v
  FROM embeddings, range(1024) t(i)),
paper AS (SELECT vec_id, any_value(label) AS label, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM px GROUP BY vec_id),
dots(dot, dx, dy) AS (VALUES (1, 7, 4), (2, 7, 16), (3, 7, 27), (4, 24, 4), (5, 24, 16), (6, 24, 27)),
signal AS (
  SELECT p.vec_id, p.label, d.dot, greatest(avg(v) - any_value(lo), any_value(hi) - avg(v), max(v) - min(v)) AS strength
  FROM px p JOIN paper USING (vec_id) JOIN dots d ON p.x >= d.dx - 4 AND p.x < d.dx + 4 AND p.y >= d.dy - 4 AND p.y < d.dy + 4
  GROUP BY p.vec_id, p.label, d.dot)
"""
