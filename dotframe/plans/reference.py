"""Queries of the recognition pipeline's operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe import pipeline
from dotframe.functions import encode, geom
from dotframe.functions import text as names
from dotframe.operators import dataset, detector, evalm, gridfill, kernels, layout, recover, sinks, suppress, translate
from dotframe.plans import fixtures as fx
from dotframe.plans.fixtures import PRE, label_sql
from dotframe.session import staged
from dotframe.sources import annotations as ann
from dotframe.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None, pre: bool = True):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (PRE if pre else "") + sql
        return f

    return add


def r6(*cols: str, digits: int = 6) -> list:
    return [F.round(k, digits).alias(k) for k in cols]


# Patterns ------------------------------------------------------------------


@query(f"SELECT page_id, det_id, {label_sql('bits')} AS label, chr(10240 + {label_sql('bits')}) AS dot_char FROM cells")
def braille_char(s, d):
    return fx.cells(s, d).select("page_id", "det_id", encode.bits_to_label(c("bits")).alias("label"), encode.dot_char(c("bits")).alias("dot_char"))


@query("SELECT crop_id, reverse(lpad(bin(label_int), 6, '0')) AS bits6 FROM crops")
def decode_label(s, d):
    return fx.crops(s, d).select("crop_id", encode.label_to_bits(c("label_int")).alias("bits6"))


@query(f"SELECT crop_id, {label_sql('bits6')} AS label FROM crops")
def encode_bits(s, d):
    return fx.crops(s, d).select("crop_id", encode.bits_to_label(c("bits6")).alias("label"))


@query("SELECT crop_id, substr(bits6, 4, 3) || substr(bits6, 1, 3) AS flipped FROM crops")
def hflip_bits(s, d):
    return fx.crops(s, d).select("crop_id", encode.mirror_bits(c("bits6")).alias("flipped"))


@query("SELECT vec_id, list_aggregate(list_transform(embedding[1:6], lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS bits FROM embeddings")
def logits_to_bits(s, d):
    return table(s, d, "embeddings").select("vec_id", encode.logits_to_bits(F.slice("embedding", 1, 6)).alias("bits"))


@query(
    "SELECT det_id, CASE WHEN page_id % 2 = 0 THEN '000000' ELSE bits END AS bits FROM cells"
)
def class_lookup(s, d):
    n = F.when(c("page_id") % 2 == 0, 1).otherwise(64)
    return fx.cells(s, d).select("det_id", encode.class_to_bits(n, encode.bits_to_label(c("bits"))).alias("bits"))


# Quality of classification: truth is the vector's label, as a pattern ------

_HITS = """, v AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x, (label >> (i - 1)) & 1 AS y FROM embeddings, range(1, 7) t(i)),
h AS (SELECT *, CASE WHEN (x > 0) = (y = 1) THEN 1 ELSE 0 END AS hit FROM v)
"""


def _logits(s, d):
    v = table(s, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 6).alias("logits"))
    return evalm.dot_hits(v).select("vec_id", "label", "dot", "x", "y", "hit")


@query(_HITS + "SELECT label, CAST(count(*) AS BIGINT) AS n_dots, round(avg(hit), 6) AS dot_acc FROM h GROUP BY label")
def dot_accuracy(s, d):
    return evalm.dot_accuracy(_logits(s, d), "label").withColumn("dot_acc", F.round("dot_acc", 6))


@query(_HITS + "SELECT label, round(avg(ok), 6) AS cell_acc FROM (SELECT label, vec_id, min(hit) AS ok FROM h GROUP BY label, vec_id) GROUP BY label")
def cell_accuracy(s, d):
    return evalm.cell_accuracy(_logits(s, d), "vec_id", "label").withColumn("cell_acc", F.round("cell_acc", 6))


@query(_HITS + "SELECT label, round(avg(greatest(x, 0) - x*y + ln(1 + exp(-abs(x)))), 6) AS loss FROM h GROUP BY label")
def bce_loss(s, d):
    return _logits(s, d).groupBy("label").agg(F.round(F.avg(evalm.bce(c("x"), c("y"))), 6).alias("loss"))


# Geometry ------------------------------------------------------------------


@query("SELECT det_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM box")
def cell_corners(s, d):
    return suppress.with_corners(fx.cells(s, d)).select("det_id", *r6("x0", "y0", "x1", "y1"))


@query("SELECT det_id, round((x0 + x1)/2, 6) AS cx, round((y0 + y1)/2, 6) AS cy, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h FROM box")
def xyxy_to_center(s, d):
    b = suppress.with_corners(fx.cells(s, d)).select("det_id", "x0", "y0", "x1", "y1")
    return b.select("det_id", *geom.centre(c("x0"), c("y0"), c("x1"), c("y1"))).select("det_id", *r6("cx", "cy", "w", "h"))


_IOU = """least(a.x1, b.x1) - greatest(a.x0, b.x0) AS iw, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS ih,
  (a.x1 - a.x0)*(a.y1 - a.y0) + (b.x1 - b.x0)*(b.y1 - b.y0) AS both_areas"""
_PAIRS = f""", pair AS (
  SELECT page_id, hi, lo, iw*ih/(both_areas - iw*ih) AS iou FROM (
    SELECT a.page_id, a.det_id AS hi, b.det_id AS lo, {_IOU} FROM box a JOIN box b
      ON a.page_id = b.page_id AND (a.conf > b.conf OR (a.conf = b.conf AND a.det_id < b.det_id)))
  WHERE iw > 0 AND ih > 0)
"""


@query(_PAIRS + "SELECT page_id, hi, lo, round(iou, 6) AS iou FROM pair WHERE iou > 0.15e0")
def iou_pairs(s, d):
    return suppress.pairs(fx.cells(s, d), 0.15).select("page_id", "hi", "lo", F.round("iou", 6).alias("iou"))


@query(
    """, tile AS (SELECT page_id, floor(min(cx)) AS bx0, floor(min(cy)) AS by0, floor(median(cx)) AS bx1, floor(median(cy)) AS by1 FROM cells GROUP BY page_id)
SELECT page_id, det_id FROM cells JOIN tile USING (page_id) WHERE cx BETWEEN bx0 AND bx1 AND cy BETWEEN by0 AND by1"""
)
def containment_pairs(s, d):
    cells = fx.cells(s, d)
    q = lambda f, k, n: F.floor(f(k)).alias(n)
    box = cells.groupBy("page_id").agg(q(F.min, "cx", "bx0"), q(F.min, "cy", "by0"), q(F.median, "cx", "bx1"), q(F.median, "cy", "by1"))
    return cells.join(box, "page_id").where(geom.inside(c("cx"), c("cy"), c("bx0"), c("by0"), c("bx1"), c("by1"))).select("page_id", "det_id")


@query(
    """SELECT det_id, round(abs(cx - px) + abs(cy - py), 6) AS l1, round(sqrt((cx - px)*(cx - px) + (cy - py)*(cy - py)), 6) AS l2 FROM (
  SELECT *, lag(cx) OVER o AS px, lag(cy) OVER o AS py FROM cells WINDOW o AS (PARTITION BY page_id ORDER BY det_id)) WHERE px IS NOT NULL"""
)
def center_distances(s, d):
    o = W.partitionBy("page_id").orderBy("det_id")
    n = fx.cells(s, d).withColumn("px", F.lag("cx").over(o)).withColumn("py", F.lag("cy").over(o)).where("px is not null")
    return n.select(
        "det_id", F.round(geom.distance_l1(c("cx") - c("px"), c("cy") - c("py")), 6).alias("l1"), F.round(geom.distance_l2(c("cx") - c("px"), c("cy") - c("py")), 6).alias("l2")
    )


@query("SELECT det_id, CAST(round_even(w/4, 0) AS BIGINT) AS quarter, CAST(round_even(floor(h)/2, 0) AS BIGINT) AS half FROM cells")
def round_even(s, d):
    return fx.cells(s, d).select("det_id", geom.half_even(c("w") / 4).cast("long").alias("quarter"), geom.half_even(F.floor("h") / 2).cast("long").alias("half"))


@query(
    """SELECT det_id, CAST(trunc(greatest(0, cx - w/2)) AS BIGINT) AS x0, CAST(trunc(greatest(0, cy - h/2)) AS BIGINT) AS y0,
  CAST(trunc(least(1000, cx + w/2)) AS BIGINT) AS x1, CAST(trunc(least(800, cy + h/2)) AS BIGINT) AS y1 FROM cells"""
)
def crop_corners(s, d):
    return fx.cells(s, d).select("det_id", *geom.clipped_corners(c("cx"), c("cy"), c("w"), c("h"), F.lit(1000), F.lit(800)))


@query(
    """, p AS (SELECT page_id, cell_idx, img_w, img_h, (l + r)/2*img_w AS cx, (t + b)/2*img_h AS cy, (r - l)*img_w AS w, (b - t)*img_h AS h FROM gt),
q AS (SELECT *, least(img_w - 1, greatest(0, floor(cx - w/2 - w*0.1e0 + 0.5e0))) AS x0, least(img_h - 1, greatest(0, floor(cy - h/2 - h*0.1e0 + 0.5e0))) AS y0 FROM p)
SELECT page_id, cell_idx, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0,
  CAST(greatest(x0 + 1, least(img_w, floor(cx + w/2 + w*0.1e0 + 0.5e0))) AS BIGINT) AS x1,
  CAST(greatest(y0 + 1, least(img_h, floor(cy + h/2 + h*0.1e0 + 0.5e0))) AS BIGINT) AS y1 FROM q"""
)
def crop_bounds(s, d):
    p = fx.boxes(s, d).select("page_id", "cell_idx", "img_w", "img_h", *geom.frac_to_centre("frac_bbox", c("img_w"), c("img_h")))
    return p.select("page_id", "cell_idx", *geom.crop_corners(c("cx"), c("cy"), c("w"), c("h"), c("img_w"), c("img_h")))


@query(
    """SELECT page_id, cell_idx, round((l + r)/2*img_w, 8) AS cx, round((t + b)/2*img_h, 8) AS cy, round((r - l)*img_w, 8) AS w, round((b - t)*img_h, 8) AS h,
  bits6 FROM gt"""
)
def gt_from_frac(s, d):
    p = fx.boxes(s, d).select("page_id", "cell_idx", "bits6", *geom.frac_to_centre("frac_bbox", c("img_w"), c("img_h")))
    return p.select("page_id", "cell_idx", "bits6", *r6("cx", "cy", "w", "h", digits=8))


@query(
    """SELECT page_id, cell_idx, round(greatest(0, l*img_w - (r - l)*img_w*0.1e0), 8) AS x0, round(greatest(0, t*img_h - (b - t)*img_h*0.1e0), 8) AS y0,
  round(least(img_w, r*img_w + (r - l)*img_w*0.1e0), 8) AS x1, round(least(img_h, b*img_h + (b - t)*img_h*0.1e0), 8) AS y1 FROM gt"""
)
def padded_bbox(s, d):
    p = fx.boxes(s, d).select("page_id", "cell_idx", *geom.padded_box("frac_bbox", c("img_w"), c("img_h")))
    return p.select("page_id", "cell_idx", *r6("x0", "y0", "x1", "y1", digits=8))


@query("SELECT det_id, round(greatest(1, 96/w), 6) AS factor, round(cx*greatest(1, 96/w), 6) AS target_x FROM cells")
def upscale_target(s, d):
    f = geom.upscale(c("w"))
    return fx.cells(s, d).select("det_id", F.round(f, 6).alias("factor"), F.round(c("cx") * f, 6).alias("target_x"))


_BOX = """, s AS (SELECT page_id, img_w AS w, img_h AS h, least(640.0e0/img_h, 640.0e0/img_w) AS scale FROM page_images),
u AS (SELECT *, floor(w*scale + 0.5e0) AS uw, floor(h*scale + 0.5e0) AS uh FROM s),
z AS (SELECT *, ((640 - uw) % 32)/2 AS dw, ((640 - uh) % 32)/2 AS dh FROM u)
SELECT page_id, round(scale, 6) AS scale, CAST(uw AS BIGINT) AS unpad_w, CAST(uh AS BIGINT) AS unpad_h,
  CAST(floor(dw - 0.1e0 + 0.5e0) AS BIGINT) AS pad_left, CAST(floor(dh - 0.1e0 + 0.5e0) AS BIGINT) AS pad_top,
  CAST(uw + floor(dw - 0.1e0 + 0.5e0) + floor(dw + 0.1e0 + 0.5e0) AS BIGINT) AS out_w,
  CAST(uh + floor(dh - 0.1e0 + 0.5e0) + floor(dh + 0.1e0 + 0.5e0) AS BIGINT) AS out_h FROM z"""


@query(_BOX)
def letterbox_geom(s, d):
    g = table(s, d, "page_images").select("page_id", *geom.letterbox(c("img_w"), c("img_h")))
    return g.withColumn("scale", F.round("scale", 6))


# Tiles ---------------------------------------------------------------------

_TILES = """, fw AS (SELECT page_id, median(r - l) AS fw FROM gt GROUP BY page_id),
sized AS (SELECT page_id, img_w, img_h, CAST(greatest(100, round_even(coalesce(fw*img_w, 640)*640/30.0e0, 0)) AS BIGINT) AS tile FROM page_images LEFT JOIN fw USING (page_id)),
st AS (SELECT *, greatest(1, tile - CAST(round_even(tile*0.2e0, 0) AS BIGINT)) AS stride, greatest(img_w - tile, 0) AS lx, greatest(img_h - tile, 0) AS ly FROM sized),
xs0 AS (SELECT page_id, unnest(range(0, lx//stride + 1))*stride AS x0 FROM st),
xs AS (SELECT page_id, x0 FROM xs0 UNION SELECT page_id, lx FROM st WHERE (lx//stride)*stride + tile < img_w),
ys0 AS (SELECT page_id, unnest(range(0, ly//stride + 1))*stride AS y0 FROM st),
ys AS (SELECT page_id, y0 FROM ys0 UNION SELECT page_id, ly FROM st WHERE (ly//stride)*stride + tile < img_h),
tiles AS (
  SELECT page_id, img_w, img_h, tile, 0 AS tile_no, 0 AS x0, 0 AS y0, img_w AS x1, img_h AS y1 FROM st WHERE img_w <= tile AND img_h <= tile
  UNION ALL
  SELECT page_id, img_w, img_h, tile, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0) - 1, x0, y0, least(x0 + tile, img_w), least(y0 + tile, img_h)
  FROM st JOIN xs USING (page_id) JOIN ys USING (page_id) WHERE img_w > tile OR img_h > tile),
placed AS (
  SELECT g.page_id, g.cell_idx, t.tile_no, greatest(0, (l*t.img_w - x0)/(x1 - x0)) AS l, greatest(0, (t*t.img_h - y0)/(y1 - y0)) AS t,
    least(1, (r*t.img_w - x0)/(x1 - x0)) AS r, least(1, (b*t.img_h - y0)/(y1 - y0)) AS b, coalesce(label, 0) AS label
  FROM gt g JOIN tiles t USING (page_id)
  WHERE (l + r)/2 BETWEEN x0/t.img_w AND x1/t.img_w AND (g.t + g.b)/2 BETWEEN y0/t.img_h AND y1/t.img_h)
"""


def _tiles(s, d):
    return dataset.tiles_of(table(s, d, "page_images").select("page_id", "img_w", "img_h"), fx.boxes(s, d))


def _placed(s, d):
    return dataset.cells_in_tiles(_tiles(s, d), fx.boxes(s, d).drop("img_w", "img_h"))


@query(_TILES + "SELECT page_id, tile FROM sized")
def native_tile_size(s, d):
    return _tiles(s, d).where("tile_no = 0").select("page_id", "tile")


@query(_TILES + "SELECT page_id, CAST(tile_no AS BIGINT) AS tile_no, x0, y0, x1, y1 FROM tiles")
def tile_grid(s, d):
    return _tiles(s, d).select("page_id", c("tile_no").cast("long").alias("tile_no"), "x0", "y0", "x1", "y1")


@query(_TILES + "SELECT page_id, cell_idx, CAST(tile_no AS BIGINT) AS tile_no FROM placed")
def cells_in_tiles(s, d):
    return _placed(s, d).select("page_id", "cell_idx", c("tile_no").cast("long").alias("tile_no"))


@query(_TILES + "SELECT page_id, cell_idx, CAST(tile_no AS BIGINT) AS tile_no, round(l, 9) AS l, round(t, 9) AS t, round(r, 9) AS r, round(b, 9) AS b FROM placed")
def tile_relative_bbox(s, d):
    return _placed(s, d).select("page_id", "cell_idx", c("tile_no").cast("long").alias("tile_no"), *r6("l", "t", "r", "b", digits=9))


@query(_TILES + "SELECT page_id, CAST(tile_no AS BIGINT) AS tile_no, count(*) AS n_cells FROM placed GROUP BY page_id, tile_no")
def nonempty_tiles(s, d):
    return _placed(s, d).groupBy("page_id", c("tile_no").cast("long").alias("tile_no")).agg(F.count(F.lit(1)).alias("n_cells"))


@query(
    _TILES
    + """SELECT page_id, CAST(tile_no AS BIGINT) AS tile_no, cell_idx,
  printf('%d %d.%06d %d.%06d %d.%06d %d.%06d', label, x//1000000, x % 1000000, y//1000000, y % 1000000, w//1000000, w % 1000000, h//1000000, h % 1000000) AS line FROM (
  SELECT *, CAST(floor((l + r)/2*1e6 + 0.5e0) AS BIGINT) AS x, CAST(floor((t + b)/2*1e6 + 0.5e0) AS BIGINT) AS y, CAST(floor((r - l)*1e6 + 0.5e0) AS BIGINT) AS w, CAST(floor((b - t)*1e6 + 0.5e0) AS BIGINT) AS h FROM placed)"""
)
def label_lines(s, d):
    line = dataset.label_line(F.coalesce("label", F.lit(0)), c("l"), c("t"), c("r"), c("b")).alias("line")
    return _placed(s, d).select("page_id", c("tile_no").cast("long").alias("tile_no"), "cell_idx", line)


@query(
    """, t AS (SELECT *, floor(cx/200)*200 AS tx0, floor(cy/200)*200 AS ty0 FROM box)
SELECT det_id FROM t WHERE NOT ((x0 - tx0 < 10 AND tx0 > 0) OR (x1 > tx0 + 190 AND tx0 + 200 < 1000) OR (y0 - ty0 < 10 AND ty0 > 0) OR (y1 > ty0 + 190 AND ty0 + 200 < 1000))"""
)
def edge_filter(s, d):
    t = fx.cells(s, d).withColumn("tx0", F.floor(c("cx") / 200) * 200).withColumn("ty0", F.floor(c("cy") / 200) * 200)
    t = t.withColumn("tx1", c("tx0") + 200).withColumn("ty1", c("ty0") + 200).withColumn("tile", F.lit(200)).withColumn("img_w", F.lit(1000)).withColumn("img_h", F.lit(1000))
    return suppress.tile_edge_filter(t).select("det_id")


@query(
    """SELECT page_id, det_id, round(cx + 100*(det_id % 3), 6) AS cx, round(cy + 50*(det_id % 2), 6) AS cy FROM cells"""
)
def tile_offset_union(s, d):
    at = fx.cells(s, d).withColumn("tx", 100 * (c("det_id") % 3)).withColumn("ty", 50 * (c("det_id") % 2))
    parts = [at.where(c("det_id") % 3 == k) for k in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.select("page_id", "det_id", F.round(c("cx") + c("tx"), 6).alias("cx"), F.round(c("cy") + c("ty"), 6).alias("cy"))


# Counts, medians and percentiles -------------------------------------------


@query("SELECT page_id, count(*) AS n, count(*) FILTER (WHERE conf >= 0.3e0) AS n_high, count(*) FILTER (WHERE rescued) AS n_rescued FROM cells GROUP BY page_id")
def stage_counts(s, d):
    return fx.cells(s, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("conf") >= 0.3).alias("n_high"), F.count_if("rescued").alias("n_rescued"))


@query("SELECT CASE WHEN conf >= 0.3e0 THEN 'high' ELSE 'low' END AS part, det_id FROM cells")
def conf_split(s, d):
    hi, lo = recover.split_by_confidence(fx.cells(s, d))
    return hi.select(F.lit("high").alias("part"), "det_id").unionByName(lo.select(F.lit("low").alias("part"), "det_id"))


@query("SELECT page_id, median(w) AS mw, median(h) AS mh, median(cx) AS mx, median(cy) AS my FROM cells GROUP BY page_id")
def page_medians(s, d):
    return fx.cells(s, d).groupBy("page_id").agg(*[F.median(k).alias(n) for k, n in (("w", "mw"), ("h", "mh"), ("cx", "mx"), ("cy", "my"))])


@query(
    """SELECT page_id, round(quantile_cont(cx, 0.05), 6) AS x05, round(quantile_cont(cx, 0.95), 6) AS x95, round(quantile_cont(cy, 0.25), 6) AS y25
FROM cells GROUP BY page_id"""
)
def page_percentiles(s, d):
    q = lambda k, p, n: F.round(F.percentile(k, F.lit(p)), 6).alias(n)
    return fx.cells(s, d).groupBy("page_id").agg(q("cx", 0.05, "x05"), q("cx", 0.95, "x95"), q("cy", 0.25, "y25"))


@query("SELECT page_id, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM cells GROUP BY page_id")
def text_block_bounds(s, d):
    return fx.cells(s, d).groupBy("page_id").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))


@query("SELECT page_id, round(avg(w), 6) AS w, round(avg(h), 6) AS h FROM cells GROUP BY page_id")
def mean_cell_size(s, d):
    return fx.cells(s, d).groupBy("page_id").agg(F.round(F.avg("w"), 6).alias("w"), F.round(F.avg("h"), 6).alias("h"))


@query("SELECT page_id, bool_or(conf < 0.3e0 AND bits = '111111') AS doubtful FROM cells GROUP BY page_id")
def any_known(s, d):
    return fx.cells(s, d).groupBy("page_id").agg(F.bool_or((c("conf") < 0.3) & (c("bits") == encode.ALL_DOTS)).alias("doubtful"))


@query("SELECT page_id, det_id FROM cells WHERE page_id IN (SELECT page_id FROM cells GROUP BY page_id HAVING count(*) >= 3)")
def min_candidate_guard(s, d):
    return recover.enough_candidates(fx.cells(s, d)).select("page_id", "det_id")


@query(
    """, m AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE conf >= 0.3e0) AS nh, median(w) FILTER (WHERE conf >= 0.3e0) AS mh, median(w) AS ma FROM cells GROUP BY page_id HAVING count(*) >= 3),
t AS (SELECT page_id, CASE WHEN nh >= 3 THEN mh ELSE ma END AS median_w FROM m),
u AS (SELECT *, CAST(greatest(100, round_even(median_w*640/30.0e0, 0)) AS BIGINT) AS tile FROM t)
SELECT page_id, median_w, tile, round(640.0e0/tile, 6) AS ratio, (640.0e0/tile > 1.5e0 OR 640.0e0/tile < 0.67e0) AS again FROM u"""
)
def scale_decision(s, d):
    return recover.scale_decision(fx.cells(s, d)).select("page_id", "median_w", "tile", F.round("ratio", 6).alias("ratio"), "again")


# Suppression ---------------------------------------------------------------


def _fold_sql(t: float, frm: str = "box", id_: str = "det_id") -> str:
    return f""", folded AS (
  SELECT page_id, list_reduce(list([{{'id': {id_}, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'conf': conf}}] ORDER BY conf DESC, {id_}),
    lambda kept, e: CASE WHEN len(list_filter(kept, lambda k: least(k.x1, e[1].x1) > greatest(k.x0, e[1].x0) AND least(k.y1, e[1].y1) > greatest(k.y0, e[1].y0) AND
      (least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0))*(least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0)) > {t}e0*((k.x1 - k.x0)*(k.y1 - k.y0)
      + (e[1].x1 - e[1].x0)*(e[1].y1 - e[1].y0) - (least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0))*(least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0))))) > 0
    THEN kept ELSE list_concat(kept, e) END) AS kept FROM {frm} GROUP BY page_id),
survivors AS (SELECT page_id, unnest(kept, recursive := true) FROM folded)
"""


def _nms_sql(t: float, limit: int | None = None, frm: str = "box") -> str:
    where = f" QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, id) <= {limit}" if limit else ""
    return _fold_sql(t, frm) + f"SELECT page_id, id AS det_id FROM survivors{where}"


@query(_nms_sql(0.5))
def nms_50(s, d):
    return suppress.nms(fx.cells(s, d)).select("page_id", "det_id")


@query(_nms_sql(0.7, 50))
def nms_70_limit(s, d):
    return suppress.nms(fx.cells(s, d), 0.7, 50).select("page_id", "det_id")


@query()
def resolve_overlaps(s, d):
    return suppress.resolve_overlaps(fx.cells(s, d)).select("page_id", "det_id")


# Lines and text ------------------------------------------------------------


@query("SELECT page_id, det_id, line_id FROM lines")
def line_groups(s, d):
    return fx.lines(s, d).select("page_id", "det_id", "line_id")


@query("SELECT page_id, det_id, round(gap, 6) AS gap FROM gaps")
def line_gaps(s, d):
    return layout.line_gaps(fx.lines(s, d)).select("page_id", "det_id", F.round("gap", 6).alias("gap"))


@query("SELECT page_id, line_id, n_cells, round(spacing, 6) AS spacing FROM spacing")
def char_spacing(s, d):
    return layout.char_spacing(fx.lines(s, d)).select("page_id", "line_id", "n_cells", F.round("spacing", 6).alias("spacing"))


@query("SELECT page_id, line_id, first_cx, last_cx FROM spacing")
def line_ends(s, d):
    return layout.char_spacing(fx.lines(s, d)).select("page_id", "line_id", "first_cx", "last_cx")


@query("SELECT page_id, line_id, n_cells FROM usable")
def usable_lines(s, d):
    return layout.usable(layout.char_spacing(fx.lines(s, d))).select("page_id", "line_id", "n_cells")


@query(
    """, k AS (SELECT *, unnest(range(0, n_spaces + 1)) AS k FROM spaced)
SELECT page_id, line_id, row_number() OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id, k) - 1 AS seq, CASE WHEN k = n_spaces THEN cx END AS cx, cy,
  CASE WHEN k = n_spaces THEN bits ELSE '000000' END AS bits, k < n_spaces AS is_space FROM k"""
)
def insert_spaces(s, d):
    return layout.insert_spaces(fx.lines(s, d)).withColumn("seq", c("seq").cast("long"))


_TEXT = f""", strings AS (SELECT page_id, line_id, string_agg(repeat(chr(10240), n_spaces) || chr(10240 + {label_sql("bits")}), '' ORDER BY cx, det_id) AS text
  FROM spaced GROUP BY page_id, line_id)
"""


@query(_TEXT + "SELECT page_id, line_id, text FROM strings")
def line_strings(s, d):
    return layout.line_strings(fx.lines(s, d))


@query(_TEXT + "SELECT page_id, string_agg(text, chr(10) ORDER BY line_id) AS text FROM strings GROUP BY page_id")
def page_text(s, d):
    return layout.page_text(fx.rel(s, d))


@query(_TEXT + "SELECT page_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM strings GROUP BY page_id")
def layout_summary(s, d):
    return layout.line_strings(fx.lines(s, d)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    """, i AS (SELECT *, bits = '111111' AS f, row_number() OVER (PARTITION BY page_id, line_id ORDER BY cy, det_id)
  - row_number() OVER (PARTITION BY page_id, line_id, bits = '111111' ORDER BY cy, det_id) AS g FROM lines)
SELECT page_id, det_id FROM i QUALIFY NOT f OR count(*) OVER (PARTITION BY page_id, line_id, f, g) < 2"""
)
def markout_strip(s, d):
    return layout.strip_markout(fx.lines(s, d)).select("page_id", "det_id")


@query(
    """SELECT page_id, det_id, CAST(sum(CASE WHEN gap >= 3*mw THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id
FROM (SELECT *, median(w) OVER (PARTITION BY page_id) AS mw FROM gaps)"""
)
def horizontal_runs(s, d):
    return layout.horizontal_runs(fx.lines(s, d)).select("page_id", "det_id", "run_id")


@query(
    """, r AS (SELECT page_id, line_id, det_id, sum(CASE WHEN gap >= 3*mw THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id ROWS UNBOUNDED PRECEDING) AS run_id
FROM (SELECT *, median(w) OVER (PARTITION BY page_id) AS mw FROM gaps))
SELECT page_id, line_id, CAST(run_id AS BIGINT) AS run_id, count(*) AS n FROM r GROUP BY ALL HAVING count(*) <= 3"""
)
def small_clusters(s, d):
    return layout.small_clusters(fx.lines(s, d))


@query(
    """, t AS (SELECT *, lead(cx) OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id) AS nx FROM lines)
SELECT t.page_id, det_id, round(cx + spacing, 6) AS ex, cy AS ey, w, h FROM t JOIN usable USING (page_id, line_id)
WHERE bits IN ('000001', '000011', '000110', '000111', '001111') AND (nx IS NULL OR nx - cx > 1.4e0*spacing)"""
)
def indicator_targets(s, d):
    return layout.indicator_targets(fx.lines(s, d)).select("page_id", "det_id", F.round("ex", 6).alias("ex"), "ey", "w", "h")


@query("SELECT page_id, det_id, k, round(ex, 6) AS ex, ey FROM gap_slots")
def gap_slots(s, d):
    return layout.gap_slots(fx.lines(s, d)).select("page_id", "det_id", "k", F.round("ex", 6).alias("ex"), "ey")


@query("SELECT page_id, line_id, side, k, round(ex, 6) AS ex, ey FROM edge_slots")
def edge_slots(s, d):
    return layout.edge_slots(fx.lines(s, d)).select("page_id", "line_id", "side", "k", F.round("ex", 6).alias("ex"), "ey")


@query("SELECT page_id, det_id, (row_number() OVER o - 1)//40 AS sheet_row, (row_number() OVER o - 1) % 40 AS sheet_col FROM cells WINDOW o AS (PARTITION BY page_id ORDER BY det_id)")
def sheet_positions(s, d):
    return layout.sheet_positions(fx.cells(s, d)).select("page_id", "det_id", "sheet_row", c("sheet_col").cast("long").alias("sheet_col"))


@query(
    """, o AS (SELECT page_id, det_id, row_number() OVER (PARTITION BY page_id ORDER BY cy, det_id) - 1 AS n, count(*) OVER (PARTITION BY page_id) AS of_page FROM cells)
SELECT page_id, det_id, CASE WHEN of_page > 1 THEN printf('shot%d_%04d', page_id, n) ELSE printf('shot%d', page_id) END AS name FROM o"""
)
def ordinal_names(s, d):
    return layout.ordinal_names(fx.cells(s, d), F.format_string("shot%d", "page_id")).select("page_id", "det_id", "name")


# Rescue --------------------------------------------------------------------


_CLAIMS = """, size AS (SELECT page_id, median(w) AS mw, median(h) AS mh FROM rel GROUP BY page_id),
slot AS (
  SELECT page_id, line_id, 0 AS part, "from", det_id, k, ex, ey FROM gap_slots
  UNION ALL SELECT page_id, line_id, CASE WHEN side = 'left' THEN 1 ELSE 2 END, NULL, NULL, k, ex, ey FROM edge_slots),
num AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_id, part, "from", det_id, k) AS n FROM slot),
cand AS (
  SELECT n.page_id, n.n, list(c.det_id ORDER BY c.conf DESC, c.det_id) FILTER (WHERE c.det_id IS NOT NULL) AS ids
  FROM num n JOIN spacing s USING (page_id, line_id) JOIN size z USING (page_id)
  LEFT JOIN cells c ON c.page_id = n.page_id AND c.conf < 0.3e0 AND abs(c.cx - n.ex) < s.spacing*0.45e0 AND abs(c.cy - n.ey) < z.mh*0.55e0
    AND NOT (c.bits = '111111' AND c.conf < 0.15e0)
  GROUP BY n.page_id, n.n),
fold AS (
  SELECT page_id, list_reduce(list([{'n': n, 'id': CAST(NULL AS BIGINT), 'ids': coalesce(ids, [])}] ORDER BY n),
    lambda s, e: list_concat(s, [{'n': e[1].n, 'id': list_filter(e[1].ids, lambda x: NOT coalesce(list_contains(list_transform(s, lambda y: y.id), x), false))[1], 'ids': CAST([] AS BIGINT[])}]),
    CAST([] AS STRUCT(n BIGINT, id BIGINT, ids BIGINT[])[])) AS got FROM cand GROUP BY page_id),
claims AS (SELECT page_id, unnest(got, recursive := true) FROM fold)"""


@query(
    _CLAIMS
    + """
SELECT page_id, 'reliable' AS stage, det_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM rel
UNION ALL SELECT c.page_id, 'rescued', c.id, round(k.cx, 6), round(k.cy, 6) FROM claims c JOIN cells k ON k.page_id = c.page_id AND k.det_id = c.id
UNION ALL SELECT c.page_id, CASE WHEN part = 0 THEN 'gap' ELSE 'edge' END, NULL, round(ex, 6), round(ey, 6) FROM claims c JOIN num USING (page_id, n) WHERE c.id IS NULL
UNION ALL SELECT page_id, 'unfiltered', det_id, round(cx, 6), round(cy, 6) FROM cells WHERE page_id NOT IN (SELECT page_id FROM size)"""
)
def grid_fill(s, d):
    return gridfill.grid_fill(fx.cells(s, d)).select("page_id", "stage", "det_id", *r6("cx", "cy"))


_HEAD = PRE.replace("WITH cells AS (", "WITH raw AS (", 1).split("box AS (", 1)
_PROCESS = f"""{_HEAD[0].rstrip().rstrip(",")},
rbox AS (SELECT *, cx - w/2 AS x0, cy - h/2 AS y0, cx + w/2 AS x1, cy + h/2 AS y1 FROM raw){_fold_sql(0.5, "rbox")},
cells AS (SELECT raw.* FROM raw JOIN survivors s ON s.page_id = raw.page_id AND s.id = raw.det_id),
box AS ({_HEAD[1]}{_CLAIMS},
final AS (
  SELECT page_id, det_id, cx, cy, w, h, conf, bits FROM rel UNION ALL SELECT k.page_id, det_id, cx, cy, w, h, conf, bits FROM claims c JOIN cells k ON k.page_id = c.page_id AND k.det_id = c.id
  UNION ALL SELECT page_id, det_id, cx, cy, w, h, conf, bits FROM cells WHERE page_id NOT IN (SELECT page_id FROM size)),
block AS (SELECT page_id, median(w) AS bw, median(h) AS bh, min(cx) AS bx0, max(cx) AS bx1, min(cy) AS by0, max(cy) AS by1 FROM final WHERE conf >= 0.3e0 GROUP BY page_id HAVING count(*) >= 20),
kept AS (SELECT f.* FROM final f LEFT JOIN block USING (page_id) WHERE bw IS NULL OR (cx BETWEEN bx0 - 3*bw AND bx1 + 3*bw AND cy BETWEEN by0 - 2*bh AND by1 + 2*bh)),
klines AS (
  SELECT *, sum(brk) OVER (PARTITION BY page_id ORDER BY cy, det_id ROWS UNBOUNDED PRECEDING) AS line_id FROM (
    SELECT *, CASE WHEN abs(cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, det_id)) >= 0.55e0*mh THEN 1 ELSE 0 END AS brk FROM (SELECT *, median(h) OVER (PARTITION BY page_id) AS mh FROM kept))),
kgaps AS (SELECT *, cx - lag(cx) OVER (PARTITION BY page_id, line_id ORDER BY cx, det_id) AS gap, median(w) OVER (PARTITION BY page_id) AS mw FROM klines),
kspaced AS (SELECT *, CASE WHEN gap - mg > 0.5e0*mw THEN greatest(1, CAST(round_even((gap - mg)/mw, 0) AS INT)) ELSE 0 END AS n_spaces FROM (SELECT *, median(gap) OVER (PARTITION BY page_id, line_id) AS mg FROM kgaps)),
ktext AS (SELECT page_id, line_id, string_agg(repeat(chr(10240), n_spaces) || chr(10240 + {label_sql("bits")}), '' ORDER BY cx, det_id) AS text FROM kspaced GROUP BY page_id, line_id)
SELECT page_id, string_agg(text, chr(10) ORDER BY line_id) AS text FROM ktext GROUP BY page_id"""


@query(_PROCESS, pre=False)
def process(s, d):
    return pipeline.text_of_detections(fx.cells(s, d))


@query(
    """, b AS (SELECT page_id, median(w) AS mw, median(h) AS mh, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM rel GROUP BY page_id HAVING count(*) >= 20)
SELECT c.page_id, det_id FROM cells c LEFT JOIN b USING (page_id)
WHERE mw IS NULL OR (cx BETWEEN x0 - 3*mw AND x1 + 3*mw AND cy BETWEEN y0 - 2*mh AND y1 + 2*mh)"""
)
def margin_filter(s, d):
    return evalm.margin_filter(fx.cells(s, d)).select("page_id", "det_id")


@query(
    """, b AS (SELECT page_id, avg(w) AS mw, avg(h) AS mh, quantile_cont(cx, 0.05) AS x0, quantile_cont(cx, 0.95) AS x1, quantile_cont(cy, 0.05) AS y0, quantile_cont(cy, 0.95) AS y1 FROM rel GROUP BY page_id)
SELECT c.page_id, det_id FROM cells c LEFT JOIN b USING (page_id) WHERE mw IS NULL OR (cx > x0 - mw AND cx < x1 + mw AND cy > y0 - mh AND cy < y1 + mh)"""
)
def margin_filter_eval(s, d):
    return evalm.margin_filter_strict(fx.cells(s, d)).select("page_id", "det_id")


@query(
    """, t AS (SELECT page_id, det_id, round(cx + w, 6) AS ex, round(cy, 6) AS ey, w, h FROM rel)
SELECT page_id, det_id FROM t WHERE NOT EXISTS (SELECT 1 FROM cells k WHERE k.page_id = t.page_id AND abs(t.ex - k.cx) < 0.7e0*t.w AND abs(t.ey - k.cy) < 0.7e0*t.h)"""
)
def near_known_reject(s, d):
    slots = fx.rel(s, d).select("page_id", "det_id", F.round(c("cx") + c("w"), 6).alias("ex"), F.round("cy", 6).alias("ey"), "w", "h")
    return recover.not_near_known(slots, fx.cells(s, d)).select("page_id", "det_id")


@query(
    """SELECT page_id, line_id, side, k FROM edge_slots t WHERE NOT EXISTS (
  SELECT 1 FROM cells k WHERE k.page_id = t.page_id AND abs(t.ex - k.cx) < 0.7e0*20 AND abs(t.ey - k.cy) < 0.7e0*30)"""
)
def known_cell_anti(s, d):
    slots = layout.edge_slots(fx.lines(s, d)).withColumn("w", F.lit(20.0)).withColumn("h", F.lit(30.0))
    return recover.not_near_known(slots, fx.cells(s, d)).select("page_id", "line_id", "side", "k")


@query(
    """SELECT page_id, det_id FROM cells a WHERE conf < 0.3e0 AND NOT EXISTS (
  SELECT 1 FROM rel b WHERE b.page_id = a.page_id AND round_even(a.cx, 0) = round_even(b.cx, 0) AND round_even(a.cy, 0) = round_even(b.cy, 0))"""
)
def rounded_dedupe(s, d):
    hi, lo = recover.split_by_confidence(fx.cells(s, d))
    return recover.new_by_rounding(lo, hi).select("page_id", "det_id")


@query(_PAIRS + """, ctx AS (SELECT p.page_id, p.hi, p.lo, (a.cy + b.cy)/2 AS mid, greatest(a.h, b.h)*0.55e0 AS band FROM pair p JOIN cells a ON a.page_id = p.page_id AND a.det_id = p.hi JOIN cells b ON b.page_id = p.page_id AND b.det_id = p.lo WHERE iou > 0.15e0)
SELECT x.page_id, hi, lo, count(k.det_id) AS n_row FROM ctx x LEFT JOIN rel k ON k.page_id = x.page_id AND abs(k.cy - mid) < band AND k.det_id NOT IN (hi, lo) GROUP BY ALL""")
def same_row_context(s, d):
    cells = fx.cells(s, d)
    return suppress.row_context(suppress.pairs(cells, 0.15), cells, fx.rel(s, d))


@query(
    """, t AS (SELECT shot_id AS page_id, detector, count(*) FILTER (WHERE conf >= 0.3e0) AS n FROM predicted_cells WHERE detector IS NOT NULL AND shot_id IS NOT NULL GROUP BY ALL)
SELECT page_id, detector, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, detector) AS r FROM t) WHERE r = 1"""
)
def best_variant(s, d):
    n = table(s, d, "predicted_cells").where("detector is not null and shot_id is not null").groupBy(c("shot_id").alias("page_id"), "detector").agg(F.count_if(c("conf") >= 0.3).alias("n"))
    n = n.withColumn("idx", F.rank().over(W.partitionBy("page_id").orderBy("detector")))
    return recover.best_of(n, "page_id", "n", "idx", "detector").select("page_id", "detector", "n")


@query("SELECT page_id, arg_max(det_id, (conf, -det_id)) AS det_id, max(conf) AS conf FROM cells GROUP BY page_id")
def crop_argmax(s, d):
    return recover.best_of(fx.cells(s, d), "page_id", "conf", "det_id", "det_id")


@query("SELECT page_id, det_id FROM rel UNION ALL SELECT page_id, det_id FROM cells WHERE page_id NOT IN (SELECT page_id FROM rel)")
def whole_page_fallback(s, d):
    return recover.or_else(fx.rel(s, d), fx.cells(s, d)).select("page_id", "det_id")


@query("SELECT page_id, 'high' AS stage, count(*) AS n FROM rel GROUP BY 1 UNION ALL SELECT page_id, 'gap', count(*) FROM gap_slots GROUP BY 1 UNION ALL SELECT page_id, 'edge', count(*) FROM edge_slots GROUP BY 1")
def stage_union(s, d):
    lines = fx.lines(s, d)
    part = lambda df, n: df.select("page_id", F.lit(n).alias("stage"))
    rows = part(lines, "high").unionByName(part(layout.gap_slots(lines), "gap")).unionByName(part(layout.edge_slots(lines), "edge"))
    return rows.groupBy("page_id", "stage").agg(F.count(F.lit(1)).alias("n"))


@query(
    """, boxes AS (SELECT page_id, k, x0 + k*(x1 - x0)/4 AS bx0, y0 AS by0, x0 + (k + 1)*(x1 - x0)/4 AS bx1, (y0 + y1)/2 AS by1 FROM (
  SELECT page_id, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM cells GROUP BY page_id), range(4) t(k))
SELECT page_id, k FROM boxes b WHERE EXISTS (SELECT 1 FROM cells c WHERE c.page_id = b.page_id AND cx BETWEEN bx0 AND bx1 AND cy BETWEEN by0 AND by1)"""
)
def container_semi(s, d):
    ext = fx.cells(s, d).groupBy("page_id").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    w = c("x1") - c("x0")
    boxes = ext.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).select(
        "page_id", "k", (c("x0") + c("k") * w / 4).alias("bx0"), c("y0").alias("by0"), (c("x0") + (c("k") + 1) * w / 4).alias("bx1"), ((c("y0") + c("y1")) / 2).alias("by1")
    )
    return suppress.containers_with_cells(boxes, fx.cells(s, d)).select("page_id", "k")


# Contours: a page's annotated cells as candidate boxes ----------------------

_CONTOUR = """, ct AS (SELECT page_id, cell_idx, (r - l)*img_w AS w, (b - t)*img_h AS h, img_w*img_h AS whole, (r - l)*img_w*(b - t)*img_h*0.8e0 AS area, 2*((r - l)*img_w + (b - t)*img_h) AS perimeter FROM gt),
sc AS (SELECT *, CASE WHEN w*h > 0 THEN area/(w*h) ELSE 0 END AS rect, CASE WHEN perimeter > 0 THEN 4*pi()*area/(perimeter*perimeter) ELSE 0 END AS circ FROM ct)
"""


def _contours(s, d):
    b = c("frac_bbox")
    w, h = (b["r"] - b["l"]) * c("img_w"), (b["b"] - b["t"]) * c("img_h")
    return fx.boxes(s, d).select("page_id", "cell_idx", (c("img_w") * c("img_h")).alias("whole"), w.alias("w"), h.alias("h"), ((b["r"] - b["l"]) * c("img_w") * (b["b"] - b["t"]) * c("img_h") * 0.8).alias("area"), (2 * (w + h)).alias("perimeter"))


@query(_CONTOUR + "SELECT page_id, cell_idx, round(rect, 6) AS rectangularity, round(circ, 6) AS circularity FROM sc")
def shape_scores(s, d):
    k = _contours(s, d)
    return k.select("page_id", "cell_idx", *geom.shape_scores(c("area"), c("perimeter"), c("w"), c("h"))).select("page_id", "cell_idx", *r6("rectangularity", "circularity"))


@query(_CONTOUR + "SELECT page_id, cell_idx FROM sc WHERE area/whole BETWEEN 0.005e0 AND 0.95e0 AND greatest(rect, circ) >= 0.6e0")
def contour_filter(s, d):
    return suppress.fair_contours(_contours(s, d)).select("page_id", "cell_idx")


@query(_CONTOUR + "SELECT page_id, cell_idx FROM sc WHERE w >= 20 AND h >= 20")
def container_side(s, d):
    k = _contours(s, d).select("page_id", "cell_idx", F.lit(0.0).alias("bx0"), F.lit(0.0).alias("by0"), c("w").alias("bx1"), c("h").alias("by1"))
    return suppress.large_enough(k).select("page_id", "cell_idx")


_CANDIDATES = """, cand AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY cell_idx, l, t, r, b, coalesce(bits6, ''), coalesce(label, -1)) AS det_id,
    (r - l)*img_w*(b - t)*img_h AS conf, l*img_w AS x0, t*img_h AS y0, r*img_w AS x1, b*img_h AS y1 FROM gt)"""


@query(_CANDIDATES + _nms_sql(0.7, frm="cand"))
def container_dedupe(s, d):
    b = c("frac_bbox")
    cand = fx.numbered(fx.boxes(s, d)).select(
        "page_id", c("n").alias("det_id"), *geom.frac_to_centre("frac_bbox", c("img_w"), c("img_h")), ((b["r"] - b["l"]) * c("img_w") * (b["b"] - b["t"]) * c("img_h")).alias("conf")
    )
    return suppress.nms(cand, 0.7).select("page_id", "det_id")


_LETTERBOX = _BOX.replace("SELECT page_id, round(scale, 6) AS scale", "SELECT page_id, scale")


@query(
    f""", anchors AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY det_id) - 1 AS anchor, cx, cy, w, h, conf, x0, y0, x1, y1 FROM box),
sure AS (SELECT * FROM anchors WHERE conf >= 0.15e0){_fold_sql(0.7, "sure", "anchor")}{_LETTERBOX.replace("SELECT page_id, scale", ", lb AS (SELECT page_id, scale", 1)}),
top AS (SELECT page_id, id AS anchor FROM survivors QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, id) <= 300)
SELECT a.page_id, anchor AS det_id, (cx - pad_left)/scale AS cx, (cy - pad_top)/scale AS cy, w/scale AS w, h/scale AS h, conf
FROM anchors a JOIN top USING (page_id, anchor) JOIN (SELECT DISTINCT shot_id, page_id AS img FROM predicted_cells) s ON s.shot_id = a.page_id JOIN lb ON lb.page_id = s.img"""
)
def detector_decode(s, d):
    # a photograph's cells as the tensor of its letterboxed page image
    rows = F.array_sort(F.collect_list(F.struct("det_id", *detector.ROWS)))
    tensor = fx.cells(s, d).groupBy("page_id").agg(rows.alias("_r")).select("page_id", F.array(*[c(f"_r.{k}") for k in detector.ROWS]).alias("tensor"))
    size = table(s, d, "page_images").select(c("page_id").alias("img"), *geom.letterbox(c("img_w"), c("img_h")))
    shot = fx.shots(s, d).select(c("shot_id").alias("page_id"), c("page_id").alias("img"))
    return detector.decode(tensor.join(shot, "page_id").join(size, "img"), least=0.15)


# Order and choice ----------------------------------------------------------


@query("SELECT page_id, det_id, row_number() OVER (PARTITION BY page_id ORDER BY cy, det_id) AS by_y, row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, det_id) AS by_conf FROM cells")
def stable_orders(s, d):
    p = W.partitionBy("page_id")
    rn = lambda *o: F.row_number().over(p.orderBy(*o)).cast("long")
    return fx.cells(s, d).select("page_id", "det_id", rn("cy", "det_id").alias("by_y"), rn(c("conf").desc(), c("det_id")).alias("by_conf"))


@query("SELECT page_id, det_id, conf FROM cells QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, det_id) <= 3")
def top3_conf(s, d):
    o = W.partitionBy("page_id").orderBy(c("conf").desc(), "det_id")
    return fx.cells(s, d).withColumn("r", F.row_number().over(o)).where("r <= 3").select("page_id", "det_id", "conf")


@query("SELECT page_id, line_id, arg_max(det_id, (conf, -det_id)) AS det_id FROM lines GROUP BY page_id, line_id")
def best_candidate(s, d):
    return fx.lines(s, d).groupBy("page_id", "line_id").agg(F.max_by("det_id", F.struct("conf", (-c("det_id")).alias("o"))).alias("det_id"))


@query("SELECT page_id, path, row_number() OVER (ORDER BY path, page_id) - 1 AS n FROM page_images WHERE path IS NOT NULL QUALIFY n >= 3 AND n < 12", pre=False)
def page_slice(s, d):
    # a slice of the sorted list of images: the feature itself is a limit
    return evalm.image_range(table(s, d, "page_images").where("path is not null").select("page_id", "path"), 3, 12, ("path", "page_id"))


@query("SELECT page_id, path, row_number() OVER (ORDER BY path, page_id) - 1 AS n FROM page_images WHERE path IS NOT NULL QUALIFY n >= 20", pre=False)
def page_slice_open(s, d):
    return evalm.image_range(table(s, d, "page_images").where("path is not null").select("page_id", "path"), 20, None, ("path", "page_id"))


# Evaluation ----------------------------------------------------------------

_MATCH = """, lim AS (SELECT page_id, avg(w)*0.5e0 AS lim FROM truth GROUP BY page_id),
near AS (
  SELECT p.page_id, p.det_id, list(g.det_id ORDER BY sqrt((g.cx - p.cx)*(g.cx - p.cx) + (g.cy - p.cy)*(g.cy - p.cy)), g.det_id) AS ids
  FROM cells p JOIN lim l USING (page_id) JOIN truth g ON g.page_id = p.page_id AND sqrt((g.cx - p.cx)*(g.cx - p.cx) + (g.cy - p.cy)*(g.cy - p.cy)) < l.lim
  GROUP BY p.page_id, p.det_id),
mfold AS (
  SELECT page_id, list_reduce(list([{'n': det_id, 'id': CAST(NULL AS BIGINT), 'ids': ids}] ORDER BY det_id),
    lambda s, e: list_concat(s, [{'n': e[1].n, 'id': list_filter(e[1].ids, lambda x: NOT coalesce(list_contains(list_transform(s, lambda y: y.id), x), false))[1], 'ids': CAST([] AS BIGINT[])}]),
    CAST([] AS STRUCT(n BIGINT, id BIGINT, ids BIGINT[])[])) AS got FROM near GROUP BY page_id),
matches AS (SELECT page_id, n AS pred_id, id AS gt_id FROM (SELECT page_id, unnest(got, recursive := true) FROM mfold) WHERE id IS NOT NULL),
counts AS (
  SELECT page_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(class_ok, 0) AS class_ok
  FROM (SELECT page_id, count(*) AS n_gt FROM truth GROUP BY 1) FULL JOIN (SELECT page_id, count(*) AS n_pred FROM cells GROUP BY 1) USING (page_id)
  LEFT JOIN (SELECT m.page_id, count(*) AS tp, count(*) FILTER (WHERE p.bits = g.bits) AS class_ok FROM matches m JOIN cells p ON p.page_id = m.page_id AND p.det_id = m.pred_id
    JOIN truth g ON g.page_id = m.page_id AND g.det_id = m.gt_id GROUP BY 1) USING (page_id)),
total AS (SELECT CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(class_ok) AS BIGINT) AS class_ok FROM counts)
"""


def _scores_sql(frm: str, keys: str = "") -> str:
    return f"""SELECT {keys}n_gt, n_pred, tp, class_ok, round(p, 6) AS prec, round(r, 6) AS rec, round(CASE WHEN p + r = 0 THEN 0 ELSE 2*p*r/(p + r) END, 6) AS f1, round(ca, 6) AS ca FROM (
  SELECT *, CASE WHEN n_pred = 0 THEN 0 ELSE tp/n_pred END AS p, CASE WHEN n_gt = 0 THEN 0 ELSE tp/n_gt END AS r, CASE WHEN tp = 0 THEN 0 ELSE class_ok/tp END AS ca FROM {frm})"""


def _counts(s, d):
    pred, gt = fx.cells(s, d), fx.truth(s, d)
    return evalm.page_counts(pred, gt, evalm.match_cells(pred, gt))


@query(_MATCH + "SELECT page_id, pred_id, gt_id FROM matches")
def match_cells(s, d):
    return evalm.match_cells(fx.cells(s, d), fx.truth(s, d))


@query(_MATCH + _scores_sql("counts", "page_id, "))
def page_metrics(s, d):
    return evalm.page_metrics(_counts(s, d))


@query(_MATCH + _scores_sql("total"))
def micro_metrics(s, d):
    return evalm.micro_metrics(_counts(s, d))


@query(_MATCH + "SELECT printf('shot%d,%d,%d,%d,%d', page_id, n_gt, n_pred, tp, class_ok) AS line FROM counts")
def eval_csv_rows(s, d):
    return _counts(s, d).select(F.concat_ws(",", F.concat(F.lit("shot"), c("page_id")), "n_gt", "n_pred", "tp", "class_ok").alias("line"))


@query(
    _MATCH + ", rep AS (" + _scores_sql("counts", "page_id, ") + """) SELECT page_id, printf('shot%d gt=%d pred=%d tp=%d prec=%.2f rec=%.2f f1=%.2f cls=%.2f', page_id, n_gt, n_pred, tp,
  floor(prec*100)/100, floor(rec*100)/100, floor(f1*100)/100, floor(ca*100)/100) AS line FROM rep"""
)
def eval_report(s, d):
    m = evalm.page_metrics(_counts(s, d))
    return m.select("page_id", evalm.report_line(m, F.format_string("shot%d", "page_id")).alias("line"))


@query(
    _MATCH + ", rep AS (" + _scores_sql("total") + """) SELECT CAST(0 AS INT) AS line_no, printf('AGGREGATE gt=%d pred=%d tp=%d', n_gt, n_pred, tp) AS line FROM rep
UNION ALL SELECT 1, printf('Precision : %.3f', floor(prec*1000)/1000) FROM rep UNION ALL SELECT 2, printf('Recall    : %.3f', floor(rec*1000)/1000) FROM rep
UNION ALL SELECT 3, printf('F1        : %.3f', floor(f1*1000)/1000) FROM rep UNION ALL SELECT 4, printf('Class acc : %.3f', floor(ca*1000)/1000) FROM rep"""
)
def eval_aggregate(s, d):
    return evalm.aggregate_lines(_counts(s, d))


@query(_MATCH + "SELECT page_id, det_id, ids[1] AS nearest FROM near")
def nearest_gt(s, d):
    return evalm.nearest_truth(fx.cells(s, d), fx.truth(s, d))


@query(
    """, p AS (SELECT a.page_id, a.cell_idx, a.bits6 AS truth, b.bits AS pred FROM (SELECT page_id, cell_idx, min(bits6) AS bits6 FROM gt_cells WHERE bits6 IS NOT NULL AND page_id IS NOT NULL GROUP BY 1, 2) a
  JOIN (SELECT page_id, cell_idx, min(bits6) AS bits FROM crops GROUP BY 1, 2) b USING (page_id, cell_idx))
SELECT page_id, count(*) AS n, count(*) FILTER (WHERE truth = pred) AS n_equal, round(avg(CASE WHEN truth = pred THEN 1 ELSE 0 END), 6) AS share FROM p GROUP BY page_id"""
)
def label_quality_metrics(s, d):
    gt = table(s, d, "gt_cells").where("bits6 is not null and page_id is not null").groupBy("page_id", "cell_idx").agg(F.min("bits6").alias("truth"))
    p = gt.join(fx.crops(s, d).groupBy("page_id", "cell_idx").agg(F.min("bits6").alias("pred")), ["page_id", "cell_idx"])
    ok = c("truth") == c("pred")
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_equal"), F.round(F.avg(ok.cast("int")), 6).alias("share"))


# Training sets and sinks ---------------------------------------------------


_ALL = "(SELECT DISTINCT crop_id, page_id, cell_idx, split, path, bits6, label_int FROM manifest)"


@query(f"SELECT split, path, bits6, label_int FROM {_ALL}", pre=False)
def manifest(s, d):
    return fx.all_crops(s, d).select("split", "path", "bits6", "label_int")


@query(f"SELECT split, path, label_int FROM {_ALL} WHERE split = 'train'", pre=False)
def manifest_scan(s, d):
    return fx.all_crops(s, d).where("split = 'train'").select("split", "path", "label_int")


@query(f"SELECT split, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM {_ALL} GROUP BY split", pre=False)
def split_counts(s, d):
    return fx.all_crops(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query(
    f"""SELECT crop_id, false AS flip, bits6, label_int FROM crops WHERE split = 'train'
UNION ALL SELECT crop_id, true, substr(bits6, 4, 3) || substr(bits6, 1, 3), {label_sql("(substr(bits6, 4, 3) || substr(bits6, 1, 3))")} FROM crops WHERE split = 'train'"""
)
def flip_union(s, d):
    return dataset.with_flips(fx.crops(s, d).where("split = 'train'").select("crop_id", "bits6", "label_int"))


@query("SELECT CAST(i AS INT) AS cls, reverse(lpad(bin(i), 6, '0')) AS name FROM range(64) t(i)", pre=False)
def class_names(s, d):
    return dataset.class_names(s)


_SPLIT = dataset.seeded_split(["angelina", "braille_natural", "dsbi", "field_notes", "press_archive", "school_sheets", "synth_render"])


@query(f"SELECT source, split FROM piece_limits JOIN (VALUES {', '.join(map(str, _SPLIT.items()))}) v(source, split) USING (source)", pre=False)
def split_permutation(s, d):
    found = table(s, d, "piece_limits").select("source")
    return found.join(s.createDataFrame(list(_SPLIT.items()), "source string, split string"), "source")


@query()
def image_splits(s, d):
    # split_permutation only permutes the names of the sources; this permutes the images of each
    return dataset.image_splits(table(s, d, "page_images"))


@query("SELECT path, regexp_replace(replace(path, '/', '_'), '\\.[^.]*$', '') AS stem FROM page_images WHERE path IS NOT NULL", pre=False)
def unique_stem(s, d):
    return table(s, d, "page_images").where("path is not null").select("path", names.flat_stem(c("path")).alias("stem"))


_DOTS6 = "VALUES (1, -0.28e0, -0.35e0), (2, -0.28e0, 0.0e0), (3, -0.28e0, 0.35e0), (4, 0.28e0, -0.35e0), (5, 0.28e0, 0.0e0), (6, 0.28e0, 0.35e0)"


@query(
    f"""SELECT page_id, det_id, dot, CAST(trunc(cx - w/2) AS INT) AS x0, CAST(trunc(cy - h/2) AS INT) AS y0, CAST(trunc(cx + w/2) AS INT) AS x1, CAST(trunc(cy + h/2) AS INT) AS y1,
  CASE WHEN rescued THEN 0 ELSE CAST(trunc(255*(1 - conf)) AS INT) END AS red, CASE WHEN rescued THEN 220 ELSE CAST(trunc(255*conf) AS INT) END AS green, CASE WHEN rescued THEN 220 ELSE 0 END AS blue,
  greatest(2, CAST(trunc(least(w, h)*0.09e0) AS INT)) AS radius, CAST(trunc(cx + dx*w) AS INT) AS dot_x, CAST(trunc(cy + dy*h) AS INT) AS dot_y, substr(bits, dot, 1) = '1' AS filled
FROM cells, ({_DOTS6}) z(dot, dx, dy)"""
)
def overlay_commands(s, d):
    return sinks.overlay_commands(fx.cells(s, d))


@query(
    f"""SELECT page_id, det_id, k + 1 AS dot, CAST(6 + (n % 40)*60 + 4 + (k//3)*22 + 11 AS INT) AS dot_x, CAST(6 + (n//40)*60 + 4 + (k % 3)*13 + 6 AS INT) AS dot_y,
  (CASE WHEN rescued THEN 'rescued' ELSE 'plain' END) || (CASE WHEN substr(bits, CAST(k AS INT) + 1, 1) = '1' THEN ' raised' ELSE ' flat' END) AS state, chr(10240 + {label_sql("bits")}) AS cell_char
FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY det_id) - 1 AS n FROM cells), range(6) t(k)"""
)
def dot_sheet(s, d):
    return sinks.sheet_commands(fx.cells(s, d)).withColumn("dot", c("dot").cast("long"))


@query("SELECT det_id, CASE WHEN rescued THEN 0 ELSE CAST(trunc(255*(1 - conf)) AS INT) END AS red, CASE WHEN rescued THEN 220 ELSE CAST(trunc(255*conf) AS INT) END AS green, CASE WHEN rescued THEN 220 ELSE 0 END AS blue FROM cells")
def conf_rgb(s, d):
    return fx.cells(s, d).select("det_id", *geom.conf_colour(c("conf"), c("rescued")))


@query(
    """SELECT page_id, count(*) AS n_cells, round(sum(cx), 2) AS sum_x, string_agg(bits, '' ORDER BY det_id) AS bits FROM cells GROUP BY page_id"""
)
def cells_to_json(s, d):
    back = sinks.cells_json(fx.cells(s, d)).withColumn("c", F.from_json("json", "cells array<struct<cx double, cy double, w double, h double, bits string>>")["cells"])
    total = F.aggregate("c", F.lit(0.0), lambda a, z: a + z["cx"])
    return back.select("page_id", F.size("c").cast("long").alias("n_cells"), F.round(total, 2).alias("sum_x"), F.array_join(F.transform("c", lambda z: z["bits"]), "").alias("bits"))


# Annotation formats --------------------------------------------------------

_NUM = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


@query(
    rf""", f AS (SELECT raw_id, list_transform(string_split(regexp_replace(raw_line, '\r$', ''), ';'), lambda x: trim(x)) AS f FROM raw_annotations WHERE fmt = 'cell_csv')
SELECT raw_id, CAST(f[1] AS DOUBLE) AS l, CAST(f[2] AS DOUBLE) AS t, CAST(f[3] AS DOUBLE) AS r, CAST(f[4] AS DOUBLE) AS b, CAST(f[5] AS INT) AS label FROM f
WHERE len(f) >= 5 AND regexp_full_match(f[1], '{_NUM}') AND regexp_full_match(f[2], '{_NUM}') AND regexp_full_match(f[3], '{_NUM}') AND regexp_full_match(f[4], '{_NUM}') AND regexp_full_match(f[5], '[0-9]+')"""
)
def annotation_csv_parse(s, d):
    f = F.split(F.regexp_replace("raw_line", r"\r$", ""), ";")
    part = lambda i: F.trim(F.try_element_at(f, F.lit(i)))
    ok = (F.size(f) >= 5) & part(5).rlike("^[0-9]+$")
    for i in range(1, 5):
        ok = ok & part(i).rlike(rf"^{_NUM}$")
    rows = table(s, d, "raw_annotations").where("fmt = 'cell_csv'").where(F.coalesce(ok, F.lit(False)))
    return ann.cell_lines(rows, "raw_line").select("raw_id", "l", "t", "r", "b", "label")


@query(
    r""", w AS (SELECT file_path, line_no, regexp_split_to_array(trim(replace(regexp_replace(raw_line, '\r$', ''), chr(9), ' ')), ' +') AS f FROM raw_annotations WHERE fmt = 'grid_txt'),
hd AS (SELECT a.file_path, list_transform(a.f, lambda x: CAST(x AS DOUBLE)) AS xs, list_transform(b.f, lambda x: CAST(x AS DOUBLE)) AS ys
  FROM (SELECT file_path, any_value(f) AS f FROM w WHERE line_no = 2 GROUP BY 1) a JOIN (SELECT file_path, any_value(f) AS f FROM w WHERE line_no = 3 GROUP BY 1) b USING (file_path)),
k AS (SELECT w.file_path, line_no, CAST(f[1] AS INT) AS row, CAST(f[2] AS INT) AS col, xs, ys FROM w JOIN hd USING (file_path)
  WHERE line_no > 3 AND len(f) >= 8 AND regexp_full_match(f[1], '[0-9]{1,6}') AND regexp_full_match(f[2], '[0-9]{1,6}')),
g AS (SELECT file_path, line_no, xs[2*col - 1] AS x0, xs[2*col] AS x1, ys[3*row - 2] AS y0, ys[3*row] AS y1, xs[len(xs)] + 20 AS iw, ys[len(ys)] + 20 AS ih FROM k WHERE row >= 1 AND col >= 1 AND 2*col <= len(xs) AND 3*row <= len(ys))
SELECT DISTINCT file_path, line_no, round(least(iw, greatest(0, x0 - (x1 - x0)*0.15e0)), 6) AS x0, round(least(ih, greatest(0, y0 - (y1 - y0)*0.15e0)), 6) AS y0,
  round(least(iw, x1 + (x1 - x0)*0.15e0), 6) AS x1, round(least(ih, y1 + (y1 - y0)*0.15e0), 6) AS y1 FROM g"""
)
def dsbi_cells(s, d):
    w = table(s, d, "raw_annotations").where("fmt = 'grid_txt'").select(
        "file_path", "line_no", F.split(F.trim(F.translate(F.regexp_replace("raw_line", r"\r$", ""), "\t", " ")), " +").alias("f")
    )
    head = lambda n, k: F.first(F.when(c("line_no") == n, F.transform("f", lambda x: F.expr("0D") + F.try_to_number(x, F.lit("999999")).cast("double"))), ignorenulls=True).alias(k)
    hd = w.where("line_no in (2, 3)").groupBy("file_path").agg(head(2, "xs"), head(3, "ys"))
    whole = lambda i: F.element_at("f", i).rlike("^[0-9]{1,6}$")
    k = w.where("line_no > 3 and size(f) >= 8").where(whole(1) & whole(2)).join(hd, "file_path")
    k = k.withColumn("row", F.element_at("f", 1).cast("int")).withColumn("col", F.element_at("f", 2).cast("int"))
    b = ann.grid_boxes(c("row"), c("col"), c("xs"), c("ys"), F.element_at("xs", -1) + 20, F.element_at("ys", -1) + 20)
    return k.select("file_path", "line_no", *b).where("x0 is not null").select("file_path", "line_no", *r6("x0", "y0", "x1", "y1")).distinct()


@query("SELECT page_id, cell_idx, round((l*img_w)/img_w, 6) AS l, round((b*img_h)/img_h, 6) AS b FROM gt")
def voc_xml_parse(s, d):
    box = F.col("frac_bbox")
    px = lambda k, n: (box[k] * c(n)).cast("string")
    one = F.concat(
        F.lit("<annotation><size><width>"), c("img_w"), F.lit("</width><height>"), c("img_h"), F.lit("</height></size><object><bndbox><xmin>"), px("l", "img_w"),
        F.lit("</xmin><ymin>"), px("t", "img_h"), F.lit("</ymin><xmax>"), px("r", "img_w"), F.lit("</xmax><ymax>"), px("b", "img_h"), F.lit("</ymax></bndbox></object></annotation>"),
    )
    parsed = fx.boxes(s, d).select("page_id", "cell_idx", F.from_xml(one, ann.VOC_SCHEMA).alias("x")).select("page_id", "cell_idx", "x.*")
    return ann.voc_boxes(parsed).select("page_id", "cell_idx", *r6("l", "b"))


@query(r"SELECT page_id, replace(path, '\', '/') AS value FROM page_images WHERE path IS NOT NULL", pre=False)
def page_list_clean(s, d):
    raw = table(s, d, "page_images").where("path is not null").select("page_id", F.concat(F.lit("  "), F.translate("path", "/", "\\"), F.lit(" \r")).alias("value"))
    blank = raw.withColumn("value", F.lit("  \t"))
    return ann.page_list(raw.unionByName(blank))


@query("SELECT page_id FROM page_images p WHERE EXISTS (SELECT 1 FROM gt_cells g WHERE g.page_id = p.page_id)", pre=False)
def image_annotation_pairs(s, d):
    return table(s, d, "page_images").join(table(s, d, "gt_cells").select("page_id"), "page_id", "left_semi").select("page_id")


@query("SELECT page_id, side, regexp_replace(path, '\\.[^./]+$', '') || '+' || side AS path FROM page_images, (VALUES ('recto'), ('verso')) v(side) WHERE source = 'dsbi'", pre=False)
def side_expand(s, d):
    return ann.sides(table(s, d, "page_images").where("source = 'dsbi'").select("page_id", c("path").alias("value"))).select("page_id", "side", "path")


def _by_source(s, d):
    """Annotated cells by each source of the images, as readers of the sources give them."""
    gt, images = table(s, d, "gt_cells"), table(s, d, "page_images")
    names = [r[0] for r in images.select("source").where("source is not null").distinct().orderBy("source").collect()]  # as many as there are readers
    return {k: gt.where(c("source") == k).drop("source") for k in names}


@query("SELECT source, count(*) AS n FROM gt_cells WHERE source IS NOT NULL GROUP BY source", pre=False)
def source_union(s, d):
    return ann.union_sources(_by_source(s, d), single_class=True).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, count(*) AS n FROM gt_cells WHERE source <> 'braille_natural' GROUP BY source", pre=False)
def source_capability(s, d):
    return ann.union_sources(_by_source(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# Translated text -----------------------------------------------------------

_ABC = translate.alphabet()


@query(f"SELECT doc_id, translate(text, '{''.join(_ABC)}', '{''.join(_ABC.values())}') AS text FROM documents WHERE doc_kind = 'cell_text' AND text IS NOT NULL", pre=False)
def back_translate(s, d):
    return table(s, d, "documents").where("doc_kind = 'cell_text' and text is not null").select("doc_id", translate.back_translate(c("text")).alias("text"))


@query(r"SELECT doc_id, regexp_replace('\456/' || text || '\3456/', '\\(\d+)/', '', 'g') AS text FROM documents WHERE text IS NOT NULL", pre=False)
def orphan_strip(s, d):
    t = F.concat(F.lit("\\456/"), c("text"), F.lit("\\3456/"))
    return table(s, d, "documents").where("text is not null").select("doc_id", translate.clean(t).alias("text"))


@query("SELECT doc_id, substr(text, 1, 800) AS text FROM documents WHERE text IS NOT NULL", pre=False)
def truncate_text(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", names.cut(c("text")).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(replace(text, chr(10240), ' '), '^\\s+|\\s+$', '', 'g')) AS text FROM documents WHERE doc_kind = 'cell_text' AND text IS NOT NULL", pre=False)
def blank_to_space(s, d):
    return table(s, d, "documents").where("doc_kind = 'cell_text' and text is not null").select("doc_id", encode.blank_to_space(c("text")).alias("text"))


# Whole runs of letters, digits and _ that are six or more small ASCII letters:
# what the look-arounds of the pattern say, which this dialect lacks.
_WORDS = r"""WITH d AS (SELECT text FROM documents WHERE text IS NOT NULL AND (lang IS NULL OR regexp_full_match(lower(regexp_replace(lang, '^\s+|\s+$', '', 'g')), '(en([-_].*)?)?'))),
w AS (SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM d) WHERE regexp_full_match(word, '[a-z]{6,}') GROUP BY word)
"""
_KNOWN = f""", f AS (SELECT freq, count(*)*freq AS n FROM w GROUP BY freq),
least AS (SELECT min(freq) AS least FROM (SELECT freq, coalesce(sum(n) OVER (ORDER BY freq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above, sum(n) OVER () AS total FROM f) WHERE above < total*{translate.COVERED}e0),
domain(word) AS (VALUES {", ".join(f"('{x}')" for x in translate.DOMAIN)}),
known AS (SELECT word, max(freq) AS freq FROM (SELECT word, freq FROM w, least WHERE freq >= least UNION ALL SELECT word, freq FROM w WHERE word IN (SELECT word FROM domain) UNION ALL SELECT word, 0 FROM domain) GROUP BY word),
unknown AS (SELECT word FROM w WHERE word NOT IN (SELECT word FROM known) UNION SELECT substr(word, 2) || 'x' FROM w WHERE substr(word, 2) || 'x' NOT IN (SELECT word FROM known))
"""


def _words(s, d):
    docs = table(s, d, "documents").where("text is not null").where(names.english(c("lang")))
    return docs.select(F.explode(names.whole_candidates(c("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _misspelt(w):
    # the words, and each with its first letter lost and one too many at its end
    return w.select("word").union(w.select(F.concat(F.expr("substring(word, 2)"), F.lit("x")))).distinct()


@query(_WORDS + "SELECT word, freq FROM w", pre=False)
def spell_candidates(s, d):
    return _words(s, d)


@query(_WORDS + _KNOWN + "SELECT word FROM unknown", pre=False)
def word_lookup(s, d):
    w = staged(_words(s, d), "words")
    return translate.unknown_words(_misspelt(w), translate.dictionary(w))


@query(
    _WORDS + _KNOWN
    + """, m AS (SELECT u.word, k.word AS correction, freq, levenshtein(u.word, k.word) AS n FROM unknown u JOIN known k ON abs(length(u.word) - length(k.word)) <= 2)
SELECT word, arg_min(correction, (n, -freq, correction)) AS correction FROM m WHERE n <= 2 GROUP BY word""",
    pre=False,
)
def spell_correct(s, d):
    w = staged(_words(s, d), "words")
    known = staged(translate.dictionary(w), "dictionary")
    return translate.corrections(translate.unknown_words(_misspelt(w), known), known)


# Pixels --------------------------------------------------------------------


@query("SELECT vec_id, CAST(dot AS INT) AS dot, round(strength, 4) AS strength FROM signal")
def dot_strength(s, d):
    return kernels.dot_signals(fx.patches(s, d), "vec_id").withColumn("strength", F.round("strength", 4))


@query("SELECT vec_id, round(lo, 4) AS paper_low, round(hi, 4) AS paper_high FROM paper")
def paper_levels(s, d):
    return kernels.pixel_levels(fx.patches(s, d), "vec_id").select("vec_id", *r6("paper_low", "paper_high", digits=4))


@query(
    """SELECT label, round(coalesce(greatest(quantile_cont(strength, 0.25) FILTER (WHERE (label >> (dot - 1)) & 1 = 1), 5), 20), 4) AS threshold FROM signal GROUP BY label"""
)
def calibrate_threshold(s, d):
    p = fx.patches(s, d)
    sig = kernels.dot_signals(p, "vec_id").join(p.select("vec_id", "label"), "vec_id").withColumn("present", F.expr("(shiftright(label, dot - 1) & 1) = 1"))
    return kernels.dot_threshold(sig, "label").withColumn("threshold", F.round("threshold", 4))


@query("SELECT vec_id, count(*) FILTER (WHERE strength > 150) >= 2 AS present FROM signal GROUP BY vec_id")
def cell_present(s, d):
    return kernels.present_cells(kernels.dot_signals(fx.patches(s, d), "vec_id"), "vec_id", 150)


@query("SELECT vec_id, round(sum(strength), 3) AS total, round(max(strength), 3) AS peak FROM signal GROUP BY vec_id")
def snap_sum_max(s, d):
    return kernels.dot_signals(fx.patches(s, d), "vec_id").groupBy("vec_id").agg(F.round(F.sum("strength"), 3).alias("total"), F.round(F.max("strength"), 3).alias("peak"))


@query(
    """, off AS (SELECT dx, dy, row_number() OVER (ORDER BY dy, dx) AS n FROM (SELECT unnest(range(-6, 7, 2)) AS dx), (SELECT unnest(range(-4, 5, 2)) AS dy)),
level AS (SELECT vec_id, n, any_value(dx) AS dx, any_value(dy) AS dy, quantile_cont(v, 0.25) AS lo, quantile_cont(v, 0.75) AS hi FROM px, off
  WHERE x >= greatest(0, dx) AND x < least(32, 32 + dx) AND y >= greatest(0, dy) AND y < least(32, 32 + dy) GROUP BY vec_id, n),
spot AS (SELECT off.n, d.dot, d.dx + off.dx AS x, d.dy + off.dy AS y FROM off, dots d),
mark AS (SELECT p.vec_id, s.n, s.dot, avg(v) AS m, max(v) - min(v) AS s FROM spot s JOIN px p ON p.x >= s.x - 4 AND p.x < s.x + 4 AND p.y >= s.y - 4 AND p.y < s.y + 4
  WHERE s.x >= 4 AND s.x < 28 AND s.y >= 4 AND s.y < 28 GROUP BY ALL),
score AS (SELECT l.vec_id, l.n, any_value(dx) AS dx, any_value(dy) AS dy, coalesce(sum(greatest(m - lo, hi - m, s)), 0) AS total, coalesce(max(greatest(m - lo, hi - m, s)), 0) AS peak
  FROM level l LEFT JOIN mark k ON k.vec_id = l.vec_id AND k.n = l.n GROUP BY l.vec_id, l.n)
SELECT vec_id, CAST(16 + dx AS DOUBLE) AS sx, CAST(16 + dy AS DOUBLE) AS sy, round(total, 4) AS total, round(peak, 4) AS peak FROM score QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY total DESC, n) = 1"""
)
def snap_peak(s, d):
    return kernels.snapped(fx.patches(s, d), "vec_id").select("vec_id", "sx", "sy", *r6("total", "peak", digits=4))


@query(
    """, o AS (SELECT CAST(i AS INT) AS o, least(greatest((i + 0.5e0)*(32/20.0e0) - 0.5e0, 0), 31) AS pos FROM range(20) t(i)),
ax AS (SELECT o, CAST(floor(pos) AS INT) AS a, least(CAST(floor(pos) AS INT) + 1, 31) AS b, pos - floor(pos) AS f FROM o),
im AS (SELECT vec_id, list_transform(range(1024), lambda i: floor((CAST(embedding[((i//32)//4)*8 + (i%32)//4 + 1] + 1 AS DOUBLE))*127.5e0)) AS v FROM embeddings)
SELECT vec_id, y.o AS y, x.o AS x, round((v[y.a*32 + x.a + 1] + (v[y.a*32 + x.b + 1] - v[y.a*32 + x.a + 1])*x.f)
  + ((v[y.b*32 + x.a + 1] + (v[y.b*32 + x.b + 1] - v[y.b*32 + x.a + 1])*x.f) - (v[y.a*32 + x.a + 1] + (v[y.a*32 + x.b + 1] - v[y.a*32 + x.a + 1])*x.f))*y.f, 4) AS value
FROM im, ax y, ax x"""
)
def bilinear_resize(s, d):
    return kernels.resized(fx.patches(s, d), "vec_id", 20, 20).withColumn("value", F.round("value", 4))


@query(
    """, m AS (SELECT vec_id, floor(avg(v) + 0.5e0) AS m FROM px GROUP BY vec_id)
SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(least(255, greatest(0, m + (v - m)*1.4e0)), 6) AS value FROM px JOIN m USING (vec_id)"""
)
def contrast_patch(s, d):
    return kernels.contrasted(fx.patches(s, d), "vec_id", 1.4).withColumn("value", F.round("value", 6))


@query(
    """SELECT vec_id, CAST(c AS INT) AS channel, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round((v/255 - mean)/dev, 6) AS value
FROM px, (VALUES (0, 0.485e0, 0.229e0), (1, 0.456e0, 0.224e0), (2, 0.406e0, 0.225e0)) z(c, mean, dev)"""
)
def chw_norm(s, d):
    return kernels.normalised(fx.patches(s, d), "vec_id").withColumn("value", F.round("value", 6))
