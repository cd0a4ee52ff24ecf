"""Queries of the llm problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotframe.llm import leakage, mixing, mojibake, pieces, representative, sample, splits, tokenize
from dotframe.session import staged
from dotframe.sources.tables import table

def _crops(spark: SparkSession, sf: str) -> DataFrame:
    crops = sample.distinct_crops(table(spark, sf, "manifest"), "bits6", "label_int")
    return staged(crops.select("crop_id", sample.pattern_column().alias("label_int")).where("label_int is not null"), "crops")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return sample.report(_crops(spark, sf), {"label_int": table(spark, sf, "sample_targets")}, "label_int")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_report(spark, sf).where("named and not met").select("label_int")


def p1_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sample.draw(_crops(spark, sf), {"label_int": table(spark, sf, "sample_targets")})


def p1_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """One sample after two sets of targets: shares of patterns and of sources."""
    crops = mixing.sized_crops(table(spark, sf, "manifest"), table(spark, sf, "page_images"), "bits6", "label_int")
    crops = crops.select("crop_id", sample.pattern_column().alias("label_int"), "source").where("label_int is not null and source is not null")
    shares = table(spark, sf, "mix_targets").select(mixing.norm_source("source").alias("source"), (100 * F.col("target_pct")).alias("target_bp"), F.lit(0).alias("min_rows"))
    return sample.reports(crops, {"label_int": table(spark, sf, "sample_targets"), "source": shares})


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.sized_crops(table(spark, sf, "manifest"), table(spark, sf, "page_images"))


def p4_shares(spark: SparkSession, sf: str) -> DataFrame:
    crops, targets = _sized(spark, sf), table(spark, sf, "mix_targets")
    return mixing.shares(crops, targets, mixing.placements(crops, targets, mixing.PRODUCTION_CURRICULUM))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_shares(spark, sf).where("short").select("source")


def p4_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.ordered(mixing.mix(_sized(spark, sf), table(spark, sf, "mix_targets"), mixing.PRODUCTION_CURRICULUM))


def p2_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return splits.page_links(table(spark, sf, "manifest"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.least("train_page", "eval_page"), F.greatest("train_page", "eval_page")
    return splits.overlaps(table(spark, sf, "manifest")).select(a.alias("page_id_a"), b.alias("page_id_b")).distinct()


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return splits.overlap_report(table(spark, sf, "manifest"), p2_overlaps(spark, sf))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.pieces(*(table(spark, sf, t) for t in ("gt_cells", "page_images", "piece_limits")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _pieces(spark, sf).where("piece_no = 0 and n_pieces > 1").select("page_id")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.named_pieces(_pieces(spark, sf), table(spark, sf, "manifest"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return representative.pairs(table(spark, sf, "predicted_cells"))


def p6_best(spark: SparkSession, sf: str) -> DataFrame:
    return representative.representatives(table(spark, sf, "predicted_cells"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize.token_ids(table(spark, sf, "documents").select("doc_id", "text"))


def p7_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Per document its numbers of tokens and bytes, and whether decoding
    gives the text back."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    tokens = staged(tokenize.encoded(docs), "tokens")
    back = tokenize.decoded(tokens).select("doc_id", F.col("text").alias("back"))
    text = F.coalesce("text", F.lit(""))
    return docs.join(back, "doc_id").join(tokens.select("doc_id", F.size("ids").alias("n_tokens")), "doc_id").select(
        "doc_id", "n_tokens", F.octet_length(text).alias("n_bytes"), F.coalesce(text == F.col("back"), F.lit(False)).alias("same")
    )


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).where(F.col("longest_run") >= leakage.RUN).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tokens = staged(mojibake.document_tokens(docs), "tokens")
    return mojibake.affected(docs, mojibake.substitutions(docs, tokens), tokens).select("doc_id")


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tokens = staged(mojibake.document_tokens(docs), "tokens")
    return mojibake.restored(docs, mojibake.substitutions(docs, tokens), tokens)


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_sample, p1_by_source, p4_found, p4_shares, p4_mix, p2_found, p2_overlaps, p2_report, p3_found, p3_pieces, p6_found, p6_best, p7_ids, p7_roundtrip, p8_found, p8_leaks, p9_found, p9_restored)}

_PATTERN = """
  SELECT crop_id, CASE WHEN b IS NULL THEN l WHEN l IS NULL OR l = b THEN b END AS pattern FROM (
    SELECT crop_id,
      CASE WHEN regexp_full_match(bits6, '[01]{6}') AND bits6 <> '000000' THEN
        (ascii(bits6[1])-48) + 2*(ascii(bits6[2])-48) + 4*(ascii(bits6[3])-48)
        + 8*(ascii(bits6[4])-48) + 16*(ascii(bits6[5])-48) + 32*(ascii(bits6[6])-48) END AS b,
      CASE WHEN label_int BETWEEN 1 AND 63 THEN label_int END AS l
    FROM (SELECT DISTINCT crop_id, bits6, label_int FROM manifest))
"""


# Written out apart from splits.py, so that a fault there shows.
_NAME = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(replace(lower(path), '\', '/'), '%[0-9a-f][0-9a-f]', ' ', 'g'),
    '^.*/(train|val|test)/', ''), '_[0-9]+\.(jpg|jpeg|jpe|png|tif|tiff|bmp|gif|webp)\s*$', ''),
    '(\.(jpg|jpeg|jpe|png|tif|tiff|bmp|gif|webp|labeled))+($|[^a-z0-9])', '\3', 'g'),
    '[ _-]*\(\s*([0-9]+|copy( *[0-9]+)?)\s*\)', '', 'g'), '^copy( [0-9]+)? of[^a-z0-9]+', ''),
    '[^a-z0-9]+(copy|duplicate)([^a-z0-9]*[0-9]+)?\s*$', ''), '0*([0-9]+)', '|\1|', 'g'), '[^a-z0-9|]+', '', 'g')"""

_P2_DIRECTED = f"""
WITH pt AS ({_PATTERN}), m AS (SELECT DISTINCT crop_id, page_id, cell_idx, split, path, bits6, label_int, source FROM manifest WHERE page_id IS NOT NULL),
pg AS (
  SELECT page_id, bool_or(split = 'train') AS tr, bool_or(split IN ('val', 'test')) AS ev, bool_and(bits6 IS NULL AND label_int IS NULL) AS bare, min(path) AS path, min(lower(trim(source))) AS source,
    string_agg(chr(CAST(pattern AS INT) + 63), '' ORDER BY cell_idx, crop_id) FILTER (WHERE pattern IS NOT NULL) AS seq
  FROM m JOIN pt USING (crop_id) GROUP BY page_id),
nm AS (SELECT page_id, tr, ev, {_NAME} AS name FROM pg WHERE bare),
directed AS (
  SELECT t.page_id AS t_page, e.page_id AS e_page FROM pg t JOIN pg e
    ON t.tr AND e.ev AND t.page_id <> e.page_id AND abs(length(t.seq) - length(e.seq)) <= greatest(length(t.seq), length(e.seq)) // 10
  WHERE levenshtein(t.seq, e.seq) <= greatest(length(t.seq), length(e.seq)) // 10
  UNION SELECT t.page_id, e.page_id FROM nm t JOIN nm e ON t.tr AND e.ev AND t.page_id <> e.page_id AND t.name = e.name AND t.name <> '')
"""
_P2_PAIRS = _P2_DIRECTED + "SELECT DISTINCT least(t_page, e_page) AS page_id_a, greatest(t_page, e_page) AS page_id_b FROM directed"


ORACLES = {
    "p2_report": f"""
WITH pairs AS ({_P2_PAIRS}),
pages AS (SELECT page_id, split, min(lower(trim(source))) AS source FROM manifest WHERE page_id IS NOT NULL GROUP BY page_id, split),
hit AS (SELECT DISTINCT page_id FROM (SELECT page_id_a AS page_id FROM pairs UNION ALL SELECT page_id_b FROM pairs))
SELECT split, source, count(*) AS n_pages, count(hit.page_id) AS n_overlapping FROM pages LEFT JOIN hit USING (page_id) GROUP BY split, source
""",
    "p6_best": """
WITH RECURSIVE r AS (SELECT * FROM predicted_cells WHERE det_id IS NOT NULL AND shot_id IS NOT NULL AND pred_id IS NOT NULL),
e AS (SELECT a.pred_id AS a, b.pred_id AS b FROM r a JOIN r b ON a.shot_id = b.shot_id
      WHERE a.det_id = b.det_id OR (abs(a.cx - b.cx) < greatest(a.w, b.w) / 2 AND abs(a.cy - b.cy) < greatest(a.h, b.h) / 2)),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
g AS (SELECT a AS pred_id, min(b) AS cell FROM c GROUP BY a)
SELECT any_value(shot_id) AS shot_id, cell, count(*) AS n_records,
  arg_max(cx, (detected_at, -pred_id)) FILTER (WHERE cx IS NOT NULL) AS cx, arg_max(cy, (detected_at, -pred_id)) FILTER (WHERE cy IS NOT NULL) AS cy,
  arg_max(conf, (detected_at, -pred_id)) FILTER (WHERE conf BETWEEN 0 AND 1) AS conf,
  coalesce(arg_max(bits, (detected_at, -pred_id)) FILTER (WHERE regexp_full_match(bits, '[01]{6}') AND bits <> '000000'), CASE WHEN bool_or(bits = '000000') THEN '000000' END) AS bits
FROM r JOIN g USING (pred_id) GROUP BY cell
""",
    "p2_found": _P2_PAIRS,
    "p2_overlaps": _P2_DIRECTED
    + """
SELECT page_id, CASE WHEN seq IS NOT NULL THEN sha256(seq) ELSE 'name:' || name END AS cls, source, coalesce(pg.tr, false) AS in_train, coalesce(pg.ev, false) AS in_eval,
  coalesce(n_eval, 0) AS n_eval, coalesce(n_train, 0) AS n_train
FROM pg LEFT JOIN (SELECT page_id, name FROM nm WHERE name <> '') USING (page_id)
  LEFT JOIN (SELECT t_page AS page_id, count(*) AS n_eval FROM directed GROUP BY 1) USING (page_id)
  LEFT JOIN (SELECT e_page AS page_id, count(*) AS n_train FROM directed GROUP BY 1) USING (page_id)
WHERE (pg.tr OR pg.ev) AND (seq IS NOT NULL OR name IS NOT NULL)
""",
    "p8_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
""",
    "p3_pieces": r"""
WITH RECURSIVE ok AS (SELECT page_id, frac_bbox.t AS t, frac_bbox.b AS b FROM gt_cells
  WHERE 0 <= frac_bbox.l AND frac_bbox.l < frac_bbox.r AND frac_bbox.r <= 1 AND 0 <= frac_bbox.t AND frac_bbox.t < frac_bbox.b AND frac_bbox.b <= 1 AND page_id IS NOT NULL),
tall AS (SELECT page_id, img_h, max_piece_px AS most, least(overlap_px, max_piece_px - 1) AS overlap, CAST(floor(top*img_h) AS BIGINT) AS y_top, CAST(ceil(bottom*img_h) AS BIGINT) AS y_bottom
  FROM (SELECT page_id, min(t) AS top, max(b) AS bottom FROM ok GROUP BY page_id) JOIN page_images USING (page_id) JOIN piece_limits USING (source) WHERE (bottom - top)*img_h > max_piece_px),
crossed AS (SELECT DISTINCT page_id, unnest(range(CAST(floor(t*img_h) AS BIGINT) + 1, CAST(ceil(b*img_h) AS BIGINT))) AS y FROM ok JOIN tall USING (page_id)),
free AS (SELECT page_id, list(y) AS ys FROM (SELECT page_id, unnest(range(y_top, y_bottom + 1)) AS y FROM tall) a WHERE NOT EXISTS (SELECT 1 FROM crossed c WHERE c.page_id = a.page_id AND c.y = a.y) GROUP BY page_id),
strip AS (SELECT *, coalesce(ys, []) AS fs FROM tall LEFT JOIN free USING (page_id)),
cut AS (
  SELECT page_id, 0 AS piece_no, y_top AS y0 FROM strip
  UNION ALL
  SELECT page_id, piece_no + 1, CASE WHEN f > y0 + overlap THEN f ELSE y0 + most END - overlap FROM (
    SELECT c.page_id, piece_no, y0, most, overlap, coalesce(list_max(list_filter(fs, lambda y: y <= y0 + most)), y0) AS f FROM cut c JOIN strip s ON s.page_id = c.page_id WHERE y_bottom - y0 > most)),
piece AS (
  SELECT page_id, piece_no, count(*) OVER (PARTITION BY page_id) AS n_pieces, y0, CASE WHEN y_bottom - y0 <= most THEN y_bottom WHEN f > y0 + overlap THEN f ELSE y0 + most END AS y1,
    y_bottom - y0 <= most OR f > y0 + overlap AS natural_end
  FROM (SELECT c.page_id, piece_no, y0, most, overlap, y_bottom, coalesce(list_max(list_filter(fs, lambda y: y <= y0 + most)), y0) AS f FROM cut c JOIN strip s ON s.page_id = c.page_id)),
stems AS (SELECT page_id, min(regexp_replace(regexp_replace(path, '^.*/', ''), '_[0-9]+\.[A-Za-z0-9]+$', '')) AS s FROM manifest WHERE page_id IS NOT NULL AND path IS NOT NULL GROUP BY page_id)
SELECT page_id, CAST(piece_no AS INT) AS piece_no, CAST(n_pieces AS INT) AS n_pieces, y0, y1, natural_end, coalesce(s, 'page' || page_id) AS stem, printf('%s_piece%03d', coalesce(s, 'page' || page_id), piece_no) AS name
FROM piece LEFT JOIN stems USING (page_id)
""",
    "p3_found": """
SELECT page_id FROM (
  SELECT page_id, max(frac_bbox.b) - min(frac_bbox.t) AS tall FROM gt_cells
  WHERE 0 <= frac_bbox.l AND frac_bbox.l < frac_bbox.r AND frac_bbox.r <= 1
    AND 0 <= frac_bbox.t AND frac_bbox.t < frac_bbox.b AND frac_bbox.b <= 1
  GROUP BY page_id) JOIN page_images USING (page_id) JOIN piece_limits USING (source)
WHERE tall * img_h > max_piece_px
""",
    "p6_found": """
WITH RECURSIVE r AS (SELECT * FROM predicted_cells WHERE det_id IS NOT NULL),
e AS (SELECT a.pred_id AS a, b.pred_id AS b FROM r a JOIN r b ON a.shot_id = b.shot_id AND a.pred_id <> b.pred_id
      WHERE a.det_id = b.det_id OR (abs(a.cx - b.cx) < greatest(a.w, b.w) / 2 AND abs(a.cy - b.cy) < greatest(a.h, b.h) / 2)),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT DISTINCT a AS pred_id_a, b AS pred_id_b FROM c WHERE a < b
""",
    "p1_found": f"""
WITH p AS ({_PATTERN}), n AS (SELECT count(pattern) // 5 AS s FROM p)
SELECT label_int FROM sample_targets t, n
WHERE (SELECT count(*) FROM p WHERE p.pattern = t.label_int) < greatest(t.min_rows, (t.target_bp * n.s) // 10000)
""",
    "p4_found": """
WITH c AS (SELECT DISTINCT crop_id, page_id, n_bytes, source FROM manifest),
s AS (SELECT coalesce(nullif(lower(trim(c.source)), ''), lower(trim(i.source))) AS source, coalesce(n_bytes, 0) AS n
      FROM c LEFT JOIN page_images i USING (page_id)),
t AS (SELECT sum(n) AS total FROM s)
SELECT m.source FROM mix_targets m, t
WHERE m.target_pct * total > 100 * m.max_repeats * coalesce((SELECT sum(n) FROM s WHERE s.source = m.source), 0)
""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
