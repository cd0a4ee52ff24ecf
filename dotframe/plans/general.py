"""Queries of the general (not llm) training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dotframe.operators import badrows
from dotframe.sources.tables import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.rejected_lines(table(spark, sf_dir, "raw_annotations")).select("raw_id", "reason")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.clean_cells(table(spark, sf_dir, "raw_annotations"))


QUERIES = {"p5_found": p5_found, "p5_clean": p5_clean}
_NUMBER = badrows.NUMBER.strip("^$")

_JUDGED = rf"""
WITH t AS (
  SELECT raw_id, file_path, fmt, line_no, regexp_replace(CASE WHEN line_no = 1 THEN regexp_replace(coalesce(raw_line, ''), '^\x{{FEFF}}', '') ELSE coalesce(raw_line, '') END, '\r\z', '') AS s FROM raw_annotations),
k AS (SELECT *, CASE fmt WHEN 'cell_csv' THEN ';' ELSE ',' END AS sep FROM t
  WHERE NOT regexp_full_match(s, '\s*') AND line_no > CASE fmt WHEN 'grid_txt' THEN 3 WHEN 'manifest_csv' THEN 1 ELSE 0 END),
q AS (SELECT *, CASE WHEN fmt = 'grid_txt' THEN regexp_split_to_array(trim(s, ' ' || chr(9)), '[ \t]+')
    WHEN fmt = 'cell_csv' AND regexp_full_match(s, '([ \t]*"([^"]|"")*"[ \t]*|[^";]*)(;([ \t]*"([^"]|"")*"[ \t]*|[^";]*))*') THEN regexp_extract_all(s || ';', '([ \t]*"(?:[^"]|"")*"[ \t]*|[^";]*);', 1)
    WHEN fmt = 'manifest_csv' AND regexp_full_match(s, '([ \t]*"([^"]|"")*"[ \t]*|[^",]*)(,([ \t]*"([^"]|"")*"[ \t]*|[^",]*))*') THEN regexp_extract_all(s || ',', '([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*),', 1) END AS raw FROM k),
f AS (SELECT *, list_transform(raw, lambda x: CASE WHEN fmt <> 'grid_txt' AND starts_with(trim(x, ' ' || chr(9)), '"')
    THEN replace(substr(trim(x, ' ' || chr(9)), 2, length(trim(x, ' ' || chr(9))) - 2), '""', '"') ELSE trim(x, ' ' || chr(9)) END) AS f FROM q),
h AS (SELECT file_path, max(len(regexp_split_to_array(trim(s, ' ' || chr(9)), '[ \t]+'))) FILTER (WHERE line_no = 2) // 2 AS n_cols,
    max(len(regexp_split_to_array(trim(s, ' ' || chr(9)), '[ \t]+'))) FILTER (WHERE line_no = 3) // 3 AS n_rows FROM t WHERE fmt = 'grid_txt' GROUP BY file_path),
v AS (SELECT raw_id, file_path, fmt, line_no, f, CASE WHEN raw IS NULL THEN 'quoting' WHEN len(f) <> CASE fmt WHEN 'cell_csv' THEN 5 WHEN 'grid_txt' THEN 8 ELSE 4 END THEN 'column_count'
    WHEN NOT coalesce(CASE fmt
      WHEN 'cell_csv' THEN len(list_filter(f[1:4], lambda x: regexp_full_match(x, '{_NUMBER}'))) = 4 AND regexp_full_match(f[5], '0*([1-9]|[1-5][0-9]|6[0-3])')
        AND TRY_CAST(f[1] AS DOUBLE) >= 0 AND TRY_CAST(f[1] AS DOUBLE) < TRY_CAST(f[3] AS DOUBLE) AND TRY_CAST(f[3] AS DOUBLE) <= 1
        AND TRY_CAST(f[2] AS DOUBLE) >= 0 AND TRY_CAST(f[2] AS DOUBLE) < TRY_CAST(f[4] AS DOUBLE) AND TRY_CAST(f[4] AS DOUBLE) <= 1
      WHEN 'grid_txt' THEN regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[2], '[0-9]+') AND TRY_CAST(f[1] AS DOUBLE) BETWEEN 1 AND n_rows AND TRY_CAST(f[2] AS DOUBLE) BETWEEN 1 AND n_cols
        AND len(list_filter(f[3:8], lambda x: x IN ('0', '1'))) = 6
      ELSE f[1] IN ('train', 'val', 'test') AND f[2] <> '' AND regexp_full_match(f[3], '[01]{{6}}') AND regexp_full_match(f[4], '[0-9]+')
        AND TRY_CAST(f[4] AS DOUBLE) BETWEEN 1 AND 63 AND TRY_CAST(f[4] AS DOUBLE) = (ascii(f[3][1])-48) + 2*(ascii(f[3][2])-48) + 4*(ascii(f[3][3])-48) + 8*(ascii(f[3][4])-48) + 16*(ascii(f[3][5])-48) + 32*(ascii(f[3][6])-48) END, false)
    THEN 'value' END AS reason FROM f LEFT JOIN h USING (file_path))
"""

_BITS = "CASE fmt WHEN 'manifest_csv' THEN f[3] WHEN 'grid_txt' THEN array_to_string(f[3:8], '') ELSE reverse(lpad(bin(CAST(f[5] AS INT)), 6, '0')) END"

ORACLES: dict[str, str] = {
    "p5_found": _JUDGED + "SELECT raw_id, reason FROM v WHERE reason IS NOT NULL",
    "p5_clean": _JUDGED
    + f"""
SELECT raw_id, file_path, fmt, line_no, CASE WHEN c THEN CAST(f[1] AS DOUBLE) END AS l, CASE WHEN c THEN CAST(f[2] AS DOUBLE) END AS t,
  CASE WHEN c THEN CAST(f[3] AS DOUBLE) END AS r, CASE WHEN c THEN CAST(f[4] AS DOUBLE) END AS b, CASE WHEN g THEN CAST(f[1] AS INT) END AS row, CASE WHEN g THEN CAST(f[2] AS INT) END AS col,
  CASE WHEN m THEN f[1] END AS split, CASE WHEN m THEN f[2] END AS path, bits6,
  (ascii(bits6[1])-48) + 2*(ascii(bits6[2])-48) + 4*(ascii(bits6[3])-48) + 8*(ascii(bits6[4])-48) + 16*(ascii(bits6[5])-48) + 32*(ascii(bits6[6])-48) AS label
FROM (SELECT *, fmt = 'cell_csv' AS c, fmt = 'grid_txt' AS g, fmt = 'manifest_csv' AS m, {_BITS} AS bits6 FROM v WHERE reason IS NULL)""",
}
