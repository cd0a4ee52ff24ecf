"""Separating annotation lines that fail to parse from typed valid cells.

Parsed lines are exploded into (line, column, value); a rule table says what
each column of each format must hold, and what it must be to another column of
its line; only violations are shuffled, aggregated to the first reason per
line; the clean side is the anti-join of the lines with those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INT = r"^[0-9]+$"
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# What a value of each kind must look like.
KINDS = {
    "number": NUMBER, "integer": INT, "dot": "^[01]$", "split": "^(train|val|test)$", "text": "(?s)^.+$", "bits": "^[01]{6}$",
}

# Format, column number, field, kind, lowest, highest value (row
# and col take the highest from the file's own headers), the column it is held
# against, and what it must be to it.
RULES = [
    ("cell_csv", 1, "l", "number", 0.0, 1.0, 3, "less"),
    ("cell_csv", 2, "t", "number", 0.0, 1.0, 4, "less"),
    ("cell_csv", 3, "r", "number", 0.0, 1.0, None, None),
    ("cell_csv", 4, "b", "number", 0.0, 1.0, None, None),
    ("cell_csv", 5, "label", "integer", 1.0, 63.0, None, None),
    ("grid_txt", 1, "row", "integer", 1.0, None, None, None),
    ("grid_txt", 2, "col", "integer", 1.0, None, None, None),
    *[("grid_txt", 2 + k, f"d{k}", "dot", None, None, None, None) for k in range(1, 7)],
    ("manifest_csv", 1, "split", "split", None, None, None, None),
    ("manifest_csv", 2, "path", "text", None, None, None, None),
    ("manifest_csv", 3, "bits6", "bits", None, None, 4, "pattern"),
    ("manifest_csv", 4, "label_int", "integer", 1.0, 63.0, None, None),
]
WIDTH = {"cell_csv": 5, "grid_txt": 8, "manifest_csv": 4}
HEADERS = {"cell_csv": 0, "grid_txt": 3, "manifest_csv": 1}
SEPARATOR = {"cell_csv": ";", "manifest_csv": ","}
BLANKS = " \t"
MARK = "\u0001"


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "fmt string, col_no int, field string, shape string, lo double, hi double, other int, relation string")


def _by_fmt(of: dict[str, Column]) -> Column:
    out = None
    for fmt, value in of.items():
        out = F.when(F.col("fmt") == fmt, value) if out is None else out.when(F.col("fmt") == fmt, value)
    return out


def _quoted_ok(segs: Column, sep: str) -> Column:
    """Whether the segments between double quotes alternate as they must:
    what stands outside quotes begins and ends next to a separator or the
    line's ends, blanks aside; an empty middle one is a doubled quote."""
    n = F.size(segs)
    opens, closes = f"(?s)^(.*{sep})?[ \t]*$", f"(?s)^[ \t]*({sep}.*)?$"
    middle = f"(?s)^[ \t]*{sep}(.*{sep})?[ \t]*$"

    def fits(s: Column, i: Column) -> Column:
        return (
            F.when(i % 2 == 1, True)
            .when(i == 0, s.rlike(opens))
            .when(i == n - 1, s.rlike(closes))
            .otherwise((s == "") | s.rlike(middle))
        )

    return (n == 1) | ((n % 2 == 1) & F.forall(F.transform(segs, fits), lambda x: x))


def _csv_fields(segs: Column, sep: str) -> Column:
    """Fields of a well-quoted line. Separators and blanks inside quotes are
    masked while splitting and trimming."""
    n = F.size(segs)

    def mask(s: Column, i: Column) -> Column:
        plain = F.replace(s, F.lit(MARK), F.lit(MARK + "e"))
        inside = plain
        for what, code in ((sep, "s"), (" ", "b"), ("\t", "t")):
            inside = F.replace(inside, F.lit(what), F.lit(MARK + code))
        return F.when(i % 2 == 1, inside).when((s == "") & (i > 0) & (i < n - 1), F.lit('"')).otherwise(plain)

    def unmask(s: Column) -> Column:
        s = F.trim(s, F.lit(BLANKS))
        for what, code in ((sep, "s"), (" ", "b"), ("\t", "t"), (MARK, "e")):
            s = F.replace(s, F.lit(MARK + code), F.lit(what))
        return s

    return F.transform(F.split(F.array_join(F.transform(segs, mask), ""), sep, -1), unmask)


def _partners(fields: Column, fmt: str) -> Column:
    """The value each of a line's fields is held against, null without."""
    other = {n: o for f, n, *_, o, _ in RULES if f == fmt and o}
    return F.array(*[F.try_element_at(fields, F.lit(other[i])) if i in other else F.lit(None).cast("string") for i in range(1, WIDTH[fmt] + 1)])


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``key`` (what tells lines without a raw_id apart), ``kind`` (blank,
    header or data), ``quoting_ok`` and ``fields`` to each raw line; needs fmt,
    line_no, raw_line, file_path and raw_id."""
    text = F.regexp_replace(F.coalesce("raw_line", F.lit("")), r"\r\z", "")
    text = F.when(F.col("line_no") == 1, F.regexp_replace(text, r"\A﻿", "")).otherwise(text)
    key = F.when(F.col("raw_id").isNull(), F.to_json(F.struct("file_path", "fmt", "line_no", "raw_line")))
    header = _by_fmt({f: F.coalesce(F.col("line_no") <= n, F.lit(False)) for f, n in HEADERS.items()})
    segs = F.col("segs")  # a step of its own, lest it is split again for each use
    return (
        lines.select("raw_id", "file_path", "fmt", "line_no", "raw_line")
        .withColumn("key", key)
        .withColumn("text", text)
        .withColumn(
            "kind",
            F.when(F.col("text").rlike(r"^\s*$"), "blank").when(F.coalesce(header, F.lit(False)), "header").otherwise("data"),
        )
        .withColumn("segs", F.split("text", '"', -1))
        .withColumn("quoting_ok", F.coalesce(_by_fmt({f: _quoted_ok(segs, s) for f, s in SEPARATOR.items()}), F.lit(True)))
        .withColumn(
            "fields",
            _by_fmt(
                {f: _csv_fields(segs, s) for f, s in SEPARATOR.items()}
                | {"grid_txt": F.split(F.trim("text", F.lit(BLANKS)), "[ \t]+")}
            ),
        )
        .drop("text", "segs")
    )


def _data(lines: DataFrame) -> DataFrame:
    """Data lines with ``early``: the reason not to look at their fields."""
    width = _by_fmt({f: F.size("fields") == n for f, n in WIDTH.items()})
    known = F.coalesce(F.col("fmt").isin(*WIDTH), F.lit(False))
    early = F.when(~known, "format").when(~F.col("quoting_ok"), "quoting").when(~width, "column_count")
    return parse_lines(lines).where("kind = 'data'").withColumn("early", early)


def grid_sizes(lines: DataFrame) -> DataFrame:
    """Numbers of columns (two header numbers each) and rows (three each) of
    each grid file, from its own header lines."""
    count = F.size("fields")
    return (
        parse_lines(lines.where((F.col("fmt") == "grid_txt") & F.col("line_no").isin(2, 3))).where("kind = 'header'")
        .groupBy("file_path")
        .agg(
            F.max(F.when(F.col("line_no") == 2, F.floor(count / 2))).alias("n_cols"),
            F.max(F.when(F.col("line_no") == 3, F.floor(count / 3))).alias("n_rows"),
        )
    )


LINE = ["raw_id", "key", "file_path", "fmt", "line_no", "raw_line"]


def _violations(lines: DataFrame) -> DataFrame:
    """(line, col_no, reason): cells that break a rule, and lines that fail
    before their cells are looked at, at col_no 0."""
    spark = lines.sparkSession
    whole = F.arrays_zip(F.col("fields").alias("value"), _by_fmt({f: _partners(F.col("fields"), f) for f in WIDTH}).alias("partner"))
    none = F.lit(None).cast("string")
    cell = F.when(F.col("early").isNull(), whole).otherwise(F.array(F.struct(none.alias("value"), none.alias("partner"))))
    cells = _data(lines).select(*LINE, "early", F.posexplode(cell).alias("at", "cell")).select(
        *LINE, "early", "cell.value", "cell.partner", F.when(F.col("early").isNull(), F.col("at") + 1).otherwise(0).alias("col_no")
    )
    ruled = cells.join(F.broadcast(rule_table(spark)), ["fmt", "col_no"], "left")  # as many rows as RULES
    shaped = F.lit(False)  # constant patterns are compiled once
    for shape, pattern in KINDS.items():
        shaped = F.when(F.col("shape") == shape, F.col("value").rlike(pattern)).otherwise(shaped)
    number, partner = F.expr("try_cast(value as double)"), F.expr("try_cast(partner as double)")
    ranged = F.col("lo").isNull() | ((number >= F.col("lo")) & (F.col("hi").isNull() | (number <= F.col("hi"))))
    pattern = F.expr("try_cast(conv(reverse(value), 2, 10) as double)")
    related = F.col("relation").isNull() | F.when(F.col("relation") == "less", number < partner).otherwise(pattern == partner)
    valid = F.coalesce(shaped & ranged & related, F.lit(False))
    broken = ruled.where(F.col("early").isNotNull() | ~valid).select(*LINE, "col_no", F.coalesce("early", F.lit("value")).alias("reason"))
    # Places that a grid file's own headers lack.
    places = F.array(*[F.struct(F.lit(i).alias("col_no"), F.try_element_at("fields", F.lit(i)).alias("value")) for i in (1, 2)])
    placed = (
        _data(lines.where("fmt = 'grid_txt'")).where("early is null").select(*LINE, F.explode(places).alias("p")).select(*LINE, "p.*")
        .where(F.col("value").rlike(INT)).withColumn("number", number).where("number >= 1")
        .join(grid_sizes(lines), "file_path", "left")
        .where(~F.coalesce(F.col("number") <= F.when(F.col("col_no") == 1, F.col("n_rows")).otherwise(F.col("n_cols")), F.lit(False)))
    )
    return broken.unionByName(placed.select(*LINE, "col_no", F.lit("value").alias("reason")))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that fail, with the first reason that applies of quoting,
    column_count and value (``format`` for a fmt without rules).

    Blank lines (null or empty text too), headers, one trailing carriage
    return, blanks around fields and a byte-order mark at a file's start are
    no failures. Equal lines under other raw_ids each count; lines without a
    raw_id are told apart by their place and text, and equal ones all count.
    An empty table gives an empty result.
    """
    # Equal lines break equal rules, so each broken one tells how many there are.
    n = [F.count_if(F.col("col_no") == i).alias(f"n{i}") for i in range(max(WIDTH.values()) + 1)]
    by_line = _violations(lines).groupBy(*LINE).agg(F.min("reason").alias("reason"), *n)  # a line's violations share their reason
    copies = F.greatest(*[f"n{i}" for i in range(len(n))]).cast("int")
    return by_line.select("raw_id", "file_path", "fmt", "line_no", "raw_line", "reason", F.explode(F.array_repeat(F.lit(0), copies)).alias("_c")).drop("_c")


def clean_cells(lines: DataFrame) -> DataFrame:
    """The valid data lines as typed cells: l, t, r, b, label of cell_csv;
    row, col, bits of grid_txt; split, path, bits and label of manifest_csv.
    Columns a format lacks are null, except bits and label, which follow from
    each other."""
    bad = _violations(lines).select(F.col("raw_id").alias("_id"), F.col("key").alias("_key")).distinct()
    same = F.col("raw_id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key"))
    ok = _data(lines).where("early is null").join(bad, same, "left_anti")
    of = lambda fmt, i: F.when(F.col("fmt") == fmt, F.try_element_at("fields", F.lit(i)))
    label = lambda fmt, i: of(fmt, i).cast("double").cast("int")
    bits = F.coalesce(
        of("manifest_csv", 3), F.when(F.col("fmt") == "grid_txt", F.array_join(F.slice("fields", 3, 6), "")),
        F.reverse(F.lpad(F.bin(label("cell_csv", 5)), 6, "0")),
    )
    return ok.withColumn("bits6", bits).select(
        "raw_id", "file_path", "fmt", "line_no",
        *[of("cell_csv", i).cast("double").alias(k) for i, k in enumerate("ltrb", 1)],
        *[of("grid_txt", i).cast("double").cast("int").alias(k) for i, k in enumerate(("row", "col"), 1)],
        of("manifest_csv", 1).alias("split"), of("manifest_csv", 2).alias("path"), "bits6",
        F.expr("cast(conv(reverse(bits6), 2, 10) as int)").alias("label"),
    )
