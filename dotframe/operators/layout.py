"""Lines, gaps, word spaces and text of pages of cells.

Cells have page_id, det_id (the order of ties), cx, cy, w, h, conf and bits.
Every window is partitioned by page_id, so one shuffle serves a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.functions.encode import ALL_DOTS, BLANK_BITS, BLANK_CHAR, dot_char
from dotframe.functions.geom import half_even
from dotframe.params import PARAMS


def _page():
    return W.partitionBy("page_id")


def _down():
    return _page().orderBy("cy", "det_id")


def _line():
    return W.partitionBy("page_id", "line_id")


def _read():
    return _line().orderBy("cx", "det_id")


# Patterns after which a cell must follow.
INDICATORS = ("000001", "000011", "000110", "000111", "001111")


def line_groups(cells: DataFrame) -> DataFrame:
    """Adds line_id: a new line starts where cy is 0.55 median heights or more
    from the cell before it in the order of cy."""
    step = F.abs(F.col("cy") - F.lag("cy").over(_down())) >= PARAMS.line_band * F.col("_mh")
    return (
        cells.withColumn("_mh", F.median("h").over(_page()))
        .withColumn("_new", F.when(step, 1).otherwise(0))
        .withColumn("line_id", F.sum("_new").over(_down().rowsBetween(W.unboundedPreceding, 0)))
        .drop("_mh", "_new")
    )


def line_gaps(lines: DataFrame) -> DataFrame:
    """Adds gap, from the cell before in reading order; null at a line's start."""
    return lines.withColumn("gap", F.col("cx") - F.lag("cx").over(_read()))


def char_spacing(lines: DataFrame) -> DataFrame:
    """Per line: number of cells, first and last cx, median cy, and the true
    spacing of characters: the gap at a tenth of the sorted gaps, or 1.1 median
    widths of the page without gaps."""
    gaps = line_gaps(lines.withColumn("_mw", F.median("w").over(_page())))
    nth = F.element_at(F.array_sort(F.collect_list("gap")), (F.floor((F.count(F.lit(1)) - 1) / 10) + 1).cast("int"))
    return gaps.groupBy("page_id", "line_id").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("cx").alias("first_cx"), F.max("cx").alias("last_cx"),
        F.median("cy").alias("row_y"), F.first("_mw").alias("median_w"),
        F.when(F.count("gap") > 0, nth).otherwise(F.first("_mw") * 1.1).alias("spacing"),
    )


def spaced(lines: DataFrame) -> DataFrame:
    """Adds gap and n_spaces, the word spaces before each cell, by the line's
    median gap and the page's median width."""
    excess = F.col("gap") - F.col("_mg")
    return (
        line_gaps(lines).withColumn("_mw", F.median("w").over(_page())).withColumn("_mg", F.median("gap").over(_line()))
        .withColumn(
            "n_spaces",
            F.when(excess > PARAMS.space_extra * F.col("_mw"), F.greatest(F.lit(1), half_even(excess / F.col("_mw")).cast("int"))).otherwise(0),
        )
        .drop("_mw", "_mg")
    )


def insert_spaces(lines: DataFrame) -> DataFrame:
    """Cells and space markers (cx null, cy of the cell after the gap) with
    their place ``seq`` in the line."""
    k = F.explode(F.sequence(F.lit(0), F.col("n_spaces"))).alias("_k")
    rows = spaced(lines).select("page_id", "line_id", "det_id", "cx", "cy", "w", "bits", "n_spaces", k)
    space = F.col("_k") < F.col("n_spaces")
    order = _line().orderBy("_cx", "det_id", "_k")
    return (
        rows.withColumn("_cx", F.col("cx"))
        .withColumn("is_space", space)
        .withColumn("seq", F.row_number().over(order) - 1)
        .select(
            "page_id", "line_id", "seq", F.when(~F.col("is_space"), F.col("cx")).alias("cx"), "cy",
            F.when(F.col("is_space"), BLANK_BITS).otherwise(F.col("bits")).alias("bits"), "is_space",
        )
    )


def _joined(value: Column, *order: str, sep: str = "") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda z: z["_v"]), sep)


def line_strings(lines: DataFrame) -> DataFrame:
    text = F.concat(F.repeat(F.lit(BLANK_CHAR), F.col("n_spaces")), dot_char(F.col("bits")))
    return spaced(lines).groupBy("page_id", "line_id").agg(_joined(text, "cx", "det_id").alias("text"))


def page_text(cells: DataFrame) -> DataFrame:
    """One row per page: its lines of dot characters, joined by newlines."""
    return joined_lines(line_strings(line_groups(cells)))


def joined_lines(lines: DataFrame) -> DataFrame:
    """(page_id, text) of lines (page_id, line_id, text)."""
    return lines.groupBy("page_id").agg(_joined(F.col("text"), "line_id", sep="\n").alias("text"))


def strip_markout(lines: DataFrame, min_run: int = 2, order: tuple[str, ...] = ("cy", "det_id")) -> DataFrame:
    """Drops runs of min_run or more all-dots cells. The order is that of the
    line as it was grouped; pass ("cx", "det_id") for reading order."""
    by = _line().orderBy(*order)
    full = F.col("bits") == ALL_DOTS
    island = W.partitionBy("page_id", "line_id", "_full", "_island")
    return (
        lines.withColumn("_full", full)
        .withColumn("_rn", F.row_number().over(by))
        .withColumn("_island", F.col("_rn") - F.row_number().over(W.partitionBy("page_id", "line_id", "_full").orderBy(*order)))
        .withColumn("_n", F.count(F.lit(1)).over(island))
        .where(~F.col("_full") | (F.col("_n") < min_run))
        .drop("_full", "_rn", "_island", "_n")
    )


def horizontal_runs(lines: DataFrame, factor: float = 3.0) -> DataFrame:
    """Adds run_id: a line is cut where a gap is factor median widths or more."""
    cut = F.col("gap") >= factor * F.median("w").over(_page())
    return (
        line_gaps(lines).withColumn("_cut", F.when(cut, 1).otherwise(0))
        .withColumn("run_id", F.sum("_cut").over(_read().rowsBetween(W.unboundedPreceding, 0))).drop("_cut", "gap")
    )


def small_clusters(lines: DataFrame, most: int = 3) -> DataFrame:
    """Runs of at most ``most`` cells: (page_id, line_id, run_id, n)."""
    n = horizontal_runs(lines).groupBy("page_id", "line_id", "run_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") <= most)


def ordinal_names(cells: DataFrame, stem: Column) -> DataFrame:
    """Adds ``name``: the stem, with the cell's number from the top where its
    page has several."""
    n = F.row_number().over(_down()) - 1
    named = cells.withColumn("_n", n).withColumn("_of", F.count(F.lit(1)).over(_page()))
    return named.withColumn("name", F.when(F.col("_of") > 1, F.format_string("%s_%04d", stem, "_n")).otherwise(stem)).drop("_n", "_of")


def usable(spacing: DataFrame) -> DataFrame:
    return spacing.where((F.col("n_cells") >= 2) & (F.col("spacing") >= 0.6 * F.col("median_w")))


def gap_slots(lines: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """Empty places between cells of a line, at multiples of its spacing
    (``char_spacing``, if it is there already)."""
    s = usable(char_spacing(lines) if spacing is None else spacing).select("page_id", "line_id", "spacing", "row_y")
    ahead = lines.withColumn("_next", F.lead("cx").over(_read())).where("_next is not null")
    n = half_even((F.col("_next") - F.col("cx")) / F.col("spacing")).cast("int") - 1
    return (
        ahead.join(s, ["page_id", "line_id"]).withColumn("_n", n).where("_n >= 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .select("page_id", "line_id", "det_id", "k", (F.col("cx") + F.col("k") * F.col("spacing")).alias("ex"), F.col("row_y").alias("ey"))
    )


def text_bounds(lines: DataFrame) -> DataFrame:
    """Left and right of the text block: medians over lines of three or more."""
    return (
        lines.groupBy("page_id", "line_id").agg(F.count(F.lit(1)).alias("_n"), F.min("cx").alias("_l"), F.max("cx").alias("_r"))
        .where("_n >= 3").groupBy("page_id").agg(F.median("_l").alias("text_left"), F.median("_r").alias("text_right"))
    )


def edge_slots(lines: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """Empty places before a line's first and after its last cell, up to the
    text block."""
    s = usable(char_spacing(lines) if spacing is None else spacing).join(text_bounds(lines), "page_id")
    cs = F.col("spacing")
    # Places first - k * cs > left - cs / 2, and mirrored.
    left = F.ceil((F.col("first_cx") - F.col("text_left")) / cs + 0.5) - 1
    right = F.ceil((F.col("text_right") - F.col("last_cx")) / cs + 0.5) - 1
    def side(name: str, n: Column, at: str, sign: int) -> DataFrame:
        return (
            s.withColumn("_n", n.cast("int")).where("_n >= 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
            .select("page_id", "line_id", F.lit(name).alias("side"), "k", (F.col(at) + sign * F.col("k") * cs).alias("ex"), F.col("row_y").alias("ey"))
        )

    return side("left", left, "first_cx", -1).unionByName(side("right", right, "last_cx", 1))


def indicator_targets(lines: DataFrame) -> DataFrame:
    """Places right after an indicator cell at which its partner is missing."""
    s = usable(char_spacing(lines)).select("page_id", "line_id", "spacing")
    ahead = lines.withColumn("_next", F.lead("cx").over(_read())).where(F.col("bits").isin(*INDICATORS))
    return (
        ahead.join(s, ["page_id", "line_id"])
        .where(F.col("_next").isNull() | (F.col("_next") - F.col("cx") > 1.4 * F.col("spacing")))
        .select("page_id", "line_id", "det_id", (F.col("cx") + F.col("spacing")).alias("ex"), F.col("cy").alias("ey"), "w", "h")
    )


def sheet_positions(cells: DataFrame, columns: int = 40) -> DataFrame:
    """Row and column of each cell on a sheet of 40 columns."""
    at = F.row_number().over(_page().orderBy("det_id")) - 1
    return cells.withColumn("idx", at).withColumn("sheet_row", F.expr(f"idx div {columns}")).withColumn("sheet_col", F.col("idx") % columns)
