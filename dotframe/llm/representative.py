"""One record per cell of a photograph from all records that show it.

Records of one shot show one cell if they share a det_id or lie close to each
other; groups are closed under this. The surviving record is chosen field by
field by currency: transitions between the stages (detector and whether it was
a rescue) of timestamped records of the same cell teach which stage comes
before which; that precedence, closed under transitivity, orders the records of
each group in part, and the value that is topologically latest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.llm.linking import link_large
from dotframe.session import staged

#: Records of a shot that one task takes.
SHOT_ROWS = 200_000
#: Records of a cell that a block of its pairs holds on one side.
PAIR_BLOCK = 1024


def _find(parent: np.ndarray, edges_a: np.ndarray, edges_b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by vectorised hooking of the
    larger root onto the smaller and pointer jumping."""
    while len(edges_a):
        ra, rb = parent[edges_a], parent[edges_b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        keep = parent[edges_a] != parent[edges_b]
        edges_a, edges_b = edges_a[keep], edges_b[keep]
    return parent


def link_shots(shot: np.ndarray, det: np.ndarray, cx: np.ndarray, cy: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Component (a row number) of each row; NaN: unknown.

    Rows that must link without a look at their partners come first: equal
    det_ids, and rows of one grid cell no wider than half their own size. Then
    a sweep over cx within bands of lines: a band is as high as the largest
    half height of the shot, and two rows in reach lie in one or in
    neighbouring bands, so two passes over pairs of bands see them together.
    A row is compared with those after it, nearest first, up to the largest
    half width of the shot.
    """
    parent = np.arange(len(shot))
    parent = _find(parent, *_chain((shot, det), np.lexsort((det, shot))))
    half_w, half_h = np.where(np.isnan(w), 0.0, w) / 2, np.where(np.isnan(h), 0.0, h) / 2
    rows = np.flatnonzero(~(np.isnan(cx) | np.isnan(cy)))
    sized = rows[(half_w[rows] > 0) & (half_h[rows] > 0)]
    if len(sized):
        k, m = np.floor(np.log2(half_w[sized])), np.floor(np.log2(half_h[sized]))
        keys = (shot[sized], k, m, np.floor(cx[sized] / 2.0**k), np.floor(cy[sized] / 2.0**m))
        a, b = _chain(keys, np.lexsort(keys[::-1]))
        parent = _find(parent, sized[a], sized[b])
        # Of rows alike in place and size, linked by now, one goes on.
        alike = np.unique(np.column_stack([shot[sized], cx[sized], cy[sized], half_w[sized], half_h[sized]]), axis=0, return_index=True)[1]
        rows = np.sort(np.concatenate([np.setdiff1d(rows, sized, assume_unique=True), sized[alike]]))
    if not len(rows):
        return parent
    _, of = np.unique(shot[rows], return_inverse=True)
    most_w, most_h = np.zeros(of.max() + 1), np.zeros(of.max() + 1)
    np.maximum.at(most_w, of, half_w[rows])
    np.maximum.at(most_h, of, half_h[rows])
    reach = most_w[of]
    band = np.floor(cy[rows] / np.where(most_h[of] > 0, most_h[of], 1.0))
    for shift in (0, 1):
        pair = np.floor((band + shift) / 2)
        order = np.lexsort((cx[rows], pair, of))
        parent = _sweep(parent, rows[order], of[order], pair[order], reach[order], cx, cy, half_w, half_h)
    return parent


def _sweep(parent, rows, of, pair, reach, cx, cy, half_w, half_h) -> np.ndarray:
    x, live, step = cx[rows], np.arange(len(rows)), 1
    while len(live):
        live = live[live + step < len(rows)]
        ahead = live + step
        near = (of[live] == of[ahead]) & (pair[live] == pair[ahead]) & (x[ahead] - x[live] < reach[live])
        live = live[near]
        a, b = rows[live], rows[live + step]
        hit = (np.abs(cx[a] - cx[b]) < np.maximum(half_w[a], half_w[b])) & (np.abs(cy[a] - cy[b]) < np.maximum(half_h[a], half_h[b]))
        hit &= parent[a] != parent[b]
        parent = _find(parent, a[hit], b[hit])
        step += 1
    return parent


def _chain(keys: tuple, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between neighbours in ``order`` with equal keys (NaN: none)."""
    if len(order) < 2:
        return order[:0], order[:0]
    a, b = order[:-1], order[1:]
    eq = np.ones(len(a), dtype=bool)
    for k in keys:
        eq &= k[a] == k[b]
    return a[eq], b[eq]


def _grouped(t: pa.Table) -> pa.Table:
    f = lambda c: t[c].to_numpy(zero_copy_only=False).astype(float)
    root = link_shots(t["shot_id"].to_numpy(), *(f(c) for c in ("det_id", "cx", "cy", "w", "h")))
    rid = t["pred_id"].to_numpy()
    first = np.full(len(root), np.iinfo(np.int64).max)
    np.minimum.at(first, root, rid)
    return t.append_column("cell", pa.array(first[root])).append_column("n_records", pa.array(np.bincount(root, minlength=len(root))[root]))


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come ordered by shot_id; the last shot of a batch waits for the
    next one, until it is whole."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        shots = t["shot_id"].to_numpy()
        cut = int(np.searchsorted(shots, shots[-1]))
        if held and shots[0] != held[0]["shot_id"][0].as_py():
            if cut:
                held.append(t.slice(0, cut))
            yield from _grouped(pa.concat_tables(held)).to_batches()
            held = []
        elif cut:
            yield from _grouped(pa.concat_tables([*held, t.slice(0, cut)])).to_batches()
            held = []
        held.append(t.slice(cut))
    if held:
        yield from _grouped(pa.concat_tables(held)).to_batches()


def grouped_records(records: DataFrame, *extra: str, most: int = SHOT_ROWS) -> DataFrame:
    """The records that belong to a cell, with ``cell``, the smallest pred_id
    of its cell, and the cell's n_records. Columns: pred_id, shot_id, det_id,
    cx, cy, w, h and ``extra``.

    Records without shot_id, det_id or pred_id belong to none. Unknown sizes
    reach nothing by themselves, unknown centres link by det_id alone. Rows
    are shuffled by shot, not by page: a page photographed over and over
    spreads over all tasks. Shots of more than ``most`` records are linked by
    joins instead (linking.link_large), with the same result.
    """
    f = lambda c: F.col(c).cast("double").alias(c)
    some = records.where("shot_id is not null and det_id is not null and pred_id is not null").select(
        F.col("pred_id").cast("long"), F.col("shot_id").cast("long"), "det_id", f("cx"), f("cy"), f("w"), f("h"), *extra
    )
    schema = ", ".join(f"`{c}` {t}" for c, t in some.dtypes) + ", cell long, n_records long"
    in_task = lambda df: df.repartition("shot_id").sortWithinPartitions("shot_id").mapInArrow(_label, schema)
    large = staged(some.groupBy("shot_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("shot_id"), "large")
    if large.isEmpty():
        return in_task(some)
    big = some.join(large, "shot_id", "left_semi")
    cell = staged(link_large(big), "cell")
    sizes = cell.groupBy("cell").agg(F.count(F.lit(1)).alias("n_records"))
    joined = big.join(cell, "pred_id").join(sizes, "cell")
    return in_task(some.join(large, "shot_id", "left_anti").select(*some.columns)).unionByName(joined)


def _cells(records: DataFrame, most: int) -> DataFrame:
    """grouped_records with what currency needs, written once."""
    stage = F.concat_ws("|", F.coalesce("detector", F.lit("?")), F.coalesce(F.col("rescued").cast("string"), F.lit("?")))
    return staged(grouped_records(records.withColumn("stage", stage), "conf", "bits", "detected_at", "stage", most=most), "cells")


def pairs(records: DataFrame, most: int = SHOT_ROWS, block: int = PAIR_BLOCK) -> DataFrame:
    """Every two records of one cell: (pred_id_a, pred_id_b), smaller first.
    The cells are those that the representatives stand for. A cell of many
    records is paired in blocks of about ``block``, in as many tasks."""
    grouped = _cells(records, most)
    kept = staged(best_of_cells(grouped), "representatives").where("n_records > 1").select("cell", "n_records")
    member = grouped.where("n_records > 1").select("cell", "pred_id").join(kept, "cell")
    member = staged(member.withColumn("blocks", F.expr(f"cast(ceil(n_records / {block}) as int)")).drop("n_records"), "members")
    a = member.select("cell", F.pmod(F.xxhash64("pred_id"), F.col("blocks")).cast("int").alias("block"), F.col("pred_id").alias("pred_id_a"))
    b = member.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pred_id").alias("pred_id_b"))
    return a.join(b, ["cell", "block"]).where("pred_id_a < pred_id_b").select("pred_id_a", "pred_id_b")


def closure(edges: DataFrame) -> DataFrame:
    """(u, v) for every path from u to v: paths are doubled until none is new,
    so a path of n edges takes about log2(n) rounds."""
    reach = staged(edges.select("u", "v").distinct(), "reach")
    n = reach.count()
    while True:
        further = reach.select("u", F.col("v").alias("mid")).join(reach.select(F.col("u").alias("mid"), "v"), "mid").select("u", "v")
        reach = staged(reach.union(further).distinct(), "reach")
        was, n = n, reach.count()
        if n == was:
            return reach


def precedence(grouped: DataFrame) -> DataFrame:
    """(stage, later): the stages that come after a stage, learned from all
    cells with two or more timestamped records. u comes before v if records of
    one cell go from u to v more often than back, or if a path of such steps
    leads from u to v and none back: stages on a cycle are not ordered among
    each other. There are at most as many rows as stages."""
    by_time = W.partitionBy("cell").orderBy("detected_at", "pred_id")
    moves = (
        grouped.where("n_records > 1 and detected_at is not null")
        .withColumn("u", F.lag("stage").over(by_time))
        .where("u <> stage")
        .groupBy("u", F.col("stage").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    )
    moves = staged(moves, "moves")
    back = moves.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("n").alias("n_back"))
    reach = closure(moves.join(back, ["u", "v"], "left").where("n > coalesce(n_back, 0)"))
    after = reach.join(reach.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")
    return after.groupBy(F.col("u").alias("stage")).agg(F.collect_set("v").alias("later"))


def _known() -> dict:
    """The fields' values where they are known."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    shaped = F.when(F.col("bits").rlike(r"\A[01]{6}\z"), F.col("bits"))
    return {
        "cx": finite("cx"), "cy": finite("cy"), "conf": F.when(F.col("conf").between(0, 1), F.col("conf")),
        "bits": F.when(shaped != "000000", shaped), "blank": F.when(shaped == "000000", shaped),
    }


def best_of_cells(grouped: DataFrame) -> DataFrame:
    """One row per cell of ``grouped``: see ``representatives``."""
    order = staged(precedence(grouped), "precedence")
    fields = _known()
    alone = grouped.where("n_records = 1").select("shot_id", "cell", "n_records", *[v.alias(k) for k, v in fields.items()])
    timed, id_ = F.col("detected_at").isNotNull(), (-F.col("pred_id")).alias("id")
    aggs = []
    for name, value in fields.items():
        seen = value.isNotNull()
        aggs.append(F.max(F.when(seen & timed, F.struct("detected_at", id_, value.alias("value")))).alias(f"t_{name}"))
        aggs.append(F.max(F.when(seen & ~timed, F.struct(id_, value.alias("value")))).alias(f"u_{name}"))
    # A row a stage first, so that a cell gathers stages and not records.
    by_stage = grouped.where("n_records > 1").groupBy("cell", "stage").agg(F.min("shot_id").alias("shot_id"), F.count(F.lit(1)).alias("n"), *aggs)
    none = F.expr("cast(array() as array<string>)")
    kept = ["stage", "later", *(f"{x}_{k}" for k in fields for x in "tu")]
    by_cell = (
        by_stage.join(order, "stage", "left").withColumn("later", F.coalesce("later", none))
        .groupBy("cell").agg(F.min("shot_id").alias("shot_id"), F.sum("n").alias("n_records"), F.collect_list(F.struct(*kept)).alias("s"))
    )
    latest = lambda k: F.array_max(
        F.transform(
            F.filter("s", lambda x: x[f"t_{k}"].isNotNull()),
            lambda x: F.struct(x[f"t_{k}"]["detected_at"].alias("at"), x[f"t_{k}"]["id"].alias("id"), x[f"t_{k}"]["value"].alias("value"), x["later"].alias("later")),
        )
    )
    by_cell = by_cell.withColumns({f"t_{k}": latest(k) for k in fields})
    after = lambda k: F.filter(
        "s", lambda x: x[f"u_{k}"].isNotNull() & (F.col(f"t_{k}").isNull() | F.array_contains(F.col(f"t_{k}.later"), x["stage"]))
    )
    by_cell = by_cell.withColumns({f"u_{k}": after(k) for k in fields})

    def chosen(k: str):
        top = F.filter(f"u_{k}", lambda x: ~F.exists(f"u_{k}", lambda y: F.array_contains(x["later"], y["stage"])))
        return F.coalesce(F.array_max(F.transform(top, lambda x: x[f"u_{k}"]))["value"], F.col(f"t_{k}.value")).alias(k)

    several = by_cell.select("shot_id", "cell", "n_records", *[chosen(k) for k in fields])
    return alone.unionByName(several).withColumn("bits", F.coalesce("bits", "blank")).drop("blank")


def representatives(records: DataFrame, most: int = SHOT_ROWS) -> DataFrame:
    """One row per cell: shot_id, cell, n_records and the latest known cx, cy,
    conf and bits.

    Known: a finite number (conf within 0..1), or six dots as 0 and 1;
    000000 counts only where no other pattern is known. Timestamped records of
    a cell are ordered by their time (ties: the smaller pred_id is later). One
    without a time is later than another if its stage is learned to come after
    the other's. Of those that are later than the latest timestamped one, or of
    all where none has a time, the value wins that comes before no other; of
    several such the one of the smaller pred_id. A record without a time whose
    stage isn't comparable gives way to one with a time. A field nobody knows
    is null.
    """
    return best_of_cells(_cells(records, most))
