"""Filling empty grid places of a page with its low-confidence cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.functions.encode import ALL_DOTS
from dotframe.operators.layout import char_spacing, edge_slots, gap_slots, line_groups
from dotframe.params import PARAMS
from dotframe.session import spread, staged


def reliable(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("conf") >= PARAMS.high_conf)


def slots(lines: DataFrame, spacing: DataFrame | None = None) -> DataFrame:
    """Empty places of each page in the order they are visited: line by line;
    gaps from left to right, then outward to the left and the right."""
    gaps = gap_slots(lines, spacing).select("page_id", "line_id", F.lit(0).alias("part"), "det_id", "k", "ex", "ey")
    at = lines.select("page_id", "det_id", "cx")
    gaps = gaps.join(at, ["page_id", "det_id"]).select("page_id", "line_id", "part", F.col("cx").alias("from"), "det_id", "k", "ex", "ey")
    none = F.lit(None)
    edges = edge_slots(lines, spacing).select(
        "page_id", "line_id", F.when(F.col("side") == "left", 1).otherwise(2).alias("part"),
        none.cast("double").alias("from"), none.cast("long").alias("det_id"), "k", "ex", "ey",
    )
    return gaps.unionByName(edges)


def grid_fill(cells: DataFrame) -> DataFrame:
    """Reliable cells, low-confidence cells claimed by an empty place (stage
    ``rescued``) and places nobody claimed (stage ``gap`` or ``edge``).

    Each place takes the most confident unused cell within 0.45 of the spacing
    and 0.55 of the height; all-dots cells need 0.15. A page without reliable
    cells keeps all its cells; elsewhere unclaimed ones are dropped. The claim
    order matters, so each page's few places and candidates meet in one group.
    """
    ok = reliable(cells)
    size = ok.groupBy("page_id").agg(F.median("w").alias("mw"), F.median("h").alias("mh"))
    lines = staged(line_groups(ok).select("page_id", "line_id", "det_id", "cx", "cy", "w", "h"), "lines")
    spacing = staged(char_spacing(lines), "spacing")
    visit = slots(lines, spacing).join(spacing.select("page_id", "line_id", "spacing"), ["page_id", "line_id"]).join(size, "page_id")
    low = cells.where((F.col("conf") < PARAMS.high_conf) & ~((F.col("bits") == ALL_DOTS) & (F.col("conf") < PARAMS.all_dots_min_conf)))
    fresh = lambda df, *cols: df.select(*[F.col(k).alias(k) for k in cols])
    low = fresh(low.join(size, "page_id"), "page_id", "det_id", "cx", "cy", "w", "h", "conf", "bits")
    visit = fresh(visit, *visit.columns)

    schema = "page_id long, stage string, det_id long, ex double, ey double, cx double, cy double, w double, h double, conf double, bits string"

    def claim(key, places: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        places = places.sort_values(["line_id", "part", "from", "det_id", "k"], kind="stable", ignore_index=True)
        pool = pool.sort_values("cx", kind="stable", ignore_index=True)
        x, y, conf, ids = (pool[c].to_numpy() for c in ("cx", "cy", "conf", "det_id"))
        ex, ey = places["ex"].to_numpy(), places["ey"].to_numpy()
        dx, dy = places["spacing"].to_numpy() * 0.45, places["mh"].to_numpy() * PARAMS.line_band
        lo, hi = np.searchsorted(x, ex - dx), np.searchsorted(x, ex + dx, side="right")
        free = np.ones(len(pool), dtype=bool)
        chosen = np.full(len(places), -1)
        for i in np.flatnonzero(hi > lo):
            near = np.arange(lo[i], hi[i])
            near = near[free[near] & (np.abs(x[near] - ex[i]) < dx[i]) & (np.abs(y[near] - ey[i]) < dy[i])]
            if len(near):
                j = near[np.lexsort((ids[near], -conf[near]))[0]]
                free[j], chosen[i] = False, j
        won = chosen >= 0
        got = pool.take(np.where(won, chosen, 0)).reset_index(drop=True) if len(pool) else pool.reindex(range(len(places)))
        out = pd.DataFrame({"page_id": key[0], "stage": np.where(won, "rescued", np.where(places["part"] == 0, "gap", "edge")), "ex": ex, "ey": ey})
        out["det_id"] = got["det_id"].astype("Int64").where(won)
        empty = {"cx": ex, "cy": ey, "w": places["mw"].to_numpy(), "h": places["mh"].to_numpy(), "conf": PARAMS.crop_conf}
        for c, v in empty.items():
            out[c] = np.where(won, got[c].to_numpy(dtype=float), v)
        out["bits"] = got["bits"].astype(object).where(won, None)
        return out[[c.split()[0] for c in schema.split(", ")]]

    filled = spread(visit, "page_id").groupBy("page_id").cogroup(spread(low, "page_id").groupBy("page_id")).applyInPandas(claim, schema)
    as_stage = lambda df, s: df.select(
        "page_id", F.lit(s).alias("stage"), "det_id", F.col("cx").alias("ex"), F.col("cy").alias("ey"), "cx", "cy", "w", "h", "conf", "bits"
    )
    alone = cells.join(size, "page_id", "left_anti")
    return as_stage(ok, "reliable").unionByName(filled).unionByName(as_stage(alone, "unfiltered"))
