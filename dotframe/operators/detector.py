"""From a detector's raw output to boxes on the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.operators.suppress import nms

#: Rows of the output: centre, size and confidence of every anchor.
ROWS = ("cx", "cy", "w", "h", "conf")


def decode(outputs: DataFrame, least: float = 0.05, threshold: float = 0.7, max_det: int = 300, key: str = "page_id") -> DataFrame:
    """(key, det_id, cx, cy, w, h, conf) of outputs with ``tensor`` (five rows
    of as many anchors, in the pixels of a letterboxed image) and that image's
    scale, pad_left and pad_top. Anchors from ``least`` on are suppressed in the
    letterbox and mapped back; det_id is the anchor's number from 0. A tensor
    that hasn't five rows of equal length is an error and not read as boxes."""
    t = F.col("tensor")
    regular = (F.size(t) == len(ROWS)) & F.forall(t, lambda row: F.size(row) == F.size(t[0]))
    checked = F.when(regular, t).otherwise(F.raise_error(F.concat(F.lit("unexpected detector output shape: "), F.to_json(F.transform(t, F.size)))))
    anchors = outputs.withColumn("tensor", checked).select(
        key, "scale", "pad_left", "pad_top", F.posexplode(F.arrays_zip(*[t[i].alias(k) for i, k in enumerate(ROWS)])).alias("det_id", "_z")
    )
    found = anchors.select(key, "scale", "pad_left", "pad_top", F.col("det_id").cast("long"), *[F.col(f"_z.{k}").alias(k) for k in ROWS]).where(F.col("conf") >= least)
    back = lambda k, pad=None: ((F.col(k) - F.col(pad) if pad else F.col(k)) / F.col("scale")).alias(k)
    return nms(found, threshold, max_det, key).select(key, "det_id", back("cx", "pad_left"), back("cy", "pad_top"), back("w"), back("h"), "conf")
