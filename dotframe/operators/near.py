"""Joins of things that lie near each other on one page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-6


def meet(
    a: DataFrame, b: DataFrame, hit: Column, at: tuple[Column, Column], reach: tuple[Column, Column], place: tuple[str, str], how: str = "inner", key: str = "page_id"
) -> DataFrame:
    """Rows of ``a`` with the rows of ``b`` of the same key (there named _k)
    for which ``hit`` holds; a hit lies nearer to ``at`` than ``reach`` along
    both axes (or as near), and ``place`` names its coordinates in b.

    Squares as wide as twice the farthest reach of a page: a row of a is in
    one, a row of b in the two along each axis that it can be reached from. So
    a page with many cells costs its neighbours and not its square, and its
    squares go to different tasks.
    """
    far = a.groupBy(key).agg(*[F.greatest(F.max(r) * (1 + TINY), F.lit(TINY)).alias(n) for r, n in zip(reach, ("_rx", "_ry"))])
    square = lambda v, r: F.floor(v / (2 * F.col(r)))
    left = a.join(far, key).withColumn("_gx", square(at[0], "_rx")).withColumn("_gy", square(at[1], "_ry")).drop("_rx", "_ry")
    span = lambda v, r: F.explode(F.sequence(square(F.col(v) - F.col(r), r), square(F.col(v) + F.col(r), r)))
    x, y = place
    right = b.join(far.withColumnRenamed(key, "_k"), "_k").where(F.col(x).isNotNull() & F.col(y).isNotNull())
    right = right.withColumn("_hx", span(x, "_rx")).withColumn("_hy", span(y, "_ry")).drop("_rx", "_ry")
    on = (F.col(key) == F.col("_k")) & (F.col("_gx") == F.col("_hx")) & (F.col("_gy") == F.col("_hy")) & hit
    return left.join(right, on, how).drop("_k", "_gx", "_gy", "_hx", "_hy")
