"""A sample whose share of each category follows given targets.

Swap repair: records are grouped by category signature, a random
floor-satisfying sample is drawn at the level of signature counts, counts are
exchanged between signatures while that lowers the deviation from the targets,
and the final counts are materialised by each signature's smallest hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dotframe.session import staged

HASH_BUCKETS = 8192
MAX_SIGNATURES = 1 << 16
PAIRS = 512


def pattern_column(bits6: str = "bits6", label_int: str = "label_int") -> Column:
    """The pattern of a manifest row as an integer 1..63, or null."""
    good = F.col(bits6).rlike(r"\A[01]{6}\z") & (F.col(bits6) != "000000")
    by_bits = F.when(good, F.expr(f"cast(conv(reverse({bits6}), 2, 10) as int)"))
    by_label = F.when(F.col(label_int).between(1, 63), F.col(label_int).cast("int"))
    return (
        F.when(by_bits.isNull(), by_label)
        .when(by_label.isNull() | (by_bits == by_label), by_bits)
    )


def distinct_crops(manifest: DataFrame, *columns: str) -> DataFrame:
    """One row per crop_id with the given columns. Rows without a crop_id
    count once per distinct path, page and cell."""
    other = F.when(F.col("crop_id").isNull(), F.xxhash64("path", "page_id", "cell_idx"))
    return (
        manifest.select("crop_id", other.alias("_other"), *columns)
        .groupBy("crop_id", "_other")
        .agg(*[F.first(c).alias(c) for c in columns])
    )


@dataclass
class SamplePlan:
    """Signatures (a category of each column) with their counts, and per
    category of each column what there is, what is wanted and the floor."""

    columns: list[str]
    signatures: list[tuple]
    available: np.ndarray
    drawn: np.ndarray
    wanted: dict[str, dict]

    def per_category(self, column: str) -> list[tuple]:
        """(category, named, available, wanted, floor, drawn) in order."""
        at = self.columns.index(column)
        have, drawn = Counter(), Counter()
        for sig, n, d in zip(self.signatures, self.available, self.drawn):
            have[sig[at]] += int(n)
            drawn[sig[at]] += int(d)
        of = self.wanted[column]
        return [(k, k in of, have[k], *of.get(k, (0, 0)), drawn[k]) for k in sorted({*have, *of})]


def _spread(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """n records drawn at random, without return, from room[i] of each kind:
    systematic sampling of the kinds in random order from a random start, so
    that each kind gets its share, rounded up or down by chance."""
    total = int(room.sum())
    n = min(n, total)
    if n <= 0:
        return np.zeros_like(room)
    order = rng.permutation(len(room))
    start = rng.random()
    ends = [0]
    for upto in np.cumsum(room[order]).tolist():  # whole numbers: exact at any size
        whole, rest = divmod(upto * n, total)
        ends.append(whole + (rest / total > start))
    out = np.zeros_like(room)
    out[order] = np.diff(ends)
    return np.minimum(out, room)


def swap_repair(
    available: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, seed: int = 0, signatures: np.ndarray | None = None
) -> np.ndarray:
    """Drawn counts per signature, adding up to min(size, all).

    ``signatures[i]`` holds the categories (indices into target and floor) of
    signature i, one a column; by default each signature is a category.

    Starts from a random sample that holds min(floor, available) of each
    category, then moves records from one signature to another, each time the
    pair and number that lower the sum of squared deviations from the targets
    most, until no exchange lowers it. Categories with target 0 give before
    all others and take after them. Floors are never undercut. Of more than
    PAIRS signatures those with the largest and smallest deviations are paired
    first, and where none of these lowers the sum, all others, block by block.
    """
    available, target = available.astype(np.int64), target.astype(np.int64)
    sig = np.arange(len(available))[:, None] if signatures is None else signatures
    count = lambda x: np.bincount(sig.ravel(), np.repeat(x, sig.shape[1]), minlength=len(target)).astype(np.int64)
    least = np.minimum(floor.astype(np.int64), count(available))
    rng = np.random.default_rng(seed)
    size = int(min(size, available.sum()))
    drawn = np.zeros_like(available)
    for c in np.argsort(count(available), kind="stable"):  # rare categories first
        of = np.flatnonzero((sig == c).any(axis=1))
        drawn[of] += _spread(rng, (available - drawn)[of], int(least[c] - count(drawn)[c]))
    if drawn.sum() > size:  # floors alone don't fit: all give way
        drawn = np.floor(drawn * (size / drawn.sum())).astype(np.int64)
        least = np.minimum(least, count(drawn))
    drawn += _spread(rng, available - drawn, size - int(drawn.sum()))
    last = np.where(target > 0, 0, int(available.sum()) + 1)
    while True:
        now = count(drawn)
        over, slack = now - target + last, now - least
        pull = 2 * over[sig].sum(axis=1)
        gives = np.flatnonzero((drawn > 0) & ((slack[sig] > 0).all(axis=1) if sig.shape[1] == 1 else True))
        takes = np.flatnonzero(drawn < available)
        gives = gives[np.argsort(-pull[gives], kind="stable")]
        takes = takes[np.argsort(pull[takes], kind="stable")]
        for a, b in _blocks(len(gives), len(takes)):
            if pull[gives[a]] <= pull[takes[b]]:
                continue  # nor does any pair of the block gain
            g, t = gives[a : a + PAIRS], takes[b : b + PAIRS]
            differ = sig[g][:, None, :] != sig[t][None, :, :]
            change = 2 * differ.sum(axis=2)
            spare = np.where(differ, slack[sig[g]][:, None, :], np.iinfo(np.int64).max).min(axis=2)
            fall = pull[g][:, None] - pull[t][None, :]
            n = np.maximum(1, fall // np.maximum(2 * change, 1))
            n = np.minimum(np.minimum(n, spare), np.minimum(drawn[g][:, None], (available - drawn)[t][None, :]))
            gain = np.where((fall > change) & (change > 0) & (n > 0), n * (fall - n * change).astype(float), 0.0)
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] > 0:
                drawn[g[i]] -= n[i, j]
                drawn[t[j]] += n[i, j]
                break
        else:
            return drawn


def _blocks(n: int, m: int) -> Iterator[tuple[int, int]]:
    """Where blocks of PAIRS by PAIRS of n givers and m takers begin, the
    largest deviations first."""
    rows, cols = -(-n // PAIRS), -(-m // PAIRS)
    for k in range(rows + cols - 1 if rows and cols else 0):
        for i in range(max(0, k - cols + 1), min(k + 1, rows)):
            yield i * PAIRS, (k - i) * PAIRS


def _counts(crops: DataFrame, columns: list[str]) -> dict[tuple, int]:
    """{signature: records}; size-checked by the number of signatures."""
    known = crops.dropna(subset=columns)
    rows = known.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).limit(MAX_SIGNATURES + 1).collect()
    if len(rows) > MAX_SIGNATURES:
        raise ValueError(f"more than {MAX_SIGNATURES} category signatures")
    return {tuple(r[:-1]): r[-1] for r in rows}


def plan_sample(crops: DataFrame, targets: dict[str, DataFrame], divisor: int = 5, seed: int = 0) -> SamplePlan:
    """Plans a sample of N div ``divisor`` of the records with a category in
    every column of ``targets``.

    A column's targets: the category, target_bp (1/10,000), min_rows; both
    null as 0. Repeated rows of one category add up their shares and keep the
    largest floor. Categories without a target have target and floor 0 and
    only fill up what the others can't supply.
    """
    columns = list(targets)
    have = _counts(crops, columns)
    size = sum(have.values()) // divisor
    wanted = {}
    for c, t in targets.items():
        rows = t.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum(F.coalesce("target_bp", F.lit(0))), F.max(F.coalesce("min_rows", F.lit(0))))
        named = rows.limit(MAX_SIGNATURES + 1).collect()
        if len(named) > MAX_SIGNATURES:
            raise ValueError(f"more than {MAX_SIGNATURES} targets of {c}")
        wanted[c] = {r[0]: (max(r[1] * size // 10_000, r[2]), r[2]) for r in named}
    signatures = sorted(have)
    index = {k: i for i, k in enumerate((c, v) for at, c in enumerate(columns) for v in sorted({*wanted[c], *(s[at] for s in signatures)}))}
    goal = np.array([wanted[c].get(v, (0, 0)) for c, v in index], dtype=np.int64).reshape(-1, 2)
    available = np.array([have[s] for s in signatures], dtype=np.int64)
    sig = np.array([[index[c, v] for c, v in zip(columns, s)] for s in signatures], dtype=np.int64).reshape(-1, len(columns))
    drawn = swap_repair(available, goal[:, 0], goal[:, 1], size, seed, sig) if signatures else available
    return SamplePlan(columns, signatures, available, drawn, wanted)


def report(crops: DataFrame, targets: dict[str, DataFrame], column: str, divisor: int = 5, seed: int = 0, key: str = "crop_id") -> DataFrame:
    """One row per category of ``column``: whether it is named by a target,
    records there are, wanted (the larger of target share and floor), floor,
    drawn and left (the records of the drawn sample, counted, and those outside
    it). ``met`` is false where the sample doesn't reach what is wanted and what
    is left can't make up for it. An empty table meets every target of 0."""
    plan = plan_sample(crops, targets, divisor, seed)
    return _reached(plan, materialise(crops, plan, key, seed), column)


def reports(crops: DataFrame, targets: dict[str, DataFrame], divisor: int = 5, seed: int = 0, key: str = "crop_id") -> DataFrame:
    """``report`` of every column of one sample: column, category (as text) and
    the rest."""
    plan = plan_sample(crops, targets, divisor, seed)
    drawn = staged(materialise(crops, plan, key, seed).select(*plan.columns), "sample")
    out = None
    for c in plan.columns:
        part = _reached(plan, drawn, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("category"), "named", "available", "wanted", "min_rows", "drawn", "left", "met")
        out = part if out is None else out.unionByName(part)
    return out


def _reached(plan: SamplePlan, sampled: DataFrame, column: str) -> DataFrame:
    kind = dict(sampled.dtypes)[column]
    rows = sampled.sparkSession.createDataFrame(
        [r[:5] for r in plan.per_category(column)], f"`{column}` {kind}, named boolean, available long, wanted long, min_rows long"
    )  # as many as there are categories
    drawn = sampled.groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("drawn"))
    return (
        rows.join(drawn, F.col(column).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("left", F.col("available") - F.col("drawn"))
        .withColumn("met", F.col("drawn") + F.when(F.col("drawn") < F.col("wanted"), F.col("left")).otherwise(0) >= F.col("wanted"))
    )


def draw(crops: DataFrame, targets: dict[str, DataFrame], key: str = "crop_id", divisor: int = 5, seed: int = 0) -> DataFrame:
    """The sampled records themselves."""
    return materialise(crops, plan_sample(crops, targets, divisor, seed), key, seed)


def materialise(crops: DataFrame, plan: SamplePlan, key: str = "crop_id", seed: int = 0) -> DataFrame:
    """Of each signature its planned number of records, those with the smallest
    hash bucket of ``key`` and then the smallest hash. Exact at any size and
    without one task per signature: counts of buckets find the bucket in which a
    signature's last record lies; lower ones are taken whole, without a shuffle,
    and only that bucket is ordered."""
    kinds = dict(crops.dtypes)
    names = [f"_c{i}" for i in range(len(plan.columns))]
    wanted = crops.sparkSession.createDataFrame(
        [(*s, i, int(d)) for i, (s, d) in enumerate(zip(plan.signatures, plan.drawn)) if d > 0],
        ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, plan.columns)) + ", _sig long, _n long",
    )
    match = [F.col(c) == F.col(n) for c, n in zip(plan.columns, names)]
    hashed = (
        crops.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
        .withColumn("_bucket", F.pmod("_h", F.lit(HASH_BUCKETS)))
        .join(F.broadcast(wanted), match)  # at most MAX_SIGNATURES rows
    )
    upto = W.partitionBy("_sig").orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (
        hashed.groupBy("_sig", "_n", "_bucket").agg(F.count(F.lit(1)).alias("_k"))
        .withColumn("_upto", F.sum("_k").over(upto))  # HASH_BUCKETS rows a signature
        .where("_upto >= _n")
        .groupBy(F.col("_sig").alias("_esig")).agg(F.min(F.struct(F.col("_bucket").alias("at"), (F.col("_n") - F.col("_upto") + F.col("_k")).alias("left"))).alias("_edge"))
    )
    inside = hashed.join(F.broadcast(last), F.col("_sig") == F.col("_esig"))  # at most MAX_SIGNATURES rows
    order = W.partitionBy("_sig").orderBy("_h", key)
    edge = inside.where("_bucket = _edge.at").withColumn("_rank", F.row_number().over(order)).where("_rank <= _edge.left").drop("_rank")
    return inside.where("_bucket < _edge.at").unionByName(edge).select(*crops.columns)
