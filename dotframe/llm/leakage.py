"""Documents that hold all or part of held-out passages.

All word shingles of the passages are the seeds that find candidate
documents; a Smith-Waterman alignment of words scores each candidate, edited
and paraphrased copies too, and gives the longest unbroken run of shared words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotframe.session import spread, staged

SHINGLE = 5
RUN = 12
#: Words kept on both sides of a document's first and last hit.
MARGIN = 64
#: Bits of the filter for each shingle of the passages, and the most it has: a
#: filter that is full lets more through, and loses nothing.
BLOOM_SHARE, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 20, 1 << 29
BLOOM_HASHES = 3
MATCH, MISMATCH, GAP = 2, -1, -2
#: Words of passages that stand side by side in one alignment.
SIDE_BY_SIDE = 1 << 15

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 19:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


def shingle_hashes(ws: list[str], hashes: dict) -> np.ndarray:
    """64-bit hash of each SHINGLE consecutive words."""
    n = len(ws) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _bits(grams: np.ndarray, n_bits: int) -> list[np.ndarray]:
    return [(grams >> np.uint64(20 * k)) % np.uint64(n_bits) for k in range(BLOOM_HASHES)]


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, at, gram) of all shingles of the passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            ids, at, grams = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g = shingle_hashes(words(text), hashes)
                ids += [i] * len(g)
                at += range(len(g))
                grams.append(g)
            g = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(g.view(np.int64))], ["item_id", "at", "gram"])

    return items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, at int, gram long")


def bloom_size(n_shingles: int) -> int:
    """Bits of a filter for so many shingles: a power of 2."""
    return min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_SHARE * n_shingles).bit_length()))


def bloom(grams: DataFrame, n_bits: int) -> np.ndarray:
    """A filter of n_bits bits; it lets too much through when full, and never
    too little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), n_bits)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], ["cell", "mask"])

    cells = grams.select("gram").mapInArrow(run, "cell long, mask long").groupBy("cell").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(n_bits // 64, dtype=np.uint64)  # at most n_bits / 64 rows come to the driver
    out[cells["cell"].to_numpy(dtype=np.int64)] = cells["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def corpus_hits(documents: DataFrame, filter_bits: np.ndarray) -> DataFrame:
    """Documents with shingles that pass the filter: doc_id, text_key (equal
    for copies), the shingles' hashes, and the words from the first to the last
    with a margin. One pass over the whole texts, nothing else leaves it."""
    shared = documents.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = _Hashes(), shared.value
        for batch in batches:
            ids, keys, grams, begins, passages = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ws = words(text)
                g = shingle_hashes(ws, hashes)
                ok = np.ones(len(g), dtype=bool)
                for b in _bits(g, 64 * len(bits)):
                    ok &= (bits[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
                hit = np.flatnonzero(ok)
                if len(hit):
                    lo, hi = max(0, hit[0] - MARGIN), hit[-1] + SHINGLE + MARGIN
                    ids.append(i)
                    keys.append(xxhash.xxh3_128_digest(text.encode("utf-8", "replace")))
                    grams.append(np.unique(g[hit].view(np.int64)))
                    begins.append(lo)
                    passages.append(" ".join(ws[lo:hi]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array(begins, pa.int32()), pa.array(passages, pa.string())],
                ["doc_id", "text_key", "grams", "begins", "passage"],
            )

    some = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    return some.mapInArrow(run, "doc_id long, text_key binary, grams array<long>, begins int, passage string")


def reachable(known: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Most that an alignment within each passage can score: a word that the
    item lacks costs at least a mismatch. known: whether the item has a word."""
    worth = np.where(known, MATCH, MISMATCH)
    total = np.cumsum(worth)
    before = total - worth
    # Each passage starts afresh: lifted by more than all before it can differ.
    lift = np.repeat(np.arange(len(starts)) * (4 * len(known) + 4), np.diff(np.r_[starts, len(known)]))
    low = np.minimum.accumulate(before - lift) + lift
    return np.maximum(np.maximum.reduceat(total - low, starts), 0)


def align_all(a: np.ndarray, passages: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """Smith-Waterman of one sequence of words with each of many, all of them
    side by side in one row of the matrix: best score, the place at which that
    alignment ends (the first of equals), longest run of equal words, words of
    ``a`` matched by runs of SHINGLE or more. Passages aren't empty."""
    starts = np.cumsum([0, *(len(p) + 1 for p in passages)])[:-1]  # each behind a separator
    b = np.full(starts[-1] + len(passages[-1]) + 1, -2, dtype=np.int32)
    for s, p in zip(starts, passages):
        b[s + 1 : s + 1 + len(p)] = p
    of = np.repeat(np.arange(len(passages)), np.diff(np.r_[starts, len(b)]))
    ramp = (-GAP * np.arange(len(b)) + of * (MATCH * len(a) + 1)).astype(np.int64)
    ramp = ramp.astype(np.int32) if ramp[-1] < 1 << 30 else ramp
    h, t, best = (np.zeros(len(b), dtype=ramp.dtype) for _ in range(3))
    run = np.zeros(len(b), dtype=np.int32)
    runs = np.zeros((len(a), len(passages)), dtype=np.int32)
    for i, x in enumerate(a):
        eq = b == x
        t[1:] = h[:-1] + np.where(eq[1:], ramp.dtype.type(MATCH), ramp.dtype.type(MISMATCH))
        np.maximum(t, h + GAP, out=t)
        np.maximum(t, 0, out=t)
        t[starts] = 0
        np.maximum.accumulate(t + ramp, out=h)  # gaps along b
        h -= ramp
        np.maximum(best, h, out=best)
        run[1:] = (run[:-1] + 1) * eq[1:]
        run[0] = 0
        runs[i] = np.maximum.reduceat(run, starts)
    score = np.maximum.reduceat(best, starts)
    place = np.where(best == score[of], np.arange(len(b)) - starts[of], len(b))
    end = np.minimum.reduceat(place, starts)
    covered = np.zeros((len(a) + 1, len(passages)), dtype=np.int32)
    row, col = np.nonzero(runs >= SHINGLE)
    np.add.at(covered, (row - runs[row, col] + 1, col), 1)
    np.add.at(covered, (row + 1, col), -1)
    covered = (np.cumsum(covered, axis=0) > 0).sum(axis=0)
    return list(zip(score.tolist(), end.tolist(), runs.max(axis=0, initial=0).tolist(), covered.tolist()))


def _aligner(least_score: int):
    names = ["text_key", "item_id", "item_words", "score", "longest_run", "covered_words", "ends_at"]
    kinds = [pa.binary(), *[pa.int64()] * 6]

    def one_item(item: str, rows: list[dict], out: list[tuple]) -> None:
        a = words(item)
        number = {w: i for i, w in enumerate(dict.fromkeys(a))}
        coded = [np.fromiter((number.get(w, -1) for w in r["passage"].split(" ")), dtype=np.int32) for r in rows]
        starts = np.cumsum([0, *map(len, coded)])[:-1]
        some = np.flatnonzero(reachable(np.concatenate(coded) >= 0, starts) >= least_score)
        if not len(some):
            return
        got = align_all(np.array([number[w] for w in a], dtype=np.int32), [coded[k] for k in some])
        for k, (score, end, longest, covered) in zip(some, got):
            if score >= least_score:
                out.append((rows[k]["text_key"], rows[k]["item_id"], len(a), score, longest, covered, rows[k]["begins"] + end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            group: list[dict] = []
            wide = 0
            for r in batch.to_pylist():
                if group and (r["item_id"] != group[0]["item_id"] or wide > SIDE_BY_SIDE):
                    one_item(group[0]["item"], group, out)
                    group, wide = [], 0
                group.append(r)
                wide += len(r["passage"]) // 4
            if group:
                one_item(group[0]["item"], group, out)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    return run


def leaks(documents: DataFrame, items: DataFrame, least_score: int = MATCH * RUN, n_bits: int | None = None) -> DataFrame:
    """Pairs of a document and a passage whose alignment scores least_score or
    more: item_words, score, longest_run, covered_words (of the passage, in
    shared runs of five or more), ends_at (word of the document at which the
    best alignment ends).

    Null, empty and blank texts hold nothing; rows without an id are left out.
    Every document and passage that share SHINGLE consecutive words are aligned,
    however many other documents hold them, but for those whose words can't
    score so much in any order; those that share RUN are always found (their
    score is at least MATCH * RUN). A pair without SHINGLE shared words in a row
    isn't aligned. Copies of a text are aligned once.
    """
    shingles = staged(item_shingles(items), "item-shingles")
    hits = staged(corpus_hits(documents, bloom(shingles, n_bits or bloom_size(shingles.count()))), "hits")
    texts = hits.dropDuplicates(["text_key"])
    found = (
        texts.select("text_key", F.explode("grams").alias("gram"))
        .join(shingles.select("item_id", "gram").distinct(), "gram").select("text_key", "item_id").distinct()
    )
    passages = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.collect_set("text").alias("items"))
    ready = (
        found.join(passages.select("item_id", F.explode("items").alias("item")), "item_id")
        .join(texts.select("text_key", "begins", "passage"), "text_key")
    )
    # Spread by both, so that neither a passage nor a text makes one task's work alone.
    side_by_side = spread(ready.select("text_key", "item_id", "item", "begins", "passage"), "text_key", "item_id").sortWithinPartitions("item_id", "item")
    scored = side_by_side.mapInArrow(
        _aligner(least_score), "text_key binary, item_id long, item_words long, score long, longest_run long, covered_words long, ends_at long"
    )
    return hits.select("doc_id", "text_key").join(scored, "text_key").drop("text_key").distinct()
