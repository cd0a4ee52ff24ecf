"""Token ids of a byte-level BPE vocabulary for every text of a corpus.

Pre-tokenisation finds piece boundaries without a regular expression: each
code point has a class, each class is a transition function on a small set of
states, and an associative scan composes these functions over blocks of the
concatenated texts. Pieces are slices of the text; each distinct piece is
merged once per worker and then looked up. The slices' offsets are retained, so
that every token knows the bytes of the text that it stands for.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK = 256
CHUNK_CHARS = 1 << 20
CACHE_PIECES = 1 << 19

# Classes of code points.
SEP, SPACE, BLANK, NUMBER, OTHER, QUOTE, LETTER, ONE, TWO = range(9)
# States: nothing to attach to, after a space, in letters, in numbers, in
# others, after a quote that begins a piece, within and after a contraction.
FRESH, SPACED, LETTERS, NUMBERS, OTHERS, QUOTED, HALF, DONE = range(8)
# Code points that are white space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions are a quote with one of these letters or pairs.
SINGLE, PAIRS = "stmd", ("re", "ve", "ll")


def vocabulary_path(name: str = DEFAULT_VOCABULARY, folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, or where the installed
    public tokenizers are."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, which are the order of merges too."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_classes: np.ndarray | None = None


def _newer(table: np.ndarray) -> None:
    """Letters and numbers that are newer than this Python's Unicode data: as
    the public tokenizers' own pre-tokeniser takes them. Both libraries are
    needed: without them a worker would give other ids, so it fails."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    unknown = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn")
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for c in regex.findall(r"[\p{L}\p{N}]", unknown):
        for kind, beside in ((LETTER, "a"), (NUMBER, "1")):
            if len(split(beside + c)) == 1:
                table[ord(c)] = kind


def class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        _newer(t)
        t[WHITE] = BLANK
        t[0x20], t[ord("'")] = SPACE, QUOTE
        t[[ord(c) for c in SINGLE]] = ONE
        _classes = t
    return _classes


def _transitions() -> np.ndarray:
    """Next state by class and state."""
    t = np.empty((9, 8), dtype=np.uint8)
    t[SEP], t[SPACE], t[BLANK], t[NUMBER], t[OTHER] = FRESH, SPACED, FRESH, NUMBERS, OTHERS
    t[QUOTE] = QUOTED
    t[QUOTE, [SPACED, OTHERS, QUOTED]] = OTHERS
    for c in (LETTER, ONE, TWO):
        t[c] = LETTERS
        t[c, HALF] = DONE
    t[ONE, QUOTED], t[TWO, QUOTED] = DONE, HALF
    return t


def _continues() -> np.ndarray:
    """Whether a code point of a class, not white space, goes on with the
    piece of the state before it."""
    t = np.zeros((9, 8), dtype=bool)
    for c in (LETTER, ONE, TWO):
        t[c, [LETTERS, SPACED, HALF]] = True
    t[[ONE, TWO], QUOTED] = True
    t[NUMBER, [NUMBERS, SPACED]] = True
    t[OTHER, [OTHERS, QUOTED, SPACED]] = True
    t[QUOTE, [OTHERS, QUOTED, SPACED]] = True
    return t


NEXT, CONTINUES = _transitions(), _continues()


def scan_states(cls: np.ndarray) -> np.ndarray:
    """State before each code point. Blocks compose their transition functions
    apart from each other, a doubling scan composes the blocks, and each block
    then runs from its known first state."""
    n = len(cls)
    nb = max(1, -(-n // BLOCK))
    grid = np.zeros(nb * BLOCK, dtype=np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(nb, BLOCK).T)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (nb, 8))
    for row in grid:
        whole = NEXT[row[:, None], whole]
    step = 1
    while step < nb:
        later = np.take_along_axis(whole[step:], whole[:-step].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:step], later])
        step *= 2
    state = np.r_[np.uint8(FRESH), whole[:-1, FRESH]]
    out = np.empty((BLOCK, nb), dtype=np.uint8)
    for j, row in enumerate(grid):
        out[j] = state
        state = NEXT[row, state]
    return out.T.reshape(-1)[:n]


def piece_starts(cps: np.ndarray, sep: np.ndarray) -> np.ndarray:
    """Positions at which pieces start; ``sep`` are the positions between
    texts, each a piece of its own."""
    cls = class_table()[cps]
    cls[sep] = SEP
    after = np.r_[cps[1:], 0]
    for pair in PAIRS:
        cls[(cps == ord(pair[0])) & (after == ord(pair[1])) & (cls == LETTER)] = TWO
    state = scan_states(cls)
    white = (cls == SPACE) | (cls == BLANK)
    before, behind = np.r_[False, white[:-1]], np.r_[white[1:], False]
    ends = np.r_[cls[1:] == SEP, True]
    start = ~CONTINUES[cls, state]
    start[white] = (~before | (~behind & ~ends))[white]
    return np.flatnonzero(start)


class Merger(dict):
    """piece -> tuple of ids; merges a piece the first time it is met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = merge(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def merge(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Byte pair merging, lowest rank and then leftmost first: a heap of
    adjacent pairs over a linked list, so that long pieces stay fast."""
    if data in ranks:
        return (ranks[data],)
    n = len(data)
    part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def offer(i: int) -> None:
        j = right[i]
        if j >= 0 and (rank := ranks.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (rank, i, j, part[i] + part[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if part[i] is None or part[j] is None or right[i] != j or part[i] + part[j] != both:
            continue
        part[i], part[j] = both, None
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return tuple(ranks[p] for p in part if p is not None)


def _segments(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    """(text number, segment): long texts are cut where white space begins,
    which always begins a piece."""
    for k, text in enumerate(texts):
        if not text:
            continue
        at = 0
        while len(text) - at > CHUNK_CHARS:
            end = at + CHUNK_CHARS
            while end < len(text) and not (ord(text[end]) in _WHITE and ord(text[end - 1]) not in _WHITE):
                end += 1
            yield k, text[at:end]
            at = end
        if at < len(text):
            yield k, text[at:]


_WHITE = frozenset(WHITE)


def utf8_lengths(cps: np.ndarray) -> np.ndarray:
    """Bytes of each code point; one for a lone surrogate, which is replaced."""
    n = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    n[(cps >= 0xD800) & (cps < 0xE000)] = 1
    return n


def encode_texts(texts: list[str | None], merger: Merger, sizes_of: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(ids of all texts in a row, where each text's ids begin and end), and
    with ``sizes_of`` (bytes of each token by id) the byte of its text at which
    each token begins."""
    counts, ids, begins = np.zeros(len(texts), dtype=np.int64), [], []
    done = np.zeros(len(texts), dtype=np.int64)  # bytes of the segments of a text so far

    def run(group: list[tuple[int, str]]) -> None:
        joined = "\0".join(s for _, s in group)
        cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sep = np.cumsum([len(s) + 1 for _, s in group])[:-1] - 1
        starts = piece_starts(cps, sep)
        bounds = [*starts.tolist(), len(joined)]
        drop = np.searchsorted(starts, sep)  # each separator is a piece
        pieces = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        for d in reversed(drop.tolist()):
            del pieces[d]
        merged = [merger[p] for p in pieces]
        new = np.fromiter(chain.from_iterable(merged), dtype=np.int32)
        ids.append(new)
        many = np.fromiter(map(len, merged), dtype=np.int64, count=len(merged))
        sizes = np.r_[0, np.cumsum(many)]
        edges = np.r_[0, drop - np.arange(len(drop)), len(pieces)]
        texts_of = np.array([k for k, _ in group])
        if sizes_of is not None:
            # Where a piece's slice lies in its text, and a token in its piece.
            at = np.r_[0, np.cumsum(utf8_lengths(cps))]
            origin = at[np.r_[0, sep + 1]]
            before = []  # of the segments of a text that this group holds, too
            for (k, _), a, b in zip(group, origin, at[np.r_[sep, len(cps)]]):
                before.append(done[k])
                done[k] += b - a
            place = np.delete(at[starts], drop) + np.repeat(np.array(before) - origin, np.diff(edges))
            upto = np.r_[0, np.cumsum(sizes_of[new])]
            begins.append(np.repeat(place - upto[sizes[:-1]], many) + upto[:-1])
        np.add.at(counts, texts_of, sizes[edges[1:]] - sizes[edges[:-1]])

    group, held = [], 0
    for k, s in _segments(texts):
        if group and held + len(s) > CHUNK_CHARS:
            run(group)
            group, held = [], 0
        group.append((k, s))
        held += len(s) + 1
    if group:
        run(group)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    out = join(ids, np.int32), np.r_[0, np.cumsum(counts)]
    return out if sizes_of is None else (*out, join(begins, np.int64))


def decode(ids, tokens: dict[int, bytes]) -> str:
    return b"".join(tokens[i] for i in ids).decode("utf-8")


def token_ids(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each text without special tokens, whose strings
    are ordinary text. An empty and a null text give an empty list; every row
    gives one row. ``vocabulary`` is the path of a rank file, read once by the
    driver (its size is that of the vocabulary) and handed to the workers."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or vocabulary_path()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks.value)
        for batch in batches:
            ids, bounds = encode_texts(batch.column(1).to_pylist(), merger)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "ids"])

    some = documents.select(key, text)
    return some.mapInArrow(encode, f"`{key}` {some.dtypes[0][1]}, ids array<int>")


def encoded(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, begins): token_ids with the byte of the text at which each
    token begins, from the offsets of the pre-tokeniser's slices."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary or vocabulary_path()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(ranks.value)
        sizes_of = np.zeros(max(ranks.value.values()) + 1, dtype=np.int64)
        for token, i in ranks.value.items():
            sizes_of[i] = len(token)
        for batch in batches:
            ids, bounds, begins = encode_texts(batch.column(1).to_pylist(), merger, sizes_of)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x) for x in (pa.array(ids, pa.int32()), pa.array(begins, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "ids", "begins"])

    some = documents.select(key, text)
    return some.mapInArrow(encode, f"`{key}` {some.dtypes[0][1]}, ids array<int>, begins array<bigint>")


def decoded(tokens: DataFrame, vocabulary: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text): the text of each list of ids, every token put at the byte
    where it begins (``begins``, see encoded). Null where tokens leave a gap or
    lie over each other."""
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            texts = []
            for ids, begins in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = [by_id[i] for i in ids or []]
                out, filled = bytearray(sum(map(len, parts))), True
                for at, part in zip(begins or [], parts):
                    filled &= 0 <= at <= len(out) - len(part) and not any(out[at : at + len(part)])
                    out[at : at + len(part)] = part
                # A zero byte is a gap, unless the tokens hold as many themselves.
                filled &= out.count(0) == sum(p.count(0) for p in parts) and len(begins or []) == len(parts)
                texts.append(out.decode("utf-8", "replace") if filled else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    some = tokens.select(key, "ids", "begins")
    return some.mapInArrow(run, f"`{key}` {some.dtypes[0][1]}, text string")
