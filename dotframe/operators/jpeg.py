"""A baseline JPEG writer in numpy: no subsampling, and code tables made for
each image, so that no library of codecs is needed to write crops and tiles."""

from __future__ import annotations

import heapq
import struct

import numpy as np

_K = np.arange(8)
COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)
#: Places of a block in the order of its diagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
#: Steps grow with the frequency, and faster for colour.
STEPS = [8 + 5 * (_K[:, None] + _K[None, :]), 10 + 9 * (_K[:, None] + _K[None, :])]


def _quantisers(quality: int) -> list[np.ndarray]:
    scale = 50 / quality if quality < 50 else 2 - quality / 50
    return [np.clip(np.rint(s * scale), 1, 255).astype(int) for s in STEPS]


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of each number's magnitude."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _code(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(table segment's counts and symbols, code and length by symbol): Huffman
    codes of at most 16 bits; one code stays free, as all ones are not allowed."""
    used = np.unique(symbols)
    heap = [(int(n), i, (int(s),)) for i, (s, n) in enumerate(zip(used, np.bincount(symbols)[used]))] + [(0, -1, (256,))]
    depth = dict.fromkeys([*map(int, used), 256], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            depth[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    of = np.bincount(list(depth.values()), minlength=18)
    for n in range(len(of) - 1, 16, -1):  # too long ones: two go up to where one comes down
        while of[n] > 0:
            j = n - 2
            while of[j] == 0:
                j -= 1
            of[n] -= 2
            of[n - 1] += 1
            of[j + 1] += 2
            of[j] -= 1
    last = max(n for n in range(1, 17) if of[n])
    of[last] -= 1  # the free one
    ranked = sorted(map(int, used), key=lambda s: (depth[s], s))
    code, length, value, k = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for n in range(1, 17):
        for s in ranked[k : k + of[n]]:
            code[s], length[s] = value, n
            value += 1
        k += of[n]
        value <<= 1
    return bytes(of[1:17].tolist()) + bytes(ranked), code, length


def encode(rgb: np.ndarray, quality: int = 92) -> bytes:
    """JPEG file of an (h, w, 3) image in 0..255."""
    h, w = rgb.shape[:2]
    v = np.pad(rgb.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    luma = v @ np.array([0.299, 0.587, 0.114])
    planes = [luma - 128, (v[..., 2] - luma) / 1.772, (v[..., 0] - luma) / 1.402]
    tables = _quantisers(quality)
    blocks = []
    for i, p in enumerate(planes):
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        blocks.append(np.rint(COSINES @ b @ COSINES.T / tables[min(i, 1)]).astype(np.int64).reshape(-1, 64)[:, ZIGZAG])
    coefficients = np.stack(blocks, axis=1).reshape(-1, 64)  # component after component of each block
    dc = coefficients[:, 0].reshape(-1, 3)
    dc = np.diff(dc, axis=0, prepend=np.zeros((1, 3), np.int64)).ravel()
    # Of each place that isn't 0: zeros before it, 16 at a time as a symbol of their own.
    block, at = np.nonzero(coefficients[:, 1:])
    value = coefficients[block, at + 1]
    before = np.where(np.r_[True, block[1:] != block[:-1]], 0, np.r_[0, at[:-1] + 1]) if len(at) else at
    run = at - before
    many = run // 16
    long_b, long_at = np.repeat(block, many), np.repeat(at, many)
    top = np.full(len(coefficients), -1)
    np.maximum.at(top, block, at)
    ends = np.flatnonzero(top < 62)
    n = len(coefficients)
    key = np.r_[np.arange(n) * 256, long_b * 256 + 2 * long_at + 1, block * 256 + 2 * at + 2, ends * 256 + 255]
    symbol = np.r_[_size(dc), np.full(len(long_b), 0xF0), (run % 16) << 4 | _size(value), np.zeros(len(ends), np.int64)]
    number = np.r_[dc, np.zeros(len(long_b), np.int64), value, np.zeros(len(ends), np.int64)]
    kind = np.r_[np.zeros(n, np.int64), np.ones(len(symbol) - n, np.int64)]
    order = np.argsort(key, kind="stable")
    symbol, number, kind = symbol[order], number[order], kind[order]
    coded = [_code(symbol[kind == k]) for k in (0, 1)]
    code, length = (np.where(kind == 0, coded[0][j][symbol], coded[1][j][symbol]) for j in (1, 2))
    extra = np.where(kind == 0, symbol, symbol & 15)
    number = np.where(number < 0, number + (1 << extra) - 1, number)
    token, bits = code << extra | number, length + extra
    of = np.repeat(np.arange(len(token)), bits)
    place = np.arange(len(of)) - np.repeat(np.cumsum(bits) - bits, bits)
    stream = ((token[of] >> (bits[of] - 1 - place)) & 1).astype(np.uint8)
    stream = np.packbits(np.r_[stream, np.ones(-len(stream) % 8, np.uint8)]).tobytes().replace(b"\xff", b"\xff\0")

    def segment(marker: int, body: bytes) -> bytes:
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(segment(0xDB, bytes([i, *t.reshape(-1)[ZIGZAG].tolist()])) for i, t in enumerate(tables))
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3)))
    out += b"".join(segment(0xC4, bytes([k << 4]) + coded[k][0]) for k in (0, 1))
    out += segment(0xDA, b"\3" + b"".join(bytes([i + 1, 0]) for i in range(3)) + b"\0\x3f\0")
    return out + stream + b"\xff\xd9"
