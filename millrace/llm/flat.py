"""Whole texts of an Arrow batch as flat byte arrays: words, hashes and slices without a Python loop per word.

All hashes are 64-bit: a polynomial over per-byte random words modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_TOO = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MULT, MULT_TOO = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, mult: int) -> None:
        self.mult, self.up, self.down = mult, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            room = max(n, 2 * len(self.up))
            for name, m in (("up", self.mult), ("down", pow(self.mult, -1, 1 << 64))):
                x = np.full(room, m, U)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


POWERS, POWERS_TOO = Powers(MULT), Powers(MULT_TOO)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


def prefix(values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


def ranged(pre: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Mixed hash of each [start, end) from prefix sums; equal content and length give equal hashes."""
    h = (pre[end] - pre[start]) * powers.get(len(pre))[1][start]
    return mix(h + (end - start).astype(U) * U(0x8CB92BA72F3D8DD7))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each; a longer row makes a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte [start, end) of every maximal run of bytes outside space and 0x09-0x0D; rows end words."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[data], out=inside[1:-1])
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | row[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | row[1:])) + 1
    return start, end


def pieces(data: np.ndarray, a: int, b: int, size: int = 4 * CHUNK) -> Iterator[tuple[int, int]]:
    """[a, b) cut at white space into parts of about ``size`` bytes, so that a very long text is
    hashed in bounded memory; a word longer than that stays whole."""
    while b - a > size:
        at = a + size
        while at < b and not SPACE[data[at : min(at + 4096, b)]].any():
            at += 4096
        at = b if at >= b else at + int(np.argmax(SPACE[data[at : min(at + 4096, b)]]))
        yield a, at
        a = at
    yield a, b


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of every row, and the row offsets into these arrays; ``size`` bytes, about, are hashed at once."""
    table = BYTE_LOWER if lower else BYTE
    hashes, starts, ends = [], [], []
    for a, b in chunks(offsets, size):
        for lo, hi in pieces(data, int(offsets[a]), int(offsets[b]), 4 * size):
            part = data[lo:hi]
            inner = offsets[a : b + 1] if (lo, hi) == (offsets[a], offsets[b]) else np.array([lo, hi])
            s, e = word_bounds(part, inner - lo)
            hashes.append(ranged(prefix(table[part]), s, e))
            starts.append(s + lo)
            ends.append(e + lo)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, U), start, join(ends, np.int64), np.searchsorted(start, offsets)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
