"""Repeated windows of a fixed number of tokens, found without a row for every window.

Every window of ``depth`` tokens is dealt by its anchor: the least (by hash, then leftmost) of the
``depth - k + 1`` runs of ``k`` tokens inside it.  Equal windows have equal anchors at equal
places, so windows can only repeat where anchors do.  One row stands for an anchor and all windows
dealt by it - about one row in ``(depth - k + 2) / 2`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import flat
from .flat import POWERS_TOO, U

_POS = 22  # low bits of a sliding minimum that hold a position; a chunk has fewer tokens than 2**_POS


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def anchors(one: np.ndarray, two: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray, depth: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of windows in a flat run of tokens, given by two independent 64-bit values each.

    Segment i has tokens [lo, hi) and asks for the windows starting in [first, last).  Returns, per anchor:
    segment, position, first and last start of its windows, hash of its k tokens, hash of its
    surroundings (every token that a window dealt by it could hold), and 16 bits each of the hashes of the
    ``(depth - k) // 2`` tokens before and after it: every window dealt by it holds one of these halves.
    """
    last = np.minimum(last, hi - depth + 1)
    good = np.flatnonzero(last > first)
    if not len(good):
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.int64, U, U, np.int32))
    pre, pre_two = flat.prefix(one), flat.prefix(two, POWERS_TOO)
    at = np.arange(len(one) - k + 1)
    grams = flat.ranged(pre, at, at + k)
    low = U((1 << _POS) - 1)
    least = sliding_min((grams & ~low) | at.astype(U), depth - k + 1)
    n = (last - first)[good]
    seg = np.repeat(good, n)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + first[seg]
    pos = (least[start] & low).astype(np.int64)
    new = np.ones(len(pos), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (seg[1:] != seg[:-1])
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(pos)] - 1
    seg, pos = seg[begin], pos[begin]
    left, right = np.maximum(lo[seg], pos - (depth - k)), np.minimum(hi[seg], pos + depth)
    around = flat.ranged(pre_two, left, right, POWERS_TOO) ^ flat.mix((pos - left).astype(U) * U(0x2545F4914F6CDD1D))
    half = (depth - k) // 2
    halves = []
    for a, b in ((np.maximum(lo[seg], pos - half), pos), (pos + k, np.minimum(hi[seg], pos + k + half))):
        halves.append(flat.ranged(pre_two, a, b, POWERS_TOO) & U(0xFFFF))
    return seg, pos, start[begin], start[end], grams[pos], around, ((halves[0] << U(16)) | halves[1]).astype(np.uint32).view(np.int32)


def spans(length: int, depth: int, k: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Parts of one long row: (from, to) of the tokens to load and the [first, last) starts asked for."""
    for first in range(0, max(length - depth + 1, 0), size):
        last = min(first + size, length - depth + 1)
        yield max(0, first - depth), min(length, last + 2 * depth), first, last


def window_digests(one: np.ndarray, two: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window of ``depth`` tokens."""
    return flat.ranged(flat.prefix(one), start, start + depth), flat.ranged(flat.prefix(two, POWERS_TOO), start, start + depth, POWERS_TOO)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the spans [start, end)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0
