"""Repeated byte strings and word windows against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from millrace.llm import flat, substring_dedup, suffix_dedup, windows

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_bytes(rows, depth):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            if w in seen:
                gone[s : s + depth] = b"\1" * depth
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, depth):
    seen, words = {}, {}
    for i, t in rows:
        words[i] = w = WORD.findall((t or "").encode())
        for s in range(len(w) - depth + 1):
            key = tuple(w[s : s + depth])
            seen[key] = seen.get(key, 0) + 1
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - depth + 1):
            if seen[tuple(w[s : s + depth])] > 1:
                gone[s : s + depth] = [True] * depth
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize(("depth", "k"), [(100, 32), (40, 40), (30, 7)])
def test_bytes(corpus, documents, depth, k):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(documents, depth=depth, k=k).collect()}
    assert got == brute_bytes(corpus, depth)


@pytest.mark.parametrize("group", [1, 3, 4096])
def test_bytes_in_groups_of_any_size(corpus, documents, monkeypatch, group):
    """Groups too large for a task change no result."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    want = brute_bytes(corpus, 60)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(documents, depth=60, k=20).collect()}
    assert got == want


def test_radix_passes_find_equal_suffixes():
    rng = np.random.default_rng(5)
    for depth in (1, 7, 8, 9, 20, 100):
        data = rng.integers(97, 99, 3000, dtype=np.uint8)
        data[1000:1300] = data[200:500]
        data[2000:2300] = data[210:510]
        at = rng.permutation(len(data) - depth + 1)
        group = rng.integers(0, 2, len(at))
        index, name = suffix_dedup.radix_sorted(data, at, group, depth)
        places: dict[tuple, list] = {}
        for i, (a, g) in enumerate(zip(at.tolist(), group.tolist(), strict=True)):
            places.setdefault((g, data[a : a + depth].tobytes()), []).append(i)
        found: dict[int, list] = {}
        for i, n in zip(index.tolist(), name.tolist(), strict=True):
            found.setdefault(n, []).append(i)
        assert [found[n] for n in sorted(found)] == [places[p] for p in sorted(places) if len(places[p]) > 1]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_groups_are_whole_in_batches_of_any_size(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "SORTED", size)
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 99, 12, dtype=np.uint8)) for _ in range(60)]
    key = np.sort(rng.integers(0, 9, 60))
    doc = np.arange(60)
    table = pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(np.zeros(60, np.int64)), pa.array(np.full(60, 4, np.int32)), pa.array(texts, pa.binary())], names=["key", "doc_id", "first", "back", "held"])
    parts = [table.slice(a, 7) for a in range(0, 60, 7)]
    got = sorted((d, f) for b in suffix_dedup._passes(8)(iter(parts)) for d, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    seen, want = set(), []
    for i in range(60):
        for f in range(5):
            w = (int(key[i]), f, texts[i][f : f + 8])
            if w in seen:
                want.append((i, f))
            seen.add(w)
    assert got == sorted(want)


@pytest.mark.parametrize(("depth", "k", "batches"), [(35, 10, 3), (12, 5, 4), (6, 6, 1)])
def test_words(corpus, documents, depth, k, batches):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(documents, depth=depth, k=k, batches=batches).collect()}
    assert got == brute_words(corpus, depth)


def test_no_rows(empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(flat, "CHUNK", 1 << 20)
    rng = np.random.default_rng(3)
    part = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes().decode()
    filler = rng.integers(97, 123, 3 << 20, dtype=np.uint8).tobytes().decode()
    rows = [(1, part), (2, filler[: 1 << 20] + part + filler[1 << 20 :])]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, 5000, 1)
    assert got[2].kept_sha256 == hashlib.sha256(filler.encode()).hexdigest()


def test_every_window_is_dealt_once():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 2000).astype(np.uint8)
    lo, hi = np.array([0, 700]), np.array([700, 2000])
    seg, pos, first, last, *_ = windows.anchors(flat.BYTE[data], flat.BYTE_TOO[data], lo, hi, lo, hi, 50, 12)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    assert starts.tolist() == [*range(651), *range(700, 1951)]
    assert ((pos >= first) & (pos <= first + 38) & (pos >= last)).all()


def test_sliding_minimum():
    x = np.random.default_rng(2).integers(0, 99, 300)
    for w in (1, 2, 5, 8, 69):
        assert windows.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(300 - w + 1)]


def test_a_long_unbroken_tail_stays_in_its_text():
    """A text without white space after the place of its cut, and another text right behind it."""
    import pyarrow as pa

    long = "one " + "x" * (4 * flat.CHUNK + 5000)
    data, offsets = flat.texts(pa.array([long, "y two three", long]))
    parts = list(flat.pieces(data, 0, int(offsets[1])))
    assert parts[-1][1] == offsets[1]
    assert all(a <= b for a, b in parts)
    h, start, end, rows = flat.word_hashes(data, offsets)
    assert np.diff(rows).tolist() == [2, 3, 2]
    assert h[:2].tolist() == h[-2:].tolist()
    assert (end[rows[1:] - 1] <= offsets[1:]).all()


def test_repeated_and_null_ids(spark):
    """Equal rows of one id: each is a row of the result; rows without an id are none."""
    rng = np.random.default_rng(11)
    word = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    text = " ".join(word(5) for _ in range(60))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (3, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for out, size in ((suffix_dedup.suffix_dedup(table), "n_bytes"), (substring_dedup.substring_dedup(table), "n_words")):
        got = sorted((r.doc_id, r[size] > 0, r.n_removed > 0) for r in out.collect())
        assert [g[:2] for g in got] == [(1, True), (1, True), (2, True), (3, False), (3, False)]
        assert got[2][2]  # the same text under another id is a repeat
