"""Exact and near copies against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import components, exact_dedup, near_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute_near(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_classes(corpus, documents, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_classes(documents, width=width, percent=percent).collect()}
    assert got == brute_near(corpus, width, percent)


def test_a_hot_group_around_the_threshold(spark):
    """Many copies of one text, some linked with it, some just not, some only with each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    far = list(base)
    for k in range(10, 24):
        far[k] = f"y{k}"
    rows += [(200 + i, " ".join([*far[: 60 + i], "z", *far[61 + i :]])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_classes(df, width=3, percent=85).collect()}
    assert got == brute_near(rows, 3, 85)


def near(spark, rows, width=3, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_classes(df, width=width, percent=percent).collect()]


@pytest.mark.parametrize("block", [512, 40])
def test_a_large_group_that_no_star_joins(spark, monkeypatch, block):
    """Many texts that are all a little below the threshold from each other, and some chains of links among them."""
    monkeypatch.setattr(near_dedup, "PAIRED", 8)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(4), 3) + rng.sample(range(8, 100, 6), 3):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
        if i % 7 == 0:
            rows.append((1000 - i, " ".join([*words[:95], "end", "of", "it"])))
    want = brute_near(rows, 3, 85)
    assert 20 < len({c for _, c, _ in want.values()}) < len(rows)
    assert {i: x for i, *x in near(spark, rows)} == {i: list(x) for i, x in want.items()}


def test_tiles_hold_only_sets_that_may_be_linked(spark, monkeypatch, tmp_path):
    """Texts with a rare passage in common, most of them far apart: their sets are not dealt to a tile for each of its shingles."""
    monkeypatch.setattr(near_dedup, "PAIRED", 8)
    plain, counts = near_dedup._tiles, tmp_path / "counts"
    counts.mkdir()

    def counting(percent):
        run = plain(percent)

        def counted(batches):
            for batch in batches:
                (counts / str(uuid.uuid4())).write_text(str(batch.num_rows))
                yield batch

        return lambda batches: run(counted(batches))

    monkeypatch.setattr(near_dedup, "_tiles", counting)
    rng = random.Random(9)
    shared = [[f"p{i}w{k}" for k in range(40)] for i in range(8)]
    rows = []
    for i in range(120):
        words = sum((shared[k] for k in sorted(rng.sample(range(8), 4))), [f"f{i % 10}w{k}" for k in range(40)])
        rows.append((i, " ".join(words)))
        if i % 7 == 0:
            rows.append((1000 - i, " ".join([*words, "end"])))
    assert {i: tuple(x) for i, *x in near(spark, rows)} == brute_near(rows, 3, 85)
    assert sum(int(x.read_text()) for x in counts.iterdir()) < 3 * len(rows)


def test_tile_open():
    """Two members stay if they are of different components, may reach the threshold and share nothing rarer."""
    rng = np.random.default_rng(3)
    slots = np.ones(64, np.int64)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = []
    for _ in range(40):
        h = base.copy()
        at = rng.choice(len(h), rng.integers(1, 40), replace=False)
        h[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.sort(h))
    component = np.arange(40) // 2
    linked = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    heads = [near_dedup.head(h, slots, 85) for h in sets]
    met = set()
    for shingle in np.unique(np.concatenate(heads)):
        has = [i for i in range(40) if shingle in heads[i]]
        rank = np.array([int(np.flatnonzero(heads[i] == shingle)[0]) for i in has])
        before = [heads[i][:r] for i, r in zip(has, rank.tolist(), strict=True)]
        at = near_dedup.tile_open(rank, component[has], np.array([len(sets[i]) for i in has]), [near_dedup._parity(sets[i]) for i in has], before, 85)
        stay = [has[i] for i in at.tolist()]
        met |= {(i, j) for i in stay for j in stay}
    wanted = {(i, j) for i, j in linked if component[i] != component[j]}
    assert wanted and wanted <= met


def test_tile_links():
    rng = np.random.default_rng(2)
    base = np.arange(300, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.06, rng.integers(300, 340, 300), base)).astype(np.uint64) for _ in range(60)] + [np.arange(10**6 + 50 * i, 10**6 + 50 * i + 40, dtype=np.uint64) for i in range(5)]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    links = near_dedup.tile_links(sets, 85)
    assert {(max(x), min(x)) for x in links} <= want
    roots = list(range(len(sets)))
    for some in (want, links):
        labels = list(range(len(sets)))
        for a, b in some:
            labels = [labels[a] if x == labels[b] else x for x in labels]
        groups = {frozenset(i for i in roots if labels[i] == x) for x in labels}
        assert some is want and (first := groups) or groups == first


def test_rows_that_repeat_an_id_keep_all_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, ""), (4, "alone")]
    got = sorted(near(spark, rows))
    assert [(i, c, k) for i, _, c, k in got] == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]


def test_low_thresholds_and_long_texts(spark, corpus):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    rows = [*corpus[:40], (5000, " ".join(words)), (5001, " ".join(words[3000:])), (5002, "y" * 6_000_000), (5003, " ".join(words[:20_000]))]
    got = {i: tuple(x) for i, *x in near(spark, rows, 5, 60)}
    assert got == brute_near(rows, 5, 60)


def test_guaranteed_distance():
    """Signatures that differ in at most 2 * chunks - 1 symbols share a key, wherever the errors lie."""
    rng = np.random.default_rng(0)
    chunks = 6
    import pyarrow as pa

    for _ in range(200):
        a = rng.integers(0, 1 << 16, chunks * near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(len(a), 2 * chunks - 1, replace=False)
        b[at] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["rep", "sig"])
        keys = [tuple(k) for out in near_dedup._keys(chunks)([batch]) for k in [out.column(0).to_pylist()]]
        assert any(x == y for x, y in keys)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(70, 80), (80, 75), (90, 90)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 70: 70, 80: 70, 75: 70}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(corpus, documents, keep):
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    want = {}
    for t, ids in groups.items():
        best = (max if keep == "max" else min)(ids)
        want |= {i: (best, len(ids), i == best, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(documents, keep=keep).collect()}
    assert got == want


def test_dropping_keeps_columns_and_one_of_repeated_rows(documents):
    twice = documents.union(documents)
    left = exact_dedup.drop_exact_copies(twice)
    assert left.columns == documents.columns
    assert Counter((r.text or "") for r in left.collect()).most_common(1)[0][1] == 1
    near = near_dedup.drop_near_copies(documents)
    assert near.columns == documents.columns


def test_no_rows(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert near_dedup.near_classes(empty).count() == 0


def test_cuckoo_index_against_a_dictionary():
    rng = random.Random(0)
    index, model = exact_dedup.CuckooIndex(4), {}
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(900)]
    as_keys = lambda some: np.frombuffer(b"".join(some), np.uint64).reshape(-1, 4)
    for step in range(400):
        some = rng.sample(digests, rng.choice([1, 1, 3, 40]))
        at = index.find(as_keys(some))
        assert [(index.kept[i], index.copies[i]) if i >= 0 else None for i in at] == [model.get(d) for d in some]
        if rng.random() < 0.3:
            assert index.delete(as_keys(some)).tolist() == [model.pop(d, None) is not None for d in some]
            continue
        ids = np.array([rng.randrange(1000) for _ in some])
        index.add(as_keys(some), ids, np.ones(len(some), bool), np.full(len(some), 2), larger=True)
        for d, i in zip(some, ids.tolist(), strict=True):
            had = model.get(d, (-1, 0))
            model[d] = (max(i, had[0]), had[1] + 2)
        if step % 50 == 0:
            index = exact_dedup.CuckooIndex.from_bytes(index.to_bytes())
    keys, kept, known, copies = index.entries()
    assert index.resizes > 0 and index.live == len(model) == len(keys) and known.all()
    assert {k.tobytes(): (i, n) for k, i, n in zip(keys, kept.tolist(), copies.tolist(), strict=True)} == model
    assert not index.delete(np.zeros((1, 4), np.uint64))[0]


def test_cuckoo_hits_are_verified():
    """Digests of one fingerprint and one bucket are told apart by the bucket's content; a full bucket makes room."""
    keys = np.tile(np.array([[5, 1, 0, 0]], np.uint64), (30, 1))
    keys[:, 3] = np.arange(30)
    index = exact_dedup.CuckooIndex(4)
    half = keys[:6]
    index.insert(half, np.arange(6), np.ones(6, bool), np.ones(6, np.int64))
    assert (index.find(half) >= 0).all()
    assert (index.find(keys[6:]) == -1).all()


def test_index_is_inserted_into_deleted_from_and_reopened(spark):
    def batch(texts):
        return spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", exact_dedup.digest_of(F.col("text")).alias("digest"))

    def live(index):
        return sorted((r.kept, r.copies) for r in index.entries().collect())

    index = exact_dedup.DigestIndex.create(spark, 10)
    index.insert(batch([(1, "a"), (2, "a"), (3, "b"), (None, "c")]))
    index.insert(batch([(9, "a"), (4, "d"), (5, "c")]))
    assert live(index) == [(3, 1), (4, 1), (5, 2), (9, 3)]
    index.delete(batch([(None, "a"), (None, "never seen")]))
    again = exact_dedup.DigestIndex.reopen(spark, index.path, index.shards, index.version)
    assert live(again) == [(3, 1), (4, 1), (5, 2)]
    again.insert(batch([(7, "a")]))
    assert live(again) == [(3, 1), (4, 1), (5, 2), (7, 1)]


def test_exact_groups_of_repeated_and_null_ids(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (None, "a", "x"), (None, "b", "x"), (None, "b", "x"), (2, None, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 2, True), (None, None, 2, True), (2, 3, 2, False), (3, 3, 2, True)], key=str)
    assert sorted((str(r.doc_id), r.text) for r in exact_dedup.drop_exact_copies(df).collect()) == [("1", "a"), ("3", ""), ("None", "b")]
