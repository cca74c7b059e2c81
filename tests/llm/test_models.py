"""Quality, language model, neighbours, mixing, packing and token files."""

from __future__ import annotations

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import flat, lm_score, mixing, neighbours, packing, quality, token_file

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BPE = public_tokenizers.path("byte_bpe_50k.json")


# quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.97
    assert rows[rows.quality == 1].predicted.mean() > 0.97
    assert rows[rows.quality == 0].predicted.mean() < 0.06
    assert rows.score.between(0, 1).all()


def test_quality_reads_no_held_out_label(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_quality_edges(documents, empty, spark):
    labels = documents.select("doc_id", F.lit(1).alias("quality"))
    assert quality.quality_scores(documents, labels).count() == documents.count()
    assert quality.quality_scores(empty, labels).count() == 0
    none = quality.quality_scores(documents, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_risk_stays_non_negative():
    rng = np.random.default_rng(0)
    x = np.zeros((400, quality.DIM))
    x[:, 0] = 1
    x[np.arange(400), rng.integers(1, 40, 400)] = 1
    p = x[:40]
    w = quality.fit(x.T @ x, p.T @ p, 400, 40, 0.95)
    g, gp = x @ w, p @ w
    assert ((1 + g) ** 2).mean() / 4 - 0.95 * ((1 + gp) ** 2).mean() / 4 > -1e-6


# language model


def test_base_scores_and_model(corpus, documents):
    tokens = {i: [*WORD.findall((t or "").encode().translate(LOW)), b"\n"] for i, t in corpus}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = lm_score.lm_scores(documents).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_rare_and_frequent_words_score_alike(documents, monkeypatch):
    """A word scored in the join has the score it has when every task knows it."""
    every = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.lm_scores(documents).collect()}
    monkeypatch.setattr(lm_score, "FREQUENT", 1.0)
    joined = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm_score.lm_scores(documents).collect()}
    assert joined == every


def test_tree_gives_distributions():
    rng = np.random.default_rng(4)
    symbols = np.where(rng.random(20_000) < 0.5, rng.integers(3, 8, 20_000), 3)
    symbols[1::2] = symbols[::2]  # every second symbol repeats the one before
    windows, _, _ = lm_score.windows_of(symbols, np.array([0, len(symbols)]), lm_score.END)
    counts = [np.unique(windows & ((1 << lm_score.BITS * (d + 1)) - 1), return_counts=True) for d in range(lm_score.DEPTH + 1)]
    tree = lm_score.build_tree(counts, 5)
    assert len(tree.states[1]) > 1
    for context in (0, 3, 4, (3 << 10) | 4, (4 << 10) | 4, (1000 << 10) | 7):
        p = 10 ** tree.score((context << lm_score.BITS) | np.arange(1, 8))
        assert p.sum() == pytest.approx(1)


@pytest.fixture(scope="module")
def spoken():
    """Texts of fewer than 1,000 words, with pairs and triples that recur; words that few texts have, and unknown ones."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(400):
        w = rng.zipf(1.4, 60) % 500
        w[1::3] = (w[::3] * 7 + 1) % 500  # a word that its predecessor foretells
        out.append((i, " ".join(f"w{x}" for x in w)))
    return [*out, (400, "w1 w8 w3 never seen w1 w8"), (401, ""), (402, None)]


def whole_tree_scores(rows):
    """Scores by the in-memory tree of all words and all contexts that occur twice."""
    texts = [[*(w.decode() for w in WORD.findall((t or "").encode().translate(LOW)))] for _, t in rows]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    words = sorted({w for ws, known in zip(texts, train, strict=True) if known for w in ws})
    symbol = {w: lm_score.FIRST + k for k, w in enumerate(words)}
    assert len(words) < 1000

    def windows(ws):
        return lm_score.windows_of(np.array([symbol.get(w, lm_score.OTHER) for w in ws], np.int64), np.array([0, len(ws)]), lm_score.END)[0]

    learnt = np.concatenate([windows(ws) for ws, known in zip(texts, train, strict=True) if known])
    counts = []
    for d in range(lm_score.DEPTH + 1):
        key, n = np.unique(learnt & ((1 << lm_score.BITS * (d + 1)) - 1), return_counts=True)
        context, inverse = np.unique(key >> lm_score.BITS, return_inverse=True)
        often = (np.bincount(inverse, n) >= 2)[inverse] if d else np.ones(len(key), bool)
        counts.append((key[often], n[often]))
    tree = lm_score.build_tree(counts, len(words))
    assert len(tree.states[1]) > 100
    assert len(tree.states[2])
    return {i: tree.score(windows(ws)).sum() for (i, _), ws in zip(rows, texts, strict=True)}


@pytest.mark.parametrize("bucket", [1 << 19, 900])
def test_every_word_and_every_recurring_context_counts(spark, spoken, monkeypatch, bucket):
    """Scores are those of the tree over all words, however positions are dealt; in small buckets some words are hot."""
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(spoken, "doc_id long, text string")).collect()}
    want = whole_tree_scores(spoken)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("share", [1e-3, 1.0])
def test_hot_words_score_alike(spark, spoken, monkeypatch, share):
    """Scores do not depend on which words every task knows, hot ones included."""
    monkeypatch.setattr(lm_score, "BUCKET", 900)
    monkeypatch.setattr(lm_score, "FREQUENT", share)
    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(spoken, "doc_id long, text string")).collect()}
    assert got == pytest.approx(whole_tree_scores(spoken))


def test_counts_after_a_hot_word_are_sent_once_to_a_group(spark, spoken, monkeypatch):
    """A pair of words is told to each task that reads it, not to each of the task's buckets."""
    monkeypatch.setattr(lm_score, "BUCKET", 1500)
    plain, sent = lm_score.cut, []

    def counting(df, name, *partition_by):
        out = plain(df, name, *partition_by)
        if name == "facts":
            pairs = out.where("w <> 0")
            sent.append((pairs.count(), pairs.select("w", "s").distinct().count()))
        return out

    monkeypatch.setattr(lm_score, "cut", counting)
    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(spoken, "doc_id long, text string")).collect()}
    assert got == pytest.approx(whole_tree_scores(spoken))
    [(rows, pairs)] = sent
    assert rows == pairs > 100


@pytest.mark.parametrize("together", [1, 2, 100])
def test_groups_of_buckets_score_alike(spark, spoken, monkeypatch, together):
    monkeypatch.setattr(lm_score, "BUCKET", 300)
    monkeypatch.setattr(lm_score, "TOGETHER", together)
    got = {r.doc_id: r.score for r in lm_score.lm_scores(spark.createDataFrame(spoken, "doc_id long, text string")).collect()}
    assert got == pytest.approx(whole_tree_scores(spoken))


def test_groups_of():
    got = lm_score.groups_of(3, np.array([2, 9, 17])).tolist()
    assert got == sorted(got)
    assert [got.count(x) for x in range(got[-1] + 1)] == [1, 1, 1, 2, 5, 4, 6, 6, 5]
    assert lm_score.groups_of(1, np.zeros(0, np.int64)).tolist() == [0]


def test_frequent_words_are_placed_apart():
    """No bucket gets several of the words that would fill it, however their hashes fall."""
    sizes = np.array([700.0, 10, 400, 390, 380, 120, 110, 100, 90, 600])
    own = sizes > 500
    at = lm_score.places(sizes, own, 4)
    assert sorted(at[own].tolist()) == [4, 5]
    assert np.bincount(at[~own].astype(int), sizes[~own], 4).max() == 420
    assert lm_score.places(np.zeros(0), np.zeros(0, bool), 4).tolist() == []


def test_lm_groups_keys_in_parts():
    rng = np.random.default_rng(5)
    for key in (flat.mix(rng.integers(0, 150_000, 400_000).astype(flat.U)), rng.integers(-90_000, 90_000, 300_000), np.full(200_000, 7, flat.U), np.zeros(0, flat.U)):
        unique, place, which = lm_score.grouped(key)
        assert unique.dtype == key.dtype and sorted(unique.tolist()) == np.unique(key).tolist()
        assert (unique[which] == key).all() and (key[place] == unique).all()


def test_lm_bucket_memory():
    """A bucket is scored in bounded memory: 250 bytes for each of its positions, and nothing of it stays in the sums."""
    code = """
import re, sys
import numpy as np, pyarrow as pa
from millrace.llm import flat, lm_score as L

def mb(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

few, n = np.zeros(0, flat.U), 30_000
hashes = flat.mix(np.arange(200_002, dtype=flat.U))
order = np.argsort(hashes)
model = L.Model(hashes[order], order.astype(np.int32), hashes, np.full(len(hashes), 9.0), 1, 1e7, few, few, few, few, few, few, few, few, np.zeros(1, np.int32))
rng, blocks = np.random.default_rng(1), []
for k in range(20):
    codes = [rng.integers(2, 200_002, n).astype(np.int32) for _ in range(L.DEPTH + 1)]
    x = L.Positions([hashes[c] for c in codes], codes, np.arange(n) // 20)
    blocks.append(L._block(x, np.arange(n), 1500 * k + np.arange(1500), np.zeros(1500, bool)))
del x, codes
before = mb("VmRSS")
sums = list(L.score_bucket(blocks, L.facts_of(few, few, few), model))
print(mb("VmHWM") - before, sum(x.num_rows for x in sums), len(blocks))
"""
    taken, rows, left = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert float(taken) < 250 * 600_000 / 2**20 + 30
    assert (rows, left) == ("30000", "0")


def test_lm_no_rows(empty):
    assert lm_score.lm_scores(empty).count() == 0


# neighbours


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:80] = x[50]
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] + [1.0] * 15, 0), (1003, [None] + [1.0] * 15, 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [float("inf")] * 16, 0), (1008, [1.0, 2.5], 0)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")


def test_neighbours_are_exact(vectors):
    x, df = vectors
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    big = x.astype(float)
    for q in range(0, 300, 50):
        d = np.sqrt(((big[q] - big) ** 2).sum(1))
        want = [int(j) for j in np.lexsort((np.arange(300), d)) if j != q][:10]
        assert [(r, j, s) for r, j, s in sorted(got[q])] == [(n + 1, j, d[j]) for n, j in enumerate(want)]
    assert set(got) == set(range(0, 300, 50))


@pytest.mark.parametrize(("queries", "room", "values"), [(1, 1, 256), (7, 1 << 12, 512), (1 << 14, 64 << 20, 1 << 18)])
def test_neighbours_in_little_room(vectors, monkeypatch, queries, room, values):
    """Heaps that make room, blocks quantised anew and small tiles change no result."""
    for name, value in (("HELD_QUERIES", queries), ("BLOCK_VALUES", values), ("QUERY_VALUES", values)):
        monkeypatch.setattr(neighbours, name, value)
    x, _ = vectors
    big = x.astype(float)
    tables = []
    batches = []
    for a in range(0, 300, 40):
        for b in range(0, 300, 25):
            ids = lambda u, v: np.arange(u, min(v, 300), dtype=np.int64)
            q, c = ids(a, a + 40), ids(b, b + 25)
            tables.append((16, q.tobytes(), big[q].tobytes(), c.tobytes(), big[c].tobytes()))
    columns = [list(z) for z in zip(*tables, strict=True)]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    batches.append(pa.RecordBatch.from_arrays([pa.array(z, t) for z, t in zip(columns, kinds, strict=True)], names=["dim", "qid", "qx", "cid", "cx"]))
    held = neighbours.Quantised(room)
    assert all(np.array_equal(held.get((q, x_), np.frombuffer(x_).reshape(-1, 16))[0], neighbours.quantised(np.frombuffer(x_).reshape(-1, 16))[0]) for _, q, x_, _, _ in tables)
    assert len(held.blocks) >= 1 and (held.held <= room or len(held.blocks) == 1)
    found: dict[int, set] = {}
    for batch in neighbours._tiles(10)(iter(batches)):
        for q, v, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(q, set()).add((d, v))
    for q in range(300):
        d = np.sqrt(((big[q] - big) ** 2).sum(1))
        want = [(d[j], int(j)) for j in np.lexsort((np.arange(300), d)) if j != q][:10]
        assert sorted(found[q])[:10] == want


def test_repeated_ids_are_candidates_each(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.0]), (2, [3.0, 0.0]), (None, [1.0, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 2).collect()
    assert {r.vec_id for r in got} == {1} and min(r.score for r in got) == 0.0


def test_other_dimensions_and_few_candidates(vectors):
    _, df = vectors
    got = neighbours.nearest(df, F.col("vec_id") == 1005).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1008, 0.5)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 40)) * 3, rng.normal(size=(200, 40))
    i, j = neighbours.tile_survivors(neighbours.quantised(q), neighbours.quantised(c), 5, np.zeros((20, 200), bool))
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    d = ((q[:, None] - c[None]) ** 2).sum(2)
    assert all((a, int(b)) in kept for a in range(20) for b in np.argsort(d[a])[:5])
    assert len(kept) < 1000


# mixing


def test_mixing_rates(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "b").alias("source"), F.lit("x").alias("mix"))
    out = mixing.mix(df, {"hot": 1, "b": 2, None: 1})
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    for source, share in (("hot", 0.25), ("b", 0.5), (None, 0.25)):
        assert got[source] == pytest.approx(6000 * share, rel=0.1)
    assert set(df.columns) < set(out.columns)
    assert mixing.mix(df, {"b": 1}).select("source").distinct().collect()[0][0] == "b"
    assert mixing.mix(df, {}).count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_a_mixed_table_is_mixed_again(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"))
    once = mixing.mix(df)
    again = mixing.mix(once)
    assert again.columns == once.columns
    assert again.count() > 0


def test_poisson_counts(spark):
    for rate in (0.3, 4.0, 700.0):
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source")).union(spark.createDataFrame([(10**6 + i, "b") for i in range(int(4000 * rate) if rate < 1 else 4)], "doc_id long, source string"))
        total = df.count()
        share = rate * 4000 / total
        if share >= 1:
            share = rate * 4 / total
            name = "b"
        else:
            name = "a"
        other = "a" if name == "b" else "b"
        n = mixing.mix(df, {name: share, other: 1 - share}).where(F.col("source") == name).select("doc_id", "mix_copies").distinct().agg(F.sum("mix_copies")).first()[0] or 0
        expected = share * total
        assert abs(n - expected) < 5 * math.sqrt(expected) + 1


def test_mixing_by_size_and_plan(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 30).otherwise(10).alias("size"))
    out = mixing.mix(df, size_col="size").groupBy("source").agg(F.sum("size").alias("s")).collect()
    assert {r.source: r.s for r in out} == {"a": pytest.approx(20_000, rel=0.15), "b": pytest.approx(20_000, rel=0.15)}
    text = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


# packing


def test_packing_loses_nothing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 5, 300, 512, 700, 1500, 4096, 9000, None, -3])) for i in range(500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), run_rows=128).collect()
    total = Counter()
    bins = {}
    for r in got:
        total[r.doc_id] += r.length
        bins.setdefault(r.bin_id, []).append(r)
    assert total == {i: n for i, n in rows if n and n > 0}
    for b in bins.values():
        at = sorted((r.bin_offset, r.length) for r in b)
        assert at[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(at[:-1], at[1:], strict=True))
        used = at[-1][0] + at[-1][1]
        assert {r.bin_used for r in b} == {used}
        assert {r.bin_length for r in b} == {min(c for c in packing.CAPACITIES if c >= used)}


def test_packing_fills_bins():
    lengths = np.random.default_rng(0).integers(20, 1500, 3000)
    bins, _, sizes, used = packing.pack_run(lengths)
    assert sum(used) == lengths.sum()
    assert sum(used) / sum(sizes) > 0.97
    assert len(set(bins.tolist())) == len(sizes)


def plain_best_fit(lengths, capacities=packing.CAPACITIES, overhead=packing.OVERHEAD):
    """The rule, step by step: (length, use) of each bin and the bin of each piece."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    room, used, bin_of = [], [], {}
    for at, i in enumerate(order):
        n = lengths[i]
        fits = [(space, b) for b, space in enumerate(room) if space >= n]
        if fits:
            b = min(fits)[1]
        else:
            costs = []
            for cap in (c for c in sorted(capacities) if c >= n):
                filled = n
                for k in order[at + 1 :]:
                    if filled + lengths[k] <= cap:
                        filled += lengths[k]
                costs.append(((cap + overhead) / filled, cap))
            b = len(room)
            room.append(min(costs, key=lambda x: x[0])[1])
            used.append(0)
        room[b] -= n
        used[b] += n
        bin_of[i] = b
    return [(min(c for c in capacities if c >= u), u) for u in used], bin_of


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([1, 7, 100, 511, 512, 513, 900, 2048, 4096], 150) if seed % 2 else rng.integers(1, 4097, 150)
    bins, _, sizes, used = packing.pack_run(lengths)
    want, bin_of = plain_best_fit(lengths.tolist())
    assert list(zip(sizes, used, strict=True)) == want
    assert dict(enumerate(bins.tolist())) == bin_of


def test_packed_sequences_hold_the_token_ids(spark, corpus, documents, empty):
    tokenizer = Tokenizer.from_file(BPE)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_file.END_ID] for i, t in corpus}
    placed = packing.pack_texts(documents, BPE)
    got = {i: {} for i in ids}
    for b in packing.sequences(placed, packing.token_table(documents, BPE)).collect():
        assert len(b.ids) == b.bin_used <= b.bin_length
        for p in b.pieces:
            got[p.id][p.piece] = b.ids[p.offset : p.offset + p.length]
    assert {i: [x for _, part in sorted(parts.items()) for x in part] for i, parts in got.items()} == ids
    assert any(len(x) > 4096 for x in ids.values())
    assert packing.pack_texts(empty, BPE).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id is not None, r.length) for r in packing.pack_texts(twice, BPE).collect()) == [(False, 2), (True, 1), (True, 3), (True, 3)]


def test_packing_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


# token files


def test_encoder_is_the_library():
    rng = random.Random(1)
    parts = ["a", "b", "é", "ß", " ", " ", "  ", "\n", "\t", "'s", "'t", "'re", "'ll", "'", "''", "!", "1", "23", ".", "don't", "'should", "l", "re", "\r\n", "×", "ñ", "<|endoftext|>", "日", " "]
    texts = ["".join(rng.choice(parts[:24] if k % 2 else parts) for _ in range(rng.randint(0, 30))) for k in range(3000)] + [None]
    tokenizer = Tokenizer.from_file(BPE)
    got = token_file.Encoder(BPE).encode_rows(*flat.texts(pa.array(texts)))
    assert [g.tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_scripts_and_long_texts_in_stretches(monkeypatch):
    monkeypatch.setattr(token_file, "STRETCH", 40)
    rng = random.Random(3)
    parts = ["word", " and", " \u00a0 ", "\u00a0", " x", " 日本", "×", " é", "\u2003 ", "\n", " 12", "<|endoftext|>", " supercalifragilisticexpialidocious", " \x85 y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    encoder, tokenizer = token_file.Encoder(BPE), Tokenizer.from_file(BPE)
    got = encoder.encode_rows(*flat.texts(pa.array(texts)))
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_table_and_long_text(monkeypatch):
    monkeypatch.setattr(token_file, "CACHE_SLOTS", 1 << 12)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n)) for n in (700, 700, 700)]
    encoder, tokenizer = token_file.Encoder(BPE), Tokenizer.from_file(BPE)
    for t in texts:
        assert encoder.encode_rows(*flat.texts(pa.array([t])))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    data = np.frombuffer(texts[0].encode(), np.uint8)
    parts = list(token_file.between_words(data, 500))
    assert len(parts) > 3 and parts[0][0] == 0 and parts[-1][1] == len(data)
    ids = [x for a, b in parts for x in tokenizer.encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids]
    assert ids == tokenizer.encode(texts[0], add_special_tokens=False).ids


def test_token_file_round_trip(spark, corpus, documents, tmp_path, empty):
    tokenizer = Tokenizer.from_file(BPE)
    path = f"{tmp_path}/tokens"
    token_file.write(documents, path, BPE)
    start = 0
    rows = {r.doc_id: r for r in token_file.read(spark, path).collect()}
    for i, t in sorted(corpus):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_file.END_ID]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids) == (start, len(ids), ids)
        start += len(ids)
    some = token_file.read(spark, path, F.col("doc_id") == 7)
    assert some.first().start == rows[7].start
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)" in some._jdf.queryExecution().executedPlan().toString()
    assert token_file.token_digests(empty, BPE).count() == 0


# ids


def test_rows_that_repeat_an_id_or_have_none(spark, tmp_path):
    """One row for each row with an id, however often the id comes; token files and packing keep rows without one."""
    text = "a plain line of words that says what it has to say and then ends"
    rows = [(1, text), (1, text), (1, "another text"), (2, None), (None, text)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    ids = lambda out: sorted(r.doc_id for r in out.collect())
    assert ids(quality.quality_scores(table, labels)) == [1, 1, 1, 2]
    assert ids(lm_score.lm_scores(table)) == [1, 1, 1, 2]
    encoded = token_file.token_digests(table, BPE).orderBy("start").collect()
    assert [r.doc_id for r in encoded] == [None, 1, 1, 1, 2]
    assert [r.start for r in encoded] == list(np.cumsum([0, *(r.n_tokens for r in encoded)])[:-1])
    packed = packing.pack_texts(table, BPE).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in packed) == [(False, 1)] * 3 + [(False, 2), (True, 0)]


def test_ties_at_the_threshold(spark):
    """Equal texts have equal scores, and a score at the threshold is predicted 1."""
    table = spark.createDataFrame([(i, "the same text in every row") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    scores = {r.score for r in quality.quality_scores(table, labels).collect()}
    assert len(scores) == 1
    at = quality.quality_scores(table, labels, threshold=scores.pop()).collect()
    assert {r.predicted for r in at} == {1}
