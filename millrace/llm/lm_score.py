"""LM scoring by a probabilistic suffix tree over words.

Symbols of the tree are all words of training documents, the end of a text, and one symbol for all words that they
lack.  A context of 1 to ``DEPTH`` symbols is a state if it occurs at least ``LEAST`` times and its
next-symbol distribution diverges enough from that of its suffix; the suffixes of a state are states.  Each
distribution is smoothed towards that of the suffix, that of no context is the add-one base, and a symbol is
scored in the longest state that its past ends in.

Symbols and states grow with the corpus and are never gathered: positions are dealt by the word before them,
so all contexts that end in that word, their counts and the positions they score meet in one bucket; frequent words are
placed so that no bucket gets too many of them.  A word with
more positions than a bucket is dealt by the word before it, too, to as many buckets of its own as its positions need;
its counts are summed first and sent to the buckets that ask for them, unless only one does.  Up to ``TOGETHER`` of its
buckets are read one after another by one task, to which each count is sent once.

What a text's frequent words add to its base is summed where the text is read.  The rest of its sums leaves each
bucket packed, many texts to a row, as multiples of 1 / ``UNIT``, so that the order of summing does not show.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .scratch import cut, discard, small_batches

DEPTH, BITS = 3, 10
#: Occurrences of a state.
LEAST = 2
#: Positions of a bucket, about.
BUCKET = 1 << 19
#: A word of more positions than this share of a bucket is not dealt by its hash but to the bucket with least of such words,
#: one of more than half a bucket to a bucket of its own.
PLACED = 1 / 16
#: Buckets of a word, at most, that one task reads one after another; all other buckets are a group of their own.
TOGETHER = 8
#: Buckets whose number of texts, about, is summed at once.
SHARD = 4
UNIT = 1 << 32
#: Buckets are dealt in so many rounds, each of which reads all texts, so that less lies on disk at once.
ROUNDS = 2
#: Keys, about, that are grouped at once: Arrow took up to 62 MB to group 524,000 different ones.
GROUPED = 1 << 16
#: Bytes of text, about, whose words are hashed at once.
HASHED = 1 << 18
#: Positions that a task deals out at once.
DEALT = 1 << 20
#: Words of at least this share, at most 1 / FREQUENT, go to every task with their counts; the rest are joined.
FREQUENT = 5e-7
HELD_OUT = 2  # of crc32(id) mod 7
END_WORD = b"\n"
SUMS = ("n_known", "base", "score")
START, END, OTHER, FIRST = 0, 1, 2, 3
MASK = (1 << BITS) - 1
#: Stands for a bucket in the rows with a group's facts, so that they come before its buckets.
FACTS = -1
START_HASH = flat.mix(np.array([0x5354415254], flat.U))[0]
END_HASH = flat.ranged(flat.prefix(flat.BYTE[np.frombuffer(END_WORD, np.uint8)]), np.array([0]), np.array([1]))[0]


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == HELD_OUT


def _merged(held: list) -> tuple:
    """Counts (key, n) of several parts as one."""
    key, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
    unique, inverse = np.unique(key, return_inverse=True)
    return unique, np.bincount(inverse, n).astype(np.int64)


def _gathered(parts: Iterator[tuple], bound: int = 500_000) -> Iterator[tuple]:
    """Counts merged within the task; given out early when there are more than ``bound`` different."""
    held, rows = [], 0
    for x in parts:
        held.append(x)
        rows += len(x[0])
        if rows > 2 * bound:
            held = [_merged(held)]
            rows = len(held[0][0])
            if rows > bound:
                yield held[0]
                held, rows = [], 0
    if held:
        yield _merged(held)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple]:
        for batch in batches:
            yield np.unique(flat.word_hashes(*flat.texts(batch.column(0)), lower=True, size=HASHED)[0], return_counts=True)
            yield np.array([END_HASH]), np.array([batch.num_rows])

    for key, n in _gathered(parts()):
        yield pa.RecordBatch.from_arrays([flat.signed(key), pa.array(n)], names=["word", "n"])


def windows_of(symbols: np.ndarray, rows: np.ndarray, end_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context and symbol of each token as one integer, position of each word's, of each row's end)."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    at = np.arange(len(symbols)) + (DEPTH + 1) * row + DEPTH
    ends = rows[1:] + (DEPTH + 1) * np.arange(n) + DEPTH
    laid = np.full(len(symbols) + (DEPTH + 1) * n, START, np.int64)
    laid[at], laid[ends] = symbols, end_symbol
    where = np.sort(np.r_[at, ends])
    out = np.zeros(len(where), np.int64)
    for i in range(DEPTH, -1, -1):
        out = (out << BITS) | laid[where - i]
    place = np.zeros(len(laid), np.int64)
    place[where] = np.arange(len(where))
    return out, place[at], place[ends]


class Tree(NamedTuple):
    """The tree of one small alphabet, in memory: what the tables of ``lm_scores`` amount to.

    By length of context: sorted states, log10 of the weight of their suffix, sorted (state, symbol), log10 p."""

    states: list[np.ndarray]
    weights: list[np.ndarray]
    entries: list[np.ndarray]
    logs: list[np.ndarray]

    def score(self, windows: np.ndarray) -> np.ndarray:
        """log10 p(symbol | longest state its past ends in)."""
        out = np.zeros(len(windows))
        longest = np.zeros(len(windows), np.int64)
        place = [np.zeros(0, np.int64)]
        for d in range(1, DEPTH + 1):
            context = (windows >> BITS) & ((1 << BITS * d) - 1)
            at = np.searchsorted(self.states[d], context)
            at[at == len(self.states[d])] = 0
            place.append(at)
            if len(self.states[d]):
                longest[(longest == d - 1) & (self.states[d][at] == context)] = d
        todo = np.ones(len(windows), bool)
        for d in range(DEPTH, 0, -1):
            i = np.flatnonzero(todo & (longest >= d))
            if not len(i):
                continue
            key = windows[i] & ((1 << BITS * (d + 1)) - 1)
            at = np.minimum(np.searchsorted(self.entries[d], key), len(self.entries[d]) - 1)
            hit = self.entries[d][at] == key
            out[i[hit]] += self.logs[d][at[hit]]
            todo[i[hit]] = False
            out[i[~hit]] += self.weights[d][place[d][i[~hit]]]
        out[todo] += self.logs[0][windows[todo] & MASK]
        return out


def build_tree(counts: list[tuple[np.ndarray, np.ndarray]], alphabet: int) -> Tree:
    """``counts[d]``: (context of d symbols and symbol, occurrences) of all contexts that are frequent enough."""
    root = np.zeros(MASK + 1)
    root[END : FIRST + alphabet] = 1
    np.add.at(root, counts[0][0], counts[0][1])
    total = root.sum()
    tree = Tree([np.zeros(1, np.int64)], [np.zeros(1)], [np.arange(MASK + 1)], [root / total])
    kept: list[np.ndarray] = [np.zeros(1, np.int64)]
    for d in range(1, DEPTH + 1):
        order = np.argsort(counts[d][0])
        key, n = counts[d][0][order], counts[d][1][order].astype(float)
        context, _, size = np.unique(key >> BITS, return_index=True, return_counts=True)
        of = np.repeat(np.arange(len(context)), size)
        mass = np.bincount(of, n, minlength=len(context))
        at = np.minimum(np.searchsorted(tree.entries[d - 1], key & ((1 << BITS * d) - 1)), len(tree.entries[d - 1]) - 1)
        parent = tree.logs[d - 1][at]  # probabilities until the end
        kinds = size.astype(float)
        gain = np.bincount(of, n * np.log((n / mass[of]) / parent), minlength=len(context))  # occurrences times divergence
        kept.append(context[gain >= kinds * np.log(max(total, 2)) / 2])
        tree.states.append(context)
        tree.weights.append(kinds / (mass + kinds))
        tree.entries.append(key)
        tree.logs.append((n + kinds[of] * parent) / (mass + kinds)[of])
    for d in range(DEPTH, 1, -1):  # the suffixes of a state are states
        kept[d - 1] = np.union1d(kept[d - 1], kept[d] & ((1 << BITS * (d - 1)) - 1))
    for d in range(1, DEPTH + 1):
        state, entry = np.isin(tree.states[d], kept[d]), np.isin(tree.entries[d] >> BITS, kept[d])
        tree.states[d], tree.weights[d] = tree.states[d][state], np.log10(tree.weights[d][state])
        tree.entries[d], tree.logs[d] = tree.entries[d][entry], np.log10(tree.logs[d][entry])
    tree.logs[0] = np.log10(np.maximum(tree.logs[0], 1e-300))
    return tree


class Model(NamedTuple):
    """Frequent words: hashes (ascending), their codes; by code hashes and counts (START and END are 0 and 1).
    Words with more positions than a bucket: hashes (ascending), occurrences, kinds of next symbols, whether they diverge,
    parts, and the bucket of the first part (the others follow).  ``buckets`` is for all other words, but for ``placed`` ones
    (ascending), which are in ``placed_in``.  ``groups`` has the group of each bucket."""

    words: np.ndarray
    codes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    buckets: int
    total: float
    hot: np.ndarray
    hot_mass: np.ndarray
    hot_kinds: np.ndarray
    hot_ok: np.ndarray
    hot_parts: np.ndarray
    hot_first: np.ndarray
    placed: np.ndarray
    placed_in: np.ndarray
    groups: np.ndarray

    def code(self, h: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 of words that are not frequent."""
        unique, _, inverse = grouped(h)
        order = np.argsort(unique)
        at, hit = found(self.words, unique[order])
        out = np.full(len(unique), -1, np.int32)
        out[order[hit]] = self.codes[at[hit]]
        return out[inverse]

    def first_bucket(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket by the word before, the first one of hot words; place of hot words, -1 of others)"""
        out = flat.mix(one) % flat.U(self.buckets)
        at, is_placed = found(self.placed, one)
        out[is_placed] = self.placed_in[at[is_placed]]
        at, is_hot = found(self.hot, one)
        out[is_hot] = self.hot_first[at[is_hot]]
        return out.astype(np.uint16 if self.all_buckets <= 1 << 16 else np.int32), np.where(is_hot, at, -1).astype(np.int32)

    def bucket(self, one: np.ndarray, codes: np.ndarray, two: np.ndarray, by_code: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket by the word before, of hot words by the two words before; positions after a hot word).  ``by_code``: ``first_bucket(self.hashes)``"""
        out, hot = (x[codes] for x in by_code)
        rare = np.flatnonzero(codes < 0)
        out[rare], hot[rare] = self.first_bucket(one[rare])
        at = np.flatnonzero(hot >= 0)
        out[at] += (flat.mix(two[at]) % self.hot_parts[hot[at]]).astype(out.dtype)
        return out, at

    @property
    def all_buckets(self) -> int:
        return len(self.groups)


def found(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in the ascending table, whether it is there)."""
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, a place of each, which of them each key is)"""
    parts = len(key) // GROUPED + 1
    if parts == 1:
        coded = pa.array(key).dictionary_encode()
        unique, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    else:
        part = (((key.view(flat.U) * flat.U(flat.MULT)) >> flat.U(32)) * flat.U(parts) >> flat.U(32)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(part, minlength=parts))]
        del part
        which, several, n = np.empty(len(key), np.int32), [], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            coded = pa.array(key[order[a:b]]).dictionary_encode()
            which[order[a:b]] = coded.indices.to_numpy() + np.int32(n)
            several.append(coded.dictionary.to_numpy())
            n += len(several[-1])
        unique = np.concatenate(several)
    place = np.zeros(len(unique), np.int64)
    place[which] = np.arange(len(which))
    return unique, place, which


def places(sizes: np.ndarray, own: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each word: those with ``own`` follow the ``buckets``, the largest of the others go first to that with least."""
    out = np.zeros(len(sizes), flat.U)
    out[own] = buckets + np.arange(own.sum())
    load = [(0.0, k) for k in range(buckets)]
    for i in sorted(np.flatnonzero(~own).tolist(), key=lambda i: -sizes[i]):
        least, k = load[0]
        out[i] = k
        heapq.heapreplace(load, (least + float(sizes[i]), k))
    return out


def groups_of(buckets: int, parts: np.ndarray) -> np.ndarray:
    """The group of each bucket: one for each of ``buckets``, then those of each hot word's parts, about equally many in each."""
    out, first = [np.arange(buckets)], buckets
    for n in parts.tolist():
        many = -(-n // TOGETHER)
        out.append(first + np.arange(n) * many // n)
        first += many
    return np.concatenate(out).astype(np.int32)


def joined(a: np.ndarray, b: np.ndarray, mult: int = flat.MULT) -> np.ndarray:
    return flat.mix(a * flat.U(mult) + b)


class Positions(NamedTuple):
    """Of each word and each end of some texts: hashes and codes of it and of the ``DEPTH`` before, and its text's row."""

    hashes: list[np.ndarray]
    codes: list[np.ndarray]
    row: np.ndarray


def positions_of(column: pa.Array, model: Model) -> Iterator[Positions]:
    """The positions of some texts, ``DEALT`` at a time, however long a text is."""
    h, _, _, rows = flat.word_hashes(*flat.texts(column), lower=True, size=HASHED)
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    laid = np.full(len(h) + (DEPTH + 1) * n, START_HASH, flat.U)
    at = np.arange(len(h)) + (DEPTH + 1) * row + DEPTH
    del row
    ends = rows[1:] + (DEPTH + 1) * np.arange(n) + DEPTH
    laid[at], laid[ends] = h, END_HASH
    where = np.sort(np.r_[at, ends])
    del h, at
    for a in range(0, len(where), DEALT):
        part = where[a : a + DEALT]
        own = laid[part[0] - DEPTH : part[-1] + 1]
        codes = model.code(own)
        codes[own == START_HASH], codes[own == END_HASH] = 0, 1
        place = part - part[0] + DEPTH
        yield Positions([own[place - i] for i in range(DEPTH + 1)], [codes[place - i] for i in range(DEPTH + 1)], np.searchsorted(ends, part))


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut between texts, to about ``DEALT`` positions, at six bytes each."""
    held, size = [], 0
    for batch in batches:
        for a, b in flat.chunks(flat.texts(batch.column(batch.num_columns - 1))[1], 6 * DEALT):
            part = batch.slice(a, b - a)
            held.append(part)
            size += part.nbytes
            if size > 6 * DEALT:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _asked(shared):
    """(group, null, null, s, 0) for each word s that is not frequent; (group, bucket, w, s, n) for words after a hot one, n times
    in training; for each document its tokens, and the known ones and the base of its frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        by_code = model.first_bucket(model.hashes)
        is_known, logs = model.counts > 0, np.log10((model.counts + 1) / model.total)
        for batch in _several(batches):
            ids, train = batch.column(0).to_numpy(), ~batch.column(1).to_numpy(zero_copy_only=False)
            for x in positions_of(batch.column(2), model):
                frequent = x.codes[0] >= 0
                code = x.codes[0][frequent]
                first = np.flatnonzero(np.diff(x.row, prepend=-1))
                row = x.row[first]
                of, many = x.row - row[0], len(ids)
                known, base = (np.bincount(of[frequent], v, many)[row - row[0]] for v in (is_known[code], logs[code]))
                yield _own(ids[row], np.diff(np.r_[first, len(of)]), known, base)
                bucket, hot = model.bucket(x.hashes[1], x.codes[1], x.hashes[2], by_code)
                rare = np.flatnonzero(x.codes[0] < 0)
                group = model.groups[bucket[rare]]
                first = grouped(joined(x.hashes[0][rare], group.astype(flat.U)))[1]
                rare = rare[first]
                yield _facts(group[first], pa.nulls(len(rare), pa.int32()), pa.nulls(len(rare), pa.int64()), x.hashes[0][rare], np.zeros(len(rare), np.int64))
                _, first, inverse = grouped(joined(joined(x.hashes[1][hot], x.hashes[0][hot]), bucket[hot].astype(flat.U)))
                n = np.bincount(inverse, train[x.row[hot]], len(first)).astype(np.int64)
                hot = hot[first]
                yield _facts(model.groups[bucket[hot]], pa.array(bucket[hot].astype(np.int32)), flat.signed(x.hashes[1][hot]), x.hashes[0][hot], n)

    return run


ASKED = "grp int, bucket int, w long, s long, n long, doc_id long, n_known long, base double"
ASKED_NAMES = ["grp", "bucket", "w", "s", "n", "doc_id", "n_known", "base"]


def _facts(group, bucket, w, s, n) -> pa.RecordBatch:
    none = (pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(group), bucket, w, flat.signed(s), pa.array(n), *none], names=ASKED_NAMES)


def _own(doc, n, known, base) -> pa.RecordBatch:
    none = (pa.nulls(len(n), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.int64()))
    return pa.RecordBatch.from_arrays([*none, pa.array(n.astype(np.int64)), pa.array(doc), pa.array(known.astype(np.int64)), pa.array(base)], names=ASKED_NAMES)


def _dealt(shared, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        by_code = model.first_bucket(model.hashes)
        here = model.groups % ROUNDS == turn
        for batch in _several(batches):
            ids, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for x in positions_of(batch.column(2), model):
                bucket, _ = model.bucket(x.hashes[1], x.codes[1], x.hashes[2], by_code)
                order = np.flatnonzero(here[bucket])
                order = order[np.argsort(bucket[order], kind="stable")]
                if not len(order):
                    continue
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
                blocks = [_block(x, order[a:b], ids, held) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                own = bucket[order[cuts[:-1]]]
                yield pa.RecordBatch.from_arrays([pa.array(model.groups[own]), pa.array(own.astype(np.int32)), pa.array(blocks, pa.binary())], names=["grp", "bucket", "body"])

    return run


def _block(x: Positions, at: np.ndarray, ids: np.ndarray, held: np.ndarray) -> bytes:
    """Positions ``at``, by document: sizes, ids, held out or not, positions of each, codes in byte planes, hashes where there is no code."""
    row, many = np.unique(x.row[at], return_counts=True)
    parts = [ids[row].tobytes(), held[row].astype(np.uint8).tobytes(), many.astype(np.int32).tobytes()]
    for h, code in zip(x.hashes, x.codes, strict=True):
        c = code[at]
        parts += [c.view(np.uint8).reshape(-1, 4).T.tobytes(), h[at[c < 0]].tobytes()]
    raw = b"".join(parts)
    return np.array([len(row), len(at), len(raw)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def _unblock(body: bytes, model: Model) -> tuple[np.ndarray, ...]:
    """(document, held out, counts of the frequent symbols and -1, hashes of it and of those before)"""
    rows, n, size = np.frombuffer(body, np.int64, 3).tolist()
    raw, at = pa.decompress(body[24:], size, "zstd", asbytes=True), 0

    def take(kind, many: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, many, at)
        at += out.nbytes
        return out

    ids, held = take(np.int64, rows), take(np.uint8, rows).astype(bool)
    many = take(np.int32, rows)
    hashes, count = [], None
    for _ in range(DEPTH + 1):
        code = np.ascontiguousarray(take(np.uint8, 4 * n).reshape(4, n).T).view(np.int32)[:, 0]
        h = model.hashes[code]
        rare = code < 0
        h[rare] = take(flat.U, int(rare.sum()))
        hashes.append(h)
        if count is None:
            count = np.where(rare, -1, model.counts[code])
    return np.repeat(ids, many), np.repeat(held, many), count, *hashes


class Facts(NamedTuple):
    """What a group is told: words (ascending) and their counts, words after its hot word as one key (ascending) and theirs."""

    word: np.ndarray
    word_n: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray


def facts_of(w: np.ndarray, s: np.ndarray, n: np.ndarray) -> Facts:
    """``w``, ``s``, ``n``: counts of words (w is 0) and of words after hot ones."""
    alone = w == 0
    order = np.argsort(s[alone])
    pair = joined(w[~alone], s[~alone], flat.MULT_TOO)
    pair_order = np.argsort(pair)
    return Facts(s[alone][order], n[alone][order], pair[pair_order], n[~alone][pair_order])


def _unblocked(blocks: list[bytes], model: Model) -> list[np.ndarray]:
    """``_unblock`` of all blocks, which are taken out of the list one by one."""
    n = sum(int(np.frombuffer(b, np.int64, 2)[1]) for b in blocks)
    out = [np.empty(n, kind) for kind in (np.int64, bool, np.float64, *[flat.U] * (DEPTH + 1))]
    at = 0
    while blocks:
        part = _unblock(blocks.pop(), model)
        for x, y in zip(out, part, strict=True):
            x[at : at + len(y)] = y
        at += len(part[0])
    return out


def score_bucket(blocks: list[bytes], facts: Facts, model: Model) -> list[pa.RecordBatch]:
    """Partial sums of the bucket's documents (known and base of words that are not frequent only).  Empties ``blocks``, and
    keeps nothing of the bucket while the sums are added up and packed."""
    out = []
    doc, held, count, *hashes = _unblocked(blocks, model)
    train = (~held).astype(float)
    del held
    rare = np.flatnonzero(count < 0)
    at, hit = found(facts.word, hashes[0][rare])
    count[rare] = np.where(hit, facts.word_n[at], 0) if len(facts.word) else 0
    p = base = (count + 1) / model.total
    ids, states, suffixes, logs = [], [], [], [np.log10(base)]
    open_hot = np.zeros(len(doc), bool)
    context = None
    for d in range(1, DEPTH + 1):
        context = hashes[1] if d == 1 else joined(context, hashes[d])
        if d > 1:
            hashes[d] = None
        c, first_c, of_c = grouped(context)
        g, first, of_g = grouped(joined(context, hashes[0], flat.MULT_TOO))
        of = of_c[first]
        seen = np.bincount(of_g, train, len(g))
        mass, kinds = np.bincount(of, seen, len(c)), np.bincount(of, seen > 0, len(c))
        if d == 1:
            at_hot, is_hot = found(model.hot, c)
            if is_hot.any():
                at, hit = found(facts.pair, g)
                here = is_hot[of] & hit  # pairs that other buckets have, too
                seen[here] = facts.pair_n[at[here]]
                mass[is_hot], kinds[is_hot] = model.hot_mass[at_hot[is_hot]], model.hot_kinds[at_hot[is_hot]]
        parent = p[first]
        gain = np.bincount(of, np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(mass[of], 1) / parent), 0), len(c))
        state = (mass >= LEAST) & (gain >= kinds * np.log(max(model.total, 2)) / 2)
        if d == 1 and is_hot.any():
            state[is_hot] = model.hot_ok[at_hot[is_hot]]
            undecided = is_hot & ~state  # may still be the suffix of a state, here or in another bucket
            open_hot = undecided[of_c]
        both = (mass + kinds)[of]
        p = np.where(both > 0, (seen + kinds[of] * parent) / np.maximum(both, 1), parent)[of_g]
        logs.append(np.log10(p))
        suffixes.append(ids[-1][first_c] if ids else None)
        ids.append(of_c)
        states.append(state)
        del c, first_c, of_c, g, first, of_g, of, seen, mass, kinds, parent, gain, both
    del context, train, p
    for d in range(DEPTH - 1, 0, -1):
        states[d - 1][suffixes[d][states[d]]] = True
    longest = np.zeros(len(doc), np.int64)
    for d in range(1, DEPTH + 1):
        longest[states[d - 1][ids[d - 1]]] = d
    if open_hot.any():
        ends = np.unique(hashes[1][open_hot & (longest > 0)])
        out.append(_sums(None, np.ones(len(ends), bool), flat.signed(ends), np.zeros((len(ends), 3))))
        longest[open_hot & (longest == 1)] = 0
        at = np.flatnonzero(open_hot & (longest == 0))
        _, first, inverse = np.unique(joined(doc[at].view(flat.U), hashes[1][at]), return_index=True, return_inverse=True)
        values = np.zeros((len(first), 3))
        values[:, 2] = np.bincount(inverse, (logs[1] - logs[0])[at], len(first))
        out.append(_sums(doc[at][first], np.zeros(len(first), bool), flat.signed(hashes[1][at][first]), values))
    score = np.choose(longest, logs)
    unique, _, inverse = grouped(doc)
    of = inverse[rare]
    values = np.column_stack([np.bincount(of, count[rare] > 0, len(unique)), np.bincount(of, logs[0][rare], len(unique)), np.bincount(inverse, score, len(unique))])
    out.append(_sums(unique, np.zeros(len(unique), bool), pa.nulls(len(unique), pa.int64()), values))
    return out


def _sums(doc, is_state, hot, values: np.ndarray) -> pa.RecordBatch:
    ids = pa.nulls(len(values), pa.int64()) if doc is None else pa.array(doc)
    return pa.RecordBatch.from_arrays([ids, pa.array(is_state), hot, pa.array(values[:, 0].astype(np.int64)), *(pa.array(values[:, i].copy()) for i in (1, 2))], names=["doc_id", "is_state", "hot", *SUMS])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        held: list[pa.RecordBatch] = []  # the rows of one bucket, or the facts of one group
        current = None
        none = np.zeros(0, flat.U)
        facts = (None, facts_of(none, none, np.zeros(0)))  # of which group

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal facts
            t = pa.Table.from_batches(held)
            held.clear()
            group, bucket = current
            if bucket == FACTS:
                w, s, n = (t.column(c).fill_null(0).to_numpy() for c in ("w", "s", "n"))
                facts = group, facts_of(w.view(flat.U), s.view(flat.U), n.astype(float))
            else:
                if facts[0] != group:
                    facts = group, facts_of(none, none, np.zeros(0))
                blocks = t.column("body").to_pylist()
                del t
                yield from score_bucket(blocks, facts[1], model)
            pa.default_memory_pool().release_unused()

        def merged() -> Iterator[pa.RecordBatch]:
            nonlocal current
            for batch in batches:
                group, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.r_[0, np.flatnonzero(np.diff(group) | np.diff(bucket)) + 1, len(bucket)]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    if (group[a], bucket[a]) != current and held:
                        yield from done()
                    current = group[a], bucket[a]
                    held.append(batch.slice(a, b - a))
            if held:
                yield from done()

        for t in _summed(merged()):
            yield from _packed(t, max(1, model.all_buckets // SHARD))

    return run


def _summed(parts: Iterator[pa.RecordBatch], bound: int = 500_000) -> Iterator[pa.Table]:
    """Sums of a document from several buckets as one."""
    held, rows = [], 0

    def total() -> pa.Table:
        t = pa.Table.from_batches(held).group_by(["doc_id", "is_state", "hot"]).aggregate([(c, "sum") for c in SUMS])
        return t.rename_columns([c.removesuffix("_sum") for c in t.column_names])

    for x in parts:
        held.append(x)
        rows += x.num_rows
        if rows > bound:
            yield total()
            held, rows = [], 0
    if held:
        yield total()


def _packed(t: pa.Table, shards: int) -> Iterator[pa.RecordBatch]:
    """(null, hot, null) for hot words that are states; (shard, null, body) with the sums of the shard's documents in byte planes."""
    is_state = t.column("is_state").to_numpy()
    states = pc.unique(t.column("hot").filter(pa.array(is_state)))
    yield pa.RecordBatch.from_arrays([pa.nulls(len(states), pa.int32()), states, pa.nulls(len(states), pa.binary())], names=["shard", "hot", "body"])
    t = t.filter(pa.array(~is_state))
    if not t.num_rows:
        return
    doc, hot, known = (t.column(c).fill_null(0).to_numpy() for c in ("doc_id", "hot", "n_known"))
    fixed = [np.rint(t.column(c).to_numpy() * UNIT).astype(np.int64) for c in ("base", "score")]
    shard = (flat.mix(doc.view(flat.U)) % flat.U(shards)).astype(np.int32)
    order = np.lexsort((hot, doc, shard))
    cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
    bodies = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        columns = [np.diff(doc[at], prepend=0), hot[at], known[at], *(x[at] for x in fixed)]
        planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)
        bodies.append(np.array([len(at)], np.int64).tobytes() + pa.compress(planes, "zstd", asbytes=True))
    yield pa.RecordBatch.from_arrays([pa.array(shard[order[cuts[:-1]]]), pa.nulls(len(bodies), pa.int64()), pa.array(bodies, pa.binary())], names=["shard", "hot", "body"])


def _unpacked(body: bytes) -> list[np.ndarray]:
    """document, hot word or 0, and its sums, of each row"""
    n = int(np.frombuffer(body, np.int64, 1)[0])
    planes = np.frombuffer(pa.decompress(body[8:], 40 * n, "zstd", asbytes=True), np.uint8).reshape(5, 8, n)
    doc, *others = (np.ascontiguousarray(x.T).view(np.int64)[:, 0] for x in planes)
    return [np.cumsum(doc), *others]


def _of_documents(states: np.ndarray):
    """The sums of each document from its shard's rows, those of hot words if these are among ``states``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for body in batch.column(1):
                    doc, hot, known, *fixed = _unpacked(body.as_py())
                    taken = (hot == 0) | np.isin(hot, states)
                    values = np.column_stack([known[taken], *(x[taken] / UNIT for x in fixed)])
                    yield _sums(doc[taken], np.zeros(len(values), bool), pa.nulls(len(values), pa.int64()), values)

        for t in _summed(parts()):
            yield from t.select(["doc_id", *SUMS]).to_batches()

    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df`` with an id: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id) mod 7 is not 2.  Tokens are words (A-Z lowered) and one end; a null or
    empty text has the end only.  Rows that repeat an id are scored each: where there are any, rows are numbered in a
    table of their own first.  Null ids take no part.  Without training rows train_tokens is 0 and all words are the one unknown symbol; no rows: no rows.

    Sent to every task: frequent words with their counts, at most 1 / ``FREQUENT``, and the words with more positions
    than a bucket.  All other words' counts, and all counts and states of the tree, stay in tables dealt by bucket.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null").select("doc_id", held_out("doc_id").alias("held_out"), "text")
    numbered = None
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        numbered = cut(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        docs = numbered.select(F.col("row").alias("doc_id"), "held_out", "text")
    words = cut(docs.where("not held_out").select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    size = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_words = size["n"] or 0, size["v"]
    total = float(n_train + n_words + 1)
    end_key = int(END_HASH.astype(np.int64))

    least = max(1.0, FREQUENT * n_train)
    kept = words.where((F.col("n") >= least) & (F.col("word") != end_key)).toPandas().sort_values("n", ascending=False)
    hashes, counts = kept["word"].to_numpy(np.int64).view(flat.U), kept["n"].to_numpy(np.float64)
    ended = words.where(F.col("word") == end_key).first()
    n_ends = float(ended["n"]) if ended else 0.0
    order = np.argsort(hashes)
    none = np.zeros(0)
    few = none.astype(flat.U)
    model = Model(hashes[order], (order + 2).astype(np.int32), np.r_[np.array([START_HASH, END_HASH], flat.U), hashes], np.r_[0.0, n_ends, counts], 1, total, few, none, none, none.astype(bool), few, few, few, few, np.zeros(1, np.int32))

    often = {int(r["word"]): float(r["n"]) for r in words.where((F.col("n") > PLACED * BUCKET) & (F.col("word") != end_key)).collect()}
    if n_ends > PLACED * BUCKET:
        often[int(START_HASH.astype(np.int64))] = n_ends
    hot = {k: n for k, n in often.items() if n > BUCKET}
    hot_hashes, placed = (np.sort(np.array(list(x), np.int64).view(flat.U)) for x in (hot, often.keys() - hot.keys()))
    mass, sizes = (np.array([often[int(h.astype(np.int64))] for h in x]) for x in (hot_hashes, placed))
    parts, own = np.ceil(mass / BUCKET).astype(flat.U), sizes > BUCKET / 2
    buckets = max(1, int((n_train - mass.sum() - sizes[own].sum()) * 7 // 6 // BUCKET))
    first = buckets + int(own.sum())
    model = model._replace(buckets=buckets, hot=hot_hashes, hot_mass=mass, hot_kinds=np.ones(len(mass)), hot_ok=np.zeros(len(mass), bool), hot_parts=parts, hot_first=flat.U(first) + np.cumsum(parts) - parts)
    model = model._replace(placed=placed, placed_in=places(sizes, own, buckets), groups=groups_of(first, parts.astype(np.int64)))

    asked = cut(docs.mapInArrow(_asked(spark.sparkContext.broadcast(model)), ASKED), "asked")
    own = cut(asked.where("doc_id is not null").select("doc_id", F.col("n").alias("n_tokens"), "n_known", "base"), "own")
    counted = words.select(F.col("word").alias("s"), F.col("n").alias("__n"))
    facts = asked.where("s is not null and w is null").select("grp", "s").distinct().join(counted, "s").select("grp", F.lit(0).cast("long").alias("w"), "s", F.col("__n").alias("n"))
    pairs = None
    if hot:
        pairs = cut(asked.where("w is not null").groupBy("w", "s").agg(F.sum("n").alias("n"), (F.min("bucket") < F.max("bucket")).alias("several"), F.collect_set("grp").alias("groups")).where("n > 0"), "pairs")
        of_word = F.create_map(*(F.lit(x) for k, v in hot.items() for x in (k, v)))[F.col("w")]
        share = (F.col("__n") + 1) / F.lit(total)
        gains = {r["w"]: r for r in pairs.join(counted, "s").groupBy("w").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log(F.col("n") / of_word / share)).alias("gain")).collect()}
        rows = [gains[int(h.astype(np.int64))] for h in hot_hashes]
        kinds = np.array([r["kinds"] for r in rows], float)
        model = model._replace(hot_kinds=kinds, hot_ok=np.array([r["gain"] for r in rows]) >= kinds * np.log(max(total, 2)) / 2)
        # a pair that one bucket has alone is counted there
        facts = facts.union(pairs.where("several").select(F.explode("groups").alias("grp"), "w", "s", "n"))

    facts = cut(facts, "facts")
    discard(spark, asked, *([pairs] if pairs is not None else []))
    shared = spark.sparkContext.broadcast(model)
    turns = []
    for turn in range(min(ROUNDS, int(model.groups.max()) + 1)):
        blocks = docs.mapInArrow(_dealt(shared, turn), "grp int, bucket int, body binary").select("grp", "bucket", "body", *(F.lit(None).cast("long").alias(c) for c in "wsn"))
        dealt = blocks.union(facts.where(F.col("grp") % ROUNDS == turn).select("grp", F.lit(FACTS).alias("bucket"), F.lit(None).cast("binary").alias("body"), "w", "s", "n"))
        spread = dealt.repartition("grp").sortWithinPartitions("grp", "bucket")
        turns.append(cut(spread.mapInArrow(_scores(shared), "shard int, hot long, body binary"), "scores"))
    discard(spark, facts)
    sums = reduce(DataFrame.union, turns)
    states = np.array([r["hot"] for r in sums.where("hot is not null").select("hot").distinct().collect()] if not model.hot_ok.all() else [], np.int64)
    rest = sums.where("body is not null").select("shard", "body").repartition("shard").mapInArrow(_of_documents(states), "doc_id long, n_known long, base double, score double")
    both = own.withColumn("score", F.lit(0.0)).unionByName(rest.withColumn("n_tokens", F.lit(0).cast("long")))
    out = both.groupBy("doc_id").agg(*(F.sum(x).alias(x) for x in ("n_tokens", *SUMS)))
    if numbered is not None:
        out = out.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
