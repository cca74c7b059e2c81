"""Near-duplicate classes: MinHash signatures, multi-index Hamming join, exact links, components.

1. One scan makes each text's set of word shingles (64-bit hashes), a 128-bit digest of the set
   and a signature of ``chunks`` x ``SYMBOLS`` MinHash values cut to ``BITS`` bits.  Texts with equal
   sets form a class; only its smallest id goes on.
2. Multi-index Hamming join.  By the pigeonhole principle two signatures that differ in at most
   ``2 * chunks - 1`` symbols have a chunk with at most one error.  Each chunk is indexed under all its
   allowed errors, as the chunk with one symbol left out at a time, so all such pairs share a key.
3. Links are confirmed on the full sets.  A key's members are first tested against its first class
   (a star, not all pairs) and joined into components.  Then every pair of classes still apart is tested, unless it
   cannot reach the threshold: of two sets that reach it, the rarest few shingles (in one global order) must
   meet.  The members of a small shingle group are paired, but for pairs without enough shingles left
   from there on or with bitmaps too unlike.  Those of a large group are dealt to blocks, and any two blocks meet in
   a tile, first with their rarest shingles only: members that those tests part from all others, or that
   meet the others at a rarer shingle already, leave it.  The tile then holds the sets of the rest: a matrix product
   gives all intersections there, and at most one link for each member leaves it, so rows do not grow with the
   square of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .components import components
from .flat import U
from .scratch import cut, discard, salted_left_join, small_batches

SYMBOLS, BITS = 5, 16
#: Bits of a set's parity bitmap: bit i is odd if an odd number of its shingles hash to i.
PARITY_BITS = 1024
#: Allowed chance that a pair just at the threshold shares no key.
MISS = 3e-5
#: Members of a shingle group that are paired; of larger ones, members and hashes of a block, about.
PAIRED = 32
BLOCK_ROWS, BLOCK_HASHES = 512, 1 << 19


def chunks_for(threshold: float) -> int:
    """Chunks of SYMBOLS symbols so that a pair at ``threshold`` is missed with chance <= MISS."""
    found = threshold**SYMBOLS + SYMBOLS * (1 - threshold) * threshold ** (SYMBOLS - 1)
    return max(2, math.ceil(math.log(MISS) / math.log(1 - found)))


def seeds(count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(4)).integers(1, 2**63, (count, 2), dtype=np.uint64) * U(2) + U(1)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, row offsets).  Letters A-Z are lowered; a text
    with fewer words than ``width`` has its whole sequence as one shingle; without words none."""
    data, offsets = flat.texts(column)
    values, _, _, rows = flat.word_hashes(data, offsets, lower=True)
    counts = np.diff(rows)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for a, b in flat.chunks(rows, 200_000):
        w = values[rows[a] : rows[b]]
        local = rows[a : b + 1] - rows[a]
        pre = flat.prefix(w)
        n = np.maximum(np.diff(local) - width + 1, np.minimum(np.diff(local), 1))
        row = np.repeat(np.arange(b - a), n)
        start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + local[:-1][row]
        h = flat.ranged(pre, start, np.minimum(start + width, local[1:][row]))
        order = np.lexsort((h, row)) if b - a > 1 else np.argsort(h)
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        out.append(h[new])
        sizes[a:b] = np.bincount(row[new], minlength=b - a)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])


def set_digests(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.flatnonzero(np.diff(offsets))
    one, two = np.zeros(len(offsets) - 1, U), np.zeros(len(offsets) - 1, U)
    if len(full):
        size = np.diff(offsets)[full].astype(U)
        one[full] = flat.mix(np.add.reduceat(flat.mix(h ^ U(0x1234567)), offsets[full]) + size)
        two[full] = flat.mix(np.add.reduceat(flat.mix(h * U(0x9E3779B97F4A7C15)), offsets[full]) ^ size)
    return one, two


def signatures(h: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """rows x count MinHash symbols of BITS bits (zeros for an empty set)."""
    out = np.zeros((len(offsets) - 1, count), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for i, (flip, mult) in enumerate(seeds(count)):
            least = np.minimum.reduceat((h ^ flip) * mult, offsets[full])
            out[full, i] = (flat.mix(least) & U((1 << BITS) - 1)).astype(np.uint16)
    return out


def _scan(width: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, offsets = shingle_sets(batch.column(1), width)
            one, two = set_digests(h, offsets)
            sig = signatures(h, offsets, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), flat.signed(one), flat.signed(two), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return run


def _keys(chunks: int):
    """Each chunk of a signature under each of its allowed errors: one symbol left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, SYMBOLS).astype(U)
            for c in range(chunks):
                for gap in range(SYMBOLS):
                    key = np.full(len(sig), c * SYMBOLS + gap + 1, U)
                    for s in range(SYMBOLS):
                        if s != gap:
                            key = flat.mix(key * U(0x9E3779B97F4A7C15) + sig[:, c, s])
                    yield pa.RecordBatch.from_arrays([flat.signed(key), batch.column(0)], names=["key", "rep"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, rep): keep keys of several members, each with its smallest, streaming."""
    held_key = held_rep = None  # first row of the key that the last batch ended in
    shown = True  # whether that first row has been emitted
    for batch in batches:
        key, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        first[0] = held_key is None or key[0] != held_key
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), -1))
        star = np.where(at >= 0, rep[np.maximum(at, 0)], held_rep if held_rep is not None else 0)
        several = ~first
        several[:-1] |= ~first[1:]
        k, r, s = key[several], rep[several], star[several]
        if not first[0] and not shown:
            k, r, s = np.r_[held_key, k], np.r_[held_rep, r], np.r_[held_rep, s]
            shown = True
        if first.any():
            last = int(np.flatnonzero(first)[-1])
            held_key, held_rep, shown = key[last], rep[last], last < len(key) - 1
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(s)], names=["key", "rep", "star"])


def _sets(width: int):
    """The sets of the rows (rep, d1, d2, text) whose digests these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, offsets = shingle_sets(batch.column(3), width)
            one, two = set_digests(h, offsets)
            own = (one.view(np.int64) == batch.column(1).to_numpy()) & (two.view(np.int64) == batch.column(2).to_numpy())
            raw = h.tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["rep", "hashes"]).filter(pa.array(own))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, kept = a, np.frombuffer(x.as_buffer(), U)
                other = np.frombuffer(y.as_buffer(), U)
                small, large = (kept, other) if len(kept) <= len(other) else (other, kept)
                ok = False
                if 100 * len(small) >= percent * len(large):
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    ok = 100 * both >= percent * (len(small) + len(large) - both)
                good.append(ok)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long")


def _slot_counts(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), U)
            total += np.bincount((h % U(slots)).astype(np.int64), minlength=slots)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["slot", "n"])

    return run


def head(h: np.ndarray, slot_counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set that must meet those of any set it can be linked with, the rarest first."""
    n = len(h) - -(-percent * len(h) // 100) + 1
    return h[np.lexsort((h, slot_counts[(h % U(len(slot_counts))).astype(np.int64)]))[:n]]


def _parity(h: np.ndarray) -> bytes:
    odd = np.bincount((h >> U(40)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _heads(slot_counts: np.ndarray, percent: int):
    """The head of each set (rep, component, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), U) for x in batch.column(2)]
            heads = pa.array([head(h, slot_counts, percent).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array([_parity(h) for h in sets], pa.binary()), heads], names=["rep", "component", "size", "parity", "head"])

    return run


def _rarest(slot_counts: np.ndarray, percent: int):
    """A row for each shingle in the head of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, which, ranks, sizes, maps = [], [], [], [], []
            for i, x in enumerate(batch.column(2)):
                h = np.frombuffer(x.as_buffer(), U)
                keys.append(head(h, slot_counts, percent))
                which.append(np.full(len(keys[-1]), i))
                ranks.append(np.arange(len(keys[-1])))
                sizes.append(np.full(len(keys[-1]), len(h)))
                maps.append(_parity(h))
            if keys:
                at = pa.array(np.concatenate(which))
                yield pa.RecordBatch.from_arrays([flat.signed(np.concatenate(keys)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(ranks)), pa.array(np.concatenate(sizes)), pa.array(maps, pa.binary()).take(at)], names=["shingle", "rep", "component", "rank", "size", "parity"])

    return run


def _across(percent: int):
    """Rows sorted by (shingle, component, rep): pairs of one shingle in different components that can
    still reach the threshold, in slices.  If this is the first shingle they share in the global order, what
    follows it bounds their intersection; a pair that shares an earlier one is judged there.  And two sets differ
    in at least as many shingles as their parity bitmaps do in bits."""

    def pairs(rep: np.ndarray, comp: np.ndarray, rank: np.ndarray, size: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        if comp[0] == comp[-1]:
            return
        bits = np.frombuffer(b"".join(parity.tolist()), U).reshape(len(rep), -1)
        left = size - rank  # of each set, from this shingle on
        ends = np.searchsorted(comp, comp, "right")  # partners of row i: from ends[i] on
        for a in np.flatnonzero(ends < len(rep)).tolist():
            b = slice(ends[a], None)
            most = np.minimum(left[a], left[b])
            fit = (100 + percent) * most >= percent * (size[a] + size[b])
            at = np.flatnonzero(fit) + int(ends[a])
            differ = np.bitwise_count(bits[at] ^ bits[a]).sum(1)
            other = rep[at[(100 + percent) * differ <= (100 - percent) * (size[a] + size[at])]]
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, rep[a])), pa.array(np.maximum(other, rep[a]))], names=["a", "b"])

    def merged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for x in found:
            held.append(x)
            rows += x.num_rows
            if rows >= 20_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            k, *rest = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            if not len(k):
                continue
            cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if k[a] != key:
                    if held:
                        yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    key, held = k[a], []
                held.append([x[a:b] for x in rest])
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return lambda batches: merged(groups(batches))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many values any two of the sets share."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")  # owners of one shingle ascend
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    shingle = np.cumsum(new) - 1
    held_by = np.bincount(shingle)[shingle]
    both = np.zeros((n, n), np.float32)
    few = (held_by > 1) & (held_by <= FEW)
    own, which = owner[few], shingle[few]
    for step in range(1, FEW):
        same = which[step:] == which[:-step]
        both += np.bincount(own[:-step][same] * n + own[step:][same], minlength=n * n).reshape(n, n).astype(np.float32)
    own, which = owner[held_by > FEW], shingle[held_by > FEW]
    _, which = np.unique(which, return_inverse=True)
    for a in range(0, int(which[-1]) + 1 if len(which) else 0, COLUMNS):
        lo, hi = np.searchsorted(which, (a, a + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[own[lo:hi], which[lo:hi] - a] = 1
        both += np.triu(part @ part.T, 1)
    return both + both.T


def tile_open(rank: np.ndarray, component: np.ndarray, size: np.ndarray, parity: list[bytes], before: list[np.ndarray], percent: int) -> np.ndarray:
    """Places of the members of a tile that can be linked with a member of another component and meet it here first:
    ``before`` holds what is rarer in each member's head than the tile's shingle, which is at ``rank``."""
    bits = np.frombuffer(b"".join(parity), U).reshape(len(size), -1)
    left = size - rank
    fit = np.zeros((len(size), len(size)), bool)
    for a in range(len(size)):
        at = np.flatnonzero((component != component[a]) & ((100 + percent) * np.minimum(left[a], left) >= percent * (size[a] + size)))
        differ = np.bitwise_count(bits[at] ^ bits[a]).sum(1)
        fit[a, at] = (100 + percent) * differ <= (100 - percent) * (size[a] + size[at])
    at = np.flatnonzero(fit.any(1))
    if not len(at):
        return at
    first = fit[np.ix_(at, at)] & (intersections([before[i] for i in at.tolist()]) == 0)
    return at[first.any(1)]


def tile_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of a tile, by place."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    both = intersections(sets)
    linked = 100 * both >= percent * (size[:, None] + size[None] - both)
    apart, links = np.ones(n, bool), []
    for root in range(n):
        todo = [root] if apart[root] else []
        apart[root] = False
        while todo:
            at = todo.pop()
            near = np.flatnonzero(linked[at] & apart)
            apart[near] = False
            todo += near.tolist()
            links += [(at, x) for x in near.tolist()]
    return links


#: Shingles of at most so many members of a tile are counted pair by pair, others in matrix products of so many columns.
FEW, COLUMNS = 8, 4096


def _open(percent: int):
    """Rows (tile, rep, rank, component, size, parity, before) sorted by tile: the members that stay in each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def done() -> pa.RecordBatch:
            rep, rank, component, size, parity, before = zip(*held, strict=True)
            at = tile_open(np.array(rank), np.array(component), np.array(size), parity, [np.frombuffer(x, U) for x in before], percent)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tile)), pa.array(np.array(rep)[at])], names=["tile", "rep"])

        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != tile and held:
                    yield done()
                    held = []
                tile = t
                held.append(row)
        if held:
            yield done()

    return run


def _tiles(percent: int):
    """Rows (tile, rep, hashes) sorted by tile: the links of each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, reps, sets = None, [], []

        def done() -> pa.RecordBatch:
            links = tile_links(sets, percent)
            a, b = (pa.array([reps[x[i]] for x in links], pa.int64()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            for t, r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if t != tile and reps:
                    yield done()
                    reps, sets = [], []
                tile = t
                reps.append(r)
                sets.append(np.frombuffer(x.as_buffer().to_pybytes(), U))
        if reps:
            yield done()

    return run


def _in_tiles(rare: DataFrame, large: DataFrame, rest: DataFrame, slot_counts: np.ndarray, percent: int) -> DataFrame:
    """Links (a, b) among the members of each ``large`` shingle group: any two of its ``blocks`` meet in a tile."""
    dealt = salted_left_join(rare.select("shingle", "rep", "rank"), large.select("shingle", "blocks"), "shingle", "rep").where("blocks is not null")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", "shingle"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tile = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other"))
    met = dealt.where("own <> other or blocks = 1").select(tile.alias("tile"), "rep", "rank")
    heads = rest.mapInArrow(_heads(slot_counts, percent), "rep long, component long, size long, parity binary, head binary")
    before = F.expr("substring(head, 1, cast(8 * rank as int))")
    trimmed = met.join(heads, "rep").select("tile", "rep", "rank", "component", "size", "parity", before.alias("before"))
    kept = trimmed.repartition("tile").sortWithinPartitions("tile").mapInArrow(_open(percent), "tile long, rep long")
    return kept.join(rest.select("rep", "hashes"), "rep").select("tile", "rep", "hashes").repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(percent), "a long, b long")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (smallest id reachable over
    links, itself included), ``kept`` (id = component_id).

    Two texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word
    shingles.  Null, empty and wordless texts have no shingles and are linked with nothing, even where other rows have
    their id.  Equal texts are linked, whatever their number.  Rows that repeat an id are texts of their own, but
    share one component, and a link of any of them is a link of the id.  Rows without an id are left out.
    No rows: no rows.  Other columns are ignored.  The lower ``percent`` is, the more keys a text has (30 of them
    at 85, 40 at 80, 250 at 50).
    """
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("0 < percent <= 100 and width >= 1 are needed")
    spark = df.sparkSession
    small_batches(spark)
    chunks = chunks_for(percent / 100)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    scanned = cut(docs.mapInArrow(_scan(width, chunks * SYMBOLS), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signatures")
    grouped = scanned.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = cut(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    repeated = scanned.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    some_repeated = bool(repeated.limit(1).count())

    keyed = classes.select("rep", "sig").mapInArrow(_keys(chunks), "key long, rep long")
    buckets = cut(keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_stars, "key long, rep long, star long"), "buckets")
    members = classes.select("rep", "doc_id", "d1", "d2").join(buckets.select("rep").distinct(), "rep", "left_semi")
    # one text per class that shares a key with another
    found = docs.join(members, "doc_id").select("rep", "d1", "d2", "text").mapInArrow(_sets(width), "rep long, hashes binary")
    sets = cut(found.dropDuplicates(["rep"]) if some_repeated else found, "sets")

    stars = buckets.where("rep <> star").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(stars, sets, percent)
    if some_repeated:  # all classes of one id are one
        of_id = scanned.where("n_shingles > 0").join(repeated, "doc_id").select("doc_id", "d1", "d2").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
        links = links.union(of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")))
    links = cut(links, "links")
    joined = components(links)

    # classes of one key that are still apart
    of = buckets.select("key", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    apart = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_reps = of.join(apart, "key", "left_semi").select("rep", "component").distinct()
    rest = cut(open_reps.join(sets, "rep").select("rep", "component", "hashes"), "apart")
    discard(spark, buckets, sets)
    slots = 1 << 16
    counted = rest.select("hashes").mapInArrow(_slot_counts(slots), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(slots, np.int64)
    counts[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    rare = cut(rest.mapInArrow(_rarest(counts, percent), "shingle long, rep long, component long, rank long, size long, parity binary"), "rare")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("hashes") / BLOCK_HASHES))
    sizes = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    groups = cut(sizes.where("lo <> hi").select("shingle", (F.col("n") > PAIRED).alias("large"), F.when(F.col("n") <= 2 * BLOCK_ROWS, F.lit(1)).otherwise(blocks).cast("long").alias("blocks")), "groups")
    small, large = groups.where("not large"), groups.where("large")
    pairs = rare.join(small, "shingle", "left_semi").repartition("shingle").sortWithinPartitions("shingle", "component", "rep").mapInArrow(_across(percent), "a long, b long").distinct()
    found = [links, cut(_confirmed(pairs, rest.select("rep", "hashes"), percent), "links")]
    if large.limit(1).count():
        found.append(cut(_in_tiles(rare, large, rest, counts, percent).distinct(), "links"))
    final = components(reduce(DataFrame.union, found))
    discard(spark, rest, rare, groups, *found)

    placed = classes.select("d1", "d2", "rep", "doc_id", "copies").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    of_class = placed.join(smallest, "component", "left")
    moved = of_class.where("copies > 1 or component is not null").select(F.struct("d1", "d2").alias("__set"), F.coalesce("least", "doc_id").alias("component_id"))
    rows = scanned.select("doc_id", "n_shingles", F.struct("d1", "d2").alias("__set"))
    out = salted_left_join(rows, moved, "__set", "doc_id")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, with all their columns, whose id is the smallest of its component.

    Every row of an id goes when one of them is linked with a smaller id; rows without an id stay."""
    gone = near_classes(df, id_col, text_col, width, percent).where("not kept").select(id_col).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
