"""Token ids in ORC: stripes of run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id, so files, stripes and rows ascend; each row holds its ids and where
they begin within its file, and one total per file turns that into the global start.  Readers
split files by stripe and prune files, stripes and row groups on the id.

Byte-level BPE works on pre-tokens independently, so pre-tokens are looked up in a table, by their own bytes, and
those not in it go to the tokenizers library, many in one string that it splits in the same way.  The vectorised
pre-tokenizer is used for texts of ASCII and Latin letters, for which its character classes are certain; of any
other text the stretches between words that hold another character, or spell a special token, go to the library whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .flat import U
from .scratch import new_path, small_batches

END_ID = 2
CACHE_SLOTS = 1 << 21
#: Bytes of a pre-token that the table can hold; longer ones are encoded each time.
HELD = 24
#: Bytes that go to the library at once.
BULK = 1 << 16
#: A text that is not plain is taken in stretches of about so many bytes.
STRETCH = 1 << 10
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}

_CLASS = np.full(256, 9, np.uint8)  # 0 letter 1 number 2 other 3 space 9 not certain
_CLASS[0x21:0x7F] = 2
_CLASS[65:91] = _CLASS[97:123] = 0
_CLASS[48:58] = 1
_CLASS[flat.SPACE] = 3
_CLASS[0x80:0xC0] = 0  # continuation bytes, after
_CLASS[0xC3:0xCA] = 0  # the lead bytes of U+00C0 to U+024F, which are letters but for two


def certain(data: np.ndarray) -> bool:
    """Whether the byte classes above are those of the characters."""
    if (_CLASS[data] == 9).any():
        return False
    lead = np.flatnonzero(data[:-1] == 0xC3)
    return not np.isin(data[lead + 1], (0x97, 0xB7)).any()  # the multiplication and division signs


def pretoken_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern, in certain bytes; ``rows``: starts of texts.

    A run of one class is a pre-token, with one space before it if there is one; of white space before
    other text the last character stands alone or joins what follows; ' and a few letters make one."""
    n = len(data)
    kind = _CLASS[data]
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    row = np.zeros(n + 2, bool)
    row[rows] = True
    start |= row[:n]
    # the last white space of a run that text of the same row follows
    last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~row[1:n])
    start[last] = True
    start[last[data[last] == 0x20] + 1] = False
    quote = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & (kind[1:] == 0) & ~row[1:n])
    if len(quote):
        padded = np.r_[data, np.zeros(3, np.uint8)]
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~row[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = inside & (((two == ord("e")) & np.isin(one, (ord("r"), ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after[kind[after] == 0]] = True
    return np.flatnonzero(start)


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def held_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pre-tokens x 3: the first ``HELD`` bytes of each, as little-endian integers; no byte is 0, so they tell its size."""
    padded = np.concatenate([data, np.zeros(HELD + 8, np.uint8)])
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out = np.zeros((len(starts), 3), U)
    out[:, 0] = words[starts] & _MASKS[np.minimum(sizes, 8)]
    for i in (1, 2):
        at = np.flatnonzero(sizes > 8 * i)
        out[at, i] = words[starts[at] + 8 * i] & _MASKS[np.minimum(sizes[at] - 8 * i, 8)]
    return out


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs of ``size`` from ``begin``, one run after another."""
    end = np.cumsum(size)
    return np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


def _mixed(key: np.ndarray) -> np.ndarray:
    h = key[:, 0] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h += key[:, 1] * U(0xD6E8FEB86659FD93) + key[:, 2] * U(0xC2B2AE3D27D4EB4F)
    h *= U(0xA0761D6478BD642F)
    return h ^ (h >> U(32))


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] == b[:, 0]) & (a[:, 1] == b[:, 1]) & (a[:, 2] == b[:, 2])


def _hashed(key: np.ndarray) -> np.ndarray:
    return (_mixed(key) & U(CACHE_SLOTS - 1)).astype(np.int64)


class Encoder:
    """Encodes flat bytes with a table of pre-tokens; bounded: a full table keeps those used since it last was full."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)  # each pre-token comes once: the library's own table only costs time
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: one character for each
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(CACHE_SLOTS, np.int32)  # 1 + the row that a slot holds
        self.rows = np.zeros((CACHE_SLOTS // 2 + 1, 3), U)  # row 0: none
        self.used = np.zeros(CACHE_SLOTS // 2 + 1, bool)
        self.begin, self.size = np.zeros(CACHE_SLOTS // 2 + 1, np.int64), np.zeros(CACHE_SLOTS // 2 + 1, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.n = self.n_ids = 0

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Row of each key, 0 of those that are not in the table.  Bytes are compared, not only hashes."""
        at = _hashed(key)
        out = self.slots[at]
        todo = np.flatnonzero(~_equal(self.rows[out], key) & (out != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (CACHE_SLOTS - 1)
            out[todo] = row = self.slots[at[todo]]
            todo = todo[~_equal(self.rows[row], key[todo]) & (row != 0)]
        return out

    def _place(self, rows: np.ndarray) -> None:
        at = _hashed(self.rows[rows])
        while len(rows):
            free = self.slots[at] == 0
            self.slots[at[free]] = rows[free]  # of several in one place, one stays
            left = self.slots[at] != rows
            rows, at = rows[left], (at[left] + 1) & (CACHE_SLOTS - 1)

    def _keep(self, key: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New keys, all different, and their ids."""
        if self.n + len(key) > CACHE_SLOTS // 2:
            kept = np.flatnonzero(self.used[: self.n + 1])
            had, size, begin = self.rows[kept], self.size[kept], self.begin[kept]
            held = self.ids[_runs(begin, size)]
            self._clear()
            if len(kept) + len(key) <= CACHE_SLOTS // 2:
                self._keep(had, held, size)
            key, sizes = key[: CACHE_SLOTS // 2 - self.n], sizes[: CACHE_SLOTS // 2 - self.n]
            ids = ids[: int(sizes.sum())]
        rows = np.arange(self.n + 1, self.n + 1 + len(key))
        self.rows[rows], self.size[rows] = key, sizes
        self.begin[rows] = self.n_ids + np.cumsum(sizes) - sizes
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.int32)]
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(key), self.n_ids + len(ids)
        self._place(rows.astype(np.int32))

    def _by_library(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each pre-token).  Pre-tokens are joined, with a line break before those that begin without a
        space, wherever the pattern splits that string into just them; any others are encoded one by one."""
        blank = flat.SPACE[data[starts]]
        alone = flat.SPACE[data[starts + sizes - 1]] | (blank & (data[starts] != 0x20))
        n_ids = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # which pre-tokens, their ids one after another
        joined = np.flatnonzero(~alone)
        single = [np.flatnonzero(alone)]
        for a, b in flat.chunks(np.r_[0, np.cumsum(sizes[joined] + 1)], BULK):
            which = joined[a:b]
            extra = (~blank[which]).astype(np.int64)
            end = np.cumsum(sizes[which] + extra)
            begin = end - sizes[which]
            text = np.full(int(end[-1]), 0x0A, np.uint8)
            text[_runs(begin, sizes[which])] = data[_runs(starts[which], sizes[which])]
            cuts = np.sort(np.r_[begin, begin[extra == 1] - 1])
            ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(self.width[ids])
            first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
            if not (np.array_equal(pretoken_starts(text, np.zeros(1, np.int64)), cuts) and np.isin(end, ends).all() and np.isin(begin[1:], ends).all()):
                single.append(which)
                continue
            n_ids[which] = last - first
            found.append((which, ids[_runs(first, last - first)]))
        which = np.concatenate(single)
        if len(which):
            raw = [data[a:b].tobytes().decode() for a, b in zip(starts[which].tolist(), (starts + sizes)[which].tolist(), strict=True)]
            ids = [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(raw, add_special_tokens=False)]
            n_ids[which] = [len(x) for x in ids]
            found.append((which, np.concatenate(ids)))
        out = np.zeros(int(n_ids.sum()), np.int32)
        at = np.cumsum(n_ids) - n_ids
        for which, ids in found:
            out[_runs(at[which], n_ids[which])] = ids
        return out, n_ids

    def encode(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per row) of certain bytes whose rows begin at ``rows`` (all not empty)."""
        starts = pretoken_starts(data, rows)
        sizes = np.diff(np.r_[starts, len(data)])
        key = held_bytes(data, starts, sizes)
        row = self._find(key)
        row[sizes > HELD] = 0
        self.used[row] = True
        n_ids, begin = self.size[row], self.begin[row]
        new = np.flatnonzero(row == 0)
        ids = self.ids[: self.n_ids]
        if len(new):
            long = sizes[new] > HELD
            _, first, inverse = np.unique(np.where(long, flat.mix(new.astype(U)), _mixed(key[new])), return_index=True, return_inverse=True)
            # equal hashes of different bytes are told apart
            odd = ~_equal(key[new], key[new[first]][inverse])
            first = np.r_[first, np.flatnonzero(odd)]
            inverse[odd] = len(first) - int(odd.sum()) + np.arange(int(odd.sum()))
            which = new[first]
            fresh, many = self._by_library(data, starts[which], sizes[which])
            n_ids[new], begin[new] = many[inverse], len(ids) + (np.cumsum(many) - many)[inverse]
            ids = np.r_[ids, fresh]
            keep = ~odd[first] & ~long[first]
            self._keep(key[which[keep]], fresh[_runs((np.cumsum(many) - many)[keep], many[keep])], many[keep])
        out = ids[_runs(begin, n_ids)]
        at = np.r_[0, np.cumsum(n_ids)][np.searchsorted(starts, np.r_[rows, len(data)])]
        return out, np.diff(at)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in flat.chunks(offsets):
            part = data[offsets[a] : offsets[b]]
            local = offsets[a : b + 1] - offsets[a]
            if b - a > 1 and not self._plain(part):
                for i in range(b - a):
                    out.append(self._encode_text(part[local[i] : local[i + 1]]))
            elif b - a == 1:
                out.append(self._encode_text(part))
            else:
                full = np.diff(local) > 0
                ids, sizes = self.encode(part, local[:-1][full]) if full.any() else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                n = np.zeros(b - a, np.int64)
                n[full] = sizes
                out += np.split(ids, np.cumsum(n)[:-1])
        return out

    def _encode_text(self, text: np.ndarray) -> np.ndarray:
        """One text, in parts; of a part that is not plain the stretches that are."""
        parts = []
        for lo, hi in between_words(text):
            part = text[lo:hi]
            size = hi - lo if self._plain(part) else STRETCH
            for a, b in between_words(part, size):
                if size > STRETCH or self._plain(part[a:b]):
                    parts.append(self.encode(part[a:b], np.zeros(1, np.int64))[0])
                else:
                    parts.append(np.array(self.tokenizer.encode(part[a:b].tobytes().decode(), add_special_tokens=False).ids, np.int32))
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def _plain(self, data: np.ndarray) -> bool:
        if not certain(data):
            return False
        return not any(s in (raw if (raw := data.tobytes()) else b"") for s in self.special)


def between_words(data: np.ndarray, size: int = 2 * flat.CHUNK) -> Iterator[tuple[int, int]]:
    """Parts of a long text, cut before a single space between two ASCII words, where a pre-token always begins."""
    a, n = 0, len(data)
    while n - a > size:
        at = a + size
        while at < n - 1:
            look = data[at - 1 : at + 4097]
            word = ~flat.SPACE[look] & (look < 0x80)
            good = np.flatnonzero((look[1:-1] == 0x20) & word[:-2] & word[2:])
            if len(good):
                at += int(good[0])
                break
            at += 4096
        if at >= n - 1:
            break
        yield a, at
        a = at
    if n > a:
        yield a, n


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.r_[x, np.int32(end_id)] for x in encoder(path).encode_rows(*flat.texts(batch.column(1)))]
            sizes = np.array([len(r) for r in rows])
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(rows).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rows), part, np.int32)), pa.array(start + ends - sizes), pa.array(sizes), ids], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
            start += int(ends[-1])

    return run


def write(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write ORC files in ascending id order.
    Null ids come first; rows that repeat an id follow each other; no rows write no ids.
    The tokenizer file has to be at ``tokenizer_path`` on every executor."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(_encode(tokenizer_path, end_id), SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids.  A condition on
    ``doc_id`` prunes files, stripes and row groups; starts stay global.  One total per file is gathered
    (as many as there are files, which the driver lists anyway)."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases = np.cumsum([0] + [r["n"] for r in totals])
    files = spark.createDataFrame([(r["part"], int(b)) for r, b in zip(totals, bases, strict=False)], "part int, base long")
    if where is not None:
        rows = rows.where(where)
    return rows.join(F.broadcast(files), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, at = np.ascontiguousarray(lists.values.to_numpy(), "<i4"), lists.offsets.to_numpy()
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write a token file of ``df`` to the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(df.sparkSession, "tokens")
    write(df, path, tokenizer_path, id_col, text_col)
    return read(df.sparkSession, path).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
