"""Exact dedup over a cuckoo-filter index of live digests.

The digest space is cut into shards.  A shard's cuckoo filter holds 16-bit fingerprints of the live SHA-256 digests, and
beside each fingerprint, in the same bucket, the digest itself, the id that stays and the number of copies.
A hit in the filter is only a hint: it is verified against the content of its bucket.  When a copy arrives, the live
digest is deleted and inserted anew with the preferred id; when an insertion finds no free slot after ``MAX_KICKS``
moves, or the table is nearly full, it doubles and is rebuilt from the stored keys.

``DigestIndex`` keeps the shards in a table in the shared folder.  Every insertion or deletion of a batch writes
the next version of that table, so a version is whole or absent, and any version can be opened again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import U
from .scratch import discard_path, new_path, salted_left_join

SLOTS = 4
MAX_KICKS = 200
#: Rows of a table that goes to one shard, about.
SHARD_ROWS = 200_000
#: Rows that a task combines before they are dealt to shards.
COMBINED_ROWS = 1 << 16
#: Share of the slots above which a table doubles.
FULL = 0.85
STATE = "shard int, body binary"


class CuckooIndex:
    """Live digests (32 bytes, as rows of four integers) with an id, whether that is known, and a number of copies.

    All of it lies in arrays by slot; every operation takes many digests, all different, at once."""

    def __init__(self, buckets: int = 1024) -> None:
        self.live = self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        n = buckets * SLOTS
        self.marks = np.zeros(n, np.uint16)  # the filter; 0: free
        self.keys = np.zeros((n, 4), U)
        self.kept, self.known, self.copies = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        marks = (keys[:, 0] & U(0xFFFF)).astype(np.uint16)
        marks[marks == 0] = 1
        first = (keys[:, 1] & U(self.buckets - 1)).astype(np.int64)
        return marks, first, self._other(first, marks)

    def _other(self, bucket, mark):
        return bucket ^ ((np.int64(mark) * 0x5BD1E995) & (self.buckets - 1))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 of those that are not live.  Hits of the filter are verified."""
        out = np.full(len(keys), -1, np.int64)
        marks, *places = self._places(keys)
        for bucket in places:
            for slot in range(SLOTS):
                at = bucket * SLOTS + slot
                hint = np.flatnonzero(self.marks[at] == marks)
                real = hint[(self.keys[at[hint]] == keys[hint]).all(1)]
                out[real] = at[real]
        return out

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Whether each digest was live; none is, after."""
        at = self.find(keys)
        self.marks[at[at >= 0]] = 0
        self.live -= int((at >= 0).sum())
        return at >= 0

    def insert(self, keys: np.ndarray, kept: np.ndarray, known: np.ndarray, copies: np.ndarray) -> None:
        """Digests that are not live."""
        if self.live + len(keys) > FULL * len(self.marks):
            self._grow(self.live + len(keys))
        self.live += len(keys)
        left = self._fill(keys, kept, known, copies)
        while len(left):
            stray = self._kick(*(x[left[0] : left[0] + 1] for x in (keys, kept, known, copies)))
            left = left[1:]
            if stray is not None:
                self._grow(self.live, stray)

    def _put(self, at: np.ndarray, marks, keys, kept, known, copies) -> None:
        self.marks[at], self.keys[at], self.kept[at], self.known[at], self.copies[at] = marks, keys, kept, known, copies

    def _fill(self, keys, kept, known, copies) -> np.ndarray:
        """Puts digests where either bucket has room; those left over."""
        marks, *places = self._places(keys)
        todo = np.arange(len(keys))
        for bucket in places:
            waiting = todo
            while len(waiting):
                rows = bucket[waiting, None] * SLOTS + np.arange(SLOTS)
                free = self.marks[rows] == 0
                waiting, free, rows = waiting[free.any(1)], free[free.any(1)], rows[free.any(1)]
                if not len(waiting):
                    break
                _, one = np.unique(bucket[waiting], return_index=True)  # one for each bucket at a time
                now = waiting[one]
                self._put(rows[one, free[one].argmax(1)], marks[now], keys[now], kept[now], known[now], copies[now])
                gone = np.zeros(len(keys), bool)
                gone[now] = True
                todo, waiting = todo[~gone[todo]], waiting[~gone[waiting]]
        return todo

    def _kick(self, *item: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """None when placed; else the one left over after MAX_KICKS moves."""
        if not len(self._fill(*item)):
            return None
        mark, _, bucket = (x[0] for x in self._places(item[0]))
        for kick in range(MAX_KICKS):
            at = np.array([bucket * SLOTS + kick % SLOTS])
            old = tuple(x[at].copy() for x in (self.keys, self.kept, self.known, self.copies))
            old_mark = self.marks[at[0]]
            self._put(at, mark, *item)
            item, mark, bucket = old, old_mark, self._other(bucket, old_mark)
            free = np.flatnonzero(self.marks[bucket * SLOTS : (bucket + 1) * SLOTS] == 0)
            if len(free):
                self._put(np.array([bucket * SLOTS + free[0]]), mark, *item)
                return None
        return item

    def _grow(self, room: int, stray: tuple[np.ndarray, ...] | None = None) -> None:
        stored = self.entries()
        if stray is not None:
            stored = tuple(np.concatenate(x) for x in zip(stored, stray, strict=True))
        buckets = self.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            if room > FULL * buckets * SLOTS:
                continue
            self._clear(buckets)
            left = self._fill(*stored)
            if all(self._kick(*(x[i : i + 1] for x in stored)) is None for i in left.tolist()):
                return

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """keys, ids, whether these are known, copies of all live digests."""
        at = np.flatnonzero(self.marks)
        return self.keys[at], self.kept[at], self.known[at], self.copies[at]

    def add(self, keys: np.ndarray, kept: np.ndarray, known: np.ndarray, copies: np.ndarray, larger: bool) -> None:
        """Copies of any digests: those that are live are deleted and inserted anew, with the preferred id."""
        keys, kept, known, copies = combined(keys, kept, known, copies, larger)
        at = self.find(keys)
        had, at = np.flatnonzero(at >= 0), at[at >= 0]
        better = known[had] & (~self.known[at] | ((kept[had] > self.kept[at]) == larger))
        kept[had] = np.where(better, kept[had], self.kept[at])
        known[had] |= self.known[at]
        copies[had] += self.copies[at]
        self.delete(keys[had])
        self.insert(keys, kept, known, copies)

    def to_bytes(self) -> bytes:
        parts = (np.array([self.buckets, self.live, self.resizes], np.int64), self.marks, self.keys, self.kept, self.known, self.copies)
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, body: bytes) -> CuckooIndex:
        buckets, live, resizes = np.frombuffer(body, np.int64, 3).tolist()
        out, at = cls(buckets), 24
        out.live, out.resizes = live, resizes
        for name in ("marks", "keys", "kept", "known", "copies"):
            x = getattr(out, name)
            x[...] = np.frombuffer(body, x.dtype, x.size, at).reshape(x.shape)
            at += x.nbytes
        return out


def combined(keys: np.ndarray, kept: np.ndarray, known: np.ndarray, copies: np.ndarray, larger: bool) -> tuple[np.ndarray, ...]:
    """Rows of equal digests as one."""
    rank = np.where(known, kept if larger else -kept, np.iinfo(np.int64).min)
    order = np.lexsort((rank, known, *keys.T))
    keys, kept, known, copies = keys[order], kept[order], known[order], copies[order]
    last = np.ones(len(keys), bool)
    last[:-1] = (keys[1:] != keys[:-1]).any(1)
    total = np.cumsum(copies)[last]
    return keys[last], kept[last], known[last], np.diff(np.r_[0, total])


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(-1, 4)


def _rows(shards: int, keys, kept, known, copies) -> pa.RecordBatch:
    shard = ((keys[:, 2] >> U(8)) % U(shards)).astype(np.int32)
    raw = np.ascontiguousarray(keys).tobytes()
    digest = pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.nulls(len(keys), pa.binary()), digest, pa.array(kept, mask=~known), pa.array(copies)], names=["shard", "body", "digest", "kept", "copies"])


def _combine(shards: int, larger: bool):
    """Rows (id, digest) of one task, combined: a text that a third of all rows have leaves a row per ``COMBINED_ROWS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids = t.column(0).combine_chunks()
            known = ~np.asarray(ids.is_null())
            keys = _digests(t.column(1))
            return _rows(shards, *combined(keys, ids.fill_null(0).to_numpy(), known, np.ones(len(keys), np.int64), larger))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= COMBINED_ROWS:
                yield done()
                held = []
        if held:
            yield done()

    return run


def _update(larger: bool, remove: bool):
    """Rows sorted by (shard, body first): the state of a shard, if it has one, and then the rows of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index = None, CuckooIndex()

        def state() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([index.to_bytes()], pa.binary())], names=["shard", "body"])

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if shard[a] != current:
                    if current is not None:
                        yield state()
                    current, index = int(shard[a]), CuckooIndex()
                part = batch.slice(a, b - a)
                if part.column(1)[0].is_valid:
                    index = CuckooIndex.from_bytes(part.column(1)[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                keys, kept = _digests(part.column(2)), part.column(3)
                if remove:
                    index.delete(np.unique(keys, axis=0))
                else:
                    index.add(keys, kept.fill_null(0).to_numpy(), ~np.asarray(kept.is_null()), part.column(4).to_numpy(), larger)
        if current is not None:
            yield state()

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body in batch.column(1):
            keys, kept, known, copies = CuckooIndex.from_bytes(body.as_py()).entries()
            for a in range(0, len(keys), 50_000):
                part = _rows(1, *(x[a : a + 50_000] for x in (keys, kept, known, copies)))
                yield part.select([2, 3, 4])


class DigestIndex:
    """A persisted index: its shards are the rows of the latest version of the table at ``path``.

    The number of shards is fixed when it is made; a shard's table grows with what it holds."""

    def __init__(self, spark: SparkSession, path: str, shards: int, larger: bool = True, version: int = 0) -> None:
        self.spark, self.path, self.shards, self.larger, self.version = spark, path, shards, larger, version

    @classmethod
    def create(cls, spark: SparkSession, rows: int, larger: bool = True) -> DigestIndex:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))
        return cls(spark, new_path(spark, "digests"), shards, larger)

    @classmethod
    def reopen(cls, spark: SparkSession, path: str, shards: int, version: int, larger: bool = True) -> DigestIndex:
        return cls(spark, path, shards, larger, version)

    def _state(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v{self.version}")

    def _apply(self, rows: DataFrame, remove: bool) -> None:
        kind = f"{STATE}, digest binary, kept long, copies long"
        batch = rows.select(F.col("doc_id").cast("long"), "digest").mapInArrow(_combine(self.shards, self.larger), kind)
        if self.version:
            batch = self._state().select("shard", "body", *(F.lit(None).cast(t).alias(n) for n, t in (("digest", "binary"), ("kept", "long"), ("copies", "long")))).union(batch)
        dealt = batch.repartition(self.shards, "shard").sortWithinPartitions("shard", F.col("body").isNull())
        dealt.mapInArrow(_update(self.larger, remove), STATE).write.parquet(f"{self.path}/v{self.version + 1}")
        if self.version:
            discard_path(self.spark, f"{self.path}/v{self.version}")
        self.version += 1

    def insert(self, rows: DataFrame) -> None:
        """``rows``: (doc_id, digest)."""
        self._apply(rows, False)

    def delete(self, rows: DataFrame) -> None:
        """No digest of ``rows`` is live after."""
        self._apply(rows, True)

    def entries(self) -> DataFrame:
        """(digest, kept, copies) of all live digests."""
        return self._state().mapInArrow(_entries, "digest binary, kept long, copies long")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``df``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; a null text is the empty text.  Of equal texts the largest
    (``keep='max'``) or smallest id stays.  Rows that repeat an id count towards ``group_size`` and
    share its ``kept``; a null id stays only in a group without any other.  An empty table
    gives no rows; other columns are ignored.

    A group may hold a third of all rows: tasks combine their rows before they are dealt to shards, and the join
    of the groups with several rows back to the rows is salted.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    index = DigestIndex.create(spark, df.count(), keep == "max")
    index.insert(rows)
    copies = index.entries().where("copies > 1")
    joined = salted_left_join(rows, copies, "digest", "doc_id")
    keep_id = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("kept"))
    return joined.select(
        F.col("doc_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``df``, with all their columns, that stay; one row where a kept row is repeated."""
    own = {"__millrace_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "__millrace_sha": F.lower(F.hex(digest_of(F.col(text_col))))}
    groups = exact_groups(df, id_col, text_col, keep).where("not kept")
    copies = groups.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__millrace_id"), F.col("text_sha256").alias("__millrace_sha")).distinct()
    return df.withColumns(own).join(copies, list(own), "left_anti").dropDuplicates(list(own)).select(*df.columns)
