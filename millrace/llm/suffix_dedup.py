"""Suffix-array dedup of byte strings: a depth-limited, most-significant-digit radix sort.

Suffixes are ordered only through ``depth`` bytes, by passes over their own bytes from the first on; a group that a pass
leaves with one suffix is done and drops out, and after the last pass equal groups are exactly the repeated strings.
As few suffixes as possible get that far:

* dealing - a suffix goes where its anchor does (see ``windows``), which equal suffixes have at the same place;
  anchors that occur once drop out, and those whose whole neighbourhoods are equal are decided together;
* halves - of an anchor with several neighbourhoods, only suffixes stay that hold a half of theirs in common with
  another; suffixes with one anchor and half make a group;
* passes - within a group, suffixes with their anchor at the same place are sorted by ``DIGIT`` bytes after ``DIGIT`` bytes.

A group of over ``GROUP`` rows is not held in one task: its suffixes are sorted outside memory, by digests of 128 bits.
Whole neighbourhoods are compared by such digests, too; the passes compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, repeats, windows
from .scratch import cut, small_batches

ANCHOR = 32
DIGIT = 8
#: Rows of a group that one task sorts.
GROUP = 4096
#: Rows that are sorted at once, if no group is larger.
SORTED = 4096


def byte_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, _ = flat.texts(column)
    return flat.BYTE[data], flat.BYTE_TOO[data]


def _anchors(depth: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = flat.texts(batch.column(1))
            found = []
            for a, b in flat.chunks(offsets):
                if b - a > 1 or offsets[b] - offsets[a] <= 2 * flat.CHUNK:
                    base = offsets[a]
                    part = data[base : offsets[b]]
                    lo, hi = offsets[a:b] - base, offsets[a + 1 : b + 1] - base
                    seg, pos, first, last, fp, around, halves = windows.anchors(flat.BYTE[part], flat.BYTE_TOO[part], lo, hi, lo, hi, depth, k)
                    found.append((ids[a:b][seg], pos - lo[seg], first - lo[seg], last - lo[seg], fp, around, halves))
                    continue
                for load, to, first, last in windows.spans(int(offsets[b] - offsets[a]), depth, k, flat.CHUNK):
                    part = data[offsets[a] + load : offsets[a] + to]
                    one = lambda x: np.array([x])
                    seg, pos, s, e, fp, around, halves = windows.anchors(flat.BYTE[part], flat.BYTE_TOO[part], one(0), one(len(part)), one(first - load), one(last - load), depth, k)
                    found.append((ids[a : a + 1][seg], pos + load, s + load, e + load, fp, around, halves))
            if found:
                yield repeats.anchor_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def grouped(marks: DataFrame, depth: int, k: int) -> DataFrame:
    """(key, n, doc_id, pos, first, last): windows [first, last] of anchors with several neighbourhoods that hold a half
    of theirs in common with another; ``key`` and ``n`` are their group's."""
    half = (depth - k) // 2
    # a window that starts at least ``half`` before the anchor holds the left half; one that starts less before, the right
    left = F.struct(F.lit(0).alias("side"), F.col("first"), F.least("last", F.col("pos") - half).alias("last"), F.shiftrightunsigned("halves", 16).alias("half"))
    right = F.struct(F.lit(1).alias("side"), F.greatest("first", F.col("pos") - half + 1).alias("first"), F.col("last"), F.col("halves").bitwiseAND(F.lit(0xFFFF)).alias("half"))
    rows = marks.where("kind = 1").select("fp", "doc_id", "pos", F.explode(F.array(left, right)).alias("s")).where("s.first <= s.last")
    rows = rows.select(F.xxhash64("fp", "s.side", "s.half").alias("key"), "doc_id", "pos", "s.first", "s.last")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups, "key").select("key", "n", "doc_id", "pos", "first", "last")


def _neighbourhoods(depth: int):
    """(doc_id, text, asked) to a row per asked anchor, with the bytes that its windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.texts(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, asked in enumerate(batch.column(2)):
                own = data[offsets[i] : offsets[i + 1]]
                key, pos, first, last = (asked.values.field(c).to_numpy() for c in ("key", "pos", "first", "last"))
                there = last + depth <= len(own)  # another text of the same id may be shorter
                key, pos, first, last = key[there], pos[there], first[there], last[there]
                for a in range(0, len(key), 20_000):
                    part = slice(a, a + 20_000)
                    held = [own[x : y + depth].tobytes() for x, y in zip(first[part].tolist(), last[part].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(np.full(len(held), ids[i])), pa.array(first[part]), pa.array((pos - first)[part].astype(np.int32)), pa.array(held, pa.binary())], names=["key", "doc_id", "first", "back", "held"])

    return run


def radix_sorted(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` at ``at``, ordered within their groups through ``depth`` bytes, digit by digit: (indices into
    ``at``, new groups) of those equal to another.  Equal ones stay in the order they came in."""
    index = np.argsort(group, kind="stable")
    group = group[index]

    def several(bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        name = np.cumsum(bound) - 1
        keep = np.bincount(name)[name] > 1
        return keep, name[keep]

    if len(index):
        keep, group = several(np.r_[True, group[1:] != group[:-1]])
        index = index[keep]
    for done in range(0, depth, DIGIT):
        if not len(index):
            break
        size = min(DIGIT, depth - done)
        digit = np.zeros((len(index), DIGIT), np.uint8)
        digit[:, DIGIT - size :] = np.lib.stride_tricks.sliding_window_view(data, size)[at[index] + done]
        digit = digit.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        index, group, digit = index[order], group[order], digit[order]
        keep, group = several(np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        index = index[keep]
    return index, group


def _passes(depth: int):
    """Rows of ``_neighbourhoods`` sorted by (key, doc_id, first) to (doc_id, first) of windows equal to an earlier one."""

    def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        key, doc, first, back = (table.column(c).to_numpy() for c in ("key", "doc_id", "first", "back"))
        held = table.column("held").chunk(0)
        offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        data = np.frombuffer(held.buffers()[2], np.uint8)
        n = np.diff(offsets) - depth + 1
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        number = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        # rows come by document and first window; windows have to come by document and start
        doc, start = doc[row], first[row] + step
        order = np.lexsort((start, doc))
        index, group = radix_sorted(data, (offsets[row] + step)[order], (number[row] * (depth + 1) + back[row] - step)[order], depth)
        again = np.r_[False, group[1:] == group[:-1]] if len(group) else np.zeros(0, bool)
        found = order[index[again]]
        return pa.RecordBatch.from_arrays([pa.array(doc[found]), pa.array(start[found])], names=["doc_id", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0).to_numpy()
            if not len(key):
                continue
            if held and sum(b.num_rows for b in held) >= SORTED:  # up to where the first new group begins
                begin = int(np.argmax(key != held[-1].column(0)[-1].as_py())) if (key != held[-1].column(0)[-1].as_py()).any() else len(key)
                if begin < len(key):
                    yield told([*held, batch.slice(0, begin)])
                    held, batch = [], batch.slice(begin)
            held.append(batch)
        if held:
            yield told(held)

    return run


def equal_windows(marks: DataFrame, docs: DataFrame, depth: int, k: int) -> DataFrame:
    """(doc_id, first) of the windows of anchors with several neighbourhoods that are equal to an earlier window."""
    groups = cut(grouped(marks, depth, k), "groups")
    asked = groups.where(F.col("n") <= GROUP).groupBy("doc_id").agg(F.collect_list(F.struct("key", "pos", "first", "last")).alias("asked"))
    rows = docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_neighbourhoods(depth), "key long, doc_id long, first long, back int, held binary")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "doc_id", "first")
    large = repeats.compared_windows(groups.where(F.col("n") > GROUP).select("doc_id", "first", "last"), docs, byte_tokens, depth, False)
    return sorted_rows.mapInArrow(_passes(depth), "doc_id long, first long").union(large)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        n_removed, n_spans, digests = [], [], []
        for i, spans in enumerate(batch.column(2)):
            own = data[offsets[i] : offsets[i + 1]]
            removed = runs = 0
            if spans.is_valid and len(spans.values):
                gone = windows.covered(len(own), spans.values.field("first").to_numpy(), spans.values.field("end").to_numpy())
                removed = int(gone.sum())
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                own = own[~gone]
            n_removed.append(removed)
            n_spans.append(runs)
            digests.append(hashlib.sha256(own.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 100, k: int = ANCHOR) -> DataFrame:
    """(doc_id, spans): byte spans [first, end) covered by a ``depth``-byte string that also starts
    earlier - at a smaller id, or in the same text before.  Overlaps count; strings are judged on the
    input.  Null and short texts have none; a document without spans has no row.  Null ids take no
    part; rows that repeat an id are read as one document, its spans applying to each."""
    if not 0 < k <= depth <= 4000:
        raise ValueError("0 < k <= depth <= 4000 is needed")
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    marks = cut(repeats.sorted_classes(docs.mapInArrow(_anchors(depth, k), repeats.ROWS), False), "marks")
    return repeats.spans_of(marks, cut(equal_windows(marks, docs, depth, k), "windows"), depth)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 100, k: int = ANCHOR) -> DataFrame:
    """One row per row of ``df`` with an id: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the
    bytes that stay, joined).  See ``repeated_spans``; a null text is empty; other columns are ignored."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    spans = repeated_spans(df, id_col, text_col, depth, k)
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
