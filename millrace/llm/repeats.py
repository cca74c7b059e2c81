"""The distributed half of ``windows``: from anchor rows to the spans that repeated windows cover.

An anchor row is (fp, around, doc_id, packed, halves): hash of the anchor's own tokens, hash of its
surroundings, the document, position, window starts and copies in one long, and hashes of both halves of
the surroundings in one int.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, windows
from .flat import U
from .scratch import cut

ROWS = "fp long, around long, doc_id long, packed long, halves int"
MARKS = "kind int, doc_id long, pos long, first long, last long, fp long, halves int"
DECIDED = 0  # copies of a row whose windows are known to repeat


def pack(pos, first, last, copies):
    return (pos << 30) | ((pos - first) << 18) | ((last - first) << 6) | copies


def unpack(packed):
    pos = packed >> 30
    first = pos - ((packed >> 18) & 0xFFF)
    return pos, first, first + ((packed >> 6) & 0xFFF), packed & 0x3F


def anchor_batch(doc_id: np.ndarray, pos, first, last, fp, around, halves) -> pa.RecordBatch:
    """Rows of one batch, combined: of equal (fp, around) only the first occurrence goes on to be
    compared; the rest are decided here.  So a passage that is in a third of all documents
    gives each shuffle partition a row per batch, not a row per document."""
    order = np.lexsort((pos, doc_id, around, fp))
    doc_id, pos, first, last, fp, around, halves = (x[order] for x in (doc_id, pos, first, last, fp, around, halves))
    n = len(fp)
    if not n:
        return _rows(fp, around, doc_id, pos, halves)
    new = np.ones(n, bool)
    new[1:] = (fp[1:] != fp[:-1]) | (around[1:] != around[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    same = (doc_id == doc_id[head]) & (pos == pos[head])  # one occurrence whose windows were loaded in two parts
    twins = np.zeros(n, bool)
    twins[head[~same]] = True
    copies = np.where(same, np.where(twins[head], 2, 1), DECIDED)
    # decided rows need no company: any partition will do
    fp = np.where(same, fp, flat.mix(doc_id.astype(U) * U(0x9E3779B97F4A7C15) + pos.astype(U)))
    return _rows(fp, around, doc_id, pack(pos, first, last, copies), halves)


def _rows(fp, around, doc_id, packed, halves) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([flat.signed(fp), flat.signed(around), pa.array(doc_id, pa.int64()), pa.array(packed, pa.int64()), pa.array(halves, pa.int32())], names=["fp", "around", "doc_id", "packed", "halves"])


def classify(everywhere: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (fp, around, doc_id, packed), streaming with a carry of a few rows.

    kind 0: windows that certainly repeat - equal surroundings were seen earlier (``everywhere``: or later).
    (Neither ``fp`` nor ``halves`` are given for these.)
    kind 1: the first occurrence of each of several different surroundings of one anchor: some of their
    windows may be equal and are compared one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None  # fp, around, doc, packed, halves, told as kind 1, told as kind 0
        for batch in batches:
            fp, around, doc, packed, halves = (c.to_numpy() for c in batch.columns)
            done = (packed & 0x3F) == DECIDED
            out = [(np.zeros(int(done.sum()), np.int32), doc[done], packed[done], fp[done] * 0, halves[done] * 0)]
            live = ~done
            rows = [fp[live], around[live], doc[live], packed[live], halves[live], np.zeros(int(live.sum()), bool), np.zeros(int(live.sum()), bool)]
            if carry is not None:
                rows = [np.concatenate(x) for x in zip(carry, rows, strict=True)]
            fp, around, doc, packed, halves, told1, told0 = rows
            n = len(fp)
            if n:
                at = np.arange(n)
                new_fp, new_class = np.ones(n, bool), np.ones(n, bool)
                new_fp[1:] = fp[1:] != fp[:-1]
                new_class[1:] = new_fp[1:] | (around[1:] != around[:-1])
                head = np.maximum.accumulate(np.where(new_class, at, 0))
                group = np.cumsum(new_fp) - 1
                rep = (doc == doc[head]) & (packed >> 30 == packed[head] >> 30)
                several = (np.bincount(group, new_class) > 1)[group]
                kind1 = rep & several & ~told1
                kind0 = ~rep & ~told0
                if everywhere:
                    multi = np.zeros(n, bool)
                    multi[head[~rep | ((packed & 0x3F) > 1)]] = True
                    kind0 |= rep & multi[head] & ~told0
                for kind, pick in ((0, kind0), (1, kind1)):
                    out.append((np.full(int(pick.sum()), kind, np.int32), doc[pick], packed[pick], fp[pick] * kind, halves[pick] * kind))
                told1, told0 = told1 | kind1, told0 | kind0
                begin = int(np.flatnonzero(new_fp)[-1])
                hold = rep & (at >= begin) & ((head == begin) | (head == head[-1]))
                carry = [x[hold] for x in (fp, around, doc, packed, halves, told1, told0)]
            kind, doc, packed, fp, halves = (np.concatenate(x) for x in zip(*out, strict=True))
            pos, first, last, _ = unpack(packed)
            yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, (doc, pos, first, last, fp, halves))], names=["kind", "doc_id", "pos", "first", "last", "fp", "halves"])

    return run


def sorted_classes(anchors: DataFrame, everywhere: bool) -> DataFrame:
    return anchors.repartition("fp").sortWithinPartitions("fp", "around", "doc_id", "packed").mapInArrow(classify(everywhere), MARKS)


def _window_rows(tokens: Callable, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            spans = batch.column(2)
            for i in range(batch.num_rows):
                one, two = tokens(batch.column(1).slice(i, 1))
                own = spans[i].values
                first, last = own.field("first").to_numpy(), own.field("last").to_numpy()
                n = last - first + 1
                start = np.unique(np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                for a in range(0, len(start), 100_000):
                    part = start[a : a + 100_000]
                    lo, hi = int(part[0]), int(part[-1]) + depth
                    h1, h2 = windows.window_digests(one[lo:hi], two[lo:hi], part - lo, depth)
                    yield pa.RecordBatch.from_arrays([flat.signed(h1), flat.signed(h2), pa.array(np.full(len(part), ids[i])), pa.array(part)], names=["h1", "h2", "doc_id", "start"])

    return run


def _equal_windows(everywhere: bool):
    """Rows sorted by (h1, h2, doc_id, start), streaming: all of a repeated window but the first, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shown = None, True
        for batch in batches:
            h1, h2, doc, start = (c.to_numpy() for c in batch.columns)
            n = len(h1)
            if not n:
                continue
            same = np.zeros(n, bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            same[0] = held is not None and (h1[0], h2[0]) == held[:2]
            again = same.copy()
            extra_doc, extra_start = [], []
            if everywhere:
                again[:-1] |= same[1:]
                if same[0] and not shown:
                    extra_doc, extra_start = [held[2]], [held[3]]
            shown = bool(again[-1]) if everywhere else True
            held = (h1[-1], h2[-1], doc[-1], start[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.array(extra_doc, np.int64), doc[again]]), pa.array(np.r_[np.array(extra_start, np.int64), start[again]])], names=["doc_id", "first"])

    return run


def narrowed(marks: DataFrame, depth: int, k: int) -> DataFrame:
    """Kind 1 rows (doc_id, first, last), cut to the windows that can be equal to one of another row of their
    anchor: those holding a half of the surroundings that another row has too."""
    half = (depth - k) // 2
    one = marks.where("kind = 1").withColumns({"left": F.shiftrightunsigned("halves", 16), "right": F.col("halves").bitwiseAND(F.lit(0xFFFF))})
    for side in ("left", "right"):
        shared = one.groupBy("fp", side).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp", side, F.lit(True).alias(f"{side}_shared"))
        one = one.join(shared, ["fp", side], "left")
    left, right = F.coalesce("left_shared", F.lit(False)), F.coalesce("right_shared", F.lit(False))
    # a window that starts at least ``half`` before the anchor holds the left half; one that starts less before, the right
    first = F.when(left, F.col("first")).otherwise(F.greatest("first", F.col("pos") - half + 1))
    last = F.when(right, F.col("last")).otherwise(F.least("last", F.col("pos") - half))
    return one.where(left | right).select("doc_id", first.alias("first"), last.alias("last")).where("first <= last")


def compared(marks: DataFrame, docs: DataFrame, tokens: Callable, depth: int, k: int, everywhere: bool) -> DataFrame:
    """(doc_id, first) of the windows of kind 1 rows that are equal to a window elsewhere."""
    return compared_windows(narrowed(marks, depth, k), docs, tokens, depth, everywhere)


def compared_windows(asked: DataFrame, docs: DataFrame, tokens: Callable, depth: int, everywhere: bool) -> DataFrame:
    """(doc_id, first) of the windows asked for, as (doc_id, first, last), that are equal to one of another place."""
    asked = asked.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("asked"))
    rows = docs.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_window_rows(tokens, depth), "h1 long, h2 long, doc_id long, start long")
    return rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "start").mapInArrow(_equal_windows(everywhere), "doc_id long, first long")


def spans_by_doc(marks: DataFrame, docs: DataFrame, tokens: Callable, depth: int, k: int, everywhere: bool) -> DataFrame:
    """(doc_id, spans): the [first, end) token spans of each document that repeated windows cover."""
    return spans_of(marks, cut(compared(marks, docs, tokens, depth, k, everywhere), "windows"), depth)


def spans_of(marks: DataFrame, one_by_one: DataFrame, depth: int) -> DataFrame:
    certain = marks.where("kind = 0").select("doc_id", "first", (F.col("last") + depth).alias("end"))
    every = certain.union(one_by_one.select("doc_id", "first", (F.col("first") + depth).alias("end")))
    return every.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
