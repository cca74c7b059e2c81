"""Substring dedup of word windows over a log-structured fingerprint index.

Documents arrive in batches.  A batch's fingerprints - one per anchor of its windows, see ``windows`` -
become an immutable run: a table bucketed and sorted by fingerprint.  Each new run is merge-joined with
the runs of the past (same buckets: no shuffle, no sort of history).  Rows that meet are
verified: equal surroundings prove all windows of both rows equal, otherwise the windows themselves are
compared.  Runs of one level are then compacted into a run of the next, so a row of history is rewritten
logarithmically often.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat, repeats, windows
from .flat import U
from .scratch import cut, small_batches

ANCHOR = 10
BATCHES = 3
#: Runs of one level that are compacted into one of the next.
FAN_IN = 2


def word_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat.texts(column)
    h, _, _, _ = flat.word_hashes(data, offsets)
    return h, flat.mix(h ^ U(0x5851F42D4C957F2D))


def _anchors(depth: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = flat.texts(batch.column(1))
            h, _, _, rows = flat.word_hashes(data, offsets)
            found = []
            for a, b in flat.chunks(rows, 200_000):
                parts = [(rows[a], rows[b], rows[a:b] - rows[a], rows[a + 1 : b + 1] - rows[a], None)]
                if b - a == 1 and rows[b] - rows[a] > 400_000:
                    parts = [(rows[a] + load, rows[a] + to, np.array([0]), np.array([to - load]), (first - load, last - load)) for load, to, first, last in windows.spans(int(rows[b] - rows[a]), depth, k, 200_000)]
                for load, to, lo, hi, asked in parts:
                    own = h[load:to]
                    first, last = (lo, hi) if asked is None else (np.array([asked[0]]), np.array([asked[1]]))
                    seg, pos, s, e, fp, around, halves = windows.anchors(own, flat.mix(own ^ U(0x5851F42D4C957F2D)), lo, hi, first, last, depth, k)
                    shift = lo[seg] if asked is None else rows[a] - load
                    found.append((ids[a:b][seg], pos - shift, s - shift, e - shift, fp, around, halves))
            if found:
                yield repeats.anchor_batch(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


class FingerprintIndex:
    """Runs of historical fingerprints, by level.  ``add`` merges one batch in and returns the marks it
    causes (see ``repeats.classify``): of its own rows, and of rows of history."""

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = FAN_IN) -> None:
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.runs: list[tuple[int, str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"millrace_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        return name

    def _compact(self) -> None:
        while self.runs:
            level = min(n for n, _ in self.runs)
            same = [t for n, t in self.runs if n == level]
            if len(same) < self.fan_in:
                return
            rows = self.spark.table(same[0])
            for t in same[1:]:
                rows = rows.unionByName(self.spark.table(t))
            merged = self._write(rows.repartition(self.buckets, "fp"))
            self.runs = [(n, t) for n, t in self.runs if t not in same] + [(level + 1, merged)]
            for t in same:
                self.spark.sql(f"DROP TABLE {t}")

    def add(self, anchors: DataFrame) -> list[DataFrame]:
        """``anchors``: rows of one batch.  Returns tables of marks; kind 2 rows met another batch's."""
        self._compact()
        seen = cut(anchors.repartition(self.buckets, "fp").sortWithinPartitions("fp", "around", "doc_id", "packed").mapInArrow(_runs_and_marks, "to_run boolean, kind int, fp long, around long, doc_id long, packed long, halves int"), "batch")
        name = self._write(seen.where("to_run").select("fp", "around", "doc_id", "packed", "halves").repartition(self.buckets, "fp"))
        new = self.spark.table(name)
        met = []
        for _, t in self.runs:
            old = self.spark.table(t)
            met.append(new.join(old.select("fp"), "fp", "left_semi"))
            met.append(old.join(new.select("fp"), "fp", "left_semi"))
        self.runs.append((0, name))
        out = [seen.where("not to_run").select("kind", "fp", "around", "doc_id", "packed", "halves")]
        if met:
            rows = met[0]
            for m in met[1:]:
                rows = rows.union(m)
            out.append(cut(rows.select(F.lit(2).alias("kind"), "fp", "around", "doc_id", "packed", "halves"), "met"))
        return out

    def drop(self) -> None:
        for _, t in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.runs = []


def _runs_and_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch, sorted: those for its run (the first of each surroundings), and its own marks."""
    held = None

    def keep() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for batch in batches:
            fp, around, doc, packed, halves = (c.to_numpy() for c in batch.columns)
            live = (packed & 0x3F) != repeats.DECIDED
            f, a, d, p = fp[live], around[live], doc[live], packed[live]
            n = len(f)
            if n:
                new = np.ones(n, bool)
                new[1:] = (f[1:] != f[:-1]) | (a[1:] != a[:-1])
                if held is not None and (f[0], a[0]) == held[:2]:
                    new[0] = False
                head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                first_doc = np.where(head >= 0, d[np.maximum(head, 0)], held[2] if held is not None else 0)
                first_pos = np.where(head >= 0, p[np.maximum(head, 0)] >> 30, held[3] if held is not None else 0)
                rep = (d == first_doc) & (p >> 30 == first_pos)
                held = (f[-1], a[-1], first_doc[-1], first_pos[-1])
                queue.append((f[rep], a[rep], d[rep], p[rep], halves[live][rep]))
            yield batch

    queue: list = []
    for marks in repeats.classify(True)(keep()):
        for f, *rest in queue:
            yield _tagged(True, np.zeros(len(f), np.int32), f, *rest)
        queue.clear()
        kind, doc, pos, first, last, fp, halves = (c.to_numpy() for c in marks.columns)
        yield _tagged(False, kind, fp, np.zeros(len(fp), np.int64), doc, repeats.pack(pos, first, last, 1), halves)


def _tagged(to_run: bool, kind, fp, around, doc, packed, halves) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), to_run)), pa.array(kind), *map(pa.array, (fp, around, doc, packed, halves))], names=["to_run", "kind", "fp", "around", "doc_id", "packed", "halves"])


def _unpacked(rows: DataFrame) -> DataFrame:
    pos = F.shiftright("packed", 30)
    first = pos - F.shiftright("packed", 18).bitwiseAND(F.lit(0xFFF))
    last = first + F.shiftright("packed", 6).bitwiseAND(F.lit(0xFFF))
    return rows.select("kind", "doc_id", pos.alias("pos"), first.alias("first"), last.alias("last"), "fp", "halves")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat.texts(batch.column(1))
        raw = data.tobytes()
        n_words, n_removed, digests = [], [], []
        for i, spans in enumerate(batch.column(2)):
            a, b = int(offsets[i]), int(offsets[i + 1])
            _, start, end, _ = flat.word_hashes(data[a:b], np.array([0, b - a]))
            keep = np.ones(len(start), bool)
            if spans.is_valid and len(spans.values):
                keep = ~windows.covered(len(start), spans.values.field("first").to_numpy(), spans.values.field("end").to_numpy())
            n_words.append(len(start))
            n_removed.append(int((~keep).sum()))
            kept = b" ".join([raw[a + s : a + e] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True)])
            digests.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 35, k: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(doc_id, spans): word spans [first, end) covered by a window of ``depth`` words whose sequence
    also starts anywhere else, before or after, same text included.  Words are maximal runs
    outside space and 0x09-0x0D, unchanged.  Null and short texts have none; a document without spans has no
    row.  Null ids take no part; rows that repeat an id are read as one document.

    The table is fed to the index in ``batches`` parts, dealt by a hash of the id.
    """
    if not 0 < k <= depth <= 4000:
        raise ValueError("0 < k <= depth <= 4000 is needed")
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    index = FingerprintIndex(spark, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own, met = [], []
    for i in range(batches):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i)
        mine, *others = index.add(part.mapInArrow(_anchors(depth, k), repeats.ROWS))
        own.append(mine)
        met += others
    marks = own[0]
    for m in own[1:]:
        marks = marks.union(m)
    marks = _unpacked(marks)
    if met:
        rows = met[0]
        for m in met[1:]:
            rows = rows.union(m)
        across = rows.select("fp", "around", "doc_id", "packed", "halves").distinct()
        marks = marks.union(repeats.sorted_classes(across, True))
    marks = cut(marks.distinct(), "marks")
    index.drop()
    return repeats.spans_by_doc(marks, docs, word_tokens, depth, k, True)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 35, k: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """One row per row of ``df`` with an id: doc_id, n_words, n_removed, kept_sha256 (of the words that
    stay, joined by one space).  See ``repeated_spans``; other columns are ignored."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    spans = repeated_spans(df, id_col, text_col, depth, k, batches)
    return docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept_sha256 string")
