"""Best-fit packing into bins of several permitted sequence lengths.

Pieces are taken longest first.  Each goes to the open bin with the least room that holds
it; if none does, a bin is opened whose length costs least per token it is expected to hold, found by
filling every permitted length greedily from the pieces still to come.  At the end every bin is
downsized to the smallest permitted length that holds its contents.

``token_table`` makes the token ids of all texts, ``pack`` places them by their lengths, and ``sequences``
gives each bin its ids.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .scratch import cut, small_batches
from .token_file import END_ID, encoder

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin of length c: c tokens of compute and this much besides, per bin.
OVERHEAD = 32
#: Pieces packed together; bounds a task's memory and the bins that another run could fill better.
RUN_ROWS = 16_384


def pack_run(lengths: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """(bin of each piece, its offset there, length of each bin, use of each bin)."""
    caps = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    left = lengths[order]
    rising = -left  # ascending, for searchsorted
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    sizes: list[int] = []
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    for at, (i, n) in enumerate(zip(order.tolist(), left.tolist(), strict=True)):
        k = bisect_left(room, (n, -1))
        if k < len(room):
            space, b = room.pop(k)
        else:
            b, cap = len(used), _least_cost(rising, at, n, caps, overhead)
            space = cap
            used.append(0)
            sizes.append(cap)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if space > n:
            insort(room, (space - n, b))
    sizes = [next(c for c in caps if c >= u) for u in used]
    return bins, offsets, sizes, used


def _least_cost(rising: np.ndarray, at: int, n: int, caps: Sequence[int], overhead: int) -> int:
    best, best_cost = caps[-1], float("inf")
    for cap in caps:
        if cap < n:
            continue
        filled, k = n, at + 1
        while filled < cap:
            k = max(k, int(np.searchsorted(rising, filled - cap)))  # first piece that still fits
            if k >= len(rising):
                break
            filled -= int(rising[k])
            k += 1
        if (cost := (cap + overhead) / filled) < best_cost:
            best, best_cost = cap, cost
    return best


def _pack_partition(capacities: Sequence[int], overhead: int, run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def packed(t: pa.Table) -> pa.RecordBatch:
            bins, offsets, sizes, used = pack_run(t["length"].to_numpy(), capacities, overhead)
            columns = [*(c.combine_chunks() for c in t.columns), pa.array((part << 40) + (count << 20) + bins), pa.array(np.array(sizes, np.int64)[bins]), pa.array(np.array(used, np.int64)[bins]), pa.array(offsets)]
            return pa.RecordBatch.from_arrays(columns, names=[*t.column_names, "bin_id", "bin_length", "bin_used", "bin_offset"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= 2 * run_rows:
                t = pa.Table.from_batches(held)
                yield packed(t.slice(0, run_rows))
                held, rows, count = t.slice(run_rows).to_batches(), rows - run_rows, count + 1
        if rows:
            yield packed(pa.Table.from_batches(held))  # no run of a few pieces is left over

    return run


def pack(df: DataFrame, id_col: str = "doc_id", length_col: str = "length", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per piece: id, ``piece`` (from 0), ``piece_start``, ``length``, ``bin_id``, ``bin_length``,
    ``bin_used`` and ``bin_offset`` (where in its bin the piece begins).

    A row longer than the largest capacity is cut into pieces of that size and a rest, so nothing is
    lost.  Null lengths count as 0; rows of length 0 or less need no room and give no piece.  Rows that repeat
    an id are packed each on its own; a null id is kept.  No rows: no rows.

    Rows are dealt by a hash into partitions of about ``run_rows`` pieces, and a partition packs less than twice as
    many together, so memory is bounded and runs are independent: no global state.  ``df`` is read twice.
    """
    caps = sorted(capacities)
    top = caps[-1]
    length = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    rows = df.select(F.col(id_col).alias(id_col), length.alias("__n")).where("__n > 0")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {top}"))))
    items = cut.select(id_col, "piece", (F.col("piece") * top).alias("piece_start"), F.least(F.col("__n") - F.col("piece") * top, F.lit(top)).cast("long").alias("length"))
    parts = max(1, -(-items.count() // run_rows))
    dealt = items.repartition(parts, F.xxhash64(id_col, "piece", "length")).sortWithinPartitions(F.xxhash64(id_col, "piece", "length"), id_col, "piece", "length")
    kind = dict(items.dtypes)[id_col]
    return dealt.mapInArrow(_pack_partition(tuple(caps), overhead, run_rows), f"`{id_col}` {kind}, piece long, piece_start long, length long, bin_id long, bin_length long, bin_used long, bin_offset long")


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.r_[x, np.int32(end_id)] for x in encoder(path).encode_rows(*flat.texts(batch.column(1)))]
            sizes = np.array([len(r) for r in rows], np.int64)
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), ids], names=["doc_id", "length", "ids"])

    return run


def _count(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encode(path, end_id)(batches):
            yield batch.select([0, 1])

    return run


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def token_table(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, length, ids) of every row: the ids of the whole text (null: empty) and ``end_id``, as the tokenizers
    library gives them.  Null ids stay null, rows that repeat an id are rows of their own, no rows give none."""
    return _docs(df, id_col, text_col).mapInArrow(_encode(tokenizer_path, end_id), "doc_id long, length long, ids array<int>")


def pack_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """``pack`` of the token ids of whole texts, each with its end: a null or empty text is one token long."""
    return pack(cut(_docs(df, id_col, text_col).mapInArrow(_count(tokenizer_path, end_id), "doc_id long, length long"), "lengths"))


def sequences(placed: DataFrame, tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per bin: bin_id, bin_length, bin_used, ``pieces`` (id, piece, offset, length; by offset) and ``ids``, the
    token ids of its pieces one after another.  A bin holds at most the largest capacity, so a row is bounded.

    ``tokens`` has one row for each id that ``placed`` (of ``pack``) names; null ids are not joined."""
    part = F.slice("ids", (F.col("piece_start") + 1).cast("int"), F.col("length").cast("int"))
    pieces = placed.join(tokens.select(F.col("doc_id").alias(id_col), "ids"), id_col).select("bin_id", "bin_length", "bin_used", F.struct("bin_offset", F.col(id_col).alias("id"), "piece", "length", part.alias("ids")).alias("p"))
    whole = pieces.groupBy("bin_id", "bin_length", "bin_used").agg(F.array_sort(F.collect_list("p")).alias("p"))
    told = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["bin_offset"].alias("offset"), x["length"].alias("length")))
    return whole.select("bin_id", "bin_length", "bin_used", told.alias("pieces"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
