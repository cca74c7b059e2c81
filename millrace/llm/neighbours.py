"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are packed into blocks.  Every candidate block meets every query block once, as one tile: an
int8 matrix product gives all dot products of the tile at once, and the residuals of quantisation bound how
far each can be from the true one.  Pairs whose lower bound is beyond the k-th smallest upper bound are out
for certain; the rest are recomputed on the original vectors in double precision and merged into a
bounded heap per query.  The bounds are proven, so the result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Values in a block of candidates and of queries (vectors times dimensions), so that a tile is bounded.
BLOCK_VALUES = 1 << 18
QUERY_VALUES = 1 << 17
#: Queries gathered in one partition before they are cut into blocks.
QUERY_ROWS = 1 << 14
#: Queries whose heaps a task holds, and bytes of quantised blocks it keeps.
HELD_QUERIES = 1 << 14
HELD_BYTES = 64 << 20


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, norm, residual norm) of each row of doubles."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))
    return codes, scale, np.sqrt((x * x).sum(1)), rest


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 codes: parts of 1024 dimensions stay below 2**24, where float32 sums are exact."""
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], 1024):
        out += a[:, i : i + 1024].astype(np.float32) @ b[:, i : i + 1024].astype(np.float32).T
    return out


class Quantised:
    """Blocks quantised, each once as long as it is among the last ones used."""

    def __init__(self, room: int = HELD_BYTES) -> None:
        self.room, self.held, self.blocks = room, 0, {}

    def get(self, key: tuple[bytes, bytes], x: np.ndarray):
        found = self.blocks.pop(key, None)
        if found is None:
            found = quantised(x)
            self.held += x.size + 16 * len(x) + x.nbytes
        self.blocks[key] = found
        while self.held > self.room and len(self.blocks) > 1:
            codes = self.blocks.pop(next(iter(self.blocks)))[0]
            self.held -= 9 * codes.size + 16 * len(codes)
        return found


def tile_survivors(q, c, k: int, own: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) indices that may be among the k nearest; ``own``: pairs that are the same row;
    ``known``: the distance of each query's k-th nearest so far, infinite if it has fewer."""
    (qi, qs, qn, qr), (ci, cs, cn, cr) = q, c
    dot = product(qi, ci) * qs[:, None] * cs[None]
    # |q.c - q'.c'| <= |q| |c - c'| + |q - q'| |c'|, and |c'| <= |c| + |c - c'|; a little more for rounding
    error = qn[:, None] * cr[None] + qr[:, None] * (cn + cr)[None]
    slack = 1e-9 * (qn[:, None] + cn[None]) ** 2
    middle = (qn**2)[:, None] + (cn**2)[None] - 2 * dot
    low, high = middle - 2 * error - slack, middle + 2 * error + slack
    high[own] = np.inf
    reach = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
    if known is not None:
        reach = np.minimum(reach, known**2 * (1 + 1e-9))
    return np.nonzero((low <= reach[:, None]) & ~own)


def _pack(dim_values: int):
    """Rows (id, x array<double>) of one partition and dimension into blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = held.pop(dim)
            x = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([x.astype(np.float64).tobytes()], pa.binary())], names=["dim", "ids", "x"])

        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = values[(ends[at] - dim)[:, None] + np.arange(dim)] if len(at) < len(sizes) else values.reshape(-1, dim)
                step = max(1, dim_values // int(dim))
                for a in range(0, len(at), step):
                    had = held.setdefault(int(dim), ([], []))
                    had[0].append(ids[at[a : a + step]])
                    had[1].append(x[a : a + step])
                    if sum(map(len, had[0])) >= step:
                        yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    return run


def _tiles(k: int):
    def told(heaps: dict[int, list[tuple[float, int]]]) -> Iterator[pa.RecordBatch]:
        rows = [(query, -v, -d) for query, heap in heaps.items() for d, v in heap]
        for a in range(0, len(rows), 50_000):
            query, vec, d = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        blocks = Quantised()
        for batch in batches:
            for dim, qid, qx, cid, cx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q, c = np.frombuffer(qx).reshape(-1, dim), np.frombuffer(cx).reshape(-1, dim)
                qids, cids = np.frombuffer(qid, np.int64), np.frombuffer(cid, np.int64)
                if len(heaps) + len(qids) > HELD_QUERIES:  # the best of all tasks are ranked again in any case
                    yield from told(heaps)
                    heaps = {}
                qq, quant = blocks.get((qid, qx), q), blocks.get((cid, cx), c)
                known = np.array([-heap[0][0] if len(heap := heaps.get(i, ())) == k else np.inf for i in qids.tolist()])
                step = max(1, (1 << 21) // len(cids))
                for a in range(0, len(qids), step):
                    part = tuple(x[a : a + step] for x in qq)
                    own = qids[a : a + step, None] == cids[None]
                    i, j = tile_survivors(part, quant, k, own, known[a : a + step])
                    for b in range(0, len(i), 1 << 16):
                        rows, cols = i[b : b + (1 << 16)] + a, j[b : b + (1 << 16)]
                        exact = np.sqrt(((q[rows] - c[cols]) ** 2).sum(1))
                        order = np.lexsort((cids[cols], exact, rows))
                        rows, cols, exact = rows[order], cols[order], exact[order]
                        new = np.r_[True, rows[1:] != rows[:-1]]
                        rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
                        keep = rank < k
                        for query, vec, d in zip(qids[rows[keep]].tolist(), cids[cols[keep]].tolist(), exact[keep].tolist(), strict=True):
                            heap = heaps.setdefault(query, [])
                            if len(heap) < k:
                                heapq.heappush(heap, (-d, -vec))
                            elif (-d, -vec) > heap[0]:
                                heapq.heapreplace(heap, (-d, -vec))
        yield from told(heaps)

    return run


def usable(vector: Column) -> Column:
    """Not null or empty, all components present and finite, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """The ``k`` nearest rows (Euclidean distance) of each row with ``is_query``, its own row excluded:
    query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller id; all candidates if fewer.

    Vectors null, empty, zero or with a null or non-finite component take no part, nor do null ids;
    vectors of another dimension are no candidates.  Rows that repeat an id are candidates each, but not of
    queries with that id.  No usable query or candidate: no rows.  Other columns are ignored.

    Query blocks are repeated for the lanes of candidate blocks, so each candidate is moved once.  A task takes one
    query block after another through its lane; of a query ``k`` rows leave it, and ``k`` more each time that its
    heaps had to make room for those of others.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), is_query.alias("q")).where(usable(F.col("x")) & F.col("id").isNotNull())
    schema = "dim int, ids binary, x binary"
    candidates = cut(rows.select("id", "x").mapInArrow(_pack(BLOCK_VALUES), schema), "blocks").select("dim", F.col("ids").alias("cid"), F.col("x").alias("cx"))
    asking = rows.where("q").select("id", "x")
    parts = max(1, -(-asking.count() // QUERY_ROWS))
    queries = cut(asking.repartition(parts, "id").mapInArrow(_pack(QUERY_VALUES), schema), "queries").select("dim", F.col("ids").alias("qid"), F.col("x").alias("qx"))
    lanes = max(1, min(candidates.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = candidates.withColumn("lane", F.pmod(F.xxhash64("cid"), F.lit(lanes)))
    asked = queries.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # a merge join streams its left side and holds the rows of a key from its right, on disk if need be
    tiles = asked.join(dealt.hint("merge"), ["lane", "dim"]).select("dim", "qid", "qx", "cid", "cx")
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
