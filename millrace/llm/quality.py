"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the unlabelled sample is every document that may be
learned from, labels hidden.  The model is additive over binned text features and minimises the
non-negative unbiased risk  pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)])  with the squared loss
l(z) = (1 - z)^2 / 4, for which the risk depends on the data only through first and second moments of P and U: one
distributed pass over all rows gives them exactly, whatever their number, and the fit is a small problem on
the driver.  The class prior pi is estimated as the least ratio of the tails of U and P along the score.
The squared-loss optimum is g = 2 p(1|x) - 1, so (g + 1) / 2 is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat
from .scratch import cut, small_batches

#: Upper edges of the bins of each feature; one more bin lies above the last.
FEATURES = {
    "log2_bytes": (5, 7, 8, 9, 10, 11, 13),
    "log2_words": (2, 4, 6, 7, 8, 10),
    "upper_share": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digit_share": (0.001, 0.01, 0.03, 0.08, 0.2),
    "mark_share": (0.005, 0.015, 0.03, 0.05, 0.08, 0.12, 0.2),
    "odd_mark_share": (0.0005, 0.002, 0.006, 0.015, 0.03, 0.06, 0.12),
    "bar_share": (0.0005, 0.002, 0.006, 0.015, 0.04),
    "space_share": (0.08, 0.11, 0.14, 0.17, 0.21, 0.3),
    "other_share": (0.002, 0.02, 0.05, 0.1, 0.3),
    "mean_word": (3, 4, 4.7, 5.4, 6.2, 7.5, 10),
    "distinct_share": (0.1, 0.25, 0.4, 0.55, 0.7, 0.85, 0.95),
    "repeat_share": (0.01, 0.03, 0.08, 0.2, 0.4, 0.7),
    "markless_share": (0.2, 0.4, 0.6, 0.75, 0.85, 0.92),
    "markup_word_share": (0.01, 0.05, 0.12, 0.25, 0.5),
    "short_word_share": (0.05, 0.15, 0.25, 0.35, 0.45, 0.6),
    "line_words": (3, 6, 12, 25, 60, 200),
}
_WIDTHS = [len(e) + 1 for e in FEATURES.values()]
_STARTS = np.r_[1, 1 + np.cumsum(_WIDTHS)[:-1]]
DIM = 1 + sum(_WIDTHS)
#: Ridge of the fit, besides 2 over the number of trusted positives.
RIDGE = 1e-4
HELD_OUT = 2  # of crc32(id) mod 4

_KIND = np.full(256, 6, np.uint8)  # 0 lower 1 upper 2 digit 3 mark 4 odd mark 5 bar 6 other 7 space
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[ord(c) for c in ".,;:'\"-()?!/"]] = 3
_KIND[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+`"]] = 4
_KIND[ord("|")], _KIND[flat.SPACE] = 5, 7


def features(column: pa.Array) -> np.ndarray:
    """rows x features of whole texts."""
    data, offsets = flat.texts(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    at_least = np.maximum(size, 1)
    words, start, end, rows = flat.word_hashes(data, offsets, lower=True)
    n_words = np.diff(rows).astype(float)
    per_word = np.maximum(n_words, 1)
    kinds = np.zeros((n, 8))
    for a, b in flat.chunks(offsets):
        for lo, hi in flat.pieces(data, int(offsets[a]), int(offsets[b])):
            k = _KIND[data[lo:hi]]
            row = np.repeat(np.arange(a, b), np.diff(np.clip(offsets[a : b + 1], lo, hi)))
            kinds[a:b] += np.bincount((row - a) * 8 + k, minlength=8 * (b - a)).reshape(b - a, 8)
    row = np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((words, row)) if len(row) else np.zeros(0, np.int64)
    w, r = words[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    per = lambda mask, of=row: np.bincount(of[mask], minlength=n)[:n]
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    length = end - start
    last_kind = _KIND[data[end - 1]] if len(end) else np.zeros(0, np.uint8)
    breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    return np.column_stack([
        np.log2(size + 1), np.log2(n_words + 1), kinds[:, 1] / letters, kinds[:, 2] / at_least, kinds[:, 3] / at_least,
        kinds[:, 4] / at_least, kinds[:, 5] / at_least, kinds[:, 7] / at_least, kinds[:, 6] / at_least,
        np.bincount(row, length, minlength=n)[:n] / per_word, per(new, r) / per_word, per(again) / per_word,
        per((last_kind <= 2) | (last_kind == 6)) / per_word, per((last_kind == 4) | (last_kind == 5)) / per_word,
        per(length <= 3) / per_word, n_words / (np.diff(breaks) + 1),
    ])


def bins(x: np.ndarray) -> np.ndarray:
    """rows x features: the one-hot column of each feature's bin (column 0 is the constant)."""
    found = [np.searchsorted(e, x[:, i], "left") + s for i, (e, s) in enumerate(zip(FEATURES.values(), _STARTS, strict=True))]
    return np.column_stack(found).astype(np.uint8)


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = bins(features(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in b], pa.binary())], names=["doc_id", "bins"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, DIM, DIM))
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        x = np.zeros((len(at), DIM))
        x[:, 0] = 1
        x[np.arange(len(at))[:, None], at] = 1
        total[0] += x.T @ x
        trusted = x[batch.column(1).to_numpy(zero_copy_only=False).astype(bool)]
        total[1] += trusted.T @ trusted
    kind, i, j = np.nonzero(np.triu(total))
    yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[kind, i, j])], names=["kind", "i", "j", "v"])


def _histogram(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1001), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = (scores(batch.column(0), w) * 1000).astype(np.int64)
                total[0] += np.bincount(at, minlength=1001)
                total[1] += np.bincount(at[batch.column(1).to_numpy(zero_copy_only=False).astype(bool)], minlength=1001)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[kind, at])], names=["kind", "i", "v"])

    return run


def scores(column: pa.Array, w: np.ndarray) -> np.ndarray:
    at = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.clip((w[0] + w[at].sum(1) + 1) / 2, 0, 1)


def fit(mu: np.ndarray, mp: np.ndarray, nu: float, np_: float, prior: float) -> np.ndarray:
    """Weights minimising the non-negative risk, from the moment matrices of U and P (constant in row 0)."""
    a, b = mu / nu, mp / np_
    reg = (RIDGE + 2 / np_) * np.eye(DIM)
    w = np.linalg.solve(a + reg, 2 * prior * b[0] - a[0])  # where the unbiased risk is least
    negative = lambda w: ((w @ a @ w + 2 * a[0] @ w + 1) - prior * (w @ b @ w + 2 * b[0] @ w + 1)) / 4
    if negative(w) >= 0:
        return w
    # the part that stands for negatives fell below 0: the risk is least where it is just 0, which is the
    # optimum with weight lam < 1 on that part
    low, high = 0.0, 1.0
    for _ in range(60):
        lam = (low + high) / 2
        w = np.linalg.solve(prior * (1 - lam) * b + lam * a + reg, prior * (1 + lam) * b[0] - lam * a[0])
        low, high = (lam, high) if negative(w) >= 0 else (low, lam)
    return w


def tail_prior(hist: np.ndarray) -> float:
    """Least ratio U(score >= c) / P(score >= c) over the c that most positives reach: the largest share of
    U that can be like P."""
    tails = hist[:, ::-1].cumsum(1)
    u, p = tails[0] / tails[0, -1], tails[1] / tails[1, -1]
    return float(np.clip(np.min(u[p >= 0.95] / p[p >= 0.95]), 0.05, 0.99))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == HELD_OUT


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``df`` with an id: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Learns from rows that are not held out (crc32(id) mod 4 is not 2): trusted positives have a label 1, all
    of them are the unlabelled sample.  Labels of other values or null are not read; an id labelled twice is
    trusted if any label is 1.  Only the text makes a score; null and empty texts are scored like any other.
    Without trusted positives every score is 0.5; no rows: no rows.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    binned = cut(docs.mapInArrow(_binned, "doc_id long, bins binary"), "bins")
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
    sample = cut(binned.where(~held_out("doc_id")).join(trusted, "doc_id", "left").select("bins", F.coalesce("trusted", F.lit(False)).alias("trusted")), "sample")
    moments = sample.mapInArrow(_moments, "kind int, i int, j int, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros((2, DIM, DIM))
    m[moments["kind"], moments["i"], moments["j"]] = moments["v"]
    m = m + np.transpose(np.triu(m, 1), (0, 2, 1))
    w = np.zeros(DIM)
    if m[1, 0, 0]:
        prior = 0.5
        for _ in range(3):
            w = fit(m[0], m[1], m[0, 0, 0], m[1, 0, 0], prior)
            found = sample.mapInArrow(_histogram(w), "kind int, i int, v long").groupBy("kind", "i").agg(F.sum("v").alias("v")).toPandas()
            hist = np.zeros((2, 1001))
            hist[found["kind"], found["i"]] = found["v"]
            prior = tail_prior(hist)
        w = fit(m[0], m[1], m[0, 0, 0], m[1, 0, 0], prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), w))], names=["doc_id", "score"])

    scored = binned.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, with all their columns, that are not rejected (score below ``threshold``).  Rows with
    a null id are not judged and stay."""
    rejected = quality_scores(df, labels, id_col, text_col, threshold=threshold).where("predicted = 0").select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(rejected, id_col, "left_anti").select(*df.columns)
