"""The pipeline stage by stage against what each has to do to its input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
import public_tokenizers
from test_dedup import brute_near
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in pipeline.STAGES:
        kept[name] = docs
        docs = pipeline.cut(stage(spark, docs, SF), "test")
    names = [n for n, _ in pipeline.STAGES]
    rows = {n: kept[n].collect() for n in names}
    after_quality, after_exact, after_near, mixed = (rows[n] for n in names[1:])
    assert all(set(kept[n].columns) == {"doc_id", "text", "lang", "source", "n_chars"} for n in names)

    left = {r.doc_id for r in after_quality}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) > 0.95 * len(good)
    assert sum(i in left for i, q in labels.items() if q == 0) < 0.1 * sum(q == 0 for q in labels.values())

    best = {}
    for r in after_quality:
        best[r.text] = max(r.doc_id, best.get(r.text, -1))
    assert {r.doc_id for r in after_exact} == set(best.values())
    near = brute_near([(r.doc_id, r.text) for r in after_exact], 5, 80)
    assert {r.doc_id for r in after_near} == {i for i, (_, _, stays) in near.items() if stays}

    assert {r.doc_id for r in mixed} <= {r.doc_id for r in after_near}
    assert abs(len(mixed) - len(after_near)) < 0.2 * len(after_near)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed}
    want = Counter()
    for r in mixed:
        want[r.doc_id] += length[r.doc_id]
    got = Counter()
    for r in docs.collect():
        got[r.doc_id] += r.length
    assert got == want


def test_run_gives_bins(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert {"doc_id", "bin_id", "bin_length"} <= set(out.columns)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_no_documents(spark, tmp_path):
    path = _tables(spark, tmp_path, [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0
    assert pipeline.run(spark, path).count() == 0


def test_nulls_empty_and_repeated_rows(spark, tmp_path):
    """Null ids, texts and sources, empty texts, rows that come twice, and columns named like those inside."""
    prose = "the river keeps to its bed and the town above it keeps to its hill through all of the long winter"
    rows = [(i, f"{prose} {i} {prose[::-1]}", None, "a" if i % 2 else None, None, 1, "x") for i in range(1, 9)]
    rows += [(20, None, "en", "a", 0, 1, "x"), (21, "", "en", None, 0, 1, "x"), (21, "", "en", None, 0, 1, "x"), (None, prose, "en", "a", 1, 1, "x"), (None, None, None, None, None, None, None), (1, rows[0][1], None, "a", None, 1, "x")]
    path = _tables(spark, tmp_path, rows, SCHEMA + ", rate long, component_id string")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}, name
    assert pipeline.STAGES[-1][1](spark, docs, path).select("doc_id", "piece").count() == len(rows)
    assert pipeline.exact_copies(spark, docs, path).where("doc_id = 1").count() == 1
    assert pipeline.run(spark, path).where("length < 1").count() == 0
