"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, mixing, near_dedup, packing, quality
from millrace.llm.scratch import cut
from millrace.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Null and empty texts are judged like any other; rows without an id stay; a score at the threshold is kept; every row
    of an id goes if one of them is rejected.  No trusted positive label: every score is 0.5 and all go.  Empty: empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id.

    A null text is an empty one; of rows with one id and text one stays; a row without an id stays only where no other
    has its text.  Empty: empty."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more, the one with the smallest id.

    Texts null, empty or without words are linked with nothing and stay, as do rows without an id.  Empty: empty."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of all sources: documents repeated or left out by their source's rate.

    A null source is a source of its own; rows that repeat an id are repeated alike; rows without an id, too.  Empty: empty."""
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the permitted sequence lengths, in token ids; each text is followed by its end.

    A null or empty text is its end alone; rows without an id are packed under null.  Empty: empty."""
    import public_tokenizers

    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: No SQL: the first and the third stage are not SQL-expressible; tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
