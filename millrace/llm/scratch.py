"""Intermediate tables in the folder all machines share, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


#: Spark removes a written plan's shuffle files as soon as the write has ended, instead of some time later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start at the table, not
    at its lineage, and a lost executor costs a re-read only.  ``.written_at`` holds the path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that no later plan reads."""
    for t in tables:
        discard_path(spark, t.written_at)


def discard_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts may hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def salt(*columns: Column | str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_left_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = SALTS) -> DataFrame:
    """Left join in which one key may hold a third of ``big``: its rows are dealt over ``salts``
    partitions and each row of ``small`` (one per key) is repeated for every salt."""
    spread = big.withColumn("__salt", salt(F.col(spread_by), salts=salts))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [key, "__salt"], "left").drop("__salt")
