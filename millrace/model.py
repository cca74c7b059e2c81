"""Shuffle facts read from the input tables, as DataFrames and as the SQL that oracles start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

MAPS, PARTITIONS, BLOCK_MAPS = 16, 20, 8
BLOCK_BYTES = 65_536
#: Rows of one key that are summed together before the sums of such chunks are; see ``running_sum``.
CHUNK = 4096

FRAMES_SQL = f"""frames AS (
  SELECT l_orderkey % {MAPS} AS map_id, (l_linenumber % 3)::BIGINT AS attempt_id, l_orderkey % {PARTITIONS} AS partition_id,
         l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem
)"""
BLOCKS_SQL = f"""blocks AS (
  SELECT doc_id, doc_id % {BLOCK_MAPS} AS map_id, doc_id // {BLOCK_MAPS} AS seq_id, doc_id % {PARTITIONS} AS partition_id,
         text AS data, strlen(text)::BIGINT AS length FROM documents
)"""
BEATS_SQL = """beats AS (
  SELECT user_id % 12 AS worker, event_id, ts, event_type <> 'error' AS ok, value AS throughput FROM events
)"""


def frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One row per record on the map side (D8): which map task and attempt made it, for which partition."""
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", *more)
    return df.withColumns({
        "map_id": F.col("l_orderkey") % MAPS,
        "attempt_id": (F.col("l_linenumber") % 3).cast("long"),
        "partition_id": F.col("l_orderkey") % PARTITIONS,
    })


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per data block (D8)."""
    df = table(spark, sf_dir, "documents", "doc_id", "text")
    return df.select(
        "doc_id",
        (F.col("doc_id") % BLOCK_MAPS).alias("map_id"),
        F.expr(f"doc_id div {BLOCK_MAPS}").alias("seq_id"),
        (F.col("doc_id") % PARTITIONS).alias("partition_id"),
        F.col("text").alias("data"),
        F.octet_length("text").cast("long").alias("length"),
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per heartbeat of a worker (D15)."""
    df = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return df.select((F.col("user_id") % 12).alias("worker"), "event_id", "ts", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("throughput"))


def exact_sum(column: Column | str) -> Column:
    """A sum of money that does not depend on the order of rows: in decimals, given as a double."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(18,2)")).cast("double")


def exact_sum_sql(column: str) -> str:
    return f"sum({column}::DECIMAL(18,2))::DOUBLE"


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """``name``: sum of ``value`` over the rows of ``key`` up to and with this one, in the order of the integer ``order``.

    A few keys may hold all rows, so no window spans a key: rows are summed within chunks of ``order``,
    and only the chunks' totals (one row per CHUNK rows) are summed along the key.
    """
    rows = df.withColumns({"__value": value, "__chunk": F.expr(f"`{order}` div {CHUNK}")})
    totals = rows.groupBy(key, "__chunk").agg(F.sum("__value").alias("__total"))
    along = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "__chunk", F.coalesce(F.sum("__total").over(along), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, [key, "__chunk"]).withColumn(name, F.col("__before") + F.sum("__value").over(inside)).drop("__value", "__chunk", "__before")


#: Heartbeats of one worker in a slot of time are bounded by how often it beats, those of all time are not.
SLOT = "day"


def slotted(rows: DataFrame) -> DataFrame:
    """Rows with ``ts`` and the slot of time they are in."""
    return rows.withColumn("slot", F.date_trunc(SLOT, F.col("ts")))


def within_slot() -> Window:
    return Window.partitionBy("worker", "slot").orderBy("ts", "event_id")


def along_slots() -> Window:
    """Over one row per (worker, slot)."""
    return Window.partitionBy("worker").orderBy("slot")


def md5_int(column: Column | str) -> Column:
    """The first eight hex digits of an md5 as an integer: the seed of every draw that is otherwise random."""
    column = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def md5_int_sql(expression: str) -> str:
    return f"('0x' || substr(md5(({expression})::VARCHAR), 1, 8))::BIGINT"
