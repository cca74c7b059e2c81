"""Exchange: how records are assigned to partitions, combined, cut into blocks and read again."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES, BLOCKS_SQL, FRAMES_SQL, MAPS, PARTITIONS, blocks, exact_sum, exact_sum_sql, frames, md5_int, md5_int_sql, running_sum
from ..declare import query
from ..tables import table


@query(f"""WITH {FRAMES_SQL} SELECT partition_id, count(*) AS n, {exact_sum_sql("l_quantity")} AS quantity FROM frames GROUP BY ALL""")
def hash_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 partition assignment: records and quantity of each partition."""
    return frames(spark, sf_dir, "l_quantity").groupBy("partition_id").agg(F.count("*").alias("n"), exact_sum("l_quantity").alias("quantity"))


@query(f"SELECT o_custkey, count(*) AS n, {exact_sum_sql('o_totalprice')} AS total FROM orders GROUP BY ALL")
def hash_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 hash partitioning: one exchange on the key serves the aggregation above it."""
    dealt = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").repartition("o_custkey")
    return dealt.groupBy("o_custkey").agg(F.count("*").alias("n"), exact_sum("o_totalprice").alias("total"))


@query("SELECT l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL")
def range_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 range partitioning by ship date; a date lies in one range, so its count needs no exchange."""
    return table(spark, sf_dir, "lineitem", "l_shipdate").repartitionByRange("l_shipdate").groupBy("l_shipdate").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS total FROM lineitem")
def roundrobin_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5, X6, A4 round-robin exchange into ten partitions, then a global count and sum."""
    return table(spark, sf_dir, "lineitem", "l_orderkey").repartition(10).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("total"))


@query(f"WITH {FRAMES_SQL} SELECT partition_id::INTEGER AS placed_in, partition_id, count(*) AS n FROM frames GROUP BY ALL")
def direct_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 a partition id chosen by the caller is the partition a record lands in."""
    dealt = frames(spark, sf_dir).select("partition_id").repartitionById(PARTITIONS, F.col("partition_id").cast("int"))
    return dealt.select(F.spark_partition_id().alias("placed_in"), "partition_id").groupBy("placed_in", "partition_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def exchange_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9, X10 an exchange without combining gives out exactly the records it took in."""
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").repartition("o_custkey")


@query(f"""SELECT l_returnflag, count(*) AS n, {exact_sum_sql("l_quantity")} AS quantity FROM lineitem GROUP BY ALL""")
def partial_final_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11, A1, X16 combine on the map side by (map, key), merge the combiners by key."""
    level1 = frames(spark, sf_dir, "l_returnflag", "l_quantity").groupBy("map_id", "l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    return level1.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("q").cast("double").alias("quantity"))


@query(f"WITH {FRAMES_SQL} SELECT partition_id, l_returnflag, count(*) AS n FROM frames GROUP BY ALL")
def final_only_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 records travel as they are and are combined only after the exchange."""
    dealt = frames(spark, sf_dir, "l_returnflag").select("partition_id", "l_returnflag").repartition("partition_id", "l_returnflag")
    return dealt.groupBy("partition_id", "l_returnflag").agg(F.count("*").alias("n"))


def exchanged(df: DataFrame, partition: Column, partitions: int, *ordering: Column | str) -> DataFrame:
    """E2 an exchange by the caller's own partitioner, ``partition`` in [0, partitions), then by the caller's ordering
    inside each partition; ``placed_in`` and ``place`` say where each record has come to lie."""
    dealt = df.repartitionById(partitions, partition.cast("int")).sortWithinPartitions(*ordering)
    return dealt.withColumns({"placed_in": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


@query(f"""WITH {FRAMES_SQL} SELECT l_orderkey, l_linenumber, partition_id::INTEGER AS placed_in,
  row_number() OVER (PARTITION BY partition_id ORDER BY l_orderkey, l_linenumber) - 1 AS place FROM frames""")
def sort_within_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X17 reduce-side sort by key: the place of each record in its sorted partition."""
    rows = frames(spark, sf_dir).select("l_orderkey", "l_linenumber", "partition_id")
    return exchanged(rows, F.col("partition_id"), PARTITIONS, "l_orderkey", "l_linenumber").drop("partition_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority < '2' THEN 0 ELSE 1 + o_custkey % 9 END::INTEGER AS placed_in,
  row_number() OVER (PARTITION BY CASE WHEN o_orderpriority < '2' THEN 0 ELSE 1 + o_custkey % 9 END ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders""")
def custom_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 urgent orders in a partition of their own, the others by customer; the dearest first in each."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    partitioner = F.when(F.col("o_orderpriority") < "2", 0).otherwise(1 + F.col("o_custkey") % 9)
    return exchanged(rows, partitioner, 10, F.col("o_totalprice").desc(), F.col("o_orderkey")).select("o_orderkey", "placed_in", "place")


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT map_id, partition_id, count(*) AS n FROM frames GROUP BY ALL)
SELECT map_id, partition_id, n, (sum(n) OVER (PARTITION BY map_id ORDER BY partition_id) - n)::BIGINT AS first, (sum(n) OVER (PARTITION BY map_id ORDER BY partition_id) - 1)::BIGINT AS last FROM c""")
def sort_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2 map output sorted by partition id only: where the run of each partition begins and ends in its map's output."""
    ordered = exchanged(frames(spark, sf_dir).select("map_id", "partition_id"), F.col("map_id"), MAPS, "partition_id")
    return ordered.groupBy("map_id", "partition_id").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3 sort over all partitions: a range exchange and a local sort."""
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query(f"""WITH {BLOCKS_SQL}, sizes AS (SELECT map_id, partition_id, sum(length)::BIGINT AS bytes FROM blocks GROUP BY ALL)
SELECT map_id, sum(bytes)::BIGINT AS total, string_agg(partition_id || ':' || bytes, ',' ORDER BY partition_id) AS lengths FROM sizes GROUP BY map_id""")
def map_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X14, D12, C15 bytes of each partition in each map's output, as one vector per map."""
    sizes = blocks(spark, sf_dir).groupBy("map_id", "partition_id").agg(F.sum("length").alias("bytes"))
    vector = F.array_sort(F.collect_list(F.struct("partition_id", "bytes")))
    text = F.array_join(F.transform(vector, lambda x: F.concat_ws(":", x["partition_id"], x["bytes"])), ",")
    return sizes.groupBy("map_id").agg(F.sum("bytes").alias("total"), text.alias("lengths"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT doc_id, map_id, sum(length) OVER (PARTITION BY map_id ORDER BY seq_id) AS cum FROM blocks)
SELECT doc_id, map_id, ((cum - 1) // {BLOCK_BYTES})::BIGINT AS block_id FROM c""")
def block_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13 records of a map cut into blocks of 64 KiB by their running length."""
    summed = running_sum(blocks(spark, sf_dir).drop("data"), "map_id", "seq_id", F.col("length"), "cum")
    return summed.select("doc_id", "map_id", F.floor((F.col("cum") - 1) / BLOCK_BYTES).alias("block_id"))


def cut_with_reset(lengths: Column, threshold: int) -> Column:
    """X13, second variant, for one buffer at a time: an ordered array of lengths to block numbers; a block
    ends once its bytes exceed the threshold, and the count starts anew."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.lit(0).alias("block"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = acc["held"] + n > threshold
        return F.struct(F.when(full, 0).otherwise(acc["held"] + n).cast("long").alias("held"), (acc["block"] + F.when(full, 1).otherwise(0)).alias("block"), F.concat(acc["out"], F.array(acc["block"])).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])


@query(f"""WITH {FRAMES_SQL} SELECT map_id, attempt_id, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY map_id, attempt_id ORDER BY l_orderkey, l_linenumber) - 1 AS seq_id FROM frames""")
def block_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5 sequence ids from 0 along all records of a map attempt: a running count, by chunks."""
    rows = frames(spark, sf_dir).withColumns({"sender": F.struct("map_id", "attempt_id"), "at": F.col("l_orderkey") * 8 + F.col("l_linenumber")})
    counted = running_sum(rows, "sender", "at", F.lit(1).cast("long"), "upto")
    return counted.select("map_id", "attempt_id", "l_orderkey", "l_linenumber", (F.col("upto") - 1).alias("seq_id"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, map_id, seq_id, (sum(length + 32) OVER (PARTITION BY map_id ORDER BY seq_id) - length)::BIGINT AS "offset" FROM blocks""")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 where each payload begins in its file: the frames (32 bytes and a payload) before it, and its own header."""
    summed = running_sum(blocks(spark, sf_dir).drop("data"), "map_id", "seq_id", F.col("length") + 32, "cum")
    return summed.select("doc_id", "map_id", "seq_id", (F.col("cum") - F.col("length")).alias("offset"))


READ_THREADS, READ_MAX, READ_MERGE = 2, 128 << 20, 32 << 20


@query(f"""WITH {FRAMES_SQL}, p AS (SELECT partition_id, count(*) AS n FROM frames GROUP BY ALL)
SELECT partition_id, n, partition_id % least({READ_THREADS}, (SELECT count(*) FROM p)) AS thread, greatest({READ_MAX} // {READ_MERGE}, 1)::INTEGER AS slots FROM p""")
def reader_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15 the thread that reads each partition, and the slots of the queue between them."""
    sizes = frames(spark, sf_dir).groupBy("partition_id").agg(F.count("*").alias("n"))
    threads = sizes.agg(F.least(F.lit(READ_THREADS), F.count("*")).alias("threads"))
    return sizes.crossJoin(F.broadcast(threads)).select("partition_id", "n", (F.col("partition_id") % F.col("threads")).alias("thread"), F.lit(max(READ_MAX // READ_MERGE, 1)).alias("slots"))


def writer_choice_of(forced: Column, combine: Column, partitions: Column, relocatable: Column) -> Column:
    """X8 the writer of a shuffle: a forced one, else bypass, serialised or sort by these limits."""
    by_rule = F.when(~combine & (partitions <= 200), "bypass").when(relocatable & ~combine & (partitions <= 1 << 24), "unsafe").otherwise("sort")
    return F.when(forced != "auto", forced).otherwise(by_rule)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'sort' WHEN p_partkey % 2 <> 0 AND p_partkey * p_size <= 200 THEN 'bypass'
  WHEN p_partkey % 3 <> 0 AND p_partkey % 2 <> 0 AND p_partkey * p_size <= 16777216 THEN 'unsafe' ELSE 'sort' END AS writer FROM part""")
def writer_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 over one imagined shuffle per part."""
    key = F.col("p_partkey")
    forced = F.when(key % 11 == 0, "sort").otherwise("auto")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", writer_choice_of(forced, key % 2 == 0, key * F.col("p_size"), key % 3 != 0).alias("writer"))


@query(f"""WITH p AS (SELECT range AS partition_id FROM range(200)), s AS (SELECT partition_id, row_number() OVER (ORDER BY {md5_int_sql("partition_id")}, partition_id) - 1 AS sorted FROM p)
SELECT a.partition_id, a.sorted, b.partition_id AS restored FROM s a JOIN s b ON a.sorted = b.sorted""")
def permutation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12 a scrambled partition order and its inverse, over 200 partitions (a fixed, small range)."""
    order = Window.orderBy(md5_int("partition_id"), "partition_id")
    scrambled = spark.range(200).select(F.col("id").alias("partition_id")).withColumn("sorted", (F.row_number().over(order) - 1).cast("long"))
    inverse = scrambled.select(F.col("partition_id").alias("restored"), "sorted")
    return scrambled.join(inverse, "sorted").select("partition_id", "sorted", "restored")


@query(f"WITH {FRAMES_SQL} SELECT map_id, count(*) AS n FROM frames WHERE map_id >= 4 AND map_id < 9 GROUP BY ALL")
def map_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 read the output of maps [4, 9) only."""
    return frames(spark, sf_dir).where(F.col("map_id").between(4, 8)).groupBy("map_id").agg(F.count("*").alias("n"))


@query(f"WITH {FRAMES_SQL} SELECT partition_id, count(*) AS n, min(l_orderkey) AS first_key FROM frames WHERE partition_id >= 5 AND partition_id < 11 GROUP BY ALL")
def partition_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 read partitions [5, 11) only."""
    return frames(spark, sf_dir).where(F.col("partition_id").between(5, 10)).groupBy("partition_id").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_key"))


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders")
def cached_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 count and reduce over a table kept in memory and on disk."""
    kept = table(spark, sf_dir, "orders", "o_orderkey").persist(StorageLevel.MEMORY_AND_DISK)
    return kept.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


def text_hash(text: Column) -> Column:
    """The 32-bit hash that the JVM gives a string: 31 times what was before plus the character, wrapping around (characters
    of the basic plane)."""
    step = lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF))
    wrapped = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)


@query("""WITH h AS (SELECT event_id, user_id, list_reduce([0::BIGINT] || list_transform(string_split('app_' || user_id || '_' || event_type, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM events)
SELECT event_id, abs((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END + user_id + event_id % 20) % 10)::BIGINT AS executor FROM h""")
def executor_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, T17 the executor a partition's blocks are kept in order on: abs((hash + shuffle + partition) % n), the
    sign of % kept as on the JVM."""
    h = text_hash(F.concat(F.lit("app_"), "user_id", F.lit("_"), "event_type"))
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", F.abs((h + F.col("user_id") + F.col("event_id") % 20) % 10).alias("executor"))


@query("""SELECT event_id, abs((user_id + event_id % 20) % 10)::INTEGER AS placed_in,
  row_number() OVER (PARTITION BY abs((user_id + event_id % 20) % 10) ORDER BY event_id) - 1 AS place FROM events""")
def executor_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T17 tasks of one key run on one executor, first come first served: the place of each in its executor's queue."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id")
    return exchanged(rows, F.abs((F.col("user_id") + F.col("event_id") % 20) % 10), 10, "event_id").drop("user_id")


def checked_block_size(size: int, least: int, most: int) -> int:
    """X20 a block size is taken only within its bounds."""
    if not least <= size <= most:
        raise ValueError(f"block size {size} is not between {least} and {most}")
    return size
