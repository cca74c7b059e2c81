"""Integrity: latest attempts, duplicate blocks, checksums and late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import BLOCKS_SQL, FRAMES_SQL, blocks, frames, md5_int, md5_int_sql
from ..declare import query
from ..tables import table

NO_DATA = -1


def expected_attempts(rows: DataFrame) -> DataFrame:
    """A8 the attempt of each map to be read: the largest that has records for the partition."""
    return rows.groupBy("map_id", "partition_id").agg(F.max("attempt_id").alias("attempt_id"))


@query(f"""WITH {FRAMES_SQL}, latest AS (SELECT map_id, partition_id, max(attempt_id) AS attempt_id FROM frames GROUP BY ALL)
SELECT f.map_id, f.partition_id, f.attempt_id, count(*) AS n FROM frames f JOIN latest l
ON f.map_id = l.map_id AND f.partition_id = l.partition_id AND f.attempt_id = l.attempt_id GROUP BY ALL""")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, J1, A8 only records of the expected attempt; older, newer and unknown attempts are skipped."""
    rows = frames(spark, sf_dir).select("map_id", "partition_id", "attempt_id")
    kept = rows.join(expected_attempts(rows), ["map_id", "partition_id", "attempt_id"], "left_semi")
    return kept.groupBy("map_id", "partition_id", "attempt_id").agg(F.count("*").alias("n"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data blocks and, per map, a checksum frame with sequence id -1."""
    data = blocks(spark, sf_dir).select("map_id", "seq_id", F.col("length").alias("value"))
    sums = blocks(spark, sf_dir).groupBy("map_id").agg(F.sum(md5_int("data")).alias("value"))
    return data.unionByName(sums.select("map_id", F.lit(NO_DATA).cast("long").alias("seq_id"), "value"))


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT map_id, seq_id, length AS value FROM blocks
  UNION ALL SELECT map_id, -1, sum({md5_int_sql("data")})::BIGINT FROM blocks GROUP BY map_id)
SELECT map_id, count(*) FILTER (seq_id >= 0) AS data_frames, count(*) FILTER (seq_id = -1) AS checksum_frames,
  max(value) FILTER (seq_id = -1) AS checksum FROM f GROUP BY map_id""")
def frame_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 frames with sequence id -1 are checksums, all others data."""
    is_sum = F.col("seq_id") == NO_DATA
    return framed(spark, sf_dir).groupBy("map_id").agg(F.count_if(~is_sum).alias("data_frames"), F.count_if(is_sum).alias("checksum_frames"), F.max(F.when(is_sum, F.col("value"))).alias("checksum"))


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length END AS n FROM blocks) SELECT doc_id, map_id, seq_id, n AS length FROM b WHERE n > 0""")
def nonempty_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 blocks without bytes are neither written nor read."""
    emptied = F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("length")).cast("long")
    return blocks(spark, sf_dir).select("doc_id", "map_id", "seq_id", emptied.alias("length")).where("length > 0")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """Every tenth block sent twice, the second time from another file."""
    return rows.withColumn("file", F.lit(0)).union(rows.where("doc_id % 10 = 0").withColumn("file", F.lit(1)))


@query(f"""WITH {BLOCKS_SQL}, d AS (SELECT *, 0 AS file FROM blocks UNION ALL SELECT *, 1 FROM blocks WHERE doc_id % 10 = 0)
SELECT map_id, seq_id, min(file)::INTEGER AS file, count(*) AS copies FROM d WHERE seq_id >= 0 GROUP BY map_id, seq_id""")
def dedup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 the first block of each (map, sequence id) counts; later ones are dropped."""
    rows = with_duplicates(blocks(spark, sf_dir).drop("data")).where("seq_id >= 0")
    return rows.groupBy("map_id", "seq_id").agg(F.min("file").alias("file"), F.count("*").alias("copies"))


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT m.map_id, p.partition_id FROM (SELECT DISTINCT map_id FROM blocks) m, (SELECT range::BIGINT AS partition_id FROM range(21)) p)
SELECT p.map_id, p.partition_id, coalesce(sum({md5_int_sql("data")}), -1)::BIGINT AS checksum FROM p LEFT JOIN blocks b
ON p.map_id = b.map_id AND p.partition_id = b.partition_id GROUP BY ALL""")
def map_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, I1, S2 sum of the blocks' checksums per (map, partition), -1 without blocks.  Here a block's checksum is an
    md5-derived integer, which the oracle can also make; ``crc_checksums`` has the real one."""
    rows = blocks(spark, sf_dir)
    cells = rows.select("map_id").distinct().withColumn("partition_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    sums = rows.groupBy("map_id", "partition_id").agg(F.sum(md5_int("data")).alias("s"))
    return cells.join(sums, ["map_id", "partition_id"], "left").select("map_id", "partition_id", F.coalesce("s", F.lit(NO_DATA)).alias("checksum"))


def crc_checksums(rows: DataFrame) -> DataFrame:
    """C1, A6 sum of crc32 of the blocks' bytes; order does not matter."""
    return rows.groupBy("map_id", "partition_id").agg(F.sum(F.crc32(F.col("data").cast("binary"))).alias("checksum"))


def verified(expected: DataFrame, stored: DataFrame, read: DataFrame) -> DataFrame:
    """J2, I3 every expected map against the stored checksum and the one recomputed from what was read."""
    status = (
        F.when(F.col("stored").isNull(), "MISSING_INDEX")
        .when(F.col("read").isNull() & (F.col("stored") > NO_DATA), "MISSING_DATA")
        .when(F.col("read").isNotNull() & (F.col("read") != F.col("stored")), "MISMATCH")
        .otherwise("OK")
    )
    return expected.join(stored, "map_id", "left").join(read, "map_id", "left").withColumn("status", status)


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT map_id, sum({md5_int_sql("data")})::BIGINT AS stored FROM blocks WHERE map_id <> 1 GROUP BY ALL),
r AS (SELECT map_id, sum({md5_int_sql("data")})::BIGINT AS read FROM blocks WHERE map_id <> 2 AND NOT (map_id = 3 AND seq_id = 0) GROUP BY ALL)
SELECT e.map_id, stored, read, CASE WHEN stored IS NULL THEN 'MISSING_INDEX' WHEN read IS NULL AND stored > -1 THEN 'MISSING_DATA'
  WHEN read <> stored THEN 'MISMATCH' ELSE 'OK' END AS status
FROM (SELECT DISTINCT map_id FROM blocks) e LEFT JOIN s ON e.map_id = s.map_id LEFT JOIN r ON e.map_id = r.map_id""")
def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, I3 with faults: map 1 lost its index, map 2 its data, map 3 one block."""
    rows = blocks(spark, sf_dir).select("map_id", "seq_id", md5_int("data").alias("c"))
    stored = rows.where("map_id <> 1").groupBy("map_id").agg(F.sum("c").alias("stored"))
    read = rows.where("map_id <> 2 and not (map_id = 3 and seq_id = 0)").groupBy("map_id").agg(F.sum("c").alias("read"))
    return verified(rows.select("map_id").distinct(), stored, read)


@query(f"""WITH {BLOCKS_SQL}, m AS (SELECT map_id, count(DISTINCT partition_id) AS partitions, count(DISTINCT partition_id) - CASE WHEN map_id = 5 THEN 1 ELSE 0 END AS checksums FROM blocks GROUP BY map_id)
SELECT map_id, partitions, checksums FROM m WHERE partitions <> checksums""")
def checksum_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I6 messages whose checksums are not as many as their partitions (map 5 sends one too few)."""
    sent = blocks(spark, sf_dir).groupBy("map_id").agg(F.count_distinct("partition_id").alias("partitions"))
    return sent.withColumn("checksums", F.col("partitions") - F.when(F.col("map_id") == 5, 1).otherwise(0)).where("partitions <> checksums")


CHECKSUM_CHUNK = 256


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT partition_id, (row_number() OVER (PARTITION BY partition_id, map_id ORDER BY l_orderkey, l_linenumber) - 1) // {CHECKSUM_CHUNK} AS chunk, map_id FROM frames)
SELECT partition_id, map_id, chunk::BIGINT AS chunk, count(*) AS entries FROM c GROUP BY ALL""")
def checksum_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 checksum entries buffered per partition and sender and flushed in chunks of a bounded number."""
    order = Window.partitionBy("partition_id", "map_id").orderBy("l_orderkey", "l_linenumber")
    chunk = F.floor((F.row_number().over(order) - 1) / CHECKSUM_CHUNK)
    return frames(spark, sf_dir).select("partition_id", "map_id", chunk.alias("chunk")).groupBy("partition_id", "map_id", "chunk").agg(F.count("*").alias("entries"))


def is_late(arrived: Column, finalised: Column) -> Column:
    """F10, T2 a block of a stage that is no longer running is late; one without a stage marker is not."""
    return F.coalesce(arrived > finalised, F.lit(False))


@query("""WITH stage AS (SELECT o_orderkey AS stage, o_orderdate + INTERVAL 60 DAY AS finalised FROM orders)
SELECT l.l_orderkey % 50 AS app, count(*) AS blocks, count(*) FILTER (coalesce(l_shipdate > finalised, false)) AS late
FROM lineitem l LEFT JOIN stage s ON l.l_orderkey = s.stage GROUP BY ALL""")
def late_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, T2 blocks that arrive after their stage was finalised are dropped and counted."""
    stage = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_orderdate + interval 60 days").alias("finalised"))
    arrived = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").join(stage, "l_orderkey", "left")
    late = is_late(F.col("l_shipdate"), F.col("finalised"))
    return arrived.groupBy((F.col("l_orderkey") % 50).alias("app")).agg(F.count("*").alias("blocks"), F.count_if(late).alias("late"))


@query(f"""WITH {BLOCKS_SQL}, pipes AS (SELECT 'worker_' || (map_id % 3) AS pipe, partition_id, length FROM blocks)
SELECT partition_id, count(DISTINCT pipe) AS pipes, count(*) AS n, sum(length)::BIGINT AS bytes FROM pipes GROUP BY ALL""")
def pipe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, U1 all pipes of a partition read one after another: one per worker that received data for it."""
    rows = blocks(spark, sf_dir)
    pipes = [rows.where(F.col("map_id") % 3 == w).select(F.lit(f"worker_{w}").alias("pipe"), "partition_id", "length") for w in range(3)]
    every = pipes[0].unionByName(pipes[1]).unionByName(pipes[2])
    return every.groupBy("partition_id").agg(F.count_distinct("pipe").alias("pipes"), F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(f"""WITH {BLOCKS_SQL}, w AS (SELECT *, CASE WHEN map_id % 4 = 3 THEN 'open' ELSE 'final' END AS state FROM blocks)
SELECT partition_id, count(*) FILTER (state = 'final') AS visible, count(*) FILTER (state = 'open') AS pending FROM w GROUP BY ALL""")
def commit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, S8 only files that were closed and renamed are visible to readers; a reader waits while any is pending."""
    state = F.when(F.col("map_id") % 4 == 3, "open").otherwise("final")
    return blocks(spark, sf_dir).groupBy("partition_id").agg(F.count_if(state == "final").alias("visible"), F.count_if(state == "open").alias("pending"))


@query(f"""WITH {BLOCKS_SQL}, n AS (SELECT '/root/app_' || map_id || '/1/0/0/' || partition_id || CASE doc_id % 3
  WHEN 0 THEN '/shuffle_w1_0_' || partition_id || '.dat' WHEN 1 THEN '/final/shuffle_w1_0_' || partition_id || '.dat_final' ELSE '/_SUCCEED' END AS path FROM blocks)
SELECT path, CASE WHEN regexp_matches(path, '/shuffle_[^/]*\\.dat$') THEN 'pending' WHEN regexp_matches(path, '/shuffle_[^/]*\\.dat_final$') THEN 'ready' ELSE 'error' END AS state,
  regexp_extract(path, '/([0-9]+)/(final/)?[^/]*$', 1) AS partition, count(*) AS n FROM n GROUP BY ALL""")
def file_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, C5 files of a partition directory by their names: pending, ready, or not to be there."""
    leaf = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/shuffle_w1_0_"), F.col("partition_id"), F.lit(".dat")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/final/shuffle_w1_0_"), F.col("partition_id"), F.lit(".dat_final")))
        .otherwise("/_SUCCEED")
    )
    path = F.concat(F.lit("/root/app_"), F.col("map_id"), F.lit("/1/0/0/"), F.col("partition_id"), leaf)
    named = blocks(spark, sf_dir).select(path.alias("path"))
    state = F.when(F.col("path").rlike(r"/shuffle_[^/]*\.dat$"), "pending").when(F.col("path").rlike(r"/shuffle_[^/]*\.dat_final$"), "ready").otherwise("error")
    return named.groupBy("path", state.alias("state"), F.regexp_extract("path", r"/([0-9]+)/(final/)?[^/]*$", 1).alias("partition")).agg(F.count("*").alias("n"))
