"""Metrics: roll-ups over workers, shuffles and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BEATS_SQL, BLOCKS_SQL, FRAMES_SQL, along_slots, beats, blocks, exact_sum, exact_sum_sql, frames, running_sum, slotted, within_slot
from ..declare import query
from ..tables import table
from .placement import STATE_SQL, weighted_dispatch, worker_states

LADDER = (5, 10, 50, 100, 200, 500, 1000)
SPILL_BYTES = 100_000


@query(f"""WITH {STATE_SQL} SELECT r_name AS dc, n_name AS cluster, count(*) AS total, count(*) FILTER (state = 'online') AS normal,
  count(*) FILTER (state = 'black') AS blacklist, count(*) FILTER (state = 'punished') AS punish
FROM states JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def worker_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, S18 workers per data center and cluster by state, each counted once, with totals."""
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    joined = worker_states(spark, sf_dir).join(F.broadcast(places), F.expr("s_nationkey = n_nationkey"))
    by_state = [F.count_if(F.col("state") == s).alias(n) for s, n in (("online", "normal"), ("black", "blacklist"), ("punished", "punish"))]
    return joined.rollup(F.col("r_name").alias("dc"), F.col("n_name").alias("cluster")).agg(F.count("*").alias("total"), *by_state)


@query("""WITH w AS (SELECT s_suppkey, 1 + s_suppkey % 4 AS weight FROM supplier), i AS (SELECT s_suppkey, weight, sum(weight) OVER (ORDER BY s_suppkey) AS hi, (SELECT sum(weight) FROM w) AS total FROM w),
d AS (SELECT (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % (SELECT any_value(total) FROM i)) AS u FROM orders)
SELECT s_suppkey AS worker, count(*) AS dispatched FROM d JOIN i ON u >= hi - weight AND u < hi GROUP BY ALL""")
def dispatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 requests sent to each worker."""
    return weighted_dispatch(spark, sf_dir).groupBy(F.col("s_suppkey").alias("worker")).agg(F.count("*").alias("dispatched"))


@query(f"""WITH {BEATS_SQL}, c AS (SELECT worker, event_id, floor(throughput)::BIGINT AS v, coalesce(lag(floor(throughput)::BIGINT) OVER (PARTITION BY worker ORDER BY ts, event_id), 0) AS before FROM beats)
SELECT worker, event_id, ((v - before) // 15)::BIGINT AS per_second FROM c WHERE v >= before""")
def throughput_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 growth of a counter between heartbeats, per second; the first starts at 0; where it shrank it was reset."""
    rows = slotted(beats(spark, sf_dir).withColumn("v", F.floor("throughput")))
    lasts = rows.groupBy("worker", "slot").agg(F.max_by("v", F.struct("ts", "event_id")).alias("last"))
    left = lasts.select("worker", "slot", F.lag("last").over(along_slots()).alias("left"))
    rows = rows.withColumn("inside", F.lag("v").over(within_slot())).join(left, ["worker", "slot"]).withColumn("before", F.coalesce("inside", "left", F.lit(0)))
    return rows.where("v >= before").select("worker", "event_id", F.expr("(v - before) div 15").alias("per_second"))


@query(f"""WITH l AS (SELECT event_type, unnest([{", ".join(map(str, LADDER))}, NULL]) AS le, value FROM events)
SELECT event_type, coalesce(le::VARCHAR, '+Inf') AS le, count(*) FILTER (le IS NULL OR value <= le) AS n FROM l GROUP BY event_type, le""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 counts up to each bucket's bound, cumulative, and all under +Inf: one pass, no row per bucket."""
    upto = [F.count_if(F.col("value") <= b).alias(str(b)) for b in LADDER]
    wide = table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(*upto, F.count("*").alias("+Inf"))
    return wide.unpivot("event_type", [F.col(f"`{b}`") for b in (*LADDER, "+Inf")], "le", "n")


@query("""SELECT 'throughput_mb' AS metric, 'worker_' || (user_id % 12) AS instance, round(sum(floor(value * 1024))::BIGINT * 1024 / 1048576.0, 1)::DOUBLE AS value, '{"type":"' || event_type || '"}' AS tags,
  epoch(date_trunc('day', ts))::BIGINT AS at FROM events GROUP BY user_id % 12, event_type, date_trunc('day', ts)""")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22, S17, C10 one sample per metric, instance and tags and day, in MB with one decimal."""
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp")))
    sums = table(spark, sf_dir, "events", "user_id", "event_type", "ts", "value").groupBy((F.col("user_id") % 12).alias("w"), "event_type", day.alias("at")).agg(F.sum(F.floor(F.col("value") * 1024)).alias("k"))
    mb = F.round((F.col("k") * 1024 / 1048576).cast("decimal(30,10)"), 1).cast("double")
    return sums.select(F.lit("throughput_mb").alias("metric"), F.concat(F.lit("worker_"), "w").alias("instance"), mb.alias("value"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("tags"), "at")


@query(f"""WITH {FRAMES_SQL} SELECT map_id, count(*) AS records, count(DISTINCT partition_id) AS partitions, {exact_sum_sql("l_quantity")} AS quantity, max(attempt_id) AS attempts FROM frames GROUP BY ALL""")
def shuffle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 what each map wrote."""
    return frames(spark, sf_dir, "l_quantity").groupBy("map_id").agg(F.count("*").alias("records"), F.count_distinct("partition_id").alias("partitions"), exact_sum("l_quantity").alias("quantity"), F.max("attempt_id").alias("attempts"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT map_id, length, sum(length) OVER (PARTITION BY map_id ORDER BY seq_id) AS cum FROM blocks)
SELECT map_id, sum(length)::BIGINT AS bytes, (max(cum) // {SPILL_BYTES})::BIGINT AS spills FROM c GROUP BY map_id""")
def spill_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 bytes of each map and how often its buffer filled."""
    summed = running_sum(blocks(spark, sf_dir).drop("data"), "map_id", "seq_id", F.col("length"), "cum")
    return summed.groupBy("map_id").agg(F.sum("length").alias("bytes"), F.floor(F.max("cum") / SPILL_BYTES).alias("spills"))
