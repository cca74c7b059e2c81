"""Placement and dispatch: how many workers a shuffle gets, which, and what is sent to each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import md5_int, md5_int_sql, running_sum
from ..declare import query
from ..tables import table

PER_WORKER, LEAST_WORKERS, MOST_WORKERS = 5, 3, 2048
LEAST_GROUP, MOST_GROUP, CORES_PER_MEMBER = 3, 10, 1000
RETRIES_PER_WORKER = 3


def worker_count_of(partitions: Column) -> Column:
    """P1 a fifth of the partitions, rounded up, raised to the least number and then capped."""
    return F.least(F.lit(MOST_WORKERS), F.greatest(F.lit(LEAST_WORKERS), F.ceil(partitions / PER_WORKER))).cast("long")


@query("SELECT p_partkey, p_size * p_size * 5 AS partitions, least(2048, greatest(3, ceil(p_size * p_size * 5 / 5.0)))::BIGINT AS workers FROM part")
def worker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    partitions = F.col("p_size") * F.col("p_size") * 5
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", partitions.alias("partitions"), worker_count_of(partitions).alias("workers"))


def group_size_of(maps: Column, cores: Column) -> Column:
    """P2 a thousandth of the tasks that can run at once, between the least and the most."""
    at_once = F.least(maps, cores).cast("long")
    return F.least(F.lit(MOST_GROUP).cast("long"), F.greatest((at_once - at_once % CORES_PER_MEMBER) / CORES_PER_MEMBER, F.lit(LEAST_GROUP)).cast("long"))


@query("SELECT p_partkey, least(10, greatest(least(p_partkey * 7, p_size * 300) // 1000, 3))::BIGINT AS group_size FROM part")
def group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", group_size_of(F.col("p_partkey") * 7, F.col("p_size") * 300).alias("group_size"))


@query("SELECT range AS partition_id, range % 25 AS group_id FROM range(4000)")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3 partitions onto groups by remainder: loads differ by one at most.  A group per nation."""
    groups = table(spark, sf_dir, "nation", "n_nationkey").agg(F.count("*").alias("n"))
    return spark.range(4000).crossJoin(F.broadcast(groups)).select(F.col("id").alias("partition_id"), (F.col("id") % F.col("n")).alias("group_id"))


@query("""WITH w AS (SELECT n_name, n_nationkey AS i, count(*) OVER () AS n FROM nation)
SELECT a.i AS group_id, b.n_name AS worker, ((b.i - a.i + a.n) % a.n)::BIGINT AS place FROM w a JOIN w b ON (b.i - a.i + a.n) % a.n < 4""")
def worker_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, C14, D17 group i holds workers i to i+3, around the ring; a nation per worker, in key order."""
    ring = table(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumn("n", F.lit(table(spark, sf_dir, "nation").count()))
    member = ring.select(F.col("n_nationkey").alias("m"), F.col("n_name").alias("worker"))
    wanted = ring.select(F.col("n_nationkey").alias("group_id"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4), F.col("n")).cast("long") - 1)).alias("place"))
    return wanted.withColumn("m", ((F.col("group_id") + F.col("place")) % F.col("n")).cast("int")).join(member, "m").select("group_id", "worker", "place")


@query("""WITH s AS (SELECT p_partkey, p_size::BIGINT AS partitions, least(2048, greatest(3, ceil(p_size / 5.0)))::BIGINT AS workers,
  least(10, greatest(least(p_partkey * 7, p_size * 300) // 1000, 3))::BIGINT AS size FROM part),
p AS (SELECT *, unnest(range(partitions)) AS partition_id FROM s)
SELECT p_partkey, workers, partition_id, partition_id % workers AS group_id, array_to_string(list_transform(range(least(size, workers)), lambda j: (partition_id % workers + j) % workers), ',') AS members FROM p""")
def shuffle_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 a shuffle per part registered: its number of workers, a group of them from each worker on around the ring, and
    the group that serves each partition (P1, P2, W1, P3)."""
    asked = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.col("p_size").cast("long").alias("partitions"), group_size_of(F.col("p_partkey") * 7, F.col("p_size") * 300).alias("size"))
    return registered(asked, "p_partkey")


def registered(shuffles: DataFrame, key: str) -> DataFrame:
    """X1 (key, workers, partition_id, group_id, members) of shuffles given as (key, partitions, size of a group)."""
    sized = shuffles.withColumn("workers", worker_count_of(F.col("partitions")))
    dealt = sized.withColumn("partition_id", F.explode(F.expr("sequence(0l, partitions - 1)"))).withColumn("group_id", F.col("partition_id") % F.col("workers"))
    members = F.transform(F.expr("sequence(0l, least(size, workers) - 1)"), lambda j: (F.col("group_id") + j) % F.col("workers"))
    return dealt.select(key, "workers", "partition_id", "group_id", F.array_join(members, ",").alias("members"))


WEIGHTS_SQL = "workers AS (SELECT s_suppkey, 1 + s_suppkey % 4 AS weight FROM supplier)"


def weighted_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier per worker, with weights 1 to 4."""
    return table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", (1 + F.col("s_suppkey") % 4).alias("weight"))


def weight_intervals(workers: DataFrame) -> DataFrame:
    """Half-open intervals [lo, hi) of cumulative weight, summed by chunks of workers."""
    summed = running_sum(workers.withColumn("__all", F.lit(0)), "__all", "s_suppkey", F.col("weight"), "hi").drop("__all")
    return summed.withColumn("lo", F.col("hi") - F.col("weight"))


@query(f"""WITH {WEIGHTS_SQL}, i AS (SELECT s_suppkey, weight, sum(weight) OVER (ORDER BY s_suppkey)::BIGINT AS hi, (SELECT sum(weight) FROM workers)::BIGINT AS total FROM workers),
d AS (SELECT o_orderkey, {md5_int_sql("o_orderkey")} % (SELECT any_value(total) FROM i) AS u FROM orders)
SELECT d.o_orderkey, i.s_suppkey FROM d JOIN i ON d.u >= i.hi - i.weight AND d.u < i.hi""")
def weighted_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 every order is a request, every supplier a worker."""
    return weighted_draws(table(spark, sf_dir, "orders", "o_orderkey"), weighted_workers(spark, sf_dir))


def weighted_draws(requests: DataFrame, workers: DataFrame) -> DataFrame:
    """P4 a draw falls into one worker's share of the total weight, with replacement.

    Each worker is listed once per unit of weight, so the draw is looked up by an equi-join."""
    slots = weight_intervals(workers).select("s_suppkey", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("u"))
    total = workers.agg(F.sum("weight").alias("total"))
    draws = requests.crossJoin(F.broadcast(total)).select("o_orderkey", (md5_int("o_orderkey") % F.col("total")).alias("u"))
    return draws.join(slots, "u").select("o_orderkey", "s_suppkey")


TIMES_ASKED = 70


@query(f"""WITH {WEIGHTS_SQL}, t AS (SELECT s_suppkey, unnest(range(1, weight // (SELECT min(weight) FROM workers) + 1)) AS time FROM workers),
r AS (SELECT s_suppkey, time, row_number() OVER (ORDER BY md5(s_suppkey || ':' || time)) AS place FROM t)
SELECT s_suppkey, count(*) AS times FROM r WHERE place <= {TIMES_ASKED} GROUP BY ALL""")
def times_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 every supplier is a worker."""
    return times_given(weighted_workers(spark, sf_dir))


def times_given(workers: DataFrame) -> DataFrame:
    """P5 asked for more than there are, each worker is given as often as its weight exceeds the least, at most."""
    least = workers.agg(F.min("weight").alias("least"))
    repeated = workers.crossJoin(F.broadcast(least)).select("s_suppkey", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("weight div least"))).alias("time"))
    first = repeated.orderBy(F.md5(F.concat_ws(":", "s_suppkey", "time").cast("binary"))).limit(TIMES_ASKED)
    return first.groupBy("s_suppkey").agg(F.count("*").alias("times"))


@query("""WITH r AS (SELECT event_id, 1 + user_id % 5 AS asked, sum(1 + user_id % 5) OVER (ORDER BY event_id) - (1 + user_id % 5) AS before FROM events)
SELECT event_id, ((before + j) % 25)::BIGINT AS worker FROM r, unnest(range(asked)) AS x(j)""")
def roundrobin_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 every event is a request."""
    asked = (1 + F.col("user_id") % 5).alias("asked")
    return round_robin(table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", asked))


def round_robin(requests: DataFrame, ring: int = 25) -> DataFrame:
    """P6 each request takes the next workers around a ring; the cursor is what was asked before, summed by chunks.
    A request for more than there are is given all, and one for none gets none; neither moves the cursor."""
    within = F.col("asked") <= ring
    moved = F.when(within, F.col("asked")).otherwise(0)
    upto = running_sum(requests.where("asked > 0").withColumn("ring", F.lit(0)), "ring", "event_id", moved, "upto")
    slots = upto.withColumn("cursor", F.when(within, F.col("upto") - F.col("asked")).otherwise(0)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("asked"), F.lit(ring)).cast("long") - 1)))
    return slots.select("event_id", ((F.col("cursor") + F.col("j")) % ring).alias("worker"))


@query("""WITH r AS (SELECT event_id, user_id % 31 AS asked FROM events),
c AS (SELECT event_id, asked, sum(CASE WHEN asked <= 25 THEN asked ELSE 0 END) OVER (ORDER BY event_id) - CASE WHEN asked <= 25 THEN asked ELSE 0 END AS before FROM r)
SELECT event_id, ((before + j) % 25)::BIGINT AS worker FROM c, unnest(range(asked)) AS x(j) WHERE asked <= 25
UNION ALL SELECT event_id, j AS worker FROM c, unnest(range(25)) AS x(j) WHERE asked > 25""")
def roundrobin_overask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 with requests for up to 30 of 25 workers."""
    return round_robin(table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", (F.col("user_id") % 31).alias("asked")))


def cursor_step(cursor: int, asked: int, ring: int) -> tuple[list[int], int]:
    """P6 one request to a ring that may change: the workers given, and the cursor after it.  All, without a move, if
    more are asked for than there are; a ring that shrank below the cursor is read from its last worker."""
    if asked > ring:
        return list(range(ring)), cursor
    cursor = min(cursor, ring - 1)
    return [(cursor + j) % ring for j in range(asked)], (cursor + asked) % ring


STATE_SQL = """states AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 5 < 2 THEN 'online' WHEN s_suppkey % 5 = 2 AND s_suppkey % 2 = 0 THEN 'configured'
  WHEN s_suppkey % 5 < 4 THEN 'black' ELSE 'punished' END AS state FROM supplier)"""


def worker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier per worker, a nation per cluster; 'configured' is black through the black list."""
    r = F.col("s_suppkey") % 5
    state = F.when(r < 2, "online").when((r == 2) & (F.col("s_suppkey") % 2 == 0), "configured").when(r < 4, "black").otherwise("punished")
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("state", state)


@query(f"""WITH {STATE_SQL}, c AS (SELECT s_nationkey, count(*) FILTER (state = 'online') AS normal, count(*) FILTER (state = 'black') AS black, count(*) FILTER (state = 'punished') AS punished FROM states GROUP BY ALL)
SELECT *, black + punished <= normal AS accepted FROM c""")
def cluster_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 a cluster takes requests unless more of its workers are out than in."""
    counts = worker_states(spark, sf_dir).groupBy("s_nationkey").agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in (("online", "normal"), ("black", "black"), ("punished", "punished"))))
    return counts.withColumn("accepted", F.col("black") + F.col("punished") <= F.col("normal"))


@query("""WITH routes AS (SELECT n_nationkey AS dag, n_name AS cluster, r_name AS dc FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0)
SELECT c_custkey, coalesce(dc, 'default_dc') AS dc, coalesce(cluster, 'default_cluster') AS cluster FROM customer LEFT JOIN routes ON c_nationkey = dag""")
def dag_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, P8 a job's cluster by its DAG, the default where it is unknown.  At most one route per nation."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
    routes = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("dc"), F.col("n_name").alias("cluster"))
    jobs = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(F.broadcast(routes), "c_nationkey", "left")
    return jobs.select("c_custkey", F.coalesce("dc", F.lit("default_dc")).alias("dc"), F.coalesce("cluster", F.lit("default_cluster")).alias("cluster"))


@query(f"WITH {STATE_SQL} SELECT s_suppkey, s_nationkey FROM states WHERE state = 'online'")
def online_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 candidates are workers that are online."""
    return worker_states(spark, sf_dir).where("state = 'online'").select("s_suppkey", "s_nationkey")


@query("""WITH requests AS (SELECT l_orderkey, l_linenumber, (l_partkey % 7)::INTEGER AS retry, l_quantity = 13 AS error FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN error THEN 'host-' || (2 + (l_orderkey % 2)) ELSE 'host-' || (1 + (retry // 3) % 3) END AS host FROM requests""")
def failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T15, U3 the worker of a group after some retries; one that failed is taken out, and all come back when none is left.

    Three workers; a failed request (quantity 13) names host-1, and orders of odd keys have lost host-2 before."""
    hosts = F.array(*(F.lit(f"host-{i}") for i in (1, 2, 3)))
    black = F.when(F.col("l_quantity") == 13, F.array(F.lit("host-1"))).otherwise(F.array().cast("array<string>"))
    black = F.when((F.col("l_quantity") == 13) & (F.col("l_orderkey") % 2 == 1), F.array(F.lit("host-1"), F.lit("host-2"))).otherwise(black)
    retry = F.when(F.col("l_quantity") == 13, 0).otherwise(F.col("l_partkey") % 7)
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", failover_of(hosts, black, retry).alias("host"))


def failover_of(hosts: Column, black: Column, retry: Column) -> Column:
    """Worker number (retry div 3) of those that did not fail, around; of all if all failed."""
    left = F.array_except(hosts, black)
    left = F.when(F.size(left) == 0, hosts).otherwise(left)
    return F.element_at(left, (F.floor(retry / RETRIES_PER_WORKER) % F.size(left) + 1).cast("int"))


@query(f"SELECT s_suppkey FROM supplier ORDER BY {md5_int_sql('s_suppkey')}, s_suppkey LIMIT 7")
def worker_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O5 at most seven workers, shuffled by a hash."""
    return table(spark, sf_dir, "supplier", "s_suppkey").orderBy(md5_int("s_suppkey"), "s_suppkey").limit(7)


@query("SELECT DISTINCT l_orderkey % 20 AS shuffle, l_suppkey % 12 AS worker FROM lineitem WHERE l_linenumber <= 3 UNION SELECT DISTINCT l_orderkey % 20, 12 + l_suppkey % 3 FROM lineitem WHERE l_linenumber > 3")
def shuffle_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2 all workers of a shuffle: the union of its groups' lists, each once."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    worker = F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey") % 12).otherwise(12 + F.col("l_suppkey") % 3)
    return rows.select((F.col("l_orderkey") % 20).alias("shuffle"), worker.alias("worker")).distinct()


@query("SELECT range AS attempt, least(300, (range // 5 + 1) * 50)::BIGINT AS wait_ms FROM range(40)")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 waits grow by 50 ms every five tries, up to 300 ms."""
    return spark.range(40).select(F.col("id").alias("attempt"), F.least(F.lit(300), (F.expr("id div 5") + 1) * 50).alias("wait_ms"))


MOST_RETRIES, LEAST_RETRIES = 120, 1


def sends_of(failures: Column, retries: Column, resend: Column) -> tuple[Column, Column]:
    """T16 how often a packet is sent whose first ``failures`` sends fail on the channel, and whether one arrives: sent
    again only where that is enabled, and as often as is set, within its bounds."""
    allowed = F.when(resend, F.greatest(F.lit(LEAST_RETRIES), F.least(F.lit(MOST_RETRIES), retries))).otherwise(0)
    return F.least(failures, allowed) + 1, failures <= allowed


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 150 AS failures, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE greatest(1, least(120, l_suppkey % 140)) END AS allowed FROM lineitem)
SELECT l_orderkey, l_linenumber, least(failures, allowed) + 1 AS sends, failures <= allowed AS arrived FROM p""")
def resends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16, I5 a packet that never arrives fails its fetch, and with it the stage, which Spark runs again."""
    sends, arrived = sends_of(F.col("l_partkey") % 150, F.col("l_suppkey") % 140, F.col("l_suppkey") % 3 != 0)
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", sends.alias("sends"), arrived.alias("arrived"))


def dispatch(strategy: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """E3 the dispatch of the strategy that a setting names."""
    if strategy not in STRATEGIES:
        raise ValueError(f"no dispatch strategy {strategy!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](spark, sf_dir)


#: E3 dispatch strategies by name.
STRATEGIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"weighted": weighted_dispatch, "times": times_dispatch, "round_robin": roundrobin_dispatch}
