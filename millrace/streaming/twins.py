"""Streams: windows, joins and the stateful rules of ``operators.control``, each over the same table read as a stream.

A stream is drained (everything there is, then it ends) into a table in the shared folder, which is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.control import MOST_THROUGHPUT, PUNISH_SECONDS, first_requests, health_step, punish_step, requests, with_permits
from ..operators.integrity import is_late
from ..declare import ORACLES, query
from ..storage import new_path
from ..tables import table

DELAY = "10 minutes"
_DONE = "<= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, one file or a folder of them, as a stream of its files; so many to a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    files = spark.conf.get("millrace.stream.filesPerBatch", "1000")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}[.]parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def poured(stream: DataFrame, mode: str, path: str, made: Callable[[DataFrame, int], DataFrame] = lambda rows, batch: rows) -> None:
    """Run a stream over all there is and write what is ``made`` of each batch.  Every batch is a folder of its own,
    so a batch that is run again replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        made(rows, batch).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is and return what it wrote; of ``keys`` the last batch's row counts."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    poured(stream, mode, path)
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        return out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    if keys:
        values = [c for c in stream.columns if c not in keys]
        last = out.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
        return last.select(*keys, "v.*")
    return out.drop("batch")


@query(f"""SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, sum(floor(value))::BIGINT AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 HOUR {_DONE}""")
def st_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19 hourly windows, given out once the watermark has passed them."""
    counted = events(spark, sf_dir).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return drained(counted.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total"), "append")


@query(f"""SELECT * FROM (SELECT event_type, start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY ALL)
WHERE start + INTERVAL 2 HOUR {_DONE}""")
def st_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19 windows of two hours every hour."""
    counted = events(spark, sf_dir).groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return drained(counted.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "append")


@query(f"""WITH l AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE {_DONE}""")
def st_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19 sessions that end after half an hour without an event."""
    counted = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return drained(counted.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "append")


@query("""SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase'
AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR""")
def st_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T19 purchases within an hour after a click: two streams joined with a bound on time, so that state is dropped."""
    clicks = events(spark, sf_dir).where("event_type = 'click'").select(F.col("user_id").alias("cu"), F.col("ts").alias("ct"), F.col("event_id").alias("click_id"))
    buys = events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("pu"), F.col("ts").alias("pt"), F.col("event_id").alias("purchase_id"))
    joined = clicks.join(buys, F.expr("cu = pu and pt >= ct and pt <= ct + interval 1 hour"))
    return drained(joined.select("click_id", "purchase_id"), "append")


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "event_id"])


def _health(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    black, n, turns = state.get if state.exists else (False, 0, 0)
    for ok in _in_order(parts)["ok"]:
        was = black
        black, n = health_step(black, n, bool(ok))
        turns += black != was
    state.update((bool(black), int(n), int(turns)))
    yield pd.DataFrame({"worker": [key[0]], "black": [black], "ok_times": [n], "turns": [turns]})


@query()
def st_health_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 as a stream: each worker's state lives on between batches."""
    beats = events(spark, sf_dir).select((F.col("user_id") % 12).alias("worker"), "ts", "event_id", (F.col("event_type") != "error").alias("ok"))
    kept = beats.groupBy("worker").applyInPandasWithState(_health, "worker long, black boolean, ok_times int, turns int", "black boolean, n int, turns int", "update", GroupStateTimeout.NoTimeout)
    return drained(kept, "update", ["worker"])


def _punish(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    since, seconds, doubled = state.get if state.exists else (None, PUNISH_SECONDS, 0)
    rows = _in_order(parts)
    for at, busy in zip(rows["at"].tolist(), rows["busy"].tolist(), strict=True):
        before = (since, seconds)
        since, seconds = punish_step(since, seconds, at, busy)
        doubled += since is not None and since == before[0] and seconds == 2 * before[1]
    state.update((since, int(seconds), int(doubled)))
    yield pd.DataFrame({"worker": [key[0]], "since": pd.array([since], dtype="Int64"), "seconds": [seconds], "doubled": [doubled]})


@query()
def st_punish_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 as a stream."""
    swept = events(spark, sf_dir).select((F.col("user_id") % 12).alias("worker"), "ts", "event_id", F.unix_timestamp("ts").alias("at"), (F.col("value") > MOST_THROUGHPUT).alias("busy"))
    kept = swept.groupBy("worker").applyInPandasWithState(_punish, "worker long, since long, seconds long, doubled int", "since long, seconds long, doubled int", "update", GroupStateTimeout.NoTimeout)
    return drained(kept, "update", ["worker"])


def admitted(asked: DataFrame, decided: DataFrame) -> DataFrame:
    """The decisions of one batch, after ``decided`` (with the batch of each row): a group is opened by the first request of
    its first batch, and applications that have been decided on are not asked again.  Requests are dealt by group and application."""
    begun = decided.groupBy("group_name").agg(F.min_by("first_ts", F.struct("batch", "first_ts")).alias("begun"), F.count("*").alias("n"))
    firsts = asked.groupBy("group_name").agg(F.min("ts").alias("first")).join(F.broadcast(begun), "group_name", "left")
    apps = first_requests(asked, firsts.select("group_name", F.coalesce("begun", "first").alias("opened")))
    old = decided.select(F.col("group_name").alias("g"), F.col("app_id").alias("a"))
    new = apps.join(old, (F.col("group_name") == F.col("g")) & F.col("app_id").eqNullSafe(F.col("a")), "left_anti")
    return with_permits(new, begun.select("group_name", "n"))


@query()
def st_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 as a stream: the decision on each application's first request in its group's first interval.

    Few groups may hold all requests, so the state is not kept by group: it is what earlier batches have written."""
    asked = requests(streamed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    path, kept = new_path(spark, "stream"), "group_name string, app_id long, first_ts timestamp_ntz, admitted boolean, batch long"

    def made(rows: DataFrame, batch: int) -> DataFrame:
        here = rows.sparkSession
        decided = here.read.schema(kept).parquet(f"{path}/rows").where(F.col("batch") < batch) if batch else here.createDataFrame([], kept)
        return admitted(rows, decided)

    poured(asked, "append", path, made)
    return spark.read.schema(kept).parquet(f"{path}/rows").drop("batch")


for _twin in ("health_fsm", "punish_fsm", "admission"):
    ORACLES[f"st_{_twin}"] = ORACLES[_twin]


@query("SELECT event_id, user_id % 12 AS worker FROM events")
def st_dedup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 as a stream: every tenth event is sent twice; state is kept only as long as the watermark needs."""
    sent = events(spark, sf_dir).select("ts", "event_id", (F.col("user_id") % 12).alias("worker"), F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("file"))
    return drained(sent.dropDuplicatesWithinWatermark(["worker", "event_id"]).select("event_id", "worker"), "append")


@query(ORACLES["late_blocks"])
def st_late_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, T2 as a stream of blocks against the table of finalised stages."""
    stage = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_orderdate + interval 60 days").alias("finalised"))
    arrived = streamed(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(stage, "l_orderkey", "left")
    counted = arrived.groupBy((F.col("l_orderkey") % 50).alias("app")).agg(F.count("*").alias("blocks"), F.count_if(is_late(F.col("l_shipdate"), F.col("finalised"))).alias("late"))
    return drained(counted, "complete")
