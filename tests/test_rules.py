"""Rules with expected values of their own, and folds against step-by-step models."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest
from helpers import same
from pyspark.sql import functions as F

from millrace import registry
from millrace.functions.scalar import injected_fault, packed_long, retry_wait
from millrace.model import md5_int_sql, running_sum
from millrace.operators import control, exchange, integrity, placement
from millrace.sources import framed

SMALL = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_crc32_is_zlibs(spark):
    rows = spark.createDataFrame([(0, 0, b"123"), (0, 0, b"456"), (1, 2, b"")], "map_id int, partition_id int, data binary")
    sums = {(r.map_id, r.partition_id): r.checksum for r in integrity.crc_checksums(rows).collect()}
    assert sums == {(0, 0): zlib.crc32(b"123") + zlib.crc32(b"456"), (1, 2): 0}


@pytest.mark.parametrize(("partitions", "workers"), [(1, 3), (15, 3), (16, 4), (10_240, 2048), (99_999, 2048)])
def test_worker_count(spark, partitions, workers):
    assert one(spark, placement.worker_count_of(F.lit(partitions))) == workers


@pytest.mark.parametrize(("maps", "cores", "size"), [(5, 10**6, 3), (4500, 10**6, 4), (10**6, 2000, 3), (10**6, 10**6, 10)])
def test_group_size(spark, maps, cores, size):
    assert one(spark, placement.group_size_of(F.lit(maps), F.lit(cores))) == size


@pytest.mark.parametrize(("retry", "black", "host"), [(0, [], "host-1"), (1, [], "host-1"), (3, [], "host-2"), (6, [], "host-3"), (0, ["host-1"], "host-2"), (0, ["host-1", "host-2", "host-3"], "host-1")])
def test_failover(spark, retry, black, host):
    hosts = F.array(*(F.lit(f"host-{i}") for i in (1, 2, 3)))
    out = F.array(*map(F.lit, black)) if black else F.array().cast("array<string>")
    assert one(spark, placement.failover_of(hosts, out, F.lit(retry))) == host


def test_placement_is_even(spark, sf):
    counts = [r["count"] for r in placement.placement(spark, sf).groupBy("group_id").count().collect()]
    assert len(counts) == 25
    assert max(counts) - min(counts) <= 1


def test_weighted_shares(spark, sf):
    """Draws fall to workers in proportion to their weights."""
    slots = placement.weight_intervals(spark.createDataFrame([(i, w) for i, w in enumerate((1, 1, 2, 2))], "s_suppkey int, weight int"))
    draws = spark.range(100_001).select((F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 6).alias("u"))
    found = draws.join(slots, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("s_suppkey").count().collect()
    assert {r.s_suppkey: r["count"] * 100 // 100_001 for r in found} == {0: 16, 1: 16, 2: 33, 3: 33}


@pytest.mark.parametrize(("a", "b", "similar"), [("TEST1", "TEST2", True), ("TE", "TEST", True), (None, None, True), (None, "x", False), ("", "", True), ("", "x", False), ("AB", "AC", False)])
def test_similar_names(spark, a, b, similar):
    assert one(spark, control.similar_names(F.lit(a).cast("string"), F.lit(b).cast("string"), 4)) is similar


@pytest.mark.parametrize(("forced", "combine", "partitions", "relocatable", "writer"), [("auto", False, 200, True, "bypass"), ("auto", False, 201, True, "unsafe"), ("auto", False, (1 << 24) + 1, True, "sort"), ("auto", True, 10, True, "sort"), ("auto", False, 500, False, "sort"), ("bypass", True, 9999, False, "bypass")])
def test_writer_choice(spark, forced, combine, partitions, relocatable, writer):
    assert one(spark, exchange.writer_choice_of(F.lit(forced), F.lit(combine), F.lit(partitions), F.lit(relocatable))) == writer


def test_health_fold_is_its_steps(spark):
    rng = random.Random(1)
    oks = [rng.random() < 0.7 for _ in range(300)]
    black, n, turns = False, 0, 0
    for ok in oks:
        was = black
        black, n = control.health_step(black, n, ok)
        turns += black != was
    got = one(spark, control.health_fold(F.array(*map(F.lit, oks))))
    assert (got.black, got.n, got.turns) == (black, n, turns)


def test_punishment_doubles(spark):
    d = control.PUNISH_SECONDS
    events = [(0, True), (d + 1, True), (2 * d, True), (2 * d + 1, False), (5 * d, True)]
    since, seconds = None, d
    for at, busy in events:
        since, seconds = control.punish_step(since, seconds, at, busy)
    got = control.punish_run(None, d, np.array([at for at, _ in events]), np.array([b for _, b in events]))
    assert got == (since, seconds, 1) == (5 * d, d, 1)


def test_punish_run_is_its_steps():
    rng = random.Random(2)
    d = control.PUNISH_SECONDS
    for share in (0.1, 0.5, 0.95):
        at = sorted(rng.randrange(60 * d) for _ in range(400))
        busy = [rng.random() < share for _ in at]
        since, seconds, doubled = None, d, 0
        for a, b in zip(at, busy, strict=True):
            before = (since, seconds)
            since, seconds = control.punish_step(since, seconds, a, b)
            doubled += since is not None and since == before[0] and seconds == 2 * before[1]
        state = (None, d, 0)
        for i in range(0, len(at), 70):  # as batches cut it
            s, n, more = control.punish_run(*state[:2], np.array(at[i : i + 70]), np.array(busy[i : i + 70]))
            state = (s, n, state[2] + more)
        assert state == (since, seconds, doubled)


def test_health_by_slots_is_one_fold(spark):
    rng = random.Random(3)
    oks = [rng.random() < 0.75 for _ in range(240)]
    lit = lambda part: F.array(*map(F.lit, part))
    cuts = [0, 1, 2, 5, 60, 61, 130, 240]
    slots = F.array(*(F.struct(F.lit(i).alias("slot"), F.array(*(control.health_fold(lit(oks[a:b]), *s) for s in control.HEALTH_STATES)).alias("outcomes")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))))
    whole, chained = spark.range(1).select(control.health_fold(lit(oks)), control.health_chain(slots)).first()
    assert whole == chained


def test_blocks_with_reset(spark):
    assert one(spark, exchange.cut_with_reset(F.array(*(F.lit(x).cast("long") for x in (40, 40, 40, 10, 100, 1))), 100)) == [0, 0, 0, 1, 1, 2]


def test_running_sum_over_chunks(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = {r.id: r.s for r in running_sum(rows, "k", "id", F.lit(1), "s").collect()}
    assert all(s == i // 3 + 1 for i, s in got.items())


def test_checksum_states(spark):
    table = lambda rows, name: spark.createDataFrame(rows, f"map_id int, {name} long")
    expected = spark.createDataFrame([(i,) for i in range(6)], "map_id int")
    got = integrity.verified(expected, table([(0, 5), (1, 5), (3, 5), (4, -1)], "stored"), table([(0, 5), (1, 6), (5, 7)], "read"))
    assert {r.map_id: r.status for r in got.collect()} == {0: "OK", 1: "MISMATCH", 2: "MISSING_INDEX", 3: "MISSING_DATA", 4: "OK", 5: "MISSING_INDEX"}


def test_packed_long(spark):
    assert one(spark, packed_long(F.lit(3), F.lit(-1))) == (3 << 32) | 0xFFFFFFFF
    assert 100 <= one(spark, retry_wait(100, F.lit("x"))) <= 1000


def test_frames_are_read_back(spark, tmp_path):
    body = b"".join(framed.FRAME.pack(0, 0, i, 0, 3) + data for i, data in enumerate((b"123", b"456", b"789")))
    body += framed.FRAME.pack(0, 0, -1, 0, sum(zlib.crc32(x) for x in (b"123", b"456", b"789")))
    (tmp_path / "final").mkdir()
    (tmp_path / "final" / "shuffle_w_0_0.dat_final").write_bytes(body)
    (tmp_path / "shuffle_w_0_1.dat").write_bytes(b"not closed yet")
    spark.dataSource.register(framed.FramedSource)
    rows = spark.read.format("framed").load(str(tmp_path))
    assert [r.data for r in rows.where("seq_id >= 0").orderBy("seq_id").collect()] == [b"123", b"456", b"789"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dat_final").option("recursiveFileLookup", "true").load(str(tmp_path))
    again = framed.scan(files)
    assert again.where("seq_id = -1").first().length == again.where("seq_id >= 0").agg(F.sum(F.crc32("data"))).first()[0]
    with pytest.raises(ValueError, match="cut off"):
        list(framed.decode(body[:40]))


def _blocks(spark):
    rows = [(i % 3, i % 2, 0, i, bytes([i]) * i) for i in range(12)] + [(0, 1, 0, 99, None)]
    return spark.createDataFrame(rows, "partition_id int, map_id int, attempt_id long, seq_id int, data binary")


def test_stored_frames_show_a_flipped_byte(spark, tmp_path):
    spark.dataSource.register(framed.FramedSource)
    where = f"{tmp_path}/frames"
    clustered = _blocks(spark).repartition("partition_id").sortWithinPartitions("partition_id", "seq_id")
    clustered.write.format("framed").mode("append").save(where)
    rows = spark.read.format("framed").load(where)
    assert {r.seq_id: r.data for r in rows.where("seq_id >= 0").collect()} == {r.seq_id: bytes(r.data or b"") for r in _blocks(spark).collect()}
    assert {r.map_id: r.status for r in framed.crc_verified(rows).collect()} == {0: "OK", 1: "OK"}
    clustered.write.format("framed").mode("overwrite").save(where)
    assert spark.read.format("framed").load(where).where("seq_id >= 0").count() == 13
    path = sorted((tmp_path / "frames" / "2").rglob("*.dat_final"))[0]
    content = bytearray(path.read_bytes())
    heads, at = [], 0
    while at < len(content):
        frame = framed.FRAME.unpack_from(content, at)
        heads.append((at, frame))
        at += framed.FRAME.size + (frame[4] if frame[2] != -1 else 0)
    assert [h[3] for _, h in heads if h[2] != -1] == [a for a, h in heads if h[2] != -1]  # offsets are where frames begin
    at, frame = next((a, h) for a, h in heads if h[2] != -1 and h[4] > 0)
    content[at + framed.FRAME.size] ^= 1
    path.write_bytes(content)
    status = {r.map_id: r.status for r in framed.crc_verified(spark.read.format("framed").load(where)).collect()}
    assert status == {frame[0]: "MISMATCH", 1 - frame[0]: "OK"}
    path.write_bytes(content[:-1])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("framed").load(where).count()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(framed.FramedSource)
    where = f"{tmp_path}/frames"
    broken = F.when(F.col("seq_id") == 11, F.raise_error(F.lit("lost"))).otherwise(F.col("data")).cast("binary")
    with pytest.raises(Exception, match="lost"):
        _blocks(spark).withColumn("data", broken).coalesce(1).write.format("framed").mode("append").save(where)
    assert not list(tmp_path.rglob("shuffle_*"))
    with pytest.raises(Exception, match="no column data"):
        _blocks(spark).drop("data").write.format("framed").mode("append").save(where)


def test_reader_waits_for_pending_files(spark, tmp_path):
    spark.dataSource.register(framed.FramedSource)
    (tmp_path / "shuffle_w_0_1.dat").write_bytes(b"")
    reader = framed._Reader(str(tmp_path), 0.5)
    with pytest.raises(TimeoutError, match="1 files still pending"):
        reader.partitions()
    (tmp_path / "shuffle_w_0_1.dat").rename(tmp_path / "shuffle_w_0_1.dat_final")
    assert len(reader.partitions()) == 1
    assert spark.read.format("framed").option("wait", "1").load(str(tmp_path)).count() == 0


def test_round_robin_cursor(spark):
    """The distributed cursor is the step-by-step one while the ring stays; a ring that shrank is read from its last."""
    asked = [3, 0, 9, 11, 10, 1, 25, 4, 7]
    cursor, want = 0, []
    for i, n in enumerate(asked):
        given, cursor = placement.cursor_step(cursor, n, 10)
        want += [(i, w) for w in given]
    got = placement.round_robin(spark.createDataFrame(list(enumerate(asked)), "event_id long, asked long"), 10)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert placement.cursor_step(8, 2, 5) == ([4, 0], 1)
    assert placement.cursor_step(8, 6, 5) == (list(range(5)), 8)
    assert len({w for i in range(3) for w in placement.cursor_step(3 * i, 3, 10)[0]}) == 9


def test_black_list_file(spark, tmp_path):
    (tmp_path / "black-list.conf").write_text("127.0.0.1:19191\n\n 127.0.0.1:19191\n")
    assert [r.id for r in control.black_list(spark, str(tmp_path / "black-list.conf")).collect()] == ["127.0.0.1_19191"]


@pytest.mark.parametrize("text", ["", "a", "hello", "application_1"])
def test_text_hash(spark, text):
    value = 0
    for c in text:
        value = (value * 31 + ord(c)) & 0xFFFFFFFF
    want = value - (1 << 32) if value >= 1 << 31 else value
    assert one(spark, exchange.text_hash(F.lit(text))) == want
    assert spark._jvm.java.util.Objects.hashCode(text) == want


@pytest.mark.parametrize(("failures", "retries", "resend", "sends", "arrived"), [(0, 5, False, 1, True), (1, 5, False, 1, False), (5, 5, True, 6, True), (6, 5, True, 6, False), (130, 999, True, 121, False), (1, 0, True, 2, True)])
def test_resends(spark, failures, retries, resend, sends, arrived):
    count, there = placement.sends_of(F.lit(failures), F.lit(retries), F.lit(resend))
    assert spark.range(1).select(count, there).first() == (sends, arrived)


@pytest.mark.parametrize("name", ["st_health_fsm", "st_punish_fsm", "st_admission", "st_dedup_blocks", "st_tumbling", "st_session", "st_stream_join"])
def test_streams_keep_their_state_between_batches(spark, sf, tmp_path, name):
    """Events in three files, read one to a batch."""
    whole = spark.read.parquet(f"{sf}/events.parquet")
    low, high = (r.ts for r in whole.orderBy("ts").collect()[:: whole.count() // 3][1:3])
    for i, part in enumerate((whole.where(F.col("ts") < low), whole.where((F.col("ts") >= low) & (F.col("ts") < high)), whole.where(F.col("ts") >= high))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        assert len(list((tmp_path / "events.parquet").glob("*.parquet"))) == i + 1
    spark.conf.set("millrace.stream.filesPerBatch", "1")
    try:
        same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path))
    finally:
        spark.conf.unset("millrace.stream.filesPerBatch")


def test_frame_columns(spark):
    got = one(spark, framed.frame(F.lit(7), F.lit(-2), F.lit(-1), F.lit(1 << 40), F.lit(5)))
    assert struct.unpack(">iqiqq", got) == (7, -2, -1, 1 << 40, 5)


LARGER = "/root/testdata/sf0.01"


def test_round_robin_takes_every_request(spark):
    """Several chunks of requests, none left out."""
    requests = spark.read.parquet(f"{LARGER}/events.parquet").selectExpr("event_id", "1 + user_id % 5 AS asked")
    same(placement.round_robin(requests), """WITH r AS (SELECT event_id, 1 + user_id % 5 AS asked, sum(1 + user_id % 5) OVER (ORDER BY event_id) - (1 + user_id % 5) AS before FROM events)
SELECT event_id, ((before + j) % 25)::BIGINT AS worker FROM r, unnest(range(asked)) AS x(j)""", LARGER)  # fmt: skip


EVERY = "w AS (SELECT s_suppkey, 1 + s_suppkey % 4 AS weight FROM supplier)"


def every_worker(spark):
    return spark.read.parquet(f"{LARGER}/supplier.parquet").selectExpr("s_suppkey", "1 + s_suppkey % 4 AS weight")


def test_weighted_draws_reach_every_worker(spark, monkeypatch):
    monkeypatch.setattr("millrace.model.CHUNK", 16)
    got = placement.weighted_draws(spark.read.parquet(f"{LARGER}/orders.parquet"), every_worker(spark))
    assert got.select("s_suppkey").distinct().count() == 100
    same(got, f"""WITH {EVERY}, i AS (SELECT s_suppkey, weight, sum(weight) OVER (ORDER BY s_suppkey) AS hi, (SELECT sum(weight) FROM w) AS total FROM w),
d AS (SELECT o_orderkey, {md5_int_sql("o_orderkey")} % (SELECT any_value(total) FROM i) AS u FROM orders)
SELECT o_orderkey, s_suppkey FROM d JOIN i ON u >= hi - weight AND u < hi""", LARGER)  # fmt: skip


def test_times_are_of_every_worker(spark):
    same(placement.times_given(every_worker(spark)), f"""WITH {EVERY}, t AS (SELECT s_suppkey, unnest(range(1, weight // (SELECT min(weight) FROM w) + 1)) AS time FROM w),
r AS (SELECT s_suppkey, time, row_number() OVER (ORDER BY md5(s_suppkey || ':' || time)) AS place FROM t)
SELECT s_suppkey, count(*) AS times FROM r WHERE place <= {placement.TIMES_ASKED} GROUP BY ALL""", LARGER)  # fmt: skip


def test_injected_faults_have_their_probability(spark):
    rows = spark.range(20_000)
    share = rows.select(F.avg(injected_fault(0.2, F.col("id")).cast("int")).alias("x")).first()["x"]
    assert 0.18 < share < 0.22
    assert rows.where(injected_fault(0.0, F.col("id"))).count() == 0
    assert rows.where(injected_fault(1.0, F.col("id"))).count() == 20_000


@pytest.mark.parametrize(("size", "fits"), [(9, False), (10, True), (20, True), (21, False)])
def test_block_size_bounds(size, fits):
    if fits:
        assert exchange.checked_block_size(size, 10, 20) == size
    else:
        with pytest.raises(ValueError, match="not between 10 and 20"):
            exchange.checked_block_size(size, 10, 20)


def test_dispatch_by_name(spark):
    for name, f in placement.STRATEGIES.items():
        assert placement.dispatch(name, spark, SMALL).columns == f(spark, SMALL).columns
    with pytest.raises(ValueError, match="no dispatch strategy 'other'"):
        placement.dispatch("other", spark, SMALL)


def test_a_changed_byte_changes_the_checksum(spark):
    rows = spark.createDataFrame([(1, "abc"), (1, "def")], "map_id int, data string")
    other = spark.createDataFrame([(1, "abc"), (1, "dXf")], "map_id int, data string")
    sums = [r.groupBy("map_id").agg(F.sum(integrity.md5_int("data")).alias(n)) for r, n in ((rows, "stored"), (other, "read"))]
    assert [r.status for r in integrity.verified(rows.select("map_id").distinct(), *sums).collect()] == ["MISMATCH"]


def test_buffered_bytes_are_never_reset(spark):
    from millrace import registry

    query = "flow_memory"
    same(registry.QUERIES[query](spark, LARGER), registry.ORACLES[query], LARGER)


def test_one_bad_sketch_is_outvoted(spark, tmp_path):
    """The middle date's parts are ones that a single sketch of 5 % counts 15.3 % too high; dates and parts may be null."""
    rows = spark.range(7_086_000, 7_089_000).selectExpr("timestamp_ntz'2000-08-09' AS l_shipdate", "id AS l_partkey", "'N' AS l_returnflag", "id % 7 AS l_suppkey", "10D AS l_quantity")
    odd = "(null, 1L, 'A', 5L, 50D), (null, null, 'R', 4L, 49D), (null, 1L, null, null, 50D), (timestamp_ntz'2000-08-10', null, null, null, null)"
    rows.union(spark.sql(f"SELECT * FROM VALUES {odd}")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    same(registry.QUERIES["agg_collect"](spark, str(tmp_path)), registry.ORACLES["agg_collect"], str(tmp_path))


def test_one_group_is_admitted_by_many_tasks(spark, tmp_path):
    """All requests in one group: its decisions come from all tasks of the exchange."""
    spark.read.parquet(f"{LARGER}/events.parquet").withColumn("event_type", F.lit("view")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = registry.QUERIES["st_admission"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same(got, registry.ORACLES["st_admission"], str(tmp_path))
    assert got.groupBy(F.input_file_name()).count().count() == 4


@pytest.mark.parametrize("name", ["admission", "st_admission"])
@pytest.mark.parametrize("batches", [1, 3])
def test_admission_of_odd_requests(spark, tmp_path, name, batches):
    """Requests without a name, a time or an application; more applications at one time than permits; a group that opens late."""
    odd = "('click', null, 0), (null, 1L, 0), ('view', 1L, null), ('', 7L, 5), ('signup', null, 30), ('view', 2L, 20), ('view', 3L, 31), ('click', 99L, 9), ('click', 98L, 10)"
    rows = spark.range(25).selectExpr("'click' AS event_type", "id AS user_id", "id % 2 AS day").union(spark.sql(f"SELECT * FROM VALUES {odd}"))
    rows = rows.selectExpr("monotonically_increasing_id() AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(day) AS ts", "user_id", "event_type", "1D AS value", "'' AS props").cache()
    day = F.when(F.col("ts") < "2024-01-02", 0).when(F.col("ts") < "2024-01-06", 1).otherwise(2)
    for i in range(batches):
        rows.where(day == i if batches > 1 else F.lit(True)).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("millrace.stream.filesPerBatch", "1")
    try:
        same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path))
    finally:
        spark.conf.unset("millrace.stream.filesPerBatch")


def test_admission_of_no_requests(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES["st_admission"](spark, str(tmp_path)).count() == 0
