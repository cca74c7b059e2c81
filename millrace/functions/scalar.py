"""Scalar functions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..declare import query
from ..tables import table


def packed_long(a: Column, b: Column) -> Column:
    """C2 two ints as one long."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def retry_wait(base_ms: int, seed: Column) -> Column:
    """C13 one to ten times the base, by a hash of the seed in place of chance."""
    return (F.pmod(F.xxhash64(seed), F.lit(10)) + 1) * base_ms


@query("SELECT s_suppkey, to_base64(encode(s_suppkey || ':' || s_name)) AS coded, s_suppkey || ':' || s_name AS decoded FROM supplier")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 a map-output descriptor to text and back."""
    coded = F.base64(F.concat_ws(":", "s_suppkey", "s_name").cast("binary"))
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select("s_suppkey", coded.alias("coded"), F.unbase64(coded).cast("string").alias("decoded"))


@query("SELECT json_extract_string(props, '$.k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 a field of a JSON text."""
    return table(spark, sf_dir, "events", "props").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, 'host-' || s_suppkey AS host, (19190 + s_suppkey % 3)::INTEGER AS data_port, 19191 AS build_port, 'host-' || s_suppkey || '_' || (19190 + s_suppkey % 3) AS id FROM supplier")
def worker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, D13 host:data:build to its parts, and the id of the worker."""
    text = F.concat(F.lit("host-"), "s_suppkey", F.lit(":"), 19190 + F.col("s_suppkey") % 3, F.lit(":19191"))
    rows = table(spark, sf_dir, "supplier", "s_suppkey").withColumn("p", F.split(text, ":"))
    return rows.select("s_suppkey", F.col("p")[0].alias("host"), F.col("p")[1].cast("int").alias("data_port"), F.col("p")[2].cast("int").alias("build_port"), F.concat_ws("_", F.col("p")[0], F.col("p")[1]).alias("id"))


@query("SELECT p_partkey, replace(url_encode(p_name), '%20', '+') AS node FROM part")
def url_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 a name as a node of a path."""
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.url_encode("p_name").alias("node"))


@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS size, substr(p_brand, 1, 5) AS head, replace(p_type, ' ', '_') AS joined, reverse(p_name) AS back,
  regexp_replace(p_brand, '[0-9]+', 'N') AS masked, lpad(p_size::VARCHAR, 4, '0') AS padded FROM part""")
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 strings."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.length("p_name").alias("size"), F.substring("p_brand", 1, 5).alias("head"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("joined"),
        F.reverse("p_name").alias("back"), F.regexp_replace("p_brand", "[0-9]+", "N").alias("masked"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query("""SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, quarter(o_orderdate)::INTEGER AS q,
  date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS days, strftime(o_orderdate, '%Y-%m') AS ym, last_day(o_orderdate::DATE) AS month_end FROM orders""")
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, C16 dates."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.quarter(d).alias("q"),
        F.date_diff(d.cast("date"), F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(d, "yyyy-MM").alias("ym"), F.last_day(d.cast("date")).alias("month_end"),
    )


@query("""SELECT p_partkey, p_size % 7 AS r, floor(p_retailprice)::BIGINT AS down, ceil(p_retailprice)::BIGINT AS up, sqrt(p_size::DOUBLE) AS root, abs(p_size - 25) AS far,
  greatest(p_size, 10) AS g, least(p_size, 10) AS l, sign(p_size - 25)::DOUBLE AS s FROM part""")
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 numbers."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice").select(
        "p_partkey", (size % 7).alias("r"), F.floor("p_retailprice").alias("down"), F.ceil("p_retailprice").alias("up"), F.sqrt(size.cast("double")).alias("root"),
        F.abs(size - 25).alias("far"), F.greatest(size, F.lit(10)).alias("g"), F.least(size, F.lit(10)).alias("l"), F.signum(size - 25).alias("s"),
    )


@query("""WITH a AS (SELECT p_partkey, string_split(p_type, ' ') AS words, [p_size, p_size % 10, p_size % 3] AS nums FROM part)
SELECT p_partkey, len(words)::INTEGER AS n, array_to_string(list_sort(words), ',') AS sorted, list_sum(list_transform(nums, lambda x: x * 2))::BIGINT AS doubled,
  len(list_filter(nums, lambda x: x > 5))::INTEGER AS large, list_contains(nums, 0) AS has_zero FROM a""")
def fn_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 arrays and functions over them."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size").select("p_partkey", F.split("p_type", " ").alias("words"), F.array(size, size % 10, size % 3).alias("nums"))
    doubled = F.aggregate(F.transform("nums", lambda x: (x * 2).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("p_partkey", F.size("words").alias("n"), F.array_join(F.array_sort("words"), ",").alias("sorted"), doubled.alias("doubled"), F.size(F.filter("nums", lambda x: x > 5)).alias("large"), F.array_contains("nums", 0).alias("has_zero"))


@query("""SELECT s_nationkey, count(*)::INTEGER AS entries, max(s_suppkey) AS last_key, arg_max(s_acctbal, s_suppkey) AS last_value FROM supplier GROUP BY ALL""")
def fn_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15, C16 a map from entries, and looking up in it."""
    maps = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("s_suppkey", "s_acctbal"))).alias("m"))
    last = F.array_max(F.map_keys("m"))
    return maps.select("s_nationkey", F.size("m").alias("entries"), last.alias("last_key"), F.element_at("m", last).alias("last_value"))


def injected_fault(probability: float, seed: Column) -> Column:
    """F11 whether a call fails on purpose, with this probability, by a hash of the seed in place of chance."""
    return F.pmod(F.xxhash64(seed), F.lit(1_000_000)) < F.lit(int(probability * 1_000_000))
