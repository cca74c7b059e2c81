"""The exchanges that plans hold, and what reaches the scans."""

from __future__ import annotations

import pytest

from millrace import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("hash_exchange", "hashpartitioning"),
        ("range_exchange", "rangepartitioning"),
        ("roundrobin_agg", "RoundRobinPartitioning(10)"),
        ("roundrobin_agg", "SinglePartition"),
        ("direct_partition", "shufflepartitionidpassthrough"),
        ("sort_global", "rangepartitioning"),
        ("join_broadcast", "BroadcastHashJoin"),
        ("exchange_identity", "hashpartitioning(o_custkey"),
        ("custom_exchange", "shufflepartitionidpassthrough"),
        ("agg_collect", "ObjectHashAggregate"),
    ],
)
def test_partitioning(spark, sf, name, text):
    assert text in plan(registry.QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", ["hash_exchange", "range_exchange"])
def test_aggregation_uses_the_partitioning_below(spark, sf, name):
    assert plan(registry.QUERIES[name](spark, sf)).count("Exchange") == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(registry.QUERIES["join_semi"](spark, sf))
    assert "GreaterThan(o_totalprice,200000.0)" in text
    assert "o_orderdate" not in text


def test_partitions_are_pruned(spark, sf):
    assert "partition_id#" in (text := plan(registry.QUERIES["sink_partitioned"](spark, sf)))
    assert "PartitionFilters: [isnotnull(partition_id" in text


def test_hash_placement_is_sparks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).repartition(7, "id").select(F.spark_partition_id().alias("p"), F.pmod(F.hash("id"), F.lit(7)).alias("q"))
    assert rows.where("p <> q").count() == 0


def test_two_levels_equal_one(spark, sf):
    two = registry.QUERIES["partial_final_agg"](spark, sf)
    one = registry.QUERIES["final_only_agg"](spark, sf).groupBy("l_returnflag").sum("n")
    assert {r[0]: r[1] for r in two.collect()} == {r[0]: r[1] for r in one.collect()}


def test_global_sort_is_in_order(spark, sf):
    rows = [tuple(r) for r in registry.QUERIES["sort_global"](spark, sf).select("s_acctbal", "s_suppkey").collect()]
    assert rows == sorted(rows)


def test_aggregates_that_cannot_hash_are_sorted(spark, sf):
    """A16 a buffer of strings cannot be updated in place, so its groups are sorted."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_shipdate").agg(F.max("l_returnflag").alias("m"))
    assert "SortAggregate" in plan(rows)


def test_filter_and_columns_of_a_projection_reach_the_scan(spark, sf):
    text = plan(registry.QUERIES["project_case"](spark, sf))
    assert "GreaterThanOrEqual(l_discount,0.02)" in text
    assert "l_extendedprice" not in text
