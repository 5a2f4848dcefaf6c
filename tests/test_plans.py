"""What the plans must look like, and what must hold when one key has a large part of the rows."""

from __future__ import annotations

from contextlib import contextmanager

import pytest
from helpers import plan_of, rows_of
from pyspark.sql import functions as F

from rtshop import fixtures as X
from rtshop.operators import dims, keyed, logs, orders, sales
from rtshop.plans import registry
from rtshop.plans.oracle import ORACLE
from rtshop.sinks.batches import save_daily
from rtshop.sources.daily import daily_table, searched_table

SF = "/root/testdata/sf0.001"
BATCH = [name for name in registry.QUERIES if not name.startswith(("stream_", "report_"))]


@contextmanager
def settings(spark, **values):
    values = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", BATCH)
def test_plans_stay_in_the_engine(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        if node == "SinglePartition" and name in ("sale_search_page", "search_topk_highlight"):
            continue
        assert node not in plan, node


def test_messages_are_parsed_once(spark):
    plan = plan_of(registry.dau_total(spark, SF))
    assert plan.count("from_json") == 1
    assert plan_of(registry.order_typed_rows(spark, SF)).count("from_json") == 1


def test_counting_devices_needs_no_payload(spark):
    plan = plan_of(registry.dau_total(spark, SF))
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_hours_of_devices_need_only_the_hour(spark):
    plan = plan_of(registry.dau_hourly(spark, SF))
    aggregates = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert aggregates and all("hr" in line and "vc" not in line for line in aggregates)


def test_tables_are_read_once_and_dimensions_only_where_asked(spark):
    count = lambda name, column: plan_of(registry.QUERIES[name](spark, SF)).split("== Initial Plan ==")[0].count(
        f"FileScan parquet [{column}")
    assert (count("cdc_route_facts", "o_orderkey"), count("cdc_route_facts", "l_orderkey")) == (1, 1)
    assert count("dim_merge_latest", "c_custkey") == 1
    for name in ("sale_search_total", "province_sales"):
        assert "c_custkey" not in plan_of(registry.QUERIES[name](spark, SF))
    assert "n_nationkey" not in plan_of(registry.sale_age_share(spark, SF))


def test_search_of_a_day_goes_to_the_scan(spark, folder):
    rows = spark.range(10).selectExpr("id as detail_id", "'red' as sku_name", "'2024-01-10' as dt")
    save_daily(rows, folder, 0)
    found = searched_table(spark, folder, ["detail_id"], lambda day: sales.sale_hits(day, "red"), "2024-01-10")
    plan = plan_of(found)
    below = plan[plan.index("Window"):].splitlines()
    assert any("Filter" in line and "sku_name" in line for line in below)


def test_routing_does_not_shuffle(spark):
    assert "Exchange" not in plan_of(registry.cdc_route_facts(spark, SF))


def test_provinces_are_broadcast(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(registry.order_with_province(spark, SF))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_unneeded_columns_are_not_read(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = plan_of(registry.sale_age_share(spark, SF))
    assert "FileScan parquet [o_orderkey#" in plan and "o_totalprice" not in plan and "l_tax" not in plan


def test_day_and_columns_reach_the_scan_of_a_day_table(spark, folder):
    rows = spark.range(10).selectExpr("id as detail_id", "'red' as sku_name", "1.0 as amount",
                                      "if(id < 5, '2024-01-10', '2024-01-11') as dt")
    save_daily(rows, folder, 0)
    hits = sales.sale_hits(daily_table(spark, folder, ["detail_id"]), "red", "2024-01-10")
    plan = plan_of(hits.groupBy("dt").count())
    scan = plan[plan.index("FileScan"):]
    assert "2024-01-10" in scan[scan.index("PartitionFilters"):scan.index("PushedFilters")]
    assert "amount" not in scan


def test_one_row_per_key_is_kept_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as n", "id as v")
    plan = plan_of(keyed.latest_by_key(df, ["k"], ["n"]))
    final, partial = plan.index("Final"), plan.index("Partial")
    assert final < plan.index("Exchange") < partial


def hot_rows(spark, count=30_000):
    """A third of the rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("id") % 1000 + 2)
    return spark.range(0, count, 1, 8).select("id", key.alias("hot"))


SMALL_SPLITS = {
    "spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20KB",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10KB",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__shuffle__partitions": "8",
}


def _orders(spark, ids):
    return X.order_info(ids.selectExpr(
        "id as o_orderkey", "'P' as o_orderstatus", "user as o_custkey", "cast(id as double) as o_totalprice",
        "timestamp'2024-01-01' as o_orderdate"))


def test_hot_user_is_split(spark):
    source = hot_rows(spark).withColumnRenamed("hot", "user")
    users = spark.range(1100).selectExpr("id", "'1990-01-01' as birthday", "'M' as gender")
    with settings(spark, **SMALL_SPLITS):
        joined = orders.with_user(orders.one_row_per_order(_orders(spark, source)), users, "2024-01-01")
        counted = joined.filter("user_gender = 'M'").agg(F.count("id"), F.count_distinct("id"))
        assert tuple(counted.collect()[0]) == (30_000, 30_000)
        assert "skew=true" in plan_of(counted)


@pytest.mark.parametrize("join", ["pairs", "interval", "outer"])
def test_hot_order_is_split(spark, join):
    details = hot_rows(spark).selectExpr(
        "id", "hot as order_id", "id as sku_id", "1.0D as order_price", "1L as sku_num", "'red' as sku_name",
        "'2024-01-01 00:00:00' as create_time", "1.0D as split_total_amount",
        f"timestamp_seconds({X.START_SECONDS} + (hot * {X.ORDER_STEP}) % {X.SPREAD_SECONDS}) as timestamp")
    # Copies of the hot order must not multiply its details.
    ids = spark.range(1100).union(spark.range(500).selectExpr("1L")).selectExpr("id", "id as user")
    with settings(spark, **SMALL_SPLITS):
        single = orders.one_row_per_order(_orders(spark, ids))
        if join == "pairs":
            rows = orders.order_detail_pairs(single, details)
        elif join == "interval":
            rows = orders.order_detail_interval(single, details)
        else:
            rows = orders.order_detail_full_outer(single, details).filter("match = 'both'")
        counted = rows.agg(F.count("d_id"), F.count_distinct("d_id"), F.sum(F.length("d_create_time")))
        assert tuple(counted.collect()[0])[:2] == (30_000, 30_000)
        assert "skew=true" in plan_of(counted)


def test_hot_device_and_hot_dimension_key(spark):
    rows = hot_rows(spark).select(
        F.concat(F.lit("m"), "hot").alias("key"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        F.col("id").alias("offset"), F.lit(X.START).cast("timestamp").alias("timestamp"),
        F.to_json(F.struct(F.struct(F.concat(F.lit("m"), "hot").alias("mid")).alias("common"),
                           F.struct(F.lit("").alias("last_page_id")).alias("page"),
                           (F.lit(1704888000000) + F.col("id")).alias("ts"))).alias("value"))
    first = logs.daily_active_devices(logs.normalize_logs(rows), ["ts", "offset"])
    assert first.filter("mid = 'm1'").first()["ts"] == 1704888000000
    assert first.count() == hot_rows(spark).select("hot").distinct().count()

    changes = hot_rows(spark).select(
        F.lit("DIM_USER_INFO").alias("dim_table"), F.col("hot").cast("string").alias("rowkey"),
        F.lit("UPDATE").alias("type"), F.create_map(F.lit("id"), F.col("hot").cast("string"), F.lit("name"),
                                                    F.col("id").cast("string")).alias("row"),
        F.struct("id").alias("ord"))
    merged = dims.dim_rows(changes, "DIM_USER_INFO", ("id", "name"))
    plan = plan_of(merged)
    assert plan.index("partial_max_by") > plan.index("Exchange")
    assert rows_of(merged.filter("id = '1'")) == [("1", "29997")]


@pytest.mark.parametrize("merge", [dims.compacted, dims.merge_dim_open])
def test_cells_are_combined_in_even_parts(spark, merge):
    """One block of a file may hold all changes: they are spread before they are split into cells."""
    changes = hot_rows(spark).coalesce(1).select(
        F.lit("DIM_USER_INFO").alias("dim_table"), F.col("hot").cast("string").alias("rowkey"),
        F.col("hot").cast("string").alias("pk"), F.lit("UPDATE").alias("type"),
        F.create_map(F.lit("id"), F.col("hot").cast("string"), F.lit("name"), F.col("id").cast("string")).alias("row"),
        F.struct("id").alias("ord"))
    merged = merge(changes)
    plan = plan_of(merged)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    assert plan.index("partial_max_by") < plan.index("REBALANCE_PARTITIONS_BY_COL")
    assert merged.filter("rowkey = '1'").select(F.col("row")["name"]).first()[0] == "29997"
