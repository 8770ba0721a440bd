"""The plans are the ones meant: pushdown, pruning, one shuffle where one is enough."""

import re

from conftest import SF
from pyspark.sql import functions as F

from lakekit.bindings import entities, observing
from lakekit.operators import merge, metrics, tables
from lakekit.plans import reports
from lakekit.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange (?:hash|range|single|Round)", plan(df)))


def test_latest_snapshot_pushes_the_subquery(spark):
    e = files.read_path(spark, f"{SF}/events.parquet")
    text = plan(reports.latest_snapshot(e, "ts").select("event_id"))
    assert "EqualTo(ts,ScalarSubquery" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_param_filter_reaches_the_scan(spark):
    o = files.read_path(spark, f"{SF}/orders.parquet")
    text = plan(reports.param_filter(o, {"o_custkey": ["5", "7"], "o_orderstatus": "F"}).select("o_orderkey"))
    assert "In(o_custkey, [5,7])" in text and "EqualTo(o_orderstatus,F)" in text
    assert "o_totalprice" not in text


def test_partition_filter_reaches_a_published_table(spark, root, name):
    o = files.read_path(spark, f"{SF}/orders.parquet")
    tables.write_table(o, name, "create", root, partition_by=["o_orderstatus"])
    text = plan(spark.table(name).filter("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PartitionFilters: [isnotnull(o_orderstatus" in text and "o_totalprice" not in text


def test_row_counts_come_from_footers(spark):
    text = plan(files.row_counts(spark, SF, r"/(sf[^/]*)/([^/]+)$"))
    assert text.count("PushedAggregation: [COUNT(*)]") == 14


def test_small_merge_source_leaves_the_target_in_place(spark):
    target = files.read_path(spark, f"{SF}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), "l_tax")
    source = spark.createDataFrame([(1, 0.5)], "k bigint, l_tax double")
    merged = merge.merge_by_key(target, source, ["k"])
    merged.collect()
    final = plan(merged)
    assert "FullOuter" not in final and "BroadcastHashJoin" in final


def test_preview_is_a_top_k(spark):
    shown, _ = reports.preview(files.read_path(spark, f"{SF}/orders.parquet"), 10, ["o_orderkey"])
    assert "TakeOrderedAndProject" in plan(shown)


def test_no_python_and_no_cross_join_in_the_operators(spark):
    for name, query in {**observing.QUERIES, **entities.QUERIES}.items():
        if name in ("components", "components_hubs", "linkage_clusters", "linkage_estimate"):
            continue
        text = plan(query(spark, SF))
        for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)


def test_rate_windows_share_one_shuffle(spark):
    e = files.read_path(spark, f"{SF}/events.parquet").select("event_type", "ts", "value")
    text = plan(metrics.counter_rate(e, "event_type", "ts", "value"))
    # equal timestamps combine, slices are windowed, and busy slices are counted
    windowed = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text) if "_slice" in x]
    assert len(windowed) == 1 and text.count("Window [") >= 2
