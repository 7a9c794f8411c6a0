"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as contract
from placefold.plans import registered

NAMES = sorted(n for n in registered() if not n.startswith("stream_"))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf_dir):
    # Small tables would all be broadcast; at scale they are not.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield {n: plan_of(contract.queries()[n](spark, sf_dir)) for n in NAMES}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_cross_or_nested_loop_joins(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_no_forced_broadcasts(plans):
    for name, plan in plans.items():
        assert "BroadcastHashJoin" not in plan, name


def test_no_broadcast_of_repeated_rows(spark, sf_dir):
    """At the default limit too, nothing is broadcast that a salt has multiplied."""
    for name in ("export_rows", "delta_since_cursor", "cancel_transition", "cascade_delete", "gazetteer_join"):
        lines = plan_of(contract.queries()[name](spark, sf_dir)).split("\n")
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                assert not any("Generate explode" in below for below in lines[i : i + 3]), name


def test_hot_keys_are_split(spark):
    """A third of the rows on one key, or with equal coordinates, is no task of its own."""
    from pyspark.sql import functions as F

    from placefold.operators.gazetteer import locate_points

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        spread = spark.range(60_000).repartition(16).withColumns(
            {"point_id": F.col("id"), "lon": F.col("id") % 97 / 10.0, "lat": F.col("id") % 89 / 10.0}
        )
        hot = spread.withColumn("lon", F.when(F.col("id") % 3 == 0, 5.05).otherwise(F.col("lon")))
        hot = hot.withColumn("lat", F.when(F.col("id") % 3 == 0, 5.05).otherwise(F.col("lat")))
        none = spread.withColumn("lon", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("lon")))
        places = spark.range(0, 9000).selectExpr("id AS place_id", "int(id % 90) AS cell_x", "int(id / 90) AS cell_y")
        for points in (hot, none):
            joined = locate_points(points, places).groupBy(F.spark_partition_id().alias("p")).count()
            sizes = [r["count"] for r in joined.collect()]
            assert sum(sizes) == 60_000
            assert max(sizes) < 0.2 * 60_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_no_single_partition_shuffle_of_rows(plans):
    for name, plan in plans.items():
        assert "Exchange SinglePartition" not in plan, name


def test_only_page_extraction_runs_python(plans):
    for name, plan in plans.items():
        assert ("MapInPandas" in plan) == (name in ("extract_links", "mixed_pages", "pages_to_coverage")), name
        assert "PythonUDF" not in plan, name


@pytest.mark.parametrize("name", ["shard_errors", "seed_boxes"])
def test_rank_cut_runs_before_the_shuffle(plans, name):
    assert "WindowGroupLimit" in plans[name] and "Partial" in plans[name]


def test_aggregates_are_partial_first(plans):
    for name in ("merge_listings", "lead_coverage", "job_shard_stats", "next_per_job", "quadtree_leaves",
                 "sync_state_fold", "lifecycle_fold"):
        assert "partial_" in plans[name], name


def test_scans_read_only_what_is_asked(plans):
    read = lambda name: set(re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]))
    assert read("lead_coverage") == {"event_id:bigint,user_id:bigint,event_type:string"}
    assert read("shard_counts") == {"o_orderkey:bigint,o_orderpriority:string"}
    assert all("o_totalprice" not in r for r in read("job_shard_stats"))


def test_filters_reach_the_scan(plans):
    assert "EqualTo(event_type,click)" in plans["lead_page"]
    assert "EqualTo(o_orderkey,42)" in plans["point_lookup"]
    assert "EqualTo(o_orderpriority,2-HIGH)" in plans["shard_page"]
