"""Clustered listing tables: results, and plans that leave the table where it is."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from placefold.operators import clustered
from placefold.operators.merge import KEY, as_sightings, fold_sightings, golden_rows, merge_listings
from placefold.sources.views import view

BUCKETS = 4


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_scan(df, table):
    """Operators of the plan between the root and the scan of a table."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if table in line and "Scan" in line)
    path, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            path.append(line)
            depth = indent
    return path


def seen(spark, sf_dir):
    return as_sightings(view(spark, sf_dir, "observations"))


def test_more_sightings_do_not_move_the_table(spark, sf_dir, no_broadcast):
    whole = seen(spark, sf_dir)
    table = clustered.store_states(whole.where("seq % 3 = 0"), BUCKETS)
    states = clustered.with_sightings(spark, table, whole.where("seq % 3 != 0"), BUCKETS)
    path = above_scan(states, table)
    assert any("SortMergeJoin" in p for p in path) and not any("Exchange" in p for p in path)
    got, want = golden_rows(states), merge_listings(whole)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # Nothing new, and nothing old.
    same = clustered.with_sightings(spark, table, whole.limit(0), BUCKETS)
    assert sorted(map(str, same.collect())) == sorted(map(str, spark.table(table).collect()))
    none = clustered.store_states(whole.limit(0), BUCKETS)
    first = clustered.with_sightings(spark, none, whole, BUCKETS)
    assert sorted(map(str, first.collect())) == sorted(map(str, fold_sightings(whole).select(*first.columns).collect()))


def test_unsent_listings_do_not_move_the_table(spark, sf_dir, no_broadcast):
    golden = merge_listings(seen(spark, sf_dir), columns=("id", "name"))
    table = clustered.store(golden, BUCKETS)
    sent = golden.where("id % 2 = 0").select(*KEY)
    left = clustered.not_among(spark, table, sent.unionByName(sent), BUCKETS)
    path = above_scan(left, table)
    assert any("SortMergeJoin" in p for p in path) and not any("Exchange" in p for p in path)
    assert left.count() == golden.where("id % 2 = 1").count()


def test_pages_prune_row_groups(spark):
    rows = spark.range(200_000).select(
        F.concat(F.lit("job "), F.col("id") % 5).alias("job_id"), F.sha2(F.col("id").cast("string"), 256).alias("dedupe_key"),
        F.col("id"), F.sha2(F.concat(F.lit("x"), F.col("id")), 256).alias("name"),
    )
    size = spark._jsc.hadoopConfiguration().get("parquet.block.size")
    spark._jsc.hadoopConfiguration().set("parquet.block.size", str(256 * 1024))
    try:
        table = clustered.store(rows, BUCKETS)
    finally:
        if size is None:
            spark._jsc.hadoopConfiguration().unset("parquet.block.size")
        else:
            spark._jsc.hadoopConfiguration().set("parquet.block.size", size)
    page = clustered.page_after(spark, table, "job 2", 150_000, 20, "id", "name")
    assert [r.id for r in page.collect()] == list(range(150_002, 150_102, 5))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,150000)" in plan and "EqualTo(job_id,job 2)" in plan
    folder = spark.table(table).inputFiles()
    groups, useful = 0, 0
    for file in folder:
        meta = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            stats = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            useful += stats["job_id"].min <= "job 2" <= stats["job_id"].max and stats["id"].max > 150_000
    assert groups >= 5 * useful and useful >= 1
