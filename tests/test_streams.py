"""Streams against their batch twins: many files, restarts, replays."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from placefold.functions.times import ntz, plus_seconds
from placefold.operators.delivery import delivery_records
from placefold.operators.merge import as_sightings, fold_sightings, merge_listings
from placefold.operators.tasks import lifecycle_fold
from placefold.sources.views import VIEWS, view
from placefold.streaming import jobs as st
from placefold.streaming import states
from placefold.streaming.keyed import late_rows, stale_claims_batch
from placefold.workspace import child_dirs, fresh_dir, shared_root


@pytest.fixture()
def event_files(spark, sf_dir):
    """The events as eight files that arrive out of order."""
    source = fresh_dir(spark, "events")
    events = view(spark, sf_dir, "events")
    events.repartition(8, "user_id").write.parquet(source)
    return source, events.schema


def rows(frame):
    return sorted(map(str, frame.select(*sorted(frame.columns)).collect()))


def test_merge_in_many_batches_equals_one(spark, sf_dir, event_files):
    source, schema = event_files
    root = fresh_dir(spark, "merge")
    stream = st.stream_parquet(spark, source, schema, max_files=3)
    seen = as_sightings(spark.sql(VIEWS["observations"], events=stream))
    st.start_merge(seen, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    expected = rows(merge_listings(as_sightings(view(spark, sf_dir, "observations"))))
    assert rows(st.golden_table(spark, f"{root}/state")) == expected

    paths, upto = states.state_paths(spark, f"{root}/state")
    assert len(paths) == upto + 1 == 3
    # A restart finds nothing new and changes nothing.
    st.start_merge(seen, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    assert states.state_paths(spark, f"{root}/state")[1] == upto
    # Compaction keeps the result and leaves one folder to read.
    assert st.compact_merge(spark, f"{root}/state") == upto
    assert states.state_paths(spark, f"{root}/state")[0] == [f"{root}/state/base/{upto}"]
    assert rows(st.golden_table(spark, f"{root}/state")) == expected
    # Later batches build on the compacted base.
    late = view(spark, sf_dir, "observations").where("seq < 40")
    states.write_batch(fold_sightings(as_sightings(late)), f"{root}/state", upto + 1)
    assert rows(st.golden_table(spark, f"{root}/state")) == expected


def test_merge_compacts_on_the_way(spark, sf_dir, event_files):
    source, schema = event_files
    root = fresh_dir(spark, "merge")
    seen = as_sightings(spark.sql(VIEWS["observations"], events=st.stream_parquet(spark, source, schema, max_files=2)))
    st.start_merge(seen, f"{root}/state", f"{root}/checkpoint", compact_every=2).awaitTermination()
    assert states.state_paths(spark, f"{root}/state") == ([f"{root}/state/base/3"], 3)
    expected = rows(merge_listings(as_sightings(view(spark, sf_dir, "observations"))))
    assert rows(st.golden_table(spark, f"{root}/state")) == expected


def test_unfinished_batches_are_not_read(spark, sf_dir):
    root = fresh_dir(spark, "partial")
    seen = as_sightings(view(spark, sf_dir, "observations"))
    states.write_batch(fold_sightings(seen.where("seq % 2 = 0")), root, 0)
    states.write_batch(fold_sightings(seen.where("seq % 2 = 1")), root, 1)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batches/1/_SUCCESS"), False)
    assert rows(st.golden_table(spark, root)) == rows(merge_listings(seen.where("seq % 2 = 0")))


def test_each_listing_is_delivered_once_over_restarts(spark, sf_dir, event_files):
    source, schema = event_files
    root = fresh_dir(spark, "delivery")
    jobs = view(spark, sf_dir, "listing_jobs")

    def run():
        stream = st.stream_parquet(spark, source, schema, max_files=2)
        seen = as_sightings(spark.sql(VIEWS["observations"], events=stream))
        st.start_delivery(seen, jobs, "directory", f"{root}/out", f"{root}/checkpoint").awaitTermination()

    def keys():
        paths, _ = states.state_paths(spark, f"{root}/out")
        return rows(spark.read.parquet(*paths).select("_sent_job_id", "_sent_dedupe_key"))

    run()
    run()
    golden = merge_listings(as_sightings(view(spark, sf_dir, "observations"))).select("job_id", "dedupe_key")
    wanted = rows(golden.withColumnsRenamed({"job_id": "_sent_job_id", "dedupe_key": "_sent_dedupe_key"}))
    assert keys() == wanted and st.delivered(spark, f"{root}/out").count() == golden.count()
    # Sightings of delivered listings send nothing, whatever the batch and after compaction.
    again = view(spark, sf_dir, "events").where("event_id < 25").selectExpr("event_id + 1000000 AS event_id", "ts", "user_id", "event_type", "value", "props")
    again.write.mode("append").parquet(source)
    states.compact(spark, f"{root}/out", lambda records: records)
    run()
    known = set(keys())
    assert len(keys()) == len(known) and set(wanted) <= known


def test_a_replayed_batch_decides_the_same(spark, sf_dir):
    seen = as_sightings(view(spark, sf_dir, "observations"))
    root = fresh_dir(spark, "replay")
    jobs = view(spark, sf_dir, "listing_jobs")
    source = fresh_dir(spark, "events")
    view(spark, sf_dir, "events").write.parquet(source)
    stream = st.stream_parquet(spark, source, view(spark, sf_dir, "events").schema)
    live = as_sightings(spark.sql(VIEWS["observations"], events=stream))
    for checkpoint in ("a", "b"):  # the second run replays batch 0
        st.start_delivery(live, jobs, "directory", f"{root}/out", f"{root}/{checkpoint}").awaitTermination()
        assert st.delivered(spark, f"{root}/out").count() == merge_listings(seen).count()


def test_a_state_without_batches_has_no_rows(spark, sf_dir):
    seen = as_sightings(view(spark, sf_dir, "observations"))
    assert st.golden_table(spark, fresh_dir(spark, "none"), seen).count() == 0


def test_lifecycle_stream_equals_batch(spark, sf_dir):
    source, root = fresh_dir(spark, "orders"), fresh_dir(spark, "lifecycle")
    orders = view(spark, sf_dir, "orders")
    orders.repartition(6).write.parquet(source)
    stream = st.stream_parquet(spark, source, orders.schema, max_files=2)
    log = spark.sql(VIEWS["shard_events"], orders=stream)
    st.start_lifecycle(log, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    assert rows(st.task_states(spark, f"{root}/state")) == rows(lifecycle_fold(view(spark, sf_dir, "shard_events")))


def test_shared_folder_comes_from_the_session(spark):
    assert fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def _delivery_by_file(spark, sf_dir, root, source, schema, n_files=1):
    jobs = view(spark, sf_dir, "listing_jobs")
    stream = st.stream_parquet(spark, source, schema, max_files=n_files)
    seen = as_sightings(spark.sql(VIEWS["observations"], events=stream))
    query = st.start_delivery(seen, jobs, "directory", f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    return query


def test_a_batch_reads_nothing_of_what_was_sent(spark, sf_dir):
    """Fifty batches of one file: the last one's input and plan know its own rows only."""
    source, root = fresh_dir(spark, "events"), fresh_dir(spark, "delivery")
    events = view(spark, sf_dir, "events")
    events.repartitionByRange(50, "event_id").write.parquet(source)
    query = _delivery_by_file(spark, sf_dir, root, source, events.schema)
    progress = [json.loads(p.json) for p in query.recentProgress]
    work = [p for p in progress if p["numInputRows"]]
    assert len(work) == 50 and sum(p["numInputRows"] for p in work) == events.count()
    last = work[-1]
    assert last["numInputRows"] < 2 * events.count() / 50
    assert [s["description"] for s in last["sources"]] == [s["description"] for s in work[0]["sources"]]
    state = last["stateOperators"][0]
    assert state["numRowsUpdated"] <= last["numInputRows"] < state["numRowsTotal"]
    assert any("rocksdb" in k for k in state["customMetrics"])
    plan = query._jsq.explainInternal(False)
    assert f"{root}/out" not in plan and "StateStoreRestore" in plan


def test_changes_of_delivered_listings(spark, sf_dir):
    """With ``changes`` a later sighting sends the listing as it is by then."""
    source, root = fresh_dir(spark, "events"), fresh_dir(spark, "delivery")
    events = view(spark, sf_dir, "events")
    jobs = view(spark, sf_dir, "listing_jobs")
    half = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]

    def run(changes):
        stream = st.stream_parquet(spark, source, events.schema)
        seen = as_sightings(spark.sql(VIEWS["observations"], events=stream))
        out = f"{root}/{changes}"
        st.start_delivery(seen, jobs, "directory", out, f"{out}-checkpoint", changes=changes).awaitTermination()
        return [spark.read.parquet(p) for p in states.state_paths(spark, out)[0]]

    events.where(F.col("event_id") <= half).write.parquet(source)
    run(True), run(False)
    events.where(F.col("event_id") > half).write.mode("append").parquet(source)
    (first, second), (_, once) = run(True), run(False)
    late = as_sightings(view(spark, sf_dir, "observations").where(F.col("seq") > half))
    keys = late.select("job_id", "dedupe_key").distinct()
    golden = merge_listings(as_sightings(view(spark, sf_dir, "observations"))).join(keys, ["job_id", "dedupe_key"])
    assert rows(second.drop("_sent_job_id", "_sent_dedupe_key")) == rows(delivery_records(golden, jobs, "directory"))
    assert once.count() == golden.count() - second.join(first, ["_sent_job_id", "_sent_dedupe_key"], "left_semi").count()


def test_states_can_be_read_before_the_first_batch(spark, sf_dir):
    source, root = fresh_dir(spark, "nothing"), fresh_dir(spark, "early")
    orders, events = view(spark, sf_dir, "orders"), view(spark, sf_dir, "events")
    orders.limit(0).write.parquet(f"{source}/orders")
    events.limit(0).write.parquet(f"{source}/events")
    log = spark.sql(VIEWS["shard_events"], orders=st.stream_parquet(spark, f"{source}/orders", orders.schema))
    st.start_lifecycle(log, f"{root}/a", f"{root}/ca").awaitTermination()
    assert st.task_states(spark, f"{root}/a").count() == 0
    st.start_reclaim(log, f"{root}/b", f"{root}/cb", "1 minute", "1 minute").awaitTermination()
    assert st.table_so_far(spark, f"{root}/b").count() == 0
    _delivery_by_file(spark, sf_dir, root, f"{source}/events", events.schema)
    assert st.delivered(spark, f"{root}/out").count() == 0


def test_lifecycle_compacts_and_keeps_little(spark, sf_dir):
    source, root = fresh_dir(spark, "orders"), fresh_dir(spark, "lifecycle")
    orders = view(spark, sf_dir, "orders")
    orders.repartition(6).write.parquet(source)
    stream = st.stream_parquet(spark, source, orders.schema, max_files=1)
    log = spark.sql(VIEWS["shard_events"], orders=stream)
    st.start_lifecycle(log, f"{root}/state", f"{root}/checkpoint", compact_every=2).awaitTermination()
    assert rows(st.task_states(spark, f"{root}/state")) == rows(lifecycle_fold(view(spark, sf_dir, "shard_events")))
    assert child_dirs(spark, f"{root}/state/base") == ["3", "5"]
    assert child_dirs(spark, f"{root}/state/batches") == ["4", "5"]


LOG = "shard_id long, seq long, event string, token string, ts timestamp_ntz"


def _at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def _log(spark, *events):
    return spark.createDataFrame([(s, q, e, t, _at(m)) for s, q, e, t, m in events], LOG)


def test_claims_fire_when_their_time_comes(spark):
    """Ended in time, ended late, wrong token, taken over, and events that come before their claim."""
    source, root = fresh_dir(spark, "log"), fresh_dir(spark, "reclaim")
    parts = [
        _log(spark, (1, 1, "claim", "a", 0), (2, 2, "claim", "b", 0), (3, 3, "claim", "c", 0), (6, 8, "done", "f", 4)),
        _log(spark, (1, 4, "done", "a", 5), (2, 5, "done", "x", 3), (4, 6, "claim", "d", 3), (6, 7, "claim", "f", 2)),
        _log(spark, (2, 9, "done", "b", 11), (4, 10, "claim", "e", 6), (5, 11, "claim", "g", 30), (3, 12, "cancel", None, 10)),
        _log(spark, (9, 13, "create", None, 60)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    fired = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = st.stream_parquet(spark, source, whole.schema)
        st.start_reclaim(stream, f"{root}/out", f"{root}/checkpoint", "10 minutes", "20 minutes").awaitTermination()
        fired.append(sorted((r.shard_id, r.claim_seq) for r in st.table_so_far(spark, f"{root}/out").collect()))
    # Task 2's own write came a minute late; of task 4 both claims ran out or were taken over.
    assert fired == [[], [], [(2, 2)], [(2, 2), (4, 10), (5, 11)]]
    got = st.table_so_far(spark, f"{root}/out")
    columns = ["shard_id", "claim_seq", "token", "claimed_at", "reclaimed_at"]
    want = stale_claims_batch(whole, "10 minutes", F.lit(_at(40)).cast("timestamp_ntz"))
    assert rows(got.select(columns)) == rows(want.select(columns))
    assert {(r.status, bool(r.last_error)) for r in got.collect()} == {("retry", True)}


def test_reclaim_equals_its_batch_twin_over_many_files(spark, sf_dir):
    source, root = fresh_dir(spark, "orders"), fresh_dir(spark, "reclaim")
    orders = view(spark, sf_dir, "orders")
    orders.repartitionByRange(4, "o_orderkey").write.parquet(source)
    timed = lambda log: log.withColumn("ts", plus_seconds(ntz("2024-01-01"), F.col("seq") * 60))
    log = timed(spark.sql(VIEWS["shard_events"], orders=st.stream_parquet(spark, source, orders.schema, max_files=1)))
    # Files may come in any order: the delay covers the whole log, and one last event moves the time on.
    st.start_reclaim(log, f"{root}/out", f"{root}/checkpoint", "1 minute", "30 days").awaitTermination()
    assert st.table_so_far(spark, f"{root}/out").count() == 0
    far = orders.limit(1).withColumn("o_orderkey", F.lit(800_000).cast("bigint"))
    far.write.mode("append").parquet(source)
    st.start_reclaim(log, f"{root}/out", f"{root}/checkpoint", "1 minute", "30 days").awaitTermination()
    got = st.table_so_far(spark, f"{root}/out").select("shard_id", "claim_seq", "token", "claimed_at", "reclaimed_at")
    want = stale_claims_batch(timed(view(spark, sf_dir, "shard_events")), "1 minute", ntz("2025-01-01"))
    assert got.count() and rows(got) == rows(want)


SEEN = "job_id string, dedupe_key string, observed_at timestamp_ntz"


def test_windows_over_batches_and_late_rows(spark):
    source, root = fresh_dir(spark, "seen"), fresh_dir(spark, "recency")
    rng = random.Random(4)
    plan = [(0, 30), (25, 50), (45, 80), (75, 110)]  # hours of each file; they overlap
    sent, dropped, mark = [], 0, -1.0
    query = None
    for a, b in plan:
        part = [(rng.choice("xy"), f"k{rng.randrange(12)}", rng.uniform(a, b)) for _ in range(60)]
        if a == 75:
            part += [("x", "late", 1.0), ("y", "late", 2.0)]  # far behind the stream's time
            dropped = 2
        spark.createDataFrame([(j, k, _at(60 * h)) for j, k, h in part], SEEN).coalesce(1).write.mode("append").parquet(source)
        stream = st.stream_parquet(spark, source, spark.createDataFrame([], SEEN).schema)
        query = st.start_recency(stream, f"{root}/out", f"{root}/checkpoint", "6 hours")
        query.awaitTermination()
        sent += [p for p in part if p[1] != "late"]
    mark = max(h for *_, h in sent) - 6
    want = []
    for job in "xy":
        for end in range(1, int(mark) + 1):
            day = {k for j, k, h in sent if j == job and end - 24 <= h < end}
            hour = {k for j, k, h in sent if j == job and end - 1 <= h < end}
            if day:
                want.append((job, _at(60 * end), len(hour), len(day)))
    got = st.table_so_far(spark, f"{root}/out").select("job_id", "window_end", "seen_last_hour", "seen_last_day").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert late_rows(query) == 24 * dropped


@pytest.mark.parametrize("step", [30, 120])
def test_windows_keep_a_sighting_once_at_any_step(spark, step):
    source, root = fresh_dir(spark, "seen"), fresh_dir(spark, "recency")
    rng = random.Random(step)
    sent = []
    for n, (a, b) in enumerate([(0, 30), (30, 60)]):
        part = [(rng.choice(["x", None]), rng.choice([None, *(f"k{i}" for i in range(40))]), round(rng.uniform(a, b), 2)) for _ in range(150)]
        spark.createDataFrame([(j, k, _at(60 * h)) for j, k, h in part], SEEN).coalesce(1).write.mode("append").parquet(source)
        stream = st.stream_parquet(spark, source, spark.createDataFrame([], SEEN).schema)
        query = st.start_recency(stream, f"{root}/out", f"{root}/checkpoint", "6 hours", f"{step} minutes")
        query.awaitTermination()
        sent += part
        # Before, a sighting had a row for each window it lies in: 48 or 12 of them.
        if n == 0:
            kept = max(json.loads(p.json)["stateOperators"][-1]["numRowsTotal"] for p in query.recentProgress)
            assert kept < 4 * len(part)
    want = []
    for job in ("x", None):
        for end in (step / 60 * i for i in range(1, 200)):
            day = {k for j, k, h in sent if j == job and end - 24 <= h < end}
            if day and end <= max(h for *_, h in sent) - 6:
                want.append((job, _at(60 * end), len({k for j, k, h in sent if j == job and end - 1 <= h < end}), len(day)))
    got = st.table_so_far(spark, f"{root}/out").select("job_id", "window_end", "seen_last_hour", "seen_last_day").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
