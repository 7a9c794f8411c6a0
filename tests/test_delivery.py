"""Exports and delivery state."""

import csv
import datetime as dt
import glob
import json

import pytest

from placefold.functions.times import ntz
from placefold.operators import delivery, paging, sync

DAY = dt.datetime(2024, 1, 1)


def leads(spark):
    rows = [
        (3, "j2", "k3", 'Quote "me"', "A,B", ["x", "y"], None, 4.5),
        (1, "j1", "k1", "Plain", None, [], "line\nbreak", None),
        (2, "j1", "k2", None, "", None, " padded ", 3.0),
    ]
    return spark.createDataFrame(
        rows, "id bigint, job_id string, dedupe_key string, name string, city string, "
        "categories array<string>, address string, review_rating double")


def jobs(spark):
    return spark.createDataFrame(
        [("j1", "plumber", "us", "running", None), ("j2", "cafe", "au", "completed", "Australia")],
        "id string, keyword string, country string, status string, country_name string")


def test_csv_export_reads_back(spark, tmp_path):
    rows = delivery.export_rows(leads(spark), jobs(spark), "directory", "id").orderBy("id").drop("id")
    delivery.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv/part-*.csv"))[0], newline="") as f:
        read = list(csv.reader(f))
    assert read[0] == list(delivery.EXPORT_FIELDS)
    by = [dict(zip(read[0], r)) for r in read[1:]]
    assert [r["query_name"] for r in by] == ["plumber", "plumber", "cafe"]
    assert [r["name"] for r in by] == ["Plain", "", 'Quote "me"']
    assert [r["address"] for r in by] == ["line\nbreak", " padded ", ""]
    assert [r["categories"] for r in by] == ["", "", "x | y"]


def test_json_export_is_camel_case_with_nulls(spark, tmp_path):
    rows = delivery.export_rows(leads(spark), jobs(spark), "directory")
    delivery.write_json(rows, str(tmp_path / "json"))
    found = [json.loads(x) for p in glob.glob(str(tmp_path / "json/part-*")) for x in open(p)]
    assert len(found) == 3 and all(list(r) == list(delivery.EXPORT_FIELDS.values()) for r in found)
    plain = next(r for r in found if r["name"] == "Plain")
    assert plain["queryName"] == "plumber" and plain["stateRegion"] is None and plain["reviewRating"] is None


def test_exports_per_job_are_ordered(spark, tmp_path):
    delivery.write_exports(leads(spark), jobs(spark), "directory", str(tmp_path))
    files = sorted(glob.glob(str(tmp_path / "json/job_id=j1/part-*")))
    names = [json.loads(x)["name"] for p in files for x in open(p)]
    assert names == ["Plain", None]
    assert glob.glob(str(tmp_path / "csv/job_id=j2/part-*"))


def test_records_keep_only_known_fields(spark):
    some = delivery.available_names([{"title": "name"}, {"column_name": "job_id", "title": "Job"}, {"name": "review_rating"}])
    assert some == {"name", "job_id", "Job", "review_rating"}
    frame = delivery.delivery_records(leads(spark), jobs(spark), "directory", some)
    assert frame.columns == ["job_id", "name", "review_rating"]
    assert set(delivery.missing_fields(delivery.RECORD_FIELDS, some)) == set(delivery.RECORD_FIELDS) - some


def test_record_fallbacks(spark):
    got = {r.name: r for r in delivery.delivery_records(leads(spark), jobs(spark), "directory").collect()}
    assert set(got) == {"Plain", "", 'Quote "me"'}
    assert got["Plain"].country_name == "us" and got['Quote "me"'].country_name == "Australia"
    assert got[""].categories_json == "[]" and got["Plain"].source_bbox_json == "null" and got["Plain"].raw_json == "{}"
    assert len(got["Plain"]) == 33


def test_conform_and_evolution(spark):
    old = spark.createDataFrame([(1, "a")], "id int, name string")
    new = spark.createDataFrame([(2, "b", 5)], "id int, name string, extra int")
    whole = delivery.union_evolved(old, new)
    assert sorted(map(tuple, whole.collect())) == [(1, "a", None), (2, "b", 5)]
    shaped = delivery.conform(whole, {"id": "bigint", "city": "string"})
    assert shaped.dtypes == [("id", "bigint"), ("city", "string")]
    assert delivery.conform(whole, {"id": "bigint"}, keep_extra=True).columns == ["id", "name", "extra"]


def test_masked_config(spark):
    config = spark.createDataFrame([("u", "t"), ("v", "")], "base string, api_token string")
    rows = delivery.mask_secret(config, "api_token")
    assert rows.columns == ["base", "has_api_token"] and [r.has_api_token for r in rows.orderBy("base").collect()] == [True, False]


RUNS = "job_id string, seq bigint, ts timestamp_ntz, event string, last_id bigint, synced bigint, message string"


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def state(spark):
    runs = [
        ("a", 1, at(0), "started", None, None, None),
        ("a", 2, at(1), "success", 10, 10, "Synced 10"),
        ("a", 3, at(2), "started", None, None, None),
        ("a", 4, at(3), "failed", None, None, "HTTP 500"),
        ("b", 5, at(4), "success", 3, 3, "Synced 3"),
        ("b", 6, at(5), "success", 9, 6, "Synced 6"),
        ("c", 7, at(6), "started", None, None, None),
    ]
    return sync.sync_state_fold(spark.createDataFrame(runs, RUNS))


def test_sync_state(spark):
    got = {r.job_id: r for r in state(spark).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.last_synced_id, a.last_synced_at, a.last_status, a.last_message) == (10, at(1), "failed", "HTTP 500")
    assert (a.last_started_at, a.last_finished_at, a.synced_record_count) == (at(2), at(3), 10)
    assert (b.last_synced_id, b.synced_record_count, b.last_started_at) == (9, 9, at(4))
    assert (c.last_synced_id, c.last_status, c.last_finished_at, c.synced_record_count) == (0, "running", None, 0)


def test_due_jobs_honour_the_interval(spark):
    job_rows = spark.createDataFrame(
        [("a", "running", at(-60), at(-50)), ("b", "running", at(-60), at(-50)), ("c", "running", at(-60), at(-50)),
         ("d", "running", at(-60), None), ("e", "paused", at(-60), at(-50))],
        "id string, status string, updated_at timestamp_ntz, started_at timestamp_ntz")
    found = [(j, i, f"{j}{i}", at(i)) for j in "acde" for i in (9, 10, 11, 12)]
    lead_rows = spark.createDataFrame(found, "job_id string, id bigint, dedupe_key string, updated_at timestamp_ntz")
    view = sync.sync_overview(job_rows, lead_rows, state(spark), 30).cache()
    got = {r.job_id: (r.unsynced, r.next_due_at) for r in view.collect()}
    assert got == {"a": (2, at(31)), "b": (0, None), "c": (4, None), "d": (4, at(-30)), "e": (4, None)}
    assert [r.job_id for r in sync.sync_due(view, ntz(str(at(30)))).collect()] == ["d"]
    assert sorted(r.job_id for r in sync.sync_due(view, ntz(str(at(31)))).collect()) == ["a", "d"]
    behind = sync.undelivered(lead_rows, state(spark)).groupBy("job_id").count().collect()
    assert {r.job_id: r["count"] for r in behind} == {"a": 2, "c": 4, "d": 4, "e": 4}
    changed = sync.changed_since(lead_rows, state(spark)).where("job_id = 'a'").collect()
    assert sorted(r.id for r in changed) == [9, 10, 11, 12]


def test_pages_have_no_hidden_maximum(spark):
    frame = spark.range(2000)
    assert [r.id for r in paging.page_of(frame, [frame.id], limit=-5, offset=-1).collect()] == [0]
    assert paging.page_of(frame, [frame.id], limit=5000).count() == 2000
    with pytest.raises(ValueError):
        paging.page_of(frame, [frame.id], limit=5000, max_rows=1000)
    assert [r.id for r in paging.after_id(frame, 1997, limit=10).collect()] == [1998, 1999]
    assert paging.after_id(frame, 1997).count() == 2


def test_page_prefix_stops_at_the_first_short_page(spark):
    rows = [(1, p, 30) for p in range(1, 13)] + [(2, 1, 30), (2, 2, 5), (2, 3, 30), (3, 1, 0), (3, 2, 30)]
    pages = spark.createDataFrame(rows, "query_id int, page int, n_results int")
    got = {}
    for r in paging.full_page_prefix(pages).collect():
        got.setdefault(r.query_id, []).append(r.page)
    assert {k: sorted(v) for k, v in got.items()} == {1: list(range(1, 11)), 2: [1, 2], 3: [1]}


def test_batch_delivery_moves_the_cursor_and_can_be_forced(spark):
    from placefold.operators import sending
    from placefold.workspace import fresh_dir

    all_leads, all_jobs = leads(spark), jobs(spark)
    root = fresh_dir(spark, "sending")
    out, log, now = f"{root}/out", f"{root}/log", ntz("2024-02-01 00:00:00")
    total = all_leads.join(all_jobs.select(all_jobs.id.alias("job_id")), "job_id").count()
    count = lambda n: spark.read.parquet(f"{out}/{n}").count()
    first = sending.deliver(all_leads, all_jobs, "directory", out, log, now)
    assert count(first) == total > 0
    state = sync.sync_state_fold(sending.delivery_log(spark, log))
    assert state.agg({"synced_record_count": "sum"}).first()[0] == total
    assert count(sending.deliver(all_leads, all_jobs, "directory", out, log, now)) == 0
    top = all_leads.orderBy("id", ascending=False).limit(1)
    newer = all_leads.unionByName(top.withColumn("id", top.id + 100))
    third = sending.deliver(newer, all_jobs, "directory", out, log, now)
    assert count(third) == 1
    assert count(sending.deliver(all_leads, all_jobs, "directory", out, log, now, force=True)) == total
    # Sending all again moved no cursor back.
    assert count(sending.deliver(newer, all_jobs, "directory", out, log, now)) == 0


def test_change_sets_turn_the_old_state_into_the_new(spark):
    schema = "job_id string, dedupe_key string, name string, n int, at timestamp_ntz"
    day = dt.datetime(2024, 1, 1)
    old = [("a", "1", "x", 1, day), ("a", "2", None, 2, day), ("a", "3", "", 3, None), ("b", "1", "gone", 4, day), ("a", "5", "same", None, day)]
    new = [("a", "1", "x", 2, day), ("a", "2", "", 2, day), ("a", "3", "", 3, day), ("a", "4", "new", 1, None), ("a", "5", "same", None, day)]
    before, after = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    key = ("job_id", "dedupe_key")
    changes = sync.change_set(before, after, key)
    assert sorted((r.change, r.job_id, r.dedupe_key) for r in changes.collect()) == [
        ("delete", "b", "1"), ("insert", "a", "4"), ("update", "a", "1"), ("update", "a", "2"), ("update", "a", "3"),
    ]
    done = sync.apply_changes(before, changes, key)
    assert sorted(map(str, done.collect())) == sorted(map(str, after.collect()))
    assert sync.change_set(done, after, key).count() == 0
    assert sync.change_set(before.limit(0), after, key).select("change").distinct().collect()[0][0] == "insert"
    assert sync.change_set(before, after.limit(0), key).where("name IS NULL AND change = 'delete'").count() == 5
