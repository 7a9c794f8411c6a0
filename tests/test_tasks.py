"""Task rules against step-by-step replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from placefold.functions.boxes import make_box
from placefold.functions.times import ntz
from placefold.operators import jobs, tasks
from placefold.operators import task_tree as tt

LOG = "shard_id bigint, seq bigint, event string, token string, error string"


def random_log(seed, shards=60, steps=14):
    """Claims only when the task is claimable; everything else at random."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for shard in range(shards):
        status, token, n = None, None, 0
        used = ["t0"]
        for _ in range(rng.randrange(1, steps)):
            seq += 1
            if status is None:
                event, tok, err = "create", None, None
            elif status in ("pending", "retry") and rng.random() < 0.6:
                n += 1
                event, tok, err = "claim", f"t{n}", None
                used.append(tok)
            else:
                event = rng.choice([*tasks.WRITES, "reclaim", "cancel"])
                tok = rng.choice(used[-2:]) if event in tasks.WRITES else None
                err = rng.choice([None, "", f"err{seq}"]) if event in tasks.WRITES else None
            rows.append((shard, seq, event, tok, err))
            status, token = step(status, token, event, tok)
    return rows


def step(status, token, event, tok):
    if event == "create":
        return "pending", None
    if event == "claim":
        return "running", tok
    if event == "reclaim":
        return ("retry", None) if status == "running" else (status, token)
    if event == "cancel":
        return ("canceled", token) if status in jobs.UNFINISHED else (status, token)
    return (event, None) if status == "running" and token == tok else (status, token)


def replay(rows):
    out = {}
    for shard, seq, event, tok, err in sorted(rows, key=lambda r: r[1]):
        status, token, attempts, error = out.get(shard, (None, None, 0, None))
        hit = event in tasks.WRITES and status == "running" and token == tok
        if hit and event == "done":
            error = None
        elif hit and event != "split":
            error = err
        elif event == "reclaim" and status == "running" and not error:
            error = tasks.RECLAIMED
        status, token = step(status, token, event, tok)
        out[shard] = (status, token, attempts + (event == "claim"), error)
    return {k: (v[0], v[2], v[3]) for k, v in out.items()}


def folded(frame):
    return {r.shard_id: (r.status, r.attempt_count, r.last_error) for r in frame.collect()}


def test_lifecycle_fold_equals_replay(spark):
    for seed in range(4):
        rows = random_log(seed)
        frame = spark.createDataFrame(rows, LOG).repartition(5)
        assert folded(tasks.lifecycle_fold(frame)) == replay(rows), seed


def test_lifecycle_digests_combine(spark):
    rows = random_log(11, shards=80)
    random.Random(3).shuffle(rows)
    cut = len(rows) // 3
    parts = [spark.createDataFrame(p, LOG) for p in (rows[:cut], rows[cut:])]
    marks = tasks.lifecycle_marks(parts[0]).unionByName(tasks.lifecycle_marks(parts[1]))
    assert folded(tasks.fold_marks(tasks.combine_marks(marks))) == replay(rows)


def test_next_per_job_prefers_pending_then_old_then_deep(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    shards = spark.createDataFrame(
        [
            (1, "a", "retry", 9, day(1), day(1)),
            (2, "a", "pending", 1, day(3), day(1)),
            (3, "a", "pending", 2, day(3), day(1)),
            (4, "a", "pending", 5, day(2), day(20)),
            (5, "b", "pending", 1, day(1), day(1)),
            (6, "c", "retry", 4, day(5), day(2)),
            (7, "d", "running", 4, day(5), day(2)),
        ],
        "id bigint, job_id string, status string, depth int, updated_at timestamp_ntz, next_run_at timestamp_ntz",
    )
    job_rows = spark.createDataFrame(
        [("a", "running", day(2), None, 0), ("b", "paused", day(1), None, 0),
         ("c", "running", day(1), day(9), 3), ("d", "running", day(1), None, 0)],
        "id string, status string, created_at timestamp_ntz, last_claimed_at timestamp_ntz, completed_shards bigint",
    )
    got = tasks.next_per_job(shards, job_rows, ntz("2024-01-10")).collect()
    assert [(r.job_id, r.shard_id) for r in got] == [("a", 3), ("c", 6)]


def test_attempt_outcomes_one_per_rule(spark):
    wide = (40.0, 0.0, 41.0, 1.0)
    small = (40.0, 0.0, 40.1, 0.1)
    tiny = (40.0, 0.0, 40.04, 0.04)
    base = dict(depth=3, box=small, raw_count=10, n_leads=5, attempt=1, error_code=None, error_name=None,
                error_message=None, http_status=None, failed=False, intersects=True, job_canceled=False)
    cases = [
        ("skipped", dict(intersects=False)),
        ("dropped", dict(job_canceled=True)),
        ("done", dict(raw_count=0, n_leads=0, box=wide)),
        ("split", dict(box=wide)),
        ("split", dict(raw_count=30)),
        ("done", dict()),
        ("done", dict(raw_count=30, box=tiny)),
        ("done", dict(depth=14, box=wide)),
        ("split", dict(failed=True, error_code="COARSE_LOCATION", job_canceled=True)),
        ("done", dict(failed=True, error_code="COARSE_LOCATION", box=tiny)),
        ("dropped", dict(failed=True, job_canceled=True)),
        ("split", dict(failed=True, http_status=429, attempt=2)),
        ("done", dict(failed=True, error_message="RATE limit", attempt=2, box=tiny)),
        ("retry", dict(failed=True, error_message="blocked", attempt=1)),
        ("retry", dict(failed=True, error_message="other", attempt=5)),
        ("split", dict(failed=True, error_message="other", attempt=6)),
        ("failed", dict(failed=True, error_message="other", attempt=6, box=tiny)),
    ]
    rows = []
    for i, (_, change) in enumerate(cases):
        c = {**base, **change}
        rows.append((i, c["depth"], *c["box"], c["raw_count"], c["n_leads"], c["attempt"], c["error_code"],
                     c["error_name"], c["error_message"], c["http_status"], c["failed"], c["intersects"], c["job_canceled"]))
    frame = spark.createDataFrame(
        rows,
        "shard_id int, depth int, south double, west double, north double, east double, raw_count bigint, n_leads int, "
        "attempt int, error_code string, error_name string, error_message string, http_status int, failed boolean, "
        "intersects boolean, job_canceled boolean",
    ).withColumn("bbox", make_box(*[F.col(c) for c in ("south", "west", "north", "east")]))
    got = {r.shard_id: r for r in tasks.attempt_outcomes(frame).collect()}
    assert [got[i].outcome for i in range(len(cases))] == [want for want, _ in cases]
    assert [i for i in got if got[i].exhaustive] == [6]
    assert got[14].retry_delay_s == 60 * 2**4


def test_job_without_tasks_and_leads_ends_failed(spark):
    counters = spark.createDataFrame(
        [("a", 0, 0, 0, 0), ("b", 4, 1, 0, 7), ("c", 4, 0, 1, 7), ("d", 3, 3, 0, 0), ("e", 2, 0, 0, 0)],
        "job_id string, total_shards bigint, failed_shards bigint, unfinished_shards bigint, lead_count bigint",
    )
    got = {r.job_id: r.final_status for r in jobs.final_status(counters).collect()}
    assert got == {"a": "failed", "b": "partial", "c": None, "d": "failed", "e": "completed"}


def test_stats_of_a_job_without_tasks(spark):
    when = dt.datetime(2024, 1, 1)
    job = spark.createDataFrame([("x", "running", when)], "id string, status string, updated_at timestamp_ntz")
    none = spark.createDataFrame(
        [], "id bigint, job_id string, status string, depth int, result_count int, attempt_count int, "
        "updated_at timestamp_ntz, next_run_at timestamp_ntz")
    row = jobs.job_shard_stats(job, none).first()
    assert (row.total_shards, row.paused_shards, row.max_depth, row.last_activity_at) == (0, 0, 0, when)


# --- task tree ------------------------------------------------------------


def test_ids_hold_the_place_in_the_tree(spark):
    rng = random.Random(2)
    rows, ids = [], [5, 0, tt.LARGEST_ROOT]
    parents = {i: None for i in ids}
    frame = spark.createDataFrame([(i,) for i in ids], "id bigint")
    for depth in range(14):
        made = frame.select("id", F.explode(F.array(*[F.lit(q) for q in range(4)])).alias("q")).select(
            F.col("id").alias("up"), tt.child_id(F.col("id"), F.col("q")).alias("id")).collect()
        for r in made:
            parents[r.id] = r.up
        ids = rng.sample([r.id for r in made], 3)
        rows += ids
        frame = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert len(set(parents)) == 3 + 14 * 12
    with pytest.raises(Exception, match="no id"):
        frame.select(tt.child_id(F.col("id"), F.lit(0))).collect()

    def line(i):
        return [i, *(line(parents[i]) if parents[i] is not None else [])]

    table = spark.createDataFrame([(i,) for i in parents], "id bigint")
    for r in table.select("id", tt.parent_id(F.col("id")).alias("up"), tt.ancestors(F.col("id")).alias("line"), tt.root_of(F.col("id")).alias("root"), tt.splits_above(F.col("id")).alias("n")).collect():
        assert (r.up, r.line, r.root, r.n) == (parents[r.id], line(r.id), line(r.id)[-1], len(line(r.id)) - 1)


def test_subtree_totals(spark):
    child = lambda i, q: tt.child_id(F.lit(i).cast("bigint"), F.lit(q))
    a, b = spark.range(1).select(child(7, 0), child(7, 3)).first()
    c = spark.range(1).select(child(b, 2)).first()[0]
    frame = spark.createDataFrame([(7, 1), (a, 10), (c, 100), (c, 1000), (8, 5), (None, 9)], "id bigint, n bigint")
    got = {r.id: (r.root_id, r.parent_id, r.splits, r.tasks, r.total) for r in tt.subtree_totals(frame, {"total": F.col("n")}).collect()}
    assert got == {7: (7, None, 0, 4, 1111), a: (7, 7, 1, 1, 10), b: (7, 7, 1, 2, 1100), c: (7, b, 2, 2, 1100), 8: (8, None, 0, 1, 5)}


def test_only_the_claim_that_holds_a_task_splits_it(spark):
    box = F.struct(*[F.lit(v).alias(n) for v, n in ((0.0, "south"), (0.0, "west"), (8.0, "north"), (8.0, "east"))])
    shards = spark.createDataFrame(
        [(1, "j", 0, "running", "t2"), (2, "j", 0, "running", "t1"), (3, "j", 0, "retry", "t1"), (4, "j", 0, "running", None)],
        "id bigint, job_id string, depth int, status string, run_token string",
    ).withColumn("bbox", box).withColumn("updated_at", ntz("2024-01-01"))
    writes = spark.createDataFrame([(1, "t1"), (2, "t1"), (2, "t1"), (3, "t1"), (4, None), (9, "t1")], "id bigint, token string")
    rows = tasks.apply_splits(tasks.owned_splits(shards, writes), F.col("splitting"), ntz("2024-01-02")).collect()
    assert {r.id for r in rows if r.status == "split"} == {2}
    assert len(rows) == 8 and all(r.id is not None for r in rows) and len({r.id for r in rows}) == 8
    assert {r.parent_id for r in rows if r.status == "pending"} == {2}
