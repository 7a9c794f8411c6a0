"""Golden rows against a sequential fold, whole and in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from placefold.operators import merge as m

SCHEMA = (
    "job_id string, dedupe_key string, seq bigint, place_id string, name string, website string, "
    "city string, review_count int, email string, review_rating double"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def sightings(n=3000, seed=5, hot=0.35):
    rng = random.Random(seed)
    rows = []
    for seq in rng.sample(range(n * 3), n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(300)}"
        maybe = lambda *values: rng.choice(values)
        rows.append(
            (
                maybe("a", "b") if key != "hot" else "a",
                key,
                seq,
                maybe(None, f"p{seq}"),
                maybe(None, "", f"n{seq}"),
                maybe(None, "", "", f"w{seq}"),
                maybe(None, "", f"c{seq}"),
                maybe(None, seq % 17),
                maybe(None, f"e{seq}"),
                maybe(None, float(seq)),
            )
        )
    return rows


def sequential(rows):
    """One sighting after the other, as an upsert would."""
    golden = {}
    for row in sorted(rows, key=lambda r: r[2]):
        new = dict(zip(COLUMNS, row))
        key = (new["job_id"], new["dedupe_key"])
        old = golden.get(key)
        if old is None:
            golden[key] = new
            continue
        for c in ("place_id", "review_rating"):
            old[c] = new[c] if new[c] is not None else old[c]
        old["name"] = new["name"]
        for c in ("website", "city"):
            old[c] = old[c] or new[c]
        counts = [v for v in (old["review_count"], new["review_count"]) if v is not None]
        old["review_count"] = max(counts, default=None)
    return {
        key: tuple(v for c, v in row.items() if c not in ("job_id", "dedupe_key", "seq"))
        for key, row in golden.items()
    }


def collected(frame):
    names = [c for c in COLUMNS if c not in ("job_id", "dedupe_key", "seq")]
    return {(r.job_id, r.dedupe_key): tuple(r[c] for c in names) for r in frame.collect()}


def test_merge_equals_sequential_upserts(spark):
    rows = sightings()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert collected(m.merge_listings(frame)) == sequential(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_combine_in_any_split_and_order(spark, seed):
    rows = sightings(seed=seed, n=1200)
    random.Random(seed).shuffle(rows)
    cuts = sorted(random.Random(seed + 9).sample(range(len(rows)), 4))
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    states = [m.fold_sightings(spark.createDataFrame(p, SCHEMA)) for p in pieces if p]
    left = states[0]
    for state in states[1:]:
        left = m.combine_states(left.unionByName(state))
    at_once = m.combine_states(
        states[0].unionByName(states[1]).unionByName(states[2]).unionByName(states[3]).unionByName(states[4])
    )
    expected = sequential(rows)
    assert collected(m.golden_rows(left)) == expected
    assert collected(m.golden_rows(at_once)) == expected


def test_only_asked_columns_are_shuffled(spark):
    frame = spark.createDataFrame(sightings(50), SCHEMA)
    merged = m.merge_listings(frame, columns=("name", "city"))
    assert set(merged.columns) == {"job_id", "dedupe_key", "name", "city"}
    assert "email" not in merged._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_latest_per_key_keeps_a_last_null(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 1)], "k string, v string, n int")
    got = {r.k: (r.v, r.n) for r in m.latest_per_key(log, "k", "v", "n").collect()}
    assert got == {"a": (None, 2), "b": ("y", 1)}


def test_coverage_shortcut_equals_coverage_of_golden_rows(spark):
    from placefold.operators.jobs import lead_coverage, lead_coverage_of_sightings

    frame = spark.createDataFrame(sightings(800), SCHEMA).withColumn("phone", F.col("city"))
    slow = lead_coverage(m.merge_listings(frame.withColumnRenamed("phone", "address")
                                          .withColumn("phone", F.col("city"))))
    fast = lead_coverage_of_sightings(frame)
    assert sorted(slow.collect()) == sorted(fast.collect())
