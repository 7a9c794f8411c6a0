"""Delivery state: cursors, undelivered rows, due times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup_join


def sync_state_fold(runs: DataFrame) -> DataFrame:
    """State per job from the log of delivery runs (started, success, failed).

    A success moves the cursor and adds to the delivered count, a failure
    keeps both, a start clears the finish time.
    """
    seq, event = F.col("seq"), F.col("event")
    success = F.when(event == "success", seq)
    started = F.when(event == "started", seq)
    # Fixed value: the message while a delivery runs.
    message = F.when(event == "started", F.lit("Sync in progress.")).otherwise(F.col("message"))
    status = F.when(event == "started", F.lit("running")).otherwise(event)
    first_ts = F.min_by("ts", seq)
    return runs.groupBy("job_id").agg(
        F.coalesce(F.max_by("last_id", success), F.lit(0).cast("bigint")).alias("last_synced_id"),
        F.max_by("ts", success).alias("last_synced_at"),
        F.max_by(status, seq).alias("last_status"),
        F.max_by(message, seq).alias("last_message"),
        # Without any start the first run's own time stands in.
        F.coalesce(F.max_by("ts", started), first_ts).alias("last_started_at"),
        F.max_by(F.when(event != "started", F.col("ts")), seq).alias("last_finished_at"),
        F.coalesce(F.sum(F.when(event == "success", F.col("synced"))), F.lit(0).cast("bigint")).alias(
            "synced_record_count"
        ),
    )


def state_with_defaults(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Every job with its delivery state; idle and cursor 0 without one."""
    zero = F.lit(0).cast("bigint")
    return (
        jobs.withColumnRenamed("id", "job_id")
        .join(state, "job_id", "left")
        .withColumns(
            {
                "last_synced_id": F.coalesce("last_synced_id", zero),
                "last_status": F.coalesce("last_status", F.lit("idle")),
                "synced_record_count": F.coalesce("synced_record_count", zero),
            }
        )
    )


def undelivered(leads: DataFrame, state: DataFrame) -> DataFrame:
    """Listings behind their job's cursor."""
    cursor = state.select("job_id", "last_synced_id")
    behind = F.col("id") > F.coalesce("last_synced_id", F.lit(0))
    return (
        lookup_join(leads, cursor, ["job_id"], spread_nulls=F.col("id")).where(behind).drop("last_synced_id")
    )


def changed_since(leads: DataFrame, state: DataFrame) -> DataFrame:
    """Listings that are new or were updated after their job's last delivery.

    The cursor alone never delivers a later change to a delivered listing.
    """
    cursor = state.select("job_id", "last_synced_id", "last_synced_at")
    new = F.col("id") > F.coalesce("last_synced_id", F.lit(0))
    changed = F.col("last_synced_at").isNull() | (F.col("updated_at") > F.col("last_synced_at"))
    return (
        lookup_join(leads, cursor, ["job_id"], spread_nulls=F.col("id"))
        .where(new | changed)
        .drop("last_synced_id", "last_synced_at")
    )


def next_due(interval_minutes: int) -> Column:
    """Next delivery time of a job with state and undelivered count."""
    reference = F.coalesce("last_synced_at", "started_at", "updated_at")
    waiting = (
        (F.col("status") == "running")
        & (F.col("last_status") != "running")
        & (F.col("unsynced") > 0)
        & F.lit(interval_minutes > 0)
    )
    return F.when(waiting, reference + F.make_dt_interval(mins=F.lit(interval_minutes)))


def sync_overview(
    jobs: DataFrame, leads: DataFrame, state: DataFrame, interval_minutes: int
) -> DataFrame:
    """Every job's delivery state, undelivered count and next due time."""
    counts = undelivered(leads, state).groupBy("job_id").agg(F.count(F.lit(1)).alias("unsynced"))
    return (
        state_with_defaults(jobs, state)
        .join(counts, "job_id", "left")
        .withColumn("unsynced", F.coalesce("unsynced", F.lit(0).cast("bigint")))
        .withColumn("next_due_at", next_due(interval_minutes))
    )


def sync_due(overview: DataFrame, as_of: Column) -> DataFrame:
    """Jobs whose delivery is due: running, idle sink, rows waiting, time passed."""
    return overview.where(F.col("next_due_at") <= as_of)


def row_digest(rows: DataFrame, key: tuple[str, ...]) -> Column:
    """128 bits over all columns but the key; null and '' differ."""
    each = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in rows.columns if c not in key]
    return F.md5(F.concat_ws("\x1f", *each))


def change_set(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """What turns ``before`` into ``after``: rows with ``change`` insert, update or delete.

    Both sides go through the full join as key and digest only; the rows of
    inserts and updates are fetched by key afterwards. A delete has the key and
    nulls. A key must be unique and not null on either side; equal rows give
    nothing, so sending a change set again after it was applied sends nothing.
    """
    keys = list(key)
    old = before.select(*keys, row_digest(before, key).alias("_old"))
    new = after.select(*keys, row_digest(after, key).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") != F.col("_new"), "update")
    )
    marks = old.join(new, keys, "full").select(*keys, change.alias("change")).where(F.col("change").isNotNull())
    return marks.join(after, keys, "left").select("change", *after.columns)


def apply_changes(before: DataFrame, changes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``before`` after the changes: touched keys go, inserted and updated rows come."""
    kept = before.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes.where(F.col("change") != "delete").select(*before.columns))
