"""Task tables: ranking, attempt outcomes, lifecycle, transitions, deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import can_split, quadrants, radius_m
from ..functions.joins import lookup_join
from ..functions.text import nonempty, null_if_empty
from ..functions.times import plus_seconds
from .jobs import RUNNABLE, TERMINAL_JOB, UNFINISHED
from .task_tree import child_id, parent_id

# What counts as being blocked or slowed down by the remote side.
BLOCKED_STATUS = (429, 403, 503, 504, 530)
BLOCKED_MESSAGE = r"(?i)timeout|rate.limit|blocked"
ABORT_NAME = "AbortError"
TIMEOUT_CODE = "SHARD_EXECUTION_TIMEOUT"
COARSE_CODE = "COARSE_LOCATION"

# Events of a task log.
WRITES = ("done", "retry", "failed", "split", "skipped")
RECLAIMED = "Recovered after running shard exceeded the stale timeout."


@dataclass(frozen=True)
class TaskLimits:
    """Fixed default values of the task rules."""

    max_depth: int = 14
    retry_limit: int = 6
    retry_base_s: int = 60
    split_threshold: int = 30
    target_radius_m: int = 25000
    min_width: float = 0.05
    min_height: float = 0.05


def due(as_of: Column) -> Column:
    return F.col("status").isin(*RUNNABLE) & (F.col("next_run_at") <= as_of)


def next_per_job(shards: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """The task each running job should take next, jobs in fair order.

    Within a job: pending before retry, oldest update, deepest, lowest id.
    The pick is a minimum over an ordering struct, so a job with a third of
    all tasks still shrinks to one row per input partition before the shuffle.
    Across jobs: least recently claimed first; shallow tasks first until the
    job has completed one, deep ones after that.
    """
    order = F.struct(
        F.when(F.col("status") == "pending", 0).otherwise(1).alias("tier"),
        F.col("updated_at"),
        (-F.col("depth")).alias("height"),
        F.col("id"),
        F.col("status"),
    )
    best = shards.where(due(as_of)).groupBy("job_id").agg(F.min(order).alias("best"))
    running = jobs.where(F.col("status") == "running").select(
        F.col("id").alias("job_id"),
        F.coalesce("last_claimed_at", "created_at").alias("waiting_since"),
        "completed_shards",
    )
    fresh = F.col("completed_shards") == 0
    return (
        best.join(running, "job_id")
        .select(
            "job_id",
            F.col("best.id").alias("shard_id"),
            F.col("best.status").alias("shard_status"),
            (-F.col("best.height")).alias("depth"),
            F.col("best.updated_at").alias("updated_at"),
            "waiting_since",
            "completed_shards",
        )
        .orderBy(
            "waiting_since",
            F.when(fresh, F.col("depth")).asc_nulls_first(),
            F.when(~fresh, F.col("depth")).desc_nulls_last(),
            "updated_at",
            "shard_id",
        )
    )


def is_blocked() -> Column:
    return F.coalesce(
        (F.col("error_name") == ABORT_NAME), F.lit(False)
    ) | F.coalesce(F.col("error_code") == TIMEOUT_CODE, F.lit(False)) | F.coalesce(
        F.col("http_status").isin(*BLOCKED_STATUS), F.lit(False)
    ) | F.coalesce(F.col("error_message").rlike(BLOCKED_MESSAGE), F.lit(False))


def backoff_seconds(attempt: Column, base_s: int = 60) -> Column:
    """Doubling delay: base, 2 base, 4 base, ..."""
    return F.lit(float(base_s)) * F.pow(F.lit(2.0), (attempt - 1).cast("double"))


def attempt_outcomes(attempts: DataFrame, limits: TaskLimits = TaskLimits()) -> DataFrame:
    """What an attempt leads to: skipped, dropped, done, split, retry or failed.

    ``keeps_leads`` says whether the listings it read are merged, and
    ``exhaustive`` whether all further result pages have to be read.
    """
    box = F.col("bbox")
    splittable = (F.col("depth") < limits.max_depth) & can_split(
        box, limits.min_width, limits.min_height
    )
    coarse = F.coalesce(F.col("error_code") == COARSE_CODE, F.lit(False))
    empty = (F.col("raw_count") <= 0) & (F.col("n_leads") == 0)
    dense = F.col("raw_count") >= limits.split_threshold
    tired = F.col("attempt") >= 2
    told = lambda name, otherwise: F.coalesce(F.col(name), F.lit(otherwise))
    facts = attempts.withColumns(
        {
            # A task without a country shape counts as inside it.
            "intersects": told("intersects", True),
            "failed": told("failed", False),
            "job_canceled": told("job_canceled", False),
            "raw_count": told("raw_count", 0),
        }
    ).withColumns(
        {
            "can_split": splittable,
            "radius_m": radius_m(box),
            "blocked": F.col("failed") & is_blocked(),
        }
    )
    split_or_done = F.when(F.col("can_split"), "split").otherwise("done")
    on_success = (
        F.when(F.col("job_canceled"), "dropped")
        .when(empty, "done")
        .when(F.col("can_split") & (F.col("radius_m") > limits.target_radius_m), "split")
        .when(F.col("can_split") & dense, "split")
        .otherwise("done")
    )
    on_error = (
        F.when(coarse, split_or_done)
        .when(F.col("job_canceled"), "dropped")
        .when(F.col("blocked") & tired, split_or_done)
        .when(F.col("attempt") < limits.retry_limit, "retry")
        .when(F.col("can_split"), "split")
        .otherwise("failed")
    )
    outcome = (
        F.when(~F.col("intersects"), "skipped").when(F.col("failed"), on_error).otherwise(on_success)
    )
    succeeded = F.col("intersects") & ~F.col("failed") & ~F.col("job_canceled")
    return facts.withColumn("outcome", outcome).withColumns(
        {
            "keeps_leads": succeeded & (F.col("n_leads") > 0),
            "exhaustive": succeeded & ~empty & ~F.col("can_split") & dense,
            "retry_delay_s": F.when(
                F.col("outcome") == "retry", backoff_seconds(F.col("attempt"), limits.retry_base_s)
            ),
        }
    )


def backoff_schedule(shards: DataFrame, limits: TaskLimits = TaskLimits()) -> DataFrame:
    """When each failed attempt may run again; exhausted tasks have no time."""
    again = (F.col("attempt_count") >= 1) & (F.col("attempt_count") < limits.retry_limit)
    delay = backoff_seconds(F.col("attempt_count"), limits.retry_base_s)
    return shards.withColumn("retry_delay_s", F.when(again, delay)).withColumn(
        "retry_at", plus_seconds(F.col("updated_at"), F.col("retry_delay_s"))
    )


def current_claims(log: DataFrame) -> DataFrame:
    """Latest claim of each task: shard_id, token, claimed_at."""
    claims = log.where(F.col("event") == "claim")
    return claims.groupBy("shard_id").agg(
        F.max_by("token", "seq").alias("token"), F.max("seq").alias("claimed_at")
    )


def owned_writes(log: DataFrame) -> DataFrame:
    """Writes made under the current claim of their task."""
    claims = current_claims(log).alias("c")
    writes = log.where(F.col("event").isin(*WRITES)).alias("w")
    owned = (
        (F.col("w.shard_id") == F.col("c.shard_id"))
        & (F.col("w.token") == F.col("c.token"))
        & (F.col("w.seq") > F.col("c.claimed_at"))
    )
    return writes.join(claims, owned, "left_semi")


def lifecycle_marks(log: DataFrame) -> DataFrame:
    """Mergeable digest of an event log: a row per claim, reclaim and cancel.

    A claim's row keeps the first write under its token.
    """
    alone = F.when(~F.col("event").isin("claim", *WRITES), F.col("seq"))
    write = F.struct(
        F.col("seq").alias("at"), F.col("event").alias("status"), F.col("error").alias("error")
    )
    return (
        log.withColumn("alone", alone)
        .withColumn("token", F.when(F.col("alone").isNull(), F.col("token")))
        .groupBy("shard_id", "token", "alone")
        .agg(
            F.max(F.when(F.col("event") == "claim", F.col("seq"))).alias("claim_at"),
            F.min(F.when(F.col("event").isin(*WRITES), write)).alias("write"),
            F.max(F.when(F.col("alone").isNotNull(), F.col("event"))).alias("lone_event"),
        )
    )


def combine_marks(marks: DataFrame) -> DataFrame:
    """Digests of several parts of one log as the digest of the whole."""
    return marks.groupBy("shard_id", "token", "alone").agg(
        F.max("claim_at").alias("claim_at"),
        F.min("write").alias("write"),
        F.max("lone_event").alias("lone_event"),
    )


def lifecycle_fold(log: DataFrame) -> DataFrame:
    """Current state of each task from its event log."""
    return fold_marks(lifecycle_marks(log))


def fold_marks(marks: DataFrame) -> DataFrame:
    """Current state of each task from the digest of its log.

    A write counts when it is the first under its token and no other claim,
    reclaim or cancel came between claim and write. A reclaim counts while the
    task runs, a cancel while it is unfinished. Only the digest's rows, a
    handful per task because attempts are limited, are ordered in a window.
    """
    kind = F.coalesce("lone_event", F.when(F.col("claim_at").isNotNull(), F.lit("claim")))
    marks = (
        marks.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "shard_id",
            F.coalesce("alone", "claim_at").alias("at"),
            "kind",
            F.when(F.col("write.at") > F.col("claim_at"), F.col("write")).alias("write"),
        )
    )
    in_order = Window.partitionBy("shard_id").orderBy("at")
    before = F.lag(F.struct("kind", "write")).over(in_order)
    still_running = (F.col("before.kind") == "claim") & (
        F.col("before.write").isNull() | (F.col("before.write.at") > F.col("at"))
    )
    effective = (
        marks.withColumn("before", before)
        .where((F.col("kind") != "reclaim") | F.coalesce(still_running, F.lit(False)))
        .withColumn("before", before)
    )
    finished_before = (
        (F.col("before.kind") == "cancel")
        | (
            (F.col("before.kind") == "claim")
            & (F.col("before.write.at") < F.col("at"))
            & (F.col("before.write.status") != "retry")
        )
    )
    effective = effective.where(
        (F.col("kind") != "cancel") | ~F.coalesce(finished_before, F.lit(False))
    ).withColumn("ends_at", F.lead("at").over(in_order))
    valid = F.col("write").isNotNull() & (
        F.col("ends_at").isNull() | (F.col("write.at") < F.col("ends_at"))
    )
    status = (
        F.when(F.col("kind") == "reclaim", "retry")
        .when(F.col("kind") == "cancel", "canceled")
        .when(F.col("kind") == "create", "pending")
        .when(F.col("valid"), F.col("write.status"))
        .otherwise("running")
    )
    sets_error = F.col("valid") & (F.col("write.status") != "split")
    error_at = F.when(sets_error, F.col("write.at"))
    error = F.when(F.col("write.status") != "done", F.col("write.error"))
    folded = (
        effective.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .groupBy("shard_id")
        .agg(
            F.max_by(status, "at").alias("status"),
            F.count_if(F.col("kind") == "claim").alias("attempt_count"),
            F.max_by(F.struct(error.alias("text")), error_at).getField("text").alias("error"),
            F.max(error_at).alias("error_at"),
            F.max(F.when(F.col("kind") == "reclaim", F.col("at"))).alias("reclaimed_at"),
            F.max(
                F.greatest(F.col("at"), F.when(F.col("valid"), F.col("write.at")))
            ).alias("updated_seq"),
        )
    )
    reclaimed_later = F.col("reclaimed_at") > F.coalesce("error_at", F.lit(-1))
    return folded.select(
        "shard_id",
        "status",
        "attempt_count",
        F.coalesce(
            null_if_empty(F.col("error")), F.when(reclaimed_later, F.lit(RECLAIMED)), "error"
        ).alias("last_error"),
        "updated_seq",
    )


def job_lifecycle_fold(log: DataFrame) -> DataFrame:
    """Current state of each job from its event log, by partial aggregates only.

    Events: created, seeded, paused, resumed, canceled, failed and finalized
    (which carries the final ``status`` and may carry artifact paths). Resuming
    a job that was never seeded puts it back in the queue.
    """
    seq, event = F.col("seq"), F.col("event")
    seeded_at = F.min(F.when(event == "seeded", seq))
    folded = log.groupBy("job_id").agg(
        F.max_by(F.struct("event", "status", "message", seq.alias("at")), seq).alias("last"),
        F.min(F.when(event == "created", F.col("ts"))).alias("created_at"),
        F.min_by("ts", F.when(event == "seeded", seq)).alias("started_at"),
        seeded_at.alias("seeded_at"),
        F.max_by("ts", F.when(event.isin("canceled", "failed", "finalized"), seq)).alias("finished_at"),
        F.max_by("artifact", F.when(F.col("artifact").isNotNull(), seq)).alias("artifact"),
        F.max_by("ts", seq).alias("updated_at"),
    )
    last = F.col("last.event")
    started = F.coalesce(F.col("seeded_at") < F.col("last.at"), F.lit(False))
    status = (
        F.when(last == "created", "pending")
        .when(last == "seeded", "running")
        .when(last == "resumed", F.when(started, "running").otherwise("pending"))
        .when(last == "finalized", F.col("last.status"))
        .otherwise(last)
    )
    message = (
        F.when(F.col("status") == "pending", "Queued")
        .when(F.col("status") == "running", "Running")
        .when(last == "paused", "Paused by operator.")
        .when(last == "canceled", "Canceled")
        .otherwise(F.col("last.message"))
    )
    return folded.withColumn("status", status).withColumn("message", message).drop("last", "seeded_at")


def stale(cutoff: Column) -> Column:
    return (F.col("status") == "running") & (F.col("updated_at") <= cutoff)


def stale_jobs(shards: DataFrame, cutoff: Column) -> DataFrame:
    """Jobs with a task that has been running since before the cut-off."""
    return shards.where(stale(cutoff)).select("job_id").distinct()


def reclaim_stale(shards: DataFrame, cutoff: Column, as_of: Column) -> DataFrame:
    """The task table after stalled tasks went back to retry."""
    hit = stale(cutoff)
    message = F.when(nonempty(F.col("last_error")), F.col("last_error")).otherwise(F.lit(RECLAIMED))
    change = lambda name, value: F.when(hit, value).otherwise(F.col(name))
    return shards.withColumns(
        {
            "last_error": change("last_error", message),
            "next_run_at": change("next_run_at", as_of),
            "updated_at": change("updated_at", as_of),
            "status": change("status", F.lit("retry")),
        }
    )


def cancel_transition(shards: DataFrame, canceled_jobs: DataFrame, as_of: Column) -> DataFrame:
    """The task table after its jobs in ``canceled_jobs`` (job_id) were canceled."""
    marks = canceled_jobs.select("job_id").distinct().withColumn("_canceled", F.lit(True))
    hit = F.col("_canceled").isNotNull() & F.col("status").isin(*UNFINISHED)
    return (
        lookup_join(shards, marks, ["job_id"], spread_nulls=F.col("id"))
        .withColumns(
            {
                "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
                "status": F.when(hit, F.lit("canceled")).otherwise(F.col("status")),
            }
        )
        .drop("_canceled")
    )


def deletable(jobs: DataFrame) -> DataFrame:
    """Jobs that may be deleted: only those that have ended."""
    return jobs.where(F.col("status").isin(*TERMINAL_JOB))


def cascade_delete(child: DataFrame, jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows of a child table left after deleting the requested ended jobs."""
    gone = deletable(jobs).join(requested, "id", "left_semi").select(F.col("id").alias("job_id"))
    return lookup_join(child, gone, ["job_id"], how="left_anti")


def purge_expired(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.where(F.col("expires_at") > as_of)


def owned_splits(shards: DataFrame, writes: DataFrame) -> DataFrame:
    """``shards`` with ``splitting``: a split was written under the task's current claim.

    ``writes`` has id and token; a write under another token than the task's
    ``run_token`` comes from a worker that lost the task and changes nothing.
    """
    asked = writes.select("id", F.col("token").alias("_token")).distinct()
    mine = asked.join(shards.select("id", "run_token", "status"), "id").where(
        (F.col("status") == "running") & (F.col("run_token") == F.col("_token"))
    )
    marks = mine.select("id").distinct().withColumn("_split", F.lit(True))
    return shards.join(marks, "id", "left").withColumn("splitting", F.col("_split").isNotNull()).drop("_split")


def apply_splits(shards: DataFrame, splitting: Column, as_of: Column) -> DataFrame:
    """The task table after the rows under ``splitting`` were split.

    One pass: each split row becomes itself with status 'split' and its four
    pending children. A child's id holds its place in the tree (see
    ``task_tree``), so children can be ranked, claimed and split again.
    """
    now = as_of
    kind = shards.schema["id"].dataType
    own = F.struct(
        F.col("id").alias("id"),
        parent_id(F.col("id")).cast(kind).alias("parent_id"),
        F.col("bbox").alias("bbox"),
        F.col("depth").alias("depth"),
        F.when(splitting, F.lit("split")).otherwise(F.col("status")).alias("status"),
        F.when(splitting, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    children = F.transform(
        quadrants(F.col("bbox")),
        lambda box, i: F.struct(
            child_id(F.col("id"), i).cast(kind).alias("id"),
            F.col("id").alias("parent_id"),
            box.alias("bbox"),
            (F.col("depth") + 1).alias("depth"),
            F.lit("pending").alias("status"),
            now.alias("updated_at"),
        ),
    )
    rows = F.when(splitting, F.concat(F.array(own), children)).otherwise(F.array(own))
    return shards.select("job_id", F.explode(rows).alias("row")).select("job_id", "row.*")
