"""Statistics over jobs, their tasks and their listings.

All of them answer for every job in one grouped pass. Facts are aggregated to
one row per job before any join, so the size of a job does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty
from ..functions.times import millis_between, round_places

# Task and job statuses.
TASK_STATUSES = ("pending", "retry", "running", "done", "failed", "split", "skipped", "canceled")
RUNNABLE = ("pending", "retry")
UNFINISHED = ("pending", "retry", "running")
TERMINAL_TASK = ("done", "failed", "split", "skipped", "canceled")
TERMINAL_JOB = ("completed", "partial", "failed", "canceled")


def _is(*statuses: str) -> Column:
    return F.col("status").isin(*statuses)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name)


def task_totals(shards: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_shards") for s in TASK_STATUSES]
    return shards.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_shards"),
        *counts,
        F.count_if(_is(*TERMINAL_TASK)).alias("terminal_shards"),
        F.sum("result_count").alias("shard_result_count"),
        F.sum("attempt_count").alias("total_attempts"),
        F.max("depth").alias("max_depth"),
        F.min(F.when(_is(*RUNNABLE), F.col("next_run_at"))).alias("next_run_at"),
        F.max("updated_at").alias("last_activity_at"),
    )


TOTAL_COUNTS = (
    "total_shards",
    *(f"{s}_shards" for s in TASK_STATUSES),
    "terminal_shards",
    "shard_result_count",
    "total_attempts",
)


def job_shard_stats(jobs: DataFrame, shards: DataFrame) -> DataFrame:
    """Task counts of every job; jobs without tasks get zeros.

    ``paused_shards`` overlaps pending and retry: it is their sum while the
    job is paused.
    """
    joined = jobs.join(task_totals(shards).withColumnRenamed("job_id", "id"), "id", "left")
    runnable = F.coalesce(F.col("pending_shards") + F.col("retry_shards"), F.lit(0).cast("bigint"))
    return joined.select(
        F.col("id").alias("job_id"),
        *[_zero(name) for name in TOTAL_COUNTS],
        F.when(F.col("status") == "paused", runnable)
        .otherwise(F.lit(0).cast("bigint"))
        .alias("paused_shards"),
        F.coalesce("max_depth", F.lit(0)).alias("max_depth"),
        "next_run_at",
        F.coalesce("last_activity_at", "updated_at").alias("last_activity_at"),
    )


def lead_coverage(leads: DataFrame) -> DataFrame:
    """Listings with a website and with a phone, per job."""
    return leads.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("leads"),
        F.count_if(nonempty(F.col("website"))).alias("leads_with_website"),
        F.count_if(nonempty(F.col("phone"))).alias("leads_with_phone"),
    )


def lead_coverage_of_sightings(sightings: DataFrame) -> DataFrame:
    """Coverage of the golden rows without building them.

    A golden website (first non-empty policy) is filled exactly when some
    sighting's is, so two booleans per key replace the texts in the shuffle.
    """
    keys = sightings.groupBy("job_id", "dedupe_key").agg(
        F.bool_or(nonempty(F.col("website"))).alias("website"),
        F.bool_or(nonempty(F.col("phone"))).alias("phone"),
    )
    return keys.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("leads"),
        F.count_if("website").alias("leads_with_website"),
        F.count_if("phone").alias("leads_with_phone"),
    )


def lead_recency(leads: DataFrame, as_of: Column) -> DataFrame:
    """Listings created in the last hour and the last day before ``as_of``."""
    made = F.col("created_at")
    return leads.groupBy("job_id").agg(
        F.count_if(made >= as_of - F.expr("INTERVAL 1 HOUR")).alias("leads_last_hour"),
        F.count_if(made >= as_of - F.expr("INTERVAL 1 DAY")).alias("leads_last_day"),
    )


def job_counters(jobs: DataFrame, shards: DataFrame, lead_counts: DataFrame) -> DataFrame:
    """Counters kept on a job: tasks by outcome and listings.

    ``lead_counts`` has one row per job (job_id, lead_count).
    """
    tasks = shards.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_shards"),
        F.count_if(F.col("status") == "done").alias("completed_shards"),
        F.count_if(F.col("status") == "failed").alias("failed_shards"),
        F.count_if(_is(*UNFINISHED)).alias("unfinished_shards"),
    )
    counters = ("total_shards", "completed_shards", "failed_shards", "unfinished_shards")
    return (
        jobs.withColumnRenamed("id", "job_id")
        .join(tasks, "job_id", "left")
        .join(lead_counts, "job_id", "left")
        .select(
            "job_id",
            *[c for c in jobs.columns if c != "id" and c not in (*counters, "lead_count")],
            *[_zero(c) for c in (*counters, "lead_count")],
        )
    )


def final_status(counters: DataFrame) -> DataFrame:
    """Status a job ends with once nothing is unfinished, null before that.

    A job without any task and listing counts as failed.
    """
    nothing = (F.col("lead_count") == 0) & (F.col("failed_shards") == F.col("total_shards"))
    ended = (
        F.when(nothing, F.lit("failed"))
        .when(F.col("failed_shards") > 0, F.lit("partial"))
        .otherwise(F.lit("completed"))
    )
    # The messages that go with a status.
    message = (
        F.when(F.col("final_status") == "failed", F.lit("All shards failed."))
        .when(F.col("final_status") == "partial", F.lit("Completed with failed shards."))
        .when(F.col("final_status") == "completed", F.lit("Completed successfully."))
    )
    return counters.withColumn(
        "final_status", F.when(F.col("unfinished_shards") == 0, ended)
    ).withColumn("final_message", message)


def throughput(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Elapsed time, hourly rates and completion of jobs with counters.

    ``jobs`` has status, created_at, started_at, updated_at, finished_at,
    lead_count, completed_shards, terminal_shards and total_shards.
    """
    start = F.coalesce("started_at", "created_at")
    ended = F.col("finished_at").isNotNull() & F.col("status").isin(*TERMINAL_JOB)
    end = (
        F.when(ended, F.col("finished_at"))
        .when(F.col("status") == "paused", F.col("updated_at"))
        .otherwise(as_of)
    )
    elapsed = F.greatest(F.lit(0).cast("bigint"), millis_between(start, end))
    hours = F.col("elapsed_ms") / F.lit(3600000.0)
    per_hour = lambda n: F.when(
        F.col("elapsed_ms") > 0, round_places(F.try_divide(F.col(n).cast("double"), hours))
    )
    ratio = F.col("terminal_shards").cast("double") / F.col("total_shards").cast("double")
    return (
        jobs.withColumns({"reference_start": start, "elapsed_ms": elapsed})
        .withColumns(
            {
                "elapsed_hours": round_places(hours),
                "leads_per_hour": per_hour("lead_count"),
                "completed_shards_per_hour": per_hour("completed_shards"),
                "completion_percent": F.when(
                    F.col("total_shards") > 0, round_places(ratio * F.lit(100.0))
                ).otherwise(F.lit(0.0)),
            }
        )
    )
