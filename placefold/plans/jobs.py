"""Statistics over jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ntz, plus_seconds
from ..operators import jobs as op
from ..operators.tasks import purge_expired, stale_jobs as find_stale
from ..sources.views import view, with_views
from .golden import GOLDEN
from .merges import golden_observations

SHARDS_AS_OF = "1998-07-01 00:00:00"
LISTINGS_AS_OF = "2024-01-30 00:00:00"


def lead_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lead_coverage_of_sightings(view(spark, sf_dir, "observations"))


def lead_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = golden_observations(spark, sf_dir, "created_at")
    # Half of the listings of the fixture are first seen in the first days.
    return op.lead_recency(leads, ntz("2024-01-02 00:00:00"))


def job_shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.job_shard_stats(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "shards"))


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The listings of one order class belong to a job that is not in the jobs
    # table, so that one job has tasks but no listings.
    owner = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unlisted").otherwise(F.col("o_orderpriority"))
    leads = (
        view(spark, sf_dir, "orders")
        .select(owner.alias("job_id"), "o_custkey")
        .distinct()
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("lead_count"))
    )
    return op.job_counters(view(spark, sf_dir, "jobs"), view(spark, sf_dir, "shards"), leads)


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir).drop("created_at", "updated_at")


def job_final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = view(spark, sf_dir, "customer_shards")
    jobs = shards.select(F.col("job_id").alias("id")).distinct()
    leads = (
        shards.where((F.col("status") == "done") & (F.col("result_count") > 0))
        .groupBy("job_id")
        .agg(F.count(F.lit(1)).alias("lead_count"))
    )
    return op.final_status(op.job_counters(jobs, shards, leads))


def job_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    terminal = op.task_totals(view(spark, sf_dir, "shards")).select("job_id", "terminal_shards")
    jobs = _counters(spark, sf_dir).join(terminal, "job_id", "left")
    jobs = jobs.withColumns(
        {
            "started_at": F.when(F.col("job_id") != "2-HIGH", plus_seconds(F.col("created_at"), 86400)),
            "finished_at": F.when(F.col("status").isin("completed", "partial"), F.col("updated_at")),
        }
    )
    return op.throughput(jobs, ntz(SHARDS_AS_OF)).select(
        "job_id", "reference_start", "finished_at", "elapsed_ms", "elapsed_hours",
        "leads_per_hour", "completed_shards_per_hour", "completion_percent",
    )


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_stale(view(spark, sf_dir, "shards"), ntz("1995-03-01 00:00:00"))


def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purge_expired(view(spark, sf_dir, "expiring"), ntz(LISTINGS_AS_OF))


_COUNTERS = """, t AS (SELECT job_id, count(*) AS total_shards, count(*) FILTER (status = 'done') AS completed_shards,
  count(*) FILTER (status = 'failed') AS failed_shards, count(*) FILTER (status IN ('pending', 'retry', 'running')) AS unfinished_shards,
  count(*) FILTER (status IN ('done', 'failed', 'split', 'skipped', 'canceled')) AS terminal_shards FROM shards GROUP BY job_id),
l AS (SELECT CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'unlisted' ELSE o_orderpriority END AS job_id, count(DISTINCT o_custkey) AS lead_count FROM orders GROUP BY 1),
c AS (SELECT j.id AS job_id, j.keyword, j.country, j.status, j.created_at, j.updated_at, coalesce(total_shards, 0) AS total_shards,
  coalesce(completed_shards, 0) AS completed_shards, coalesce(failed_shards, 0) AS failed_shards,
  coalesce(unfinished_shards, 0) AS unfinished_shards, coalesce(lead_count, 0) AS lead_count, coalesce(terminal_shards, 0) AS terminal_shards
  FROM jobs j LEFT JOIN t ON t.job_id = j.id LEFT JOIN l ON l.job_id = j.id)
"""

QUERIES = {
    "lead_coverage": (
        lead_coverage,
        with_views(
            "observations",
            GOLDEN
            + """SELECT job_id, count(*) AS leads, count(*) FILTER (coalesce(website, '') <> '') AS leads_with_website,
            count(*) FILTER (coalesce(phone, '') <> '') AS leads_with_phone FROM golden GROUP BY job_id""",
        ),
    ),
    "lead_recency": (
        lead_recency,
        with_views(
            "observations",
            GOLDEN
            + """SELECT job_id, count(*) FILTER (created_at >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 1 HOUR) AS leads_last_hour,
            count(*) FILTER (created_at >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 1 DAY) AS leads_last_day FROM golden GROUP BY job_id""",
        ),
    ),
    "job_shard_stats": (
        job_shard_stats,
        with_views(
            "jobs shards",
            """SELECT j.id AS job_id, count(s.id) AS total_shards, count(*) FILTER (s.status = 'pending') AS pending_shards,
              count(*) FILTER (s.status = 'retry') AS retry_shards, count(*) FILTER (s.status = 'running') AS running_shards,
              count(*) FILTER (s.status = 'done') AS done_shards, count(*) FILTER (s.status = 'failed') AS failed_shards,
              count(*) FILTER (s.status = 'split') AS split_shards, count(*) FILTER (s.status = 'skipped') AS skipped_shards,
              count(*) FILTER (s.status = 'canceled') AS canceled_shards,
              count(*) FILTER (s.status IN ('done', 'failed', 'split', 'skipped', 'canceled')) AS terminal_shards,
              CAST(coalesce(sum(s.result_count), 0) AS BIGINT) AS shard_result_count, CAST(coalesce(sum(s.attempt_count), 0) AS BIGINT) AS total_attempts,
              count(*) FILTER (j.status = 'paused' AND s.status IN ('pending', 'retry')) AS paused_shards,
              coalesce(max(s.depth), 0) AS max_depth, min(CASE WHEN s.status IN ('pending', 'retry') THEN s.next_run_at END) AS next_run_at,
              coalesce(max(s.updated_at), any_value(j.updated_at)) AS last_activity_at
            FROM jobs j LEFT JOIN shards s ON s.job_id = j.id GROUP BY j.id""",
        ),
    ),
    "job_counters": (
        job_counters,
        with_views(
            "jobs shards",
            _COUNTERS
            + """SELECT job_id, keyword, country, status, total_shards, completed_shards, failed_shards, unfinished_shards, lead_count FROM c""",
        ),
    ),
    "job_final_status": (
        job_final_status,
        with_views(
            "customer_shards",
            """, c AS (SELECT job_id, count(*) AS total_shards, count(*) FILTER (status = 'done') AS completed_shards,
              count(*) FILTER (status = 'failed') AS failed_shards, count(*) FILTER (status IN ('pending', 'retry', 'running')) AS unfinished_shards,
              count(*) FILTER (status = 'done' AND result_count > 0) AS lead_count FROM customer_shards GROUP BY job_id),
            f AS (SELECT *, CASE WHEN unfinished_shards > 0 THEN NULL WHEN lead_count = 0 AND failed_shards = total_shards THEN 'failed'
              WHEN failed_shards > 0 THEN 'partial' ELSE 'completed' END AS final_status FROM c)
            SELECT *, CASE final_status WHEN 'failed' THEN 'All shards failed.' WHEN 'partial' THEN 'Completed with failed shards.'
              WHEN 'completed' THEN 'Completed successfully.' END AS final_message FROM f""",
        ),
    ),
    "job_throughput": (
        job_throughput,
        with_views(
            "jobs shards",
            _COUNTERS
            + f""", d AS (SELECT *, CASE WHEN job_id <> '2-HIGH' THEN created_at + INTERVAL 1 DAY ELSE created_at END AS reference_start,
              CASE WHEN status IN ('completed', 'partial') THEN updated_at END AS finished_at FROM c),
            e AS (SELECT *, greatest(0, epoch_ms(CASE WHEN finished_at IS NOT NULL THEN finished_at WHEN status = 'paused' THEN updated_at
              ELSE TIMESTAMP '{SHARDS_AS_OF}' END) - epoch_ms(reference_start)) AS elapsed_ms FROM d)
            SELECT job_id, reference_start, finished_at, elapsed_ms, round(elapsed_ms / 3600000.0::DOUBLE, 2) AS elapsed_hours,
              CASE WHEN elapsed_ms > 0 THEN round(lead_count::DOUBLE / (elapsed_ms / 3600000.0::DOUBLE), 2) END AS leads_per_hour,
              CASE WHEN elapsed_ms > 0 THEN round(completed_shards::DOUBLE / (elapsed_ms / 3600000.0::DOUBLE), 2) END AS completed_shards_per_hour,
              CASE WHEN total_shards > 0 THEN round(terminal_shards::DOUBLE / total_shards::DOUBLE * 100, 2) ELSE 0 END AS completion_percent FROM e""",
        ),
    ),
    "stale_jobs": (
        stale_jobs,
        with_views(
            "shards",
            """SELECT DISTINCT job_id FROM shards WHERE status = 'running' AND updated_at <= TIMESTAMP '1995-03-01 00:00:00'""",
        ),
    ),
    "ttl_purge": (
        ttl_purge,
        with_views("expiring", f"SELECT * FROM expiring WHERE expires_at > TIMESTAMP '{LISTINGS_AS_OF}'"),
    ),
}
