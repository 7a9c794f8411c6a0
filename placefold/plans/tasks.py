"""Task tables: ranking, outcomes, lifecycle, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import make_box
from ..functions.times import ntz
from ..operators import tasks as op
from ..sources.views import view, with_views
from .jobs import SHARDS_AS_OF, _COUNTERS, _counters


def next_per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _counters(spark, sf_dir).withColumn("id", F.col("job_id"))
    jobs = counters.withColumn(
        "last_claimed_at", F.when(F.col("job_id") == "1-URGENT", F.col("updated_at"))
    )
    return op.next_per_job(view(spark, sf_dir, "shards"), jobs, ntz(SHARDS_AS_OF))


def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = ("south", "west", "north", "east")
    attempts = view(spark, sf_dir, "attempts").withColumn(
        "bbox", make_box(*[F.col(c) for c in sides])
    )
    return op.attempt_outcomes(attempts).select(
        "shard_id", "can_split", "radius_m", "blocked", "outcome", "keeps_leads", "exhaustive",
        "retry_delay_s",
    )


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.backoff_schedule(view(spark, sf_dir, "shards")).select(
        "id", "attempt_count", "retry_delay_s", "retry_at"
    )


def lifecycle_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lifecycle_fold(view(spark, sf_dir, "shard_events"))


def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.job_lifecycle_fold(view(spark, sf_dir, "job_events"))


def owned_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.owned_writes(view(spark, sf_dir, "shard_events"))


def reclaim_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = view(spark, sf_dir, "shards")
    return op.reclaim_stale(shards, ntz("1996-01-01 00:00:00"), ntz(SHARDS_AS_OF))


def cancel_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    canceled = view(spark, sf_dir, "jobs").where(F.col("status") == "paused")
    shards = view(spark, sf_dir, "shards")
    return op.cancel_transition(
        shards, canceled.select(F.col("id").alias("job_id")), ntz(SHARDS_AS_OF)
    ).select("id", "job_id", "status", "updated_at")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "jobs")
    # A deletion is asked for every job but those of class 4; only ended ones go.
    requested = jobs.where(~F.col("id").startswith("4")).select("id")
    return op.cascade_delete(view(spark, sf_dir, "shards"), jobs, requested).select("id", "job_id", "status")


QUERIES = {
    "next_per_job": (
        next_per_job,
        with_views(
            "jobs shards",
            _COUNTERS
            + f""", due AS (SELECT * FROM shards WHERE status IN ('pending', 'retry') AND next_run_at <= TIMESTAMP '{SHARDS_AS_OF}'),
            best AS (SELECT * FROM due QUALIFY row_number() OVER (PARTITION BY job_id
              ORDER BY CASE status WHEN 'pending' THEN 0 ELSE 1 END, updated_at, depth DESC, id) = 1)
            SELECT b.job_id, b.id AS shard_id, b.status AS shard_status, b.depth, b.updated_at,
              CASE WHEN b.job_id = '1-URGENT' THEN c.updated_at ELSE c.created_at END AS waiting_since, c.completed_shards
            FROM best b JOIN c ON c.job_id = b.job_id WHERE c.status = 'running'""",
        ),
    ),
    "attempt_outcomes": (
        attempt_outcomes,
        with_views(
            "attempts",
            """, g AS (SELECT *, depth < 14 AND east - west > 0.05::DOUBLE AND north - south > 0.05::DOUBLE AS can_split,
                (south + north) / 2 AS clat, (west + east) / 2 AS clon FROM attempts),
            h AS (SELECT *, pow(sin(radians(south - clat) / 2), 2) + pow(sin(radians(west - clon) / 2), 2) * cos(radians(clat)) * cos(radians(south)) AS a1,
                pow(sin(radians(north - clat) / 2), 2) + pow(sin(radians(west - clon) / 2), 2) * cos(radians(clat)) * cos(radians(north)) AS a2 FROM g),
            r AS (SELECT *, CAST(ceil(2 * 6371008.8::DOUBLE * greatest(atan2(sqrt(a1), sqrt(1 - a1)), atan2(sqrt(a2), sqrt(1 - a2)))) AS BIGINT) AS radius_m,
                failed AND (coalesce(error_name = 'AbortError', FALSE) OR coalesce(error_code = 'SHARD_EXECUTION_TIMEOUT', FALSE)
                  OR coalesce(http_status IN (429, 403, 503, 504, 530), FALSE)
                  OR coalesce(regexp_matches(error_message, '(?i)timeout|rate.limit|blocked'), FALSE)) AS blocked FROM h),
            o AS (SELECT *, raw_count <= 0 AND n_leads = 0 AS empty, CASE WHEN NOT intersects THEN 'skipped'
                WHEN failed AND error_code = 'COARSE_LOCATION' THEN CASE WHEN can_split THEN 'split' ELSE 'done' END
                WHEN job_canceled THEN 'dropped'
                WHEN failed AND blocked AND attempt >= 2 THEN CASE WHEN can_split THEN 'split' ELSE 'done' END
                WHEN failed AND attempt < 6 THEN 'retry' WHEN failed AND can_split THEN 'split' WHEN failed THEN 'failed'
                WHEN raw_count <= 0 AND n_leads = 0 THEN 'done'
                WHEN can_split AND (radius_m > 25000 OR raw_count >= 30) THEN 'split' ELSE 'done' END AS outcome FROM r)
            SELECT shard_id, can_split, radius_m, blocked, outcome,
              intersects AND NOT failed AND NOT job_canceled AND n_leads > 0 AS keeps_leads,
              intersects AND NOT failed AND NOT job_canceled AND NOT empty AND NOT can_split AND raw_count >= 30 AS exhaustive,
              CASE WHEN outcome = 'retry' THEN 60 * pow(2, attempt - 1) END AS retry_delay_s FROM o""",
        ),
    ),
    "backoff_schedule": (
        backoff_schedule,
        with_views(
            "shards",
            """SELECT id, attempt_count, CASE WHEN attempt_count BETWEEN 1 AND 5 THEN 60 * pow(2, attempt_count - 1) END AS retry_delay_s,
              updated_at + to_seconds(CASE WHEN attempt_count BETWEEN 1 AND 5 THEN 60 * pow(2, attempt_count - 1) END) AS retry_at FROM shards""",
        ),
    ),
    "lifecycle_fold": (
        lifecycle_fold,
        with_views(
            "shard_events",
            # The log holds at most eight events per shard, replayed here step by step.
            """, replay AS (
              WITH RECURSIVE step(shard_id, k, status, token, attempts, err, updated_seq) USING KEY (shard_id) AS (
                SELECT DISTINCT shard_id, -1::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM shard_events
                UNION
                SELECT s.shard_id, e.seq,
                  CASE WHEN e.event = 'create' THEN 'pending' WHEN e.event = 'claim' THEN 'running'
                    WHEN e.event = 'reclaim' AND s.status = 'running' THEN 'retry'
                    WHEN e.event = 'cancel' AND s.status IN ('pending', 'retry', 'running') THEN 'canceled'
                    WHEN e.event NOT IN ('reclaim', 'cancel') AND s.status = 'running' AND s.token = e.token THEN e.event ELSE s.status END,
                  CASE WHEN e.event = 'claim' THEN e.token WHEN e.event = 'reclaim' AND s.status = 'running' THEN NULL
                    WHEN e.event NOT IN ('create', 'claim', 'reclaim', 'cancel') AND s.status = 'running' AND s.token = e.token THEN NULL ELSE s.token END,
                  s.attempts + CASE WHEN e.event = 'claim' THEN 1 ELSE 0 END,
                  CASE WHEN e.event = 'reclaim' AND s.status = 'running' AND coalesce(s.err, '') = '' THEN 'Recovered after running shard exceeded the stale timeout.'
                    WHEN e.event IN ('retry', 'failed', 'skipped') AND s.status = 'running' AND s.token = e.token THEN e.error
                    WHEN e.event = 'done' AND s.status = 'running' AND s.token = e.token THEN NULL ELSE s.err END,
                  CASE WHEN e.event IN ('create', 'claim') OR (e.event = 'reclaim' AND s.status = 'running')
                      OR (e.event = 'cancel' AND s.status IN ('pending', 'retry', 'running'))
                      OR (e.event NOT IN ('reclaim', 'cancel') AND s.status = 'running' AND s.token = e.token) THEN e.seq ELSE s.updated_seq END
                FROM step s JOIN shard_events e ON e.shard_id = s.shard_id
                  AND e.seq = CASE WHEN s.k < 0 THEN s.shard_id * 8 ELSE s.k + 1 END)
              SELECT * FROM step)
            SELECT shard_id, status, attempts AS attempt_count, err AS last_error, updated_seq FROM replay""",
        ),
    ),
    "job_lifecycle": (
        job_lifecycle,
        with_views(
            "job_events",
            """, m AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS back,
                min(CASE WHEN event = 'seeded' THEN seq END) OVER (PARTITION BY job_id) AS seeded_at FROM job_events),
            l AS (SELECT *, CASE WHEN event = 'created' OR (event = 'resumed' AND coalesce(seeded_at >= seq, TRUE)) THEN 'pending'
                WHEN event IN ('seeded', 'resumed') THEN 'running' WHEN event = 'finalized' THEN status ELSE event END AS now FROM m WHERE back = 1),
            a AS (SELECT job_id, min(ts) FILTER (event = 'created') AS created_at, arg_min(ts, seq) FILTER (event = 'seeded') AS started_at,
                arg_max(ts, seq) FILTER (event IN ('canceled', 'failed', 'finalized')) AS finished_at,
                arg_max(artifact, seq) FILTER (artifact IS NOT NULL) AS artifact, arg_max(ts, seq) AS updated_at FROM job_events GROUP BY job_id)
            SELECT a.*, l.now AS status, CASE WHEN now = 'pending' THEN 'Queued' WHEN now = 'running' THEN 'Running'
              WHEN event = 'paused' THEN 'Paused by operator.' WHEN event = 'canceled' THEN 'Canceled' ELSE l.message END AS message
            FROM a JOIN l ON l.job_id = a.job_id""",
        ),
    ),
    "owned_writes": (
        owned_writes,
        with_views(
            "shard_events",
            """, c AS (SELECT shard_id, arg_max(token, seq) AS token, max(seq) AS claimed_at FROM shard_events WHERE event = 'claim' GROUP BY shard_id)
            SELECT e.* FROM shard_events e JOIN c ON c.shard_id = e.shard_id AND c.token = e.token AND e.seq > c.claimed_at
            WHERE e.event IN ('done', 'retry', 'failed', 'split', 'skipped')""",
        ),
    ),
    "reclaim_stale": (
        reclaim_stale,
        with_views(
            "shards",
            f""", m AS (SELECT *, status = 'running' AND updated_at <= TIMESTAMP '1996-01-01 00:00:00' AS hit FROM shards)
            SELECT id, job_id, CASE WHEN hit THEN 'retry' ELSE status END AS status, depth, result_count, attempt_count,
              CASE WHEN hit AND coalesce(last_error, '') = '' THEN 'Recovered after running shard exceeded the stale timeout.' ELSE last_error END AS last_error,
              CASE WHEN hit THEN TIMESTAMP '{SHARDS_AS_OF}' ELSE updated_at END AS updated_at,
              CASE WHEN hit THEN TIMESTAMP '{SHARDS_AS_OF}' ELSE next_run_at END AS next_run_at FROM m""",
        ),
    ),
    "cancel_transition": (
        cancel_transition,
        with_views(
            "jobs shards",
            f""", m AS (SELECT s.*, j.status = 'paused' AND s.status IN ('pending', 'retry', 'running') AS hit FROM shards s JOIN jobs j ON j.id = s.job_id)
            SELECT id, job_id, CASE WHEN hit THEN 'canceled' ELSE status END AS status,
              CASE WHEN hit THEN TIMESTAMP '{SHARDS_AS_OF}' ELSE updated_at END AS updated_at FROM m""",
        ),
    ),
    "cascade_delete": (
        cascade_delete,
        with_views(
            "jobs shards",
            """SELECT id, job_id, status FROM shards WHERE job_id NOT IN (
              SELECT id FROM jobs WHERE status IN ('completed', 'partial', 'failed', 'canceled') AND id NOT LIKE '4%')""",
        ),
    ),
}
