"""Streaming twins, drained over the provided events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ntz, plus_seconds
from ..operators.merge import as_sightings
from ..operators.normalize import normalize_listings
from ..operators.tasks import RECLAIMED
from ..sources import tables
from ..sources.views import VIEWS, view, with_views
from ..streaming import jobs as st
from ..workspace import fresh_dir
from .delivery import SOURCE
from .golden import GOLDEN, LISTINGS
from .merges import MERGED
from .tasks import QUERIES as TASK_QUERIES

LOG_START = "2024-01-01 00:00:00"


def _stream(spark: SparkSession, sf_dir: str, name: str, table: str) -> DataFrame:
    """A derived view over a table read as a stream."""
    schema = tables.load(spark, sf_dir, table).schema
    rows = st.stream_parquet(spark, f"{sf_dir}/{table}.parquet", schema)
    return spark.sql(VIEWS[name], **{table: rows})


def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "merge")
    seen = as_sightings(_stream(spark, sf_dir, "observations", "events"))
    st.start_merge(seen, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return st.golden_table(spark, f"{root}/state").select(*MERGED)


def stream_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "delivery")
    parsed = _stream(spark, sf_dir, "parsed_records", "events").withColumn(
        "categories", F.split("categories_text", r"\|")
    )
    seen = as_sightings(normalize_listings(parsed, "seq", "job_id", "observed_at"))
    jobs = view(spark, sf_dir, "listing_jobs")
    st.start_delivery(seen, jobs, SOURCE, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return st.delivered(spark, f"{root}/out").select(
        "query_name", "source", "job_id", "country_name", "job_status", "yp_id", "name", "phone",
        "address", "city", "review_count", "review_rating", "lead_created_at", "lead_updated_at",
    )


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "lifecycle")
    log = _stream(spark, sf_dir, "shard_events", "orders")
    st.start_lifecycle(log, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return st.task_states(spark, f"{root}/state")


def _timed_log(log: DataFrame) -> DataFrame:
    """The events of the tasks, each in the minute of its number."""
    return log.withColumn("ts", plus_seconds(ntz(LOG_START), F.col("seq") * 60))


def stream_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "reclaim")
    log = _timed_log(_stream(spark, sf_dir, "shard_events", "orders"))
    st.start_reclaim(log, f"{root}/out", f"{root}/checkpoint", "1 minute", "10 minutes").awaitTermination()
    return st.table_so_far(spark, f"{root}/out")


def stream_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_dir(spark, "recency")
    seen = _stream(spark, sf_dir, "observations", "events")
    st.start_recency(seen, f"{root}/out", f"{root}/checkpoint", "10 minutes").awaitTermination()
    return st.table_so_far(spark, f"{root}/out")


QUERIES = {
    "stream_merge": (
        stream_merge,
        with_views("observations", GOLDEN + f"SELECT {', '.join(MERGED)} FROM golden"),
    ),
    "stream_delivery": (
        stream_delivery,
        with_views(
            "parsed_records listing_jobs",
            LISTINGS
            + """SELECT j.keyword AS query_name, 'directory' AS source, g.job_id, coalesce(nullif(j.country_name, ''), j.country) AS country_name,
              j.status AS job_status, coalesce(g.place_id, '') AS yp_id, g.name, coalesce(g.phone, '') AS phone, coalesce(g.address, '') AS address,
              coalesce(g.city, '') AS city, g.review_count, g.review_rating, g.created_at AS lead_created_at, g.updated_at AS lead_updated_at
              FROM listings g JOIN listing_jobs j ON j.id = g.job_id""",
        ),
    ),
    "stream_lifecycle": (stream_lifecycle, TASK_QUERIES["lifecycle_fold"][1]),
    "stream_reclaim": (
        stream_reclaim,
        with_views(
            "shard_events",
            f""", log AS (SELECT * REPLACE (TIMESTAMP '{LOG_START}' + INTERVAL 1 MINUTE * seq AS ts) FROM shard_events),
            claims AS (SELECT shard_id, seq AS claim_seq, token, ts AS claimed_at, ts + INTERVAL 1 MINUTE AS reclaimed_at FROM log WHERE event = 'claim')
            SELECT c.*, 'retry' AS status, '{RECLAIMED}' AS last_error FROM claims c
            WHERE c.reclaimed_at <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM log) AND NOT EXISTS (
              SELECT 1 FROM log e WHERE e.shard_id = c.shard_id AND e.seq > c.claim_seq AND e.ts BETWEEN c.claimed_at AND c.reclaimed_at
              AND (e.event NOT IN ('done', 'retry', 'failed', 'split', 'skipped') OR e.token IS NOT DISTINCT FROM c.token))""",
        ),
    ),
    "stream_recency": (
        stream_recency,
        with_views(
            "observations",
            """, ends AS (SELECT job_id, dedupe_key, observed_at,
                unnest(range(1, 25)) AS k, date_trunc('hour', observed_at) AS h FROM observations),
            w AS (SELECT job_id, dedupe_key, h + INTERVAL 1 HOUR * k AS window_end, max(k = 1) AS in_hour FROM ends GROUP BY ALL)
            SELECT job_id, window_end, count(*) FILTER (in_hour) AS seen_last_hour, count(*) AS seen_last_day FROM w
            WHERE window_end <= (SELECT max(observed_at) - INTERVAL 10 MINUTE FROM observations) GROUP BY job_id, window_end""",
        ),
    ),
}
