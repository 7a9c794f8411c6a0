"""Exports, delivery records, cursors and delivery state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import ntz
from ..operators import delivery as op
from ..operators import sync
from ..operators.merge import as_sightings, merge_listings
from ..sources.views import view, with_views
from .golden import GOLDEN, LISTINGS
from .merges import golden_listings

SOURCE = "directory"
INTERVAL_MINUTES = 30
DUE_AS_OF = "2024-01-31 00:20:00"


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "listing_jobs")
    leads = golden_listings(spark, sf_dir, *op.EXPORT_COLUMNS)
    return op.export_rows(leads, jobs, SOURCE, "id")


def csv_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.csv_lines(export_rows(spark, sf_dir))


def json_export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.json_lines(export_rows(spark, sf_dir))


def delivery_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = view(spark, sf_dir, "listing_jobs")
    return op.delivery_records(golden_listings(spark, sf_dir), jobs, SOURCE)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_state_fold(view(spark, sf_dir, "sync_runs"))


def sync_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)


def delta_since_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = golden_listings(spark, sf_dir, "id", "name", "phone", "website")
    return sync.undelivered(leads, _state(spark, sf_dir)).select(
        "job_id", "id", "dedupe_key", "name", "phone", "website"
    )


def changed_since_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = golden_listings(spark, sf_dir, "id", "updated_at")
    return sync.changed_since(leads, _state(spark, sf_dir)).select(
        "job_id", "id", "dedupe_key", "updated_at"
    )


CHANGED = ("job_id", "dedupe_key", "id", "name", "phone", "website", "city", "review_count", "updated_at")


def _before_and_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listings as of an earlier sighting, and of all sightings after one job was deleted."""
    seen = as_sightings(view(spark, sf_dir, "observations"))
    before = merge_listings(seen.where("seq % 10 < 7"), columns=CHANGED).select(*CHANGED)
    after = merge_listings(seen.where("seq % 10 >= 2 OR seq % 3 = 0"), columns=CHANGED).select(*CHANGED)
    return before, after.where("job_id != 'purchase'")


def delivery_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.change_set(*_before_and_after(spark, sf_dir), ("job_id", "dedupe_key"))


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_overview(
        view(spark, sf_dir, "listing_jobs"),
        golden_listings(spark, sf_dir, "id"),
        _state(spark, sf_dir),
        INTERVAL_MINUTES,
    )


def unsynced_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir).select(
        "job_id", "status", "last_status", "last_synced_id", "synced_record_count", "unsynced", "next_due_at"
    )


def sync_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_due(_overview(spark, sf_dir), ntz(DUE_AS_OF)).select("job_id", "unsynced", "next_due_at")


def schema_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations of a table brought to the columns a sink has."""
    old = view(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score")
    )
    new = view(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("area"),
    )
    target = {"id": "bigint", "name": "string", "segment": "string", "area": "string", "email": "string"}
    return op.conform(op.union_evolved(old, new), target)


_EXPORT = """, e AS (SELECT g.id, j.keyword AS query_name, 'directory' AS source, j.country, g.city, CAST(NULL AS VARCHAR) AS area, g.state_region, g.postcode,
  g.country AS lead_country, g.name, g.category, array_to_string(g.categories, ' | ') AS categories, g.phone, g.website, g.address,
  g.review_count, g.review_rating, g.place_id AS yp_id, g.link AS yp_url FROM listings g JOIN listing_jobs j ON j.id = g.job_id)
"""


def _csv(column: str) -> str:
    text = f"coalesce(CAST({column} AS VARCHAR), '')"
    return (
        f"CASE WHEN regexp_matches({text}, '[\",\\n]') "
        f"THEN '\"' || replace({text}, '\"', '\"\"') || '\"' ELSE {text} END"
    )


_STATE = """, ranked AS (SELECT *, max(CASE WHEN event = 'success' THEN seq END) OVER p AS ok_seq, max(CASE WHEN event = 'started' THEN seq END) OVER p AS start_seq,
  max(seq) OVER p AS last_seq FROM sync_runs WINDOW p AS (PARTITION BY job_id)),
state AS (SELECT job_id, coalesce(max(CASE WHEN seq = ok_seq THEN last_id END), 0) AS last_synced_id, max(CASE WHEN seq = ok_seq THEN ts END) AS last_synced_at,
  max(CASE WHEN seq = last_seq THEN CASE WHEN event = 'started' THEN 'running' ELSE event END END) AS last_status,
  max(CASE WHEN seq = last_seq THEN CASE WHEN event = 'started' THEN 'Sync in progress.' ELSE message END END) AS last_message,
  coalesce(max(CASE WHEN seq = start_seq THEN ts END), arg_min(ts, seq)) AS last_started_at,
  max(CASE WHEN seq = last_seq AND event <> 'started' THEN ts END) AS last_finished_at,
  CAST(coalesce(sum(CASE WHEN event = 'success' THEN synced END), 0) AS BIGINT) AS synced_record_count FROM ranked GROUP BY job_id)
"""

_OVERVIEW = (
    _STATE
    + """, behind AS (SELECT g.job_id, count(*) AS n FROM listings g LEFT JOIN state s ON s.job_id = g.job_id WHERE g.id > coalesce(s.last_synced_id, 0) GROUP BY g.job_id),
o AS (SELECT j.id AS job_id, j.status, coalesce(s.last_status, 'idle') AS last_status, coalesce(s.last_synced_id, 0) AS last_synced_id,
  coalesce(s.synced_record_count, 0) AS synced_record_count, coalesce(b.n, 0) AS unsynced,
  CASE WHEN j.status = 'running' AND coalesce(s.last_status, 'idle') <> 'running' AND coalesce(b.n, 0) > 0
    THEN coalesce(s.last_synced_at, j.started_at, j.updated_at) + INTERVAL 30 MINUTE END AS next_due_at
  FROM listing_jobs j LEFT JOIN state s ON s.job_id = j.id LEFT JOIN behind b ON b.job_id = j.id)
"""
)

QUERIES = {
    "export_rows": (
        export_rows,
        with_views("parsed_records listing_jobs", LISTINGS + _EXPORT + "SELECT * FROM e"),
    ),
    "csv_export_lines": (
        csv_export_lines,
        with_views(
            "parsed_records listing_jobs",
            LISTINGS + _EXPORT + "SELECT " + " || ',' || ".join(_csv(c) for c in op.EXPORT_FIELDS) + " AS line FROM e",
        ),
    ),
    "json_export_lines": (
        json_export_lines,
        with_views(
            "parsed_records listing_jobs",
            LISTINGS + _EXPORT + "SELECT CAST(json_object("
            + ", ".join(f"'{camel}', {name}" for name, camel in op.EXPORT_FIELDS.items()) + ") AS VARCHAR) AS line FROM e",
        ),
    ),
    "delivery_records": (
        delivery_records,
        with_views(
            "parsed_records listing_jobs",
            LISTINGS
            + """, u AS (SELECT job_id, dedupe_key, lower(trim(category)) AS main, categories AS l, unnest(range(len(categories))) AS pos FROM listings),
            v AS (SELECT job_id, dedupe_key, trim(l[pos + 1]) AS v, min(pos) AS pos FROM u WHERE trim(l[pos + 1]) <> '' AND lower(trim(l[pos + 1])) <> main GROUP BY ALL),
            o AS (SELECT job_id, dedupe_key, arg_min(v, pos) AS first, string_agg(v, ' | ' ORDER BY pos) AS joined FROM v GROUP BY ALL)
            SELECT j.keyword AS query_name, 'directory' AS source, g.job_id, j.country, coalesce(nullif(j.country_name, ''), j.country) AS country_name,
              coalesce(j.country_code, '') AS country_code, j.status AS job_status, coalesce(g.place_id, '') AS yp_id, '' AS yp_alias, coalesce(g.link, '') AS yp_url,
              g.name, g.category, coalesce(o.first, '') AS subcategory, coalesce(o.joined, '') AS all_subcategories,
              CAST(to_json(g.categories) AS VARCHAR) AS categories_json, coalesce(g.website, '') AS website, coalesce(g.phone, '') AS phone,
              coalesce(g.address, '') AS address, coalesce(g.city, '') AS city, '' AS area, coalesce(g.state_region, '') AS state_region,
              coalesce(g.postcode, '') AS postcode, coalesce(g.country, '') AS lead_country,
              CAST(json_object('street', raw_street, 'city', raw_city, 'state', raw_state, 'postcode', raw_postcode, 'country', raw_country) AS VARCHAR) AS complete_address_json,
              g.review_count, g.review_rating, '' AS business_status, '' AS price_range, '{}' AS raw_json, 'null' AS source_bbox_json,
              g.updated_at AS scraped_at, g.created_at AS lead_created_at, g.updated_at AS lead_updated_at
            FROM listings g JOIN listing_jobs j ON j.id = g.job_id LEFT JOIN o ON o.job_id = g.job_id AND o.dedupe_key = g.dedupe_key""",
        ),
    ),
    "sync_state_fold": (sync_state_fold, with_views("sync_runs", _STATE + "SELECT * FROM state")),
    "delta_since_cursor": (
        delta_since_cursor,
        with_views(
            "parsed_records sync_runs",
            LISTINGS + _STATE
            + """SELECT g.job_id, g.id, g.dedupe_key, g.name, g.phone, g.website FROM listings g LEFT JOIN state s ON s.job_id = g.job_id
            WHERE g.id > coalesce(s.last_synced_id, 0)""",
        ),
    ),
    "changed_since_delivery": (
        changed_since_delivery,
        with_views(
            "parsed_records sync_runs",
            LISTINGS + _STATE
            + """SELECT g.job_id, g.id, g.dedupe_key, g.updated_at FROM listings g LEFT JOIN state s ON s.job_id = g.job_id
            WHERE g.id > coalesce(s.last_synced_id, 0) OR s.last_synced_at IS NULL OR g.updated_at > s.last_synced_at""",
        ),
    ),
    "delivery_changes": (
        delivery_changes,
        with_views(
            "observations",
            "".join(
                GOLDEN.replace("golden AS", f"{name} AS").replace("FROM observations", f"FROM observations WHERE ({rule})")
                for name, rule in (("old", "seq % 10 < 7"), ("all_new", "(seq % 10 >= 2 OR seq % 3 = 0)"))
            )
            + """, new AS (SELECT * FROM all_new WHERE job_id <> 'purchase')
            SELECT CASE WHEN o.job_id IS NULL THEN 'insert' WHEN n.job_id IS NULL THEN 'delete' ELSE 'update' END AS change,
              coalesce(o.job_id, n.job_id) AS job_id, coalesce(o.dedupe_key, n.dedupe_key) AS dedupe_key,
              n.id, n.name, n.phone, n.website, n.city, n.review_count, n.updated_at
            FROM old o FULL JOIN new n ON o.job_id = n.job_id AND o.dedupe_key = n.dedupe_key
            WHERE o.job_id IS NULL OR n.job_id IS NULL OR (o.id, o.name, o.phone, o.website, o.city, o.review_count, o.updated_at)
              IS DISTINCT FROM (n.id, n.name, n.phone, n.website, n.city, n.review_count, n.updated_at)""",
        ),
    ),
    "unsynced_count": (
        unsynced_count,
        with_views("parsed_records listing_jobs sync_runs", LISTINGS + _OVERVIEW + "SELECT * FROM o"),
    ),
    "sync_due": (
        sync_due,
        with_views(
            "parsed_records listing_jobs sync_runs",
            LISTINGS + _OVERVIEW
            + f"SELECT job_id, unsynced, next_due_at FROM o WHERE next_due_at <= TIMESTAMP '{DUE_AS_OF}'",
        ),
    ),
    "schema_reconcile": (
        schema_reconcile,
        """SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS VARCHAR) AS area, CAST(NULL AS VARCHAR) AS email FROM supplier
        UNION ALL SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), NULL FROM customer""",
    ),
}
