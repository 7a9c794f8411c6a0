"""Normalising and merging sightings into golden listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustered
from ..operators.merge import as_sightings, golden_rows, latest_per_key as fold_latest
from ..operators.merge import merge_listings as merge
from ..operators.normalize import backfill_locations as backfill
from ..operators.normalize import normalize_listings as normalize
from ..sources.views import view, with_views
from .golden import GOLDEN, NORMALIZED

MERGED = (
    "job_id", "dedupe_key", "id", "place_id", "name", "website", "phone", "city", "review_count",
    "review_rating", "email", "raw_json", "created_at", "updated_at",
)


def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = view(spark, sf_dir, "parsed_records").withColumn(
        "categories", F.split("categories_text", r"\|")
    )
    return normalize(parsed, "seq", "job_id", "observed_at")


def golden_listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Golden rows of the parsed records, all or only some columns."""
    return merge(as_sightings(normalized_records(spark, sf_dir)), columns=columns or None)


def golden_observations(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Golden rows of the raw observations, all or only some columns."""
    return merge(as_sightings(view(spark, sf_dir, "observations")), columns=columns or None)


def normalize_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized_records(spark, sf_dir).select(
        "seq", "job_id", "dedupe_key", "place_id", "link", "name", "category",
        F.array_join("categories", "/").alias("categories"), "website", "phone", "address",
        F.col("complete_address.street").alias("raw_street"),
        F.col("complete_address.state").alias("raw_state"),
        "city", "state_region", "postcode", "country", "review_count", "review_rating", "email",
    )


def merge_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_observations(spark, sf_dir).select(*MERGED)


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_latest(view(spark, sf_dir, "settings_log"), "setting", "value_json", "seq")


def backfill_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backfill(view(spark, sf_dir, "partial_locations")).drop("raw_json")


def _filled(name: str, *paths: str) -> str:
    found = ", ".join(f"nullif(json_extract_string(raw, '{p}'), '')" for p in paths)
    return f"CASE WHEN coalesce({name}, '') <> '' THEN {name} ELSE coalesce({found}, NULL) END AS {name}"


BUCKETS = 8


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sightings that are stored already, and those that come after, in no order of arrival."""
    seen = as_sightings(view(spark, sf_dir, "observations"))
    return seen.where("seq % 10 < 7"), seen.where("seq % 10 >= 7")


def clustered_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of a stored table of states after more sightings."""
    stored, late = _parts(spark, sf_dir)
    table = clustered.store_states(stored, BUCKETS)
    return golden_rows(clustered.with_sightings(spark, table, late, BUCKETS)).select(*MERGED)


def clustered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fifty listings of a job in a stored table."""
    table = clustered.store(golden_observations(spark, sf_dir, "id", "name", "phone"), BUCKETS)
    return clustered.page_after(spark, table, "click", 20, 50, "id", "dedupe_key", "name", "phone")


def clustered_unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of a stored table that were not among those sent."""
    table = clustered.store(golden_observations(spark, sf_dir, "id", "name"), BUCKETS)
    sent = view(spark, sf_dir, "observations").where("seq % 10 < 3").select("job_id", "dedupe_key")
    return clustered.not_among(spark, table, sent, BUCKETS).select("job_id", "dedupe_key", "id", "name")


QUERIES = {
    "clustered_update": (
        clustered_update,
        with_views("observations", GOLDEN + f"SELECT {', '.join(MERGED)} FROM golden"),
    ),
    "clustered_page": (
        clustered_page,
        with_views(
            "observations",
            GOLDEN + "SELECT id, dedupe_key, name, phone FROM golden WHERE job_id = 'click' AND id > 20 ORDER BY id LIMIT 50",
        ),
    ),
    "clustered_unsent": (
        clustered_unsent,
        with_views(
            "observations",
            GOLDEN
            + """SELECT job_id, dedupe_key, id, name FROM golden g WHERE NOT EXISTS (
              SELECT 1 FROM observations o WHERE o.seq % 10 < 3 AND o.job_id = g.job_id AND o.dedupe_key = g.dedupe_key)""",
        ),
    ),
    "normalize_listings": (
        normalize_listings,
        with_views(
            "parsed_records",
            NORMALIZED
            + """SELECT seq, job_id, dedupe_key, place_id, link, name, category, array_to_string(categories, '/') AS categories,
              website, phone, address, raw_street, raw_state, city, state_region, postcode, country, review_count, review_rating,
              CAST(NULL AS VARCHAR) AS email FROM normalized""",
        ),
    ),
    "merge_listings": (
        merge_listings,
        with_views("observations", GOLDEN + f"SELECT {', '.join(MERGED)} FROM golden"),
    ),
    "latest_per_key": (
        latest_per_key,
        with_views(
            "settings_log",
            """SELECT setting, arg_max_null(value_json, seq) AS value_json, max(seq) AS seq
            FROM settings_log GROUP BY setting""",
        ),
    ),
    "backfill_locations": (
        backfill_locations,
        with_views(
            "partial_locations",
            """, r AS (SELECT *, CASE WHEN json_valid(raw_json) THEN raw_json END AS raw FROM partial_locations)
            SELECT id, CAST(NULL AS VARCHAR) AS area, """
            + ", ".join(
                [
                    _filled("city", "$.city"),
                    _filled("state_region", "$.stateRegion", "$.state_region"),
                    _filled("postcode", "$.postcode"),
                    _filled("country", "$.country"),
                ]
            )
            + " FROM r",
        ),
    ),
}
