"""Flat records for an external table and for exports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from ..functions.boxes import SIDES
from ..functions.joins import lookup_join
from ..functions.jsons import ADDRESS_DDL, BBOX_DDL, encode
from ..functions.text import csv_field, first_filled, subcategories
from ..workspace import fresh_dir, remove_dir

# Spark types of the listing columns.
LISTING_FIELDS: dict[str, str] = {
    "id": "bigint",
    "job_id": "string",
    "dedupe_key": "string",
    "place_id": "string",
    "cid": "string",
    "data_id": "string",
    "link": "string",
    "name": "string",
    "category": "string",
    "categories": "array<string>",
    "website": "string",
    "phone": "string",
    "email": "string",
    "address": "string",
    "complete_address": ADDRESS_DDL,
    "city": "string",
    "area": "string",
    "state_region": "string",
    "postcode": "string",
    "country": "string",
    "lat": "double",
    "lon": "double",
    "review_count": "int",
    "review_rating": "double",
    "business_status": "string",
    "price_range": "string",
    "source_bbox": BBOX_DDL,
    "raw_json": "string",
    "created_at": "timestamp_ntz",
    "updated_at": "timestamp_ntz",
}

# Fields of a delivered record with the sink's column types.
RECORD_FIELDS: dict[str, str] = {
    "query_name": "SingleLineText",
    "source": "SingleLineText",
    "job_id": "SingleLineText",
    "country": "SingleLineText",
    "country_name": "SingleLineText",
    "country_code": "SingleLineText",
    "job_status": "SingleLineText",
    "yp_id": "SingleLineText",
    "yp_alias": "SingleLineText",
    "yp_url": "URL",
    "name": "SingleLineText",
    "category": "SingleLineText",
    "subcategory": "SingleLineText",
    "all_subcategories": "LongText",
    "categories_json": "LongText",
    "website": "URL",
    "phone": "PhoneNumber",
    "address": "LongText",
    "city": "SingleLineText",
    "area": "SingleLineText",
    "state_region": "SingleLineText",
    "postcode": "SingleLineText",
    "lead_country": "SingleLineText",
    "complete_address_json": "LongText",
    "review_count": "Number",
    "review_rating": "Decimal",
    "business_status": "SingleLineText",
    "price_range": "SingleLineText",
    "raw_json": "LongText",
    "source_bbox_json": "LongText",
    "scraped_at": "DateTime",
    "lead_created_at": "DateTime",
    "lead_updated_at": "DateTime",
}

# Spark type of each sink column type.
SINK_TYPES = {
    "SingleLineText": "string",
    "LongText": "string",
    "URL": "string",
    "PhoneNumber": "string",
    "Number": "int",
    "Decimal": "double",
    "DateTime": "timestamp_ntz",
}

# Columns of the CSV export and their names in the JSON export.
EXPORT_FIELDS: dict[str, str] = {
    "query_name": "queryName",
    "source": "source",
    "country": "country",
    "city": "city",
    "area": "area",
    "state_region": "stateRegion",
    "postcode": "postcode",
    "lead_country": "leadCountry",
    "name": "name",
    "category": "category",
    "categories": "categories",
    "phone": "phone",
    "website": "website",
    "address": "address",
    "review_count": "reviewCount",
    "review_rating": "reviewRating",
    "yp_id": "ypId",
    "yp_url": "ypUrl",
}


# Listing columns that an export reads.
EXPORT_COLUMNS = (
    "id", "city", "area", "state_region", "postcode", "country", "name", "category", "categories",
    "phone", "website", "address", "review_count", "review_rating", "place_id", "link",
)


def available_names(columns: Iterable[Mapping[str, str]]) -> set[str]:
    """All names a sink's column descriptions go by."""
    labels = ("column_name", "name", "title", "displayName")
    return {str(c[label]) for c in columns for label in labels if c.get(label)}


def missing_fields(desired: Mapping[str, str], available: Iterable[str]) -> dict[str, str]:
    have = set(available)
    return {name: kind for name, kind in desired.items() if name not in have}


def conform(df: DataFrame, fields: Mapping[str, str], keep_extra: bool = False) -> DataFrame:
    """Rows with exactly these fields: missing ones as typed nulls, in order."""
    columns = [
        (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in fields.items()
    ]
    extra = [c for c in df.columns if keep_extra and c not in fields]
    return df.select(*columns, *extra)


def union_evolved(*parts: DataFrame) -> DataFrame:
    """Rows of tables whose columns were added over time."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def mask_secret(config: DataFrame, secret: str) -> DataFrame:
    """Configuration rows that only tell whether the secret is set."""
    has = F.coalesce(F.col(secret), F.lit("")) != ""
    return config.withColumn(f"has_{secret}", has).drop(secret)


def with_job(leads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Listings beside the job fields of their exports (prefixed job_)."""
    fields = {"keyword": "string", "country": "string", "country_name": "string",
              "country_code": "string", "status": "string"}
    facts = conform(jobs, {"id": "string", **fields}).select(
        F.col("id").alias("job_id"), *[F.col(f).alias(f"job_{f}") for f in fields]
    )
    return lookup_join(leads, facts, ["job_id"], how="inner")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def delivery_records(
    leads: DataFrame,
    jobs: DataFrame,
    source: str,
    available: Iterable[str] | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The record of each listing, reduced to the fields the sink has.

    ``carry`` are columns of the listings to keep beside the record.
    """
    rows = with_job(conform(leads, LISTING_FIELDS, keep_extra=bool(carry)), jobs)
    others = subcategories(F.col("category"), F.col("categories"))
    values = {
        "query_name": F.col("job_keyword"),
        "source": F.lit(source),
        "job_id": F.col("job_id"),
        "country": F.col("job_country"),
        "country_name": first_filled(F.col("job_country_name"), F.col("job_country")),
        "country_code": _text("job_country_code"),
        "job_status": F.col("job_status"),
        "yp_id": _text("place_id"),
        "yp_alias": _text("cid"),
        "yp_url": _text("link"),
        "name": _text("name"),
        "category": _text("category"),
        "subcategory": F.coalesce(F.get("_others", F.lit(0)), F.lit("")),
        "all_subcategories": F.array_join("_others", " | "),
        "categories_json": encode(F.col("categories"), "[]"),
        "website": _text("website"),
        "phone": _text("phone"),
        "address": _text("address"),
        "city": _text("city"),
        "area": _text("area"),
        "state_region": _text("state_region"),
        "postcode": _text("postcode"),
        "lead_country": _text("country"),
        "complete_address_json": encode(F.col("complete_address"), "null"),
        "review_count": F.coalesce("review_count", F.lit(0)),
        "review_rating": F.col("review_rating"),
        "business_status": _text("business_status"),
        "price_range": _text("price_range"),
        "raw_json": F.coalesce("raw_json", F.lit("{}")),
        "source_bbox_json": encode(
            F.when(F.col("source_bbox").isNotNull(),
                   F.struct(*[F.col(f"source_bbox.{s}").alias(s) for s in SIDES])),
            "null",
        ),
        "scraped_at": F.coalesce("updated_at", "created_at"),
        "lead_created_at": F.col("created_at"),
        "lead_updated_at": F.col("updated_at"),
    }
    have = set(RECORD_FIELDS if available is None else available)
    return rows.withColumn("_others", others).select(
        *carry, *[value.alias(name) for name, value in values.items() if name in have]
    )


def export_rows(leads: DataFrame, jobs: DataFrame, source: str, *carry: str) -> DataFrame:
    """The 18 export columns of each listing, nulls kept."""
    rows = with_job(conform(leads, LISTING_FIELDS), jobs)
    values = {
        "query_name": _text("job_keyword"),
        "source": F.lit(source),
        "country": _text("job_country"),
        "lead_country": F.col("country"),
        "categories": F.coalesce(F.array_join("categories", " | "), F.lit("")),
        "yp_id": F.col("place_id"),
        "yp_url": F.col("link"),
    }
    return rows.select(
        *carry, *[values.get(name, F.col(name)).alias(name) for name in EXPORT_FIELDS]
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    """One text line per export row, quoted field by field only where needed."""
    fields = [csv_field(F.col(name)) for name in EXPORT_FIELDS]
    return rows.select(F.concat_ws(",", *fields).alias("line"))


def _csv_writer(rows: DataFrame) -> DataFrameWriter:
    return (
        rows.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header, in the order of the rows."""
    _csv_writer(rows).csv(path)


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select([F.col(name).alias(camel) for name, camel in EXPORT_FIELDS.items()])


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text per export row in the JSON export's naming, nulls kept."""
    named = F.struct(*[F.col(name).alias(camel) for name, camel in EXPORT_FIELDS.items()])
    return rows.select(F.to_json(named, {"ignoreNullFields": "false"}).alias("line"))


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines in the JSON export's naming, nulls kept."""
    json_rows(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_exports(leads: DataFrame, jobs: DataFrame, source: str, path: str) -> None:
    """Both exports of every job, ordered by id within a job's files.

    The rows are written once to shared storage, because range partitioning
    samples its input and both formats read it. Ranges over (job, id) split a
    large job over many files and keep the order across them.
    """
    spark = leads.sparkSession
    staged = fresh_dir(spark, "export")
    export_rows(leads, jobs, source, "job_id", "id").write.parquet(staged)
    rows = spark.read.parquet(staged)
    placed = rows.repartitionByRange("job_id", "id").sortWithinPartitions("job_id", "id")
    _csv_writer(placed.select("job_id", *EXPORT_FIELDS)).partitionBy("job_id").csv(f"{path}/csv")
    camel = placed.select("job_id", *[F.col(n).alias(c) for n, c in EXPORT_FIELDS.items()])
    camel.write.mode("overwrite").partitionBy("job_id").option("ignoreNullFields", False).json(
        f"{path}/json"
    )
    remove_dir(spark, staged)
