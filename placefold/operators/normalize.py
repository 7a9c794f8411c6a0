"""Parsed page records to listing rows with a dedupe key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty, null_if_empty


def dedupe_key(listing_id: Column, name: Column, phone: Column, street: Column) -> Column:
    """The directory's own id, else name, phone and street joined by ':'."""
    parts = [F.coalesce(c, F.lit("")) for c in (name, phone, street)]
    return F.coalesce(null_if_empty(listing_id), F.concat_ws(":", *parts))


def joined_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[null_if_empty(c) for c in parts])


def nested_address(
    street: Column, city: Column, state: Column, postcode: Column, country: Column
) -> Column:
    return F.struct(
        street.alias("street"),
        city.alias("city"),
        state.alias("state"),
        postcode.alias("postcode"),
        country.alias("country"),
    )


def normalize_listings(parsed: DataFrame, *carry: str) -> DataFrame:
    """Listing rows of parsed records; records without a name are dropped.

    ``parsed`` has listing_id, listing_url, name, phone, website, street, city,
    state_region, postcode, country, category, rating, review_count and
    optionally categories and source_bbox. ``carry`` names further columns to
    keep.
    """
    c = F.col
    text = lambda name: null_if_empty(c(name))
    no_text = F.lit(None).cast("string")
    categories = (
        F.coalesce(c("categories"), F.array().cast("array<string>"))
        if "categories" in parsed.columns
        else F.array().cast("array<string>")
    )
    columns = {
        "dedupe_key": dedupe_key(c("listing_id"), c("name"), c("phone"), c("street")),
        "place_id": text("listing_id"),
        "cid": no_text,
        "data_id": no_text,
        "link": text("listing_url"),
        "name": c("name"),
        "category": F.coalesce(c("category"), F.lit("")),
        "categories": categories,
        "website": text("website"),
        "phone": text("phone"),
        "email": no_text,
        "address": joined_address(c("street"), c("city"), c("state_region"), c("postcode")),
        "complete_address": nested_address(
            c("street"), c("city"), c("state_region"), c("postcode"), c("country")
        ),
        "city": text("city"),
        "area": no_text,
        "state_region": text("state_region"),
        "postcode": text("postcode"),
        "country": text("country"),
        "lat": F.lit(None).cast("double"),
        "lon": F.lit(None).cast("double"),
        "review_count": F.coalesce(c("review_count"), F.lit(0)),
        "review_rating": F.nullif(c("rating"), F.lit(0.0)),
        "business_status": no_text,
        "price_range": no_text,
    }
    if "source_bbox" in parsed.columns:
        columns["source_bbox"] = c("source_bbox")
    return parsed.where(nonempty(c("name"))).select(
        *carry, *[value.alias(name) for name, value in columns.items()]
    )


_LOCATION_DDL = (
    "city string, stateRegion string, state_region string, postcode string, country string, _bad string"
)


def backfill_locations(listings: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Fill empty location fields from the raw record.

    Only narrow expressions: the filter for incomplete rows and the write-back
    become one projection, rows that are complete pass through unchanged.
    """
    record = F.from_json(raw, _LOCATION_DDL, {"columnNameOfCorruptRecord": "_bad"})
    whole = listings.withColumn("_record", record)  # parsed once for all fields
    value = lambda name: null_if_empty(F.when(F.col("_record._bad").isNull(), F.col(f"_record.{name}")))
    source = {
        "city": value("city"),
        "state_region": F.coalesce(value("stateRegion"), value("state_region")),
        "postcode": value("postcode"),
        "country": value("country"),
    }
    filled = {
        name: F.when(nonempty(F.col(name)), F.col(name)).otherwise(found)
        for name, found in source.items()
    }
    if "area" in listings.columns:
        filled["area"] = null_if_empty(F.col("area"))
    return whole.withColumns(filled).drop("_record")
