"""Stored rows with JSON text columns, decoded and renamed for readers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import ADDRESS_DDL, BBOX_DDL, decode
from ..functions.text import subcategories

# JSON columns of each table, their decoded names and shapes.
JSON_COLUMNS: dict[str, dict[str, tuple[str, str]]] = {
    "jobs": {
        "search_params_json": ("search_params", "struct<query: string>"),
        "country_bbox_json": ("country_bbox", BBOX_DDL),
    },
    "shards": {"bbox_json": ("bbox", BBOX_DDL)},
    "leads": {
        "categories_json": ("categories", "array<string>"),
        "complete_address_json": ("complete_address", ADDRESS_DDL),
        "source_bbox_json": ("source_bbox", BBOX_DDL),
    },
}

# Counters that read as 0 and texts that read as null when empty.
ZERO_DEFAULTS = {"last_synced_id", "synced_record_count"}
EMPTY_IS_NULL = {"run_token"}


def decode_rows(rows: DataFrame, table: str) -> DataFrame:
    """Rows of a stored table with its JSON columns parsed, bad JSON as null."""
    columns: list[Column] = []
    for name in rows.columns:
        if name in JSON_COLUMNS.get(table, {}):
            decoded, ddl = JSON_COLUMNS[table][name]
            columns.append(decode(F.col(name), ddl).alias(decoded))
        elif name in ZERO_DEFAULTS:
            columns.append(F.coalesce(F.col(name), F.lit(0)).alias(name))
        elif name in EMPTY_IS_NULL:
            columns.append(F.nullif(F.col(name), F.lit("")).alias(name))
        else:
            columns.append(F.col(name))
    decoded_rows = rows.select(*columns)
    if table == "leads" and {"category", "categories"} <= set(decoded_rows.columns):
        others = subcategories(F.col("category"), F.col("categories"))
        decoded_rows = decoded_rows.withColumn("all_subcategories", others).withColumn(
            "subcategory", F.coalesce(F.get("all_subcategories", F.lit(0)), F.lit(""))
        )
    return decoded_rows


def camel_case(rows: DataFrame) -> DataFrame:
    """snake_case column names as camelCase ones."""
    camel = lambda name: re.sub(r"_([a-z0-9])", lambda m: m.group(1).upper(), name)
    return rows.withColumnsRenamed({c: camel(c) for c in rows.columns})


def keyed_default(overrides: Column, key: Column, default: Column) -> Column:
    """Value of ``key`` (any case) in a map with lower-case keys, else a default."""
    return F.coalesce(F.try_element_at(overrides, F.lower(F.coalesce(key, F.lit("")))), default)
