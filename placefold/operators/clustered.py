"""Listings stored by key: bucketed by it and sorted by job and id inside each bucket.

What meets such a table by its key (new sightings, what was sent) is moved to
its buckets; the table itself is not shuffled. Pages of a job read only the
row groups whose ids can be in them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import fresh_dir
from .merge import FIRST_FILLED, KEY, LISTING_POLICIES, fold_sightings


def store(rows: DataFrame, buckets: int, order: tuple[str, ...] = ("job_id", "id"), name: str | None = None) -> str:
    """Write ``rows`` (with the listing key) as a clustered table in the shared folder; returns its name.

    Each bucket is one file. A hundred bytes a row and some hundred megabytes
    a file are a good size; ``buckets`` has to be the same for tables that meet.
    """
    table = name or f"listings_{uuid.uuid4().hex}"
    (
        rows.repartition(buckets, *KEY).sortWithinPartitions(*order)
        .write.bucketBy(buckets, *KEY).sortBy(*order)
        .option("path", fresh_dir(rows.sparkSession, table)).mode("overwrite").saveAsTable(table)
    )
    return table


def store_states(sightings: DataFrame, buckets: int, columns: Iterable[str] | None = None, name: str | None = None) -> str:
    """Merge states of sightings as a clustered table; they can take in more sightings later."""
    return store(fold_sightings(sightings, columns=columns), buckets, order=KEY, name=name)


def with_sightings(spark: SparkSession, table: str, sightings: DataFrame, buckets: int, columns: Iterable[str] | None = None) -> DataFrame:
    """The states of ``table`` after more sightings; only the new ones are shuffled.

    Both sides lie in the same buckets, so states of a key meet in a join
    without moving the table, and keys that only one side has pass through it.
    """
    old = spark.table(table)
    new = fold_sightings(sightings, columns=columns).select(*old.columns).repartition(buckets, *KEY)
    pair = F.struct(*[F.col(c) for c in old.columns])
    sides = [df.select(*[F.col(k).alias(f"{k}_{n}") for k in KEY], pair.alias(n)) for df, n in ((old, "old"), (new, "new"))]
    same = [sides[0][f"{k}_old"] == sides[1][f"{k}_new"] for k in KEY]
    met = sides[0].join(sides[1].hint("merge"), same, "full")
    each = met.select(F.coalesce("old", "new").alias("a"), F.when(F.col("old").isNotNull(), F.col("new")).alias("b"))
    return each.select(*_combined(old.columns))


def _combined(columns: list[str]) -> list[Column]:
    """State ``a`` with ``b`` (or nothing) taken in, column by column, as ``combine_states`` does over rows.

    A value goes with its place in the order of arrival: the first filled and
    the first row by the smaller, the last row and the latest value by the
    larger one; what has no place is a maximum.
    """
    out: list[Column] = []
    a, b = (lambda c: F.col("a").getField(c)), (lambda c: F.col("b").getField(c))
    for c in columns:
        if c in KEY:
            out.append(a(c).alias(c))
            continue
        value, at = (c.removesuffix("_at"), c) if c.endswith("_at") and c.removesuffix("_at") in columns else (c, f"{c}_at")
        if at not in columns:
            out.append(F.when(F.col("b").isNull(), a(c)).otherwise(F.greatest(a(c), b(c))).alias(c))
            continue
        earlier = value == "first" or LISTING_POLICIES.get(value) == FIRST_FILLED
        takes = (b(at) < a(at)) if earlier else (b(at) > a(at))
        takes = F.coalesce(takes, a(at).isNull() & b(at).isNotNull())
        out.append(F.when(takes, b(c)).otherwise(a(c)).alias(c))
    return out


def page_after(spark: SparkSession, table: str, job: str, after: int, limit: int, *columns: str) -> DataFrame:
    """The next ``limit`` listings of a job behind the id ``after``, by id."""
    rows = spark.table(table).where((F.col("job_id") == job) & (F.col("id") > after))
    return rows.select(*columns).orderBy("id").limit(max(limit, 1))


def not_among(spark: SparkSession, table: str, sent: DataFrame, buckets: int) -> DataFrame:
    """Listings of the table whose key is not in ``sent``; only ``sent`` is shuffled, into the same buckets."""
    keys = sent.select(*KEY).repartition(buckets, *KEY).distinct()
    return spark.table(table).join(keys.hint("merge"), list(KEY), "left_anti")
