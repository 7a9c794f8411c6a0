"""Fold repeated sightings of a business into one golden row.

Each column follows one of five policies. A fold state keeps, beside each
value, the arrival number that won it, so states combine in any order and any
grouping: batch, incremental and streaming merges give the same rows.
Everything is a partial-then-final aggregate, so a key with very many
sightings is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonempty

LATEST = "latest non-null"
LAST = "last, nulls included"
FIRST_FILLED = "first non-empty, else last"
MAXIMUM = "maximum"
FIRST = "first"

KEY = ("job_id", "dedupe_key")

# The merge policy of each listing column.
LISTING_POLICIES: dict[str, str] = {
    "place_id": LATEST,
    "cid": LATEST,
    "data_id": LATEST,
    "link": LATEST,
    "review_rating": LATEST,
    "business_status": LATEST,
    "price_range": LATEST,
    "name": LAST,
    "category": LAST,
    "categories": LAST,
    "complete_address": LAST,
    "raw_json": LAST,
    "updated_at": LAST,
    "website": FIRST_FILLED,
    "phone": FIRST_FILLED,
    "address": FIRST_FILLED,
    "city": FIRST_FILLED,
    "area": FIRST_FILLED,
    "state_region": FIRST_FILLED,
    "postcode": FIRST_FILLED,
    "country": FIRST_FILLED,
    "review_count": MAXIMUM,
    "email": FIRST,
    "lat": FIRST,
    "lon": FIRST,
    "source_bbox": FIRST,
    "created_at": FIRST,
    "id": FIRST,
}


def _policies(
    columns: Iterable[str], policies: Mapping[str, str], key: Iterable[str]
) -> dict[str, str]:
    return {c: policies[c] for c in columns if c in policies and c not in key}


def _of(chosen: Mapping[str, str], policy: str) -> list[str]:
    return [c for c, p in chosen.items() if p == policy]


def as_sightings(observations: DataFrame) -> DataFrame:
    """Add the columns a stored row takes from its arrival: id and both times."""
    return observations.withColumns(
        {
            "id": F.col("seq"),
            "created_at": F.col("observed_at"),
            "updated_at": F.col("observed_at"),
        }
    )


def _grouped(df: DataFrame, key: list[str]):
    """Group by ``key`` behind its hash.

    Aggregates of texts are sort-based. With the hash as the leading grouping
    column the sort decides by one 64-bit prefix instead of comparing the key
    texts, which often start alike.
    """
    return df.groupBy(F.xxhash64(*key).alias("_hash"), *key)


def fold_sightings(
    sightings: DataFrame,
    order: str = "seq",
    policies: Mapping[str, str] = LISTING_POLICIES,
    columns: Iterable[str] | None = None,
    key: Iterable[str] = KEY,
    more: Iterable[Column] = (),
) -> DataFrame:
    """One mergeable state per key. ``order`` must be unique within a key.

    ``columns`` restricts the work to what the caller needs; the others are
    neither read nor shuffled. ``more`` are aggregates of the caller's own.
    """
    key = list(key)
    chosen = _policies(columns or sightings.columns, policies, key)
    at = F.col(order)
    aggs: list[Column] = []

    last = [F.col(c) for c in _of(chosen, LAST)]
    # Of a text that is never filled only null or '' can be the last value.
    last += [F.col(c).isNull().alias(f"{c}_null") for c in _of(chosen, FIRST_FILLED)]
    if last:
        aggs += [F.max_by(F.struct(*last), at).alias("last"), F.max(at).alias("last_at")]
    first = [F.col(c) for c in _of(chosen, FIRST)]
    if first:
        aggs += [F.min_by(F.struct(*first), at).alias("first"), F.min(at).alias("first_at")]
    for c in _of(chosen, LATEST):
        when = F.when(F.col(c).isNotNull(), at)
        aggs += [F.max_by(c, when).alias(c), F.max(when).alias(f"{c}_at")]
    for c in _of(chosen, FIRST_FILLED):
        when = F.when(nonempty(F.col(c)), at)
        aggs += [F.min_by(c, when).alias(c), F.min(when).alias(f"{c}_at")]
    aggs += [F.max(c).alias(c) for c in _of(chosen, MAXIMUM)]
    return _grouped(sightings, key).agg(*aggs, *more).drop("_hash")


def combine_states(
    states: DataFrame,
    policies: Mapping[str, str] = LISTING_POLICIES,
    key: Iterable[str] = KEY,
) -> DataFrame:
    """Fold states of the same key into one; associative and commutative."""
    key = list(key)
    chosen = _policies(states.columns, policies, key)
    aggs: list[Column] = []
    if "last" in states.columns:
        aggs += [F.max_by("last", "last_at").alias("last"), F.max("last_at").alias("last_at")]
    if "first" in states.columns:
        aggs += [F.min_by("first", "first_at").alias("first"), F.min("first_at").alias("first_at")]
    for c in _of(chosen, LATEST):
        aggs += [F.max_by(c, f"{c}_at").alias(c), F.max(f"{c}_at").alias(f"{c}_at")]
    for c in _of(chosen, FIRST_FILLED):
        aggs += [F.min_by(c, f"{c}_at").alias(c), F.min(f"{c}_at").alias(f"{c}_at")]
    aggs += [F.max(c).alias(c) for c in _of(chosen, MAXIMUM)]
    return _grouped(states, key).agg(*aggs).drop("_hash")


def golden_rows(
    states: DataFrame,
    policies: Mapping[str, str] = LISTING_POLICIES,
    key: Iterable[str] = KEY,
) -> DataFrame:
    """The golden listing of each state."""
    key = list(key)
    out: dict[str, Column] = {k: F.col(k) for k in key}
    for group in ("first", "last"):
        if group in states.columns:
            for name in states.schema[group].dataType.names:
                if policies.get(name) in (FIRST, LAST):
                    out[name] = F.col(group).getField(name)
    for c in _policies(states.columns, policies, key):
        out[c] = F.col(c)
        if policies[c] == FIRST_FILLED:
            empty = F.when(~F.col("last").getField(f"{c}_null"), F.lit(""))
            out[c] = F.coalesce(F.col(c), empty)
    return states.select([value.alias(name) for name, value in out.items()])


def merge_listings(
    sightings: DataFrame,
    order: str = "seq",
    policies: Mapping[str, str] = LISTING_POLICIES,
    columns: Iterable[str] | None = None,
    key: Iterable[str] = KEY,
) -> DataFrame:
    """Golden listings straight from a table of sightings."""
    key = list(key)
    states = fold_sightings(sightings, order, policies, columns, key)
    return golden_rows(states, policies, key)


def latest_per_key(log: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Last write per key, nulls included."""
    return log.groupBy(key).agg(
        F.max_by(value, order).alias(value), F.max(order).alias(order)
    )
