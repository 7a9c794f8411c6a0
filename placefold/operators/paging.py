"""Ordered pages of rows and prefixes of result pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import top_per_key
from ..functions.text import nonempty, result_total
from .merge import KEY, merge_listings


def page_size(limit: int, max_rows: int | None = None) -> int:
    """At least one row. A service's own maximum is a parameter, and asking for more an error."""
    if max_rows is not None and limit > max_rows:
        raise ValueError(f"a page of {limit} rows was asked for, {max_rows} are allowed")
    return max(limit, 1)


def page_of(
    df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, max_rows: int | None = None
) -> DataFrame:
    """Rows offset..offset+limit in a given order (a top-k, never a full sort).

    The cost grows with the offset; go through a whole table by ``after_id``.
    """
    return df.orderBy(*order).offset(max(offset, 0)).limit(page_size(limit, max_rows))


def listing_page(
    sightings: DataFrame,
    columns: tuple[str, ...],
    limit: int = 100,
    offset: int = 0,
    order: str = "seq",
) -> DataFrame:
    """A page of golden listings by id, straight from sightings.

    A listing's id is its first arrival, so the page's keys are known from a
    cheap minimum per key; only their sightings (at most a page of keys, small
    enough for Spark to broadcast) are merged.
    """
    first_seen = sightings.groupBy(*KEY).agg(F.min(order).alias("id"))
    keys = page_of(first_seen, [F.col("id")], limit, offset).select(*KEY)
    page = sightings.join(keys, list(KEY), "left_semi")
    return merge_listings(page, order, columns=("id", *columns)).orderBy("id")


def after_id(df: DataFrame, last_id: int, limit: int | None = None) -> DataFrame:
    """Rows behind a cursor; the id bound reaches the scan."""
    rows = df.where(F.col("id") > last_id)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), F.col("id"))


def by_id(df: DataFrame, row_id) -> DataFrame:
    return df.where(F.col("id") == F.lit(row_id)).limit(1)


def task_page(
    shards: DataFrame, job_id: str, status: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Tasks of a job, latest update first."""
    rows = shards.where(F.col("job_id") == job_id)
    if status:
        rows = rows.where(F.col("status") == status)
    return page_of(rows, [F.col("updated_at").desc(), F.col("id").desc()], limit, offset)


def task_counts(shards: DataFrame) -> DataFrame:
    """Number of tasks per job and status."""
    return shards.groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("total"))


def task_errors(shards: DataFrame, limit: int = 25, max_rows: int | None = None) -> DataFrame:
    """The newest ``limit`` tasks with an error of every job."""
    return top_per_key(
        shards.where(nonempty(F.col("last_error"))),
        "job_id",
        [F.col("updated_at").desc(), F.col("id").desc()],
        page_size(limit, max_rows),
        rank="position",
        spread_by=F.col("id"),
    )


def page_totals(pages: DataFrame) -> DataFrame:
    """Announced total of each result page, its own row count without one."""
    return pages.withColumn(
        "total", F.coalesce(result_total(F.col("count_text")), F.col("n_results").cast("bigint"))
    )


def full_page_prefix(
    pages: DataFrame, per_page: int = 30, max_pages: int = 10, key: str = "query_id"
) -> DataFrame:
    """Pages up to and including the first short one, at most ``max_pages``.

    The stop page is a minimum per query, aggregated before the shuffle; no
    query's pages are gathered in one task.
    """
    wanted = pages.where(F.col("page") <= max_pages)
    stops = (
        wanted.where(F.col("n_results") < per_page).groupBy(key).agg(F.min("page").alias("stop"))
    )
    return (
        wanted.join(stops, key, "left")
        .where(F.col("page") <= F.coalesce("stop", F.lit(max_pages)))
        .drop("stop")
    )
