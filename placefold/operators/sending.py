"""Batch delivery: send what is behind the cursor, then move the cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import path_exists
from .delivery import delivery_records
from .sync import sync_state_fold, undelivered

RUN_FIELDS = (
    "job_id string, seq bigint, ts timestamp_ntz, event string, last_id bigint, synced bigint, message string"
)
_LEAD = "_lead_id"


def delivery_log(spark, log: str) -> DataFrame:
    """All runs so far; no rows before the first."""
    if path_exists(spark, log):
        return spark.read.schema(RUN_FIELDS).parquet(log)
    return spark.createDataFrame([], RUN_FIELDS)


def deliver(
    leads: DataFrame, jobs: DataFrame, source: str, out: str, log: str, as_of: Column, force: bool = False
) -> int:
    """Write the records of one delivery under ``out`` and append its runs to ``log``.

    Only listings behind their job's cursor are sent; ``force`` sends all of
    them. The records are written first and the cursors follow from what was
    written, so a delivery that broke off is done again under the same number
    and none is skipped. A cursor never moves back. Returns the number.
    """
    spark = leads.sparkSession
    runs = delivery_log(spark, log)
    state = sync_state_fold(runs)
    number = (runs.agg(F.max("seq")).first()[0] or 0) + 1
    rows = leads if force else undelivered(leads, state)
    folder = f"{out}/{number}"
    sent = rows.withColumn(_LEAD, F.col("id"))
    delivery_records(sent, jobs, source, carry=(_LEAD,)).write.mode("overwrite").parquet(folder)
    done = (
        spark.read.parquet(folder)
        .groupBy("job_id")
        .agg(F.max(_LEAD).alias("last_id"), F.count(F.lit(1)).alias("synced"))
    )
    moved = done.join(state.select("job_id", "last_synced_id"), "job_id", "left").select(
        "job_id",
        F.lit(number).cast("bigint").alias("seq"),
        as_of.alias("ts"),
        F.lit("success").alias("event"),
        F.greatest("last_id", F.coalesce("last_synced_id", F.lit(0))).alias("last_id"),
        "synced",
        F.concat(F.lit("Synced "), F.col("synced").cast("string")).alias("message"),
    )
    moved.write.mode("append").parquet(log)
    return number
