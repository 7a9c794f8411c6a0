"""Streaming merge, delivery and lifecycle jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delivery import delivery_records
from ..operators.merge import KEY, combine_states, fold_sightings, golden_rows
from ..operators.tasks import combine_marks, fold_marks, lifecycle_marks
from ..workspace import is_file
from . import states
from .keyed import rocksdb_state, sliding_recency, stale_claims

DRAIN = {"availableNow": True}


def stream_parquet(
    spark: SparkSession, path: str, schema, max_files: int | None = None
) -> DataFrame:
    """New Parquet files of a folder, or a single file, as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _start(stream: DataFrame, each, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def start_merge(
    sightings: DataFrame,
    root: str,
    checkpoint: str,
    columns: Iterable[str] | None = None,
    trigger: dict = DRAIN,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Fold a stream of sightings into the states under ``root``.

    With ``compact_every`` each so many batches are folded into one base.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        states.write_batch(fold_sightings(batch, columns=columns), root, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_merge(batch.sparkSession, root)

    return _start(sightings, each, checkpoint, trigger)


def golden_table(spark: SparkSession, root: str, sightings: DataFrame | None = None) -> DataFrame:
    """Golden listings as of the last finished micro-batch.

    With ``sightings`` (for their schema) there are no rows before the first one.
    """
    empty = None if sightings is None else fold_sightings(spark.createDataFrame([], sightings.schema))
    return golden_rows(states.read_states(spark, root, combine_states, empty))


def compact_merge(spark: SparkSession, root: str) -> int:
    return states.compact(spark, root, combine_states)


_SENT = [f"_sent_{k}" for k in KEY]


def start_delivery(
    sightings: DataFrame,
    jobs: DataFrame,
    source: str,
    out: str,
    checkpoint: str,
    trigger: dict = DRAIN,
    compact_every: int | None = None,
    changes: bool = False,
) -> StreamingQuery:
    """Deliver each listing once, in the micro-batch that first sees its key.

    The listings' merge states and the batch that first saw each are keyed
    state in RocksDB: a batch reads the states of its own keys and nothing of
    what was delivered before. The record has what the sightings of that batch
    say. Later sightings of a delivered key send nothing, or, with ``changes``,
    the listing as it is now. A replayed batch has the time and the state it
    had at first, and decides the same again.
    """
    spark = sightings.sparkSession
    now = F.current_timestamp()  # of the micro-batch
    kept = fold_sightings(sightings.withColumn("_at", now), more=[F.min("_at").alias("_first_batch")])
    due = kept.withColumn("_new", F.col("_first_batch") == now)

    def records(batch: DataFrame) -> DataFrame:
        listings = golden_rows((batch if changes else batch.where("_new")).drop("_first_batch", "_new"))
        keyed = listings.select("*", *[F.col(k).alias(s) for s, k in zip(_SENT, KEY)])
        return delivery_records(keyed, jobs, source, carry=tuple(_SENT))

    def each(batch: DataFrame, batch_id: int) -> None:
        states.write_batch(records(batch), out, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            states.compact(batch.sparkSession, out, _as_they_are)
            states.retain(batch.sparkSession, out)

    states.prepare(records(spark.createDataFrame([], due.schema)), out)
    with rocksdb_state(spark):
        return _start(due, each, checkpoint, trigger, mode="update")


def _as_they_are(records: DataFrame) -> DataFrame:
    return records


def delivered(spark: SparkSession, out: str) -> DataFrame:
    return states.read_states(spark, out, _as_they_are).drop(*_SENT)


def start_lifecycle(
    log: DataFrame, root: str, checkpoint: str, trigger: dict = DRAIN, compact_every: int | None = None
) -> StreamingQuery:
    """Digest a stream of task events under ``root``.

    With ``compact_every`` each so many batches are folded into one base, and
    what it covers is deleted.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        states.write_batch(lifecycle_marks(batch), root, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            states.compact(batch.sparkSession, root, combine_marks)
            states.retain(batch.sparkSession, root)

    states.prepare(lifecycle_marks(log.sparkSession.createDataFrame([], log.schema)), root)
    return _start(log, each, checkpoint, trigger)


def task_states(spark: SparkSession, root: str) -> DataFrame:
    """Current state of each task as of the last finished micro-batch."""
    return fold_marks(states.read_states(spark, root, combine_marks))


def _start_table(rows: DataFrame, out: str, checkpoint: str, trigger: dict, compact_every: int | None) -> StreamingQuery:
    """Write what a keyed stream gives; each row comes once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        states.write_batch(batch, out, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            states.compact(batch.sparkSession, out, _as_they_are)
            states.retain(batch.sparkSession, out)

    states.prepare(rows.sparkSession.createDataFrame([], rows.schema), out)
    with rocksdb_state(rows.sparkSession):
        return _start(rows, each, checkpoint, trigger)


def start_reclaim(
    log: DataFrame, out: str, checkpoint: str, timeout: str, delay: str, trigger: dict = DRAIN, compact_every: int | None = None
) -> StreamingQuery:
    """Write the claims that nothing ended within ``timeout`` when their time comes."""
    return _start_table(stale_claims(log, timeout, delay), out, checkpoint, trigger, compact_every)


def start_recency(
    sightings: DataFrame, out: str, checkpoint: str, delay: str, step: str = "1 hour", trigger: dict = DRAIN,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Write the listings of the last hour and day per job at every ``step`` of the stream's time."""
    return _start_table(sliding_recency(sightings, delay, step), out, checkpoint, trigger, compact_every)


def table_so_far(spark: SparkSession, out: str) -> DataFrame:
    """Rows of a keyed stream up to the last finished micro-batch."""
    return states.read_states(spark, out, _as_they_are)
