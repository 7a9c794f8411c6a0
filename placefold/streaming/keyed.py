"""Streams whose state Spark keeps by key: timers for claims, sliding windows.

State lives in the RocksDB store, with a change log per batch: a batch reads
and writes the keys it meets, not what was seen before.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.times import as_instant, as_zone_free, plus_seconds
from ..operators.tasks import RECLAIMED, WRITES

# The processors travel inside their tasks, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; they copy the settings when they start."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _seconds(text: str) -> float:
    """Seconds of an interval such as '90 seconds', '10 minutes', '1 hour' or '1 day'."""
    number, unit = text.split()
    return timedelta(**{unit.rstrip("s") + "s": float(number)}).total_seconds()


# Stale claims


def ends_claim(event: str, token: str | None, claim_token: str | None) -> bool:
    """Whether a later event ends a claim: a write under its token, or any other event."""
    return token == claim_token if event in WRITES else True


class StaleClaims(StatefulProcessor):
    """Per task the claims whose deadline the stream has not reached yet.

    A claim is over if an event that ends it has a higher number and a time up
    to the deadline. Which of the two arrives first does not matter. Events
    are dropped from the state once the watermark has passed all they can end.
    """

    def __init__(self, timeout_s: float) -> None:
        self.timeout = int(timeout_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "seq long, event string, token string, at long")

    def _open(self, events: list[tuple]) -> list[tuple]:
        return [
            c for c in events
            if c[1] == "claim" and not any(
                e[0] > c[0] and c[3] <= e[3] <= c[3] + self.timeout and ends_claim(e[1], e[2], c[2]) for e in events
            )
        ]

    def _keep(self, claims: list[tuple], events: list[tuple], watermark: int) -> None:
        """Open claims, and events that a claim not yet seen could still be ended by."""
        kept = claims + [e for e in events if e not in claims and e[3] >= watermark]
        if kept:
            self.events.put(kept)
            for at in {c[3] + self.timeout for c in claims} | {max(e[3] for e in kept) + 1}:
                self.handle.registerTimer(at)
        else:
            self.events.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        events = sorted({*known, *((r.seq, r.event, r.token, r.at) for r in rows)}, key=lambda e: (e[0], e[1]))
        self._keep(self._open(events), events, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        claims = self._open(events)
        reached = expiredTimerInfo.getExpiryTimeInMs()
        fired = [c for c in claims if c[3] + self.timeout <= reached]
        rest = [e for e in events if e not in fired]
        self._keep([c for c in claims if c not in fired], rest, timerValues.getCurrentWatermarkInMs())
        for seq, _, token, at in fired:
            yield Row(shard_id=key[0], claim_seq=seq, token=token, claimed_at=at)

    def close(self) -> None:
        pass


def stale_claims(log: DataFrame, timeout: str, delay: str) -> DataFrame:
    """The stream of claims that nothing ended within ``timeout``: tasks back to retry.

    ``log`` has shard_id, seq, event, token, ts. Rows come once the stream's
    time (the newest ts less ``delay``) has passed the deadline; events that are
    later than ``delay`` are not regarded.
    """
    events = log.select("shard_id", "seq", "event", "token", as_instant(F.col("ts")).alias("time")).withWatermark("time", delay)
    timed = events.withColumn("at", F.unix_millis("time"))
    fired = timed.groupBy("shard_id").transformWithState(
        StaleClaims(_seconds(timeout)), "shard_id long, claim_seq long, token string, claimed_at long", "Append", "EventTime"
    )
    claimed = as_zone_free(F.timestamp_millis("claimed_at"))
    return fired.select(
        "shard_id", "claim_seq", "token", claimed.alias("claimed_at"),
        plus_seconds(claimed, _seconds(timeout)).alias("reclaimed_at"),
        F.lit("retry").alias("status"), F.lit(RECLAIMED).alias("last_error"),
    )


def stale_claims_batch(log: DataFrame, timeout: str, upto) -> DataFrame:
    """What ``stale_claims`` has given when the stream's time is ``upto``, from the whole log."""
    claims = log.where(F.col("event") == "claim").select(
        "shard_id", F.col("seq").alias("claim_seq"), "token", F.col("ts").alias("claimed_at"),
        plus_seconds(F.col("ts"), _seconds(timeout)).alias("reclaimed_at"),
    ).distinct()
    later = log.select("shard_id", F.col("seq").alias("_seq"), "event", F.col("token").alias("_token"), F.col("ts").alias("_ts"))
    own = ~F.col("event").isin(*WRITES) | F.col("token").eqNullSafe(F.col("_token"))
    ended = claims.join(later, "shard_id").where(
        (F.col("_seq") > F.col("claim_seq")) & F.col("_ts").between(F.col("claimed_at"), F.col("reclaimed_at")) & own
    )
    return claims.where(F.col("reclaimed_at") <= upto).join(ended, ["shard_id", "claim_seq"], "left_anti")


# Sliding windows


DAY, HOUR = 86_400, 3_600
LATE = "late_windows"


class RecentListings(StatefulProcessor):
    """Per job and bucket of listings, what the windows still open can see: each listing's times, cut to units.

    Every bound of a window is a multiple of the unit, so a sighting needs one
    row of state, not one for each window that it lies in. A listing enters a
    window's count by the latest sighting before it, as a range of windows;
    the ranges' ends are summed up over the windows that are due.
    """

    def __init__(self, step: int) -> None:
        self.step = step
        self.unit = math.gcd(step, HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "done long, timer long, rows binary")

    def _known(self) -> tuple[int | None, int | None, pd.DataFrame]:
        if not self.seen.exists():
            return None, None, pd.DataFrame({"dedupe_key": pd.Series([], dtype=object), "at": pd.Series([], dtype="int64")})
        done, timer, rows = self.seen.get()
        with pa.ipc.open_stream(rows) as stored:
            return done, timer, stored.read_pandas()

    def _keep(self, done: int, timer: int | None, rows: pd.DataFrame) -> None:
        rows = rows[rows["at"] + DAY > done]
        if not len(rows):
            self.seen.clear()
            return
        # The first window end after what is done and after the earliest sighting.
        due = (self._index(max(done + 1, int(rows["at"].min()) + self.unit)) * self.step + DAY) * 1000
        if timer is None or due < timer or timer <= done * 1000:
            self.handle.registerTimer(due)
            timer = due
        table = pa.table({"dedupe_key": pa.array(rows["dedupe_key"], pa.string()), "at": pa.array(rows["at"], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stored:
            stored.write_table(table)
        self.seen.update((done, timer, sink.getvalue().to_pybytes()))

    def _index(self, end):
        """Number of the first window that ends at or after ``end``; window i ends at i * step + DAY."""
        return -((DAY - end) // self.step)

    def _counts(self, rows: pd.DataFrame, after: int, upto: int) -> pd.DataFrame:
        """Listings of the last hour and day at each window end in (after, upto]."""
        low, high = self._index(after + 1), self._index(upto + 1)
        low = max(low, int(self._index(int(rows["at"].min()) + self.unit))) if len(rows) else high
        high = min(high, int(self._index(int(rows["at"].max()) + DAY + 1))) if len(rows) else low
        if high <= low:
            return pd.DataFrame({"end": [], "hour": [], "day": []}, dtype="int64")
        key = pd.factorize(rows["dedupe_key"], use_na_sentinel=False)[0]
        at = rows["at"].to_numpy()
        order = np.lexsort((at, key))
        key, at = key[order], at[order]
        follows = np.concatenate([[False], key[1:] == key[:-1]])
        before = np.concatenate([[0], at[:-1]])
        found = {"end": np.arange(low, high) * self.step + DAY}
        for name, span in (("hour", HOUR), ("day", DAY)):
            begin = np.where(follows, np.maximum(before + span + 1, at + self.unit), at + self.unit)
            first = np.clip(self._index(begin), low, high) - low
            last = np.clip(self._index(at + span + 1), low, high) - low
            last = np.maximum(first, last)
            change = np.bincount(first, minlength=high - low + 1) - np.bincount(last, minlength=high - low + 1)
            found[name] = np.cumsum(change)[: high - low]
        counts = pd.DataFrame(found)
        return counts[counts["day"] > 0]

    def _out(self, job, ends, hour=0, day=0, late=0) -> pd.DataFrame:
        ends = pd.to_datetime(pd.Series(ends, dtype="int64"), unit="s").dt.tz_localize("UTC")
        return pd.DataFrame(
            {"job_id": pd.Series([job] * len(ends), dtype=object), "end": ends, "hour": hour, "day": day, "late": late}
        )

    def _due(self, job, done: int, rows: pd.DataFrame, mark: int) -> Iterator[pd.DataFrame]:
        counts = self._counts(rows, done, mark)
        if len(counts):
            yield self._out(job, counts["end"].to_numpy(), counts["hour"].to_numpy(), counts["day"].to_numpy())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        done, timer, known = self._known()
        if done is not None and mark > done:
            yield from self._due(key[0], done, known, mark)  # closed windows stay as they are
        new = pd.concat([r[["dedupe_key", "at"]] for r in rows]).drop_duplicates()
        at = new["at"].to_numpy()
        late = np.maximum(0, np.minimum(self._index(at + DAY + 1), self._index(mark + 1)) - self._index(at + self.unit)).sum()
        if late:
            yield self._out(key[0], [mark + self.step], late=int(late))
        self._keep(mark, timer, pd.concat([known, new]).drop_duplicates())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        done, timer, known = self._known()
        if done is not None and mark > done:
            yield from self._due(key[0], done, known, mark)
            self._keep(mark, None, known)

    def close(self) -> None:
        pass


def sliding_recency(seen: DataFrame, delay: str, step: str = "1 hour", buckets: int = 256) -> DataFrame:
    """Distinct listings per job in the last hour and the last day, at every ``step``.

    ``seen`` is a stream of sightings (job_id, dedupe_key, observed_at). A row
    for a window's end comes once the stream's time has passed it. The listings
    of a job are dealt to ``buckets``; a batch reads and writes those that it
    meets, with the listings of a day. Their counts are summed per job.
    """
    processor = RecentListings(int(_seconds(step)))
    time = as_instant(F.col("observed_at"))
    timed = seen.select("job_id", "dedupe_key", time.alias("time")).withWatermark("time", delay).where("time IS NOT NULL")
    at = F.floor(F.unix_micros("time") / F.lit(processor.unit * 1_000_000)).cast("long") * processor.unit
    dealt = timed.select("job_id", "dedupe_key", at.alias("at"), F.pmod(F.xxhash64("dedupe_key"), F.lit(buckets)).alias("bucket"))
    parts = dealt.groupBy("job_id", "bucket").transformWithStateInPandas(
        processor, "job_id string, end timestamp, hour long, day long, late long", "Append", "EventTime", eventTimeColumnName="end"
    )
    told = parts.observe(LATE, F.sum("late").alias("windows")).where("late = 0")
    counted = told.groupBy("end", "job_id").agg(F.sum("hour").alias("seen_last_hour"), F.sum("day").alias("seen_last_day"))
    return counted.select("job_id", as_zone_free(F.col("end")).alias("window_end"), "seen_last_hour", "seen_last_day")


def late_rows(query: StreamingQuery) -> int:
    """Rows a query left out because they came behind the watermark, over its recent batches.

    Spark drops such a row where it would first change the state; a row of a
    window stream counts once for each window it is too late for.
    """
    return sum(
        sum(op.get("numRowsDroppedByWatermark", 0) for op in _operators(p)[-1:]) + _late_windows(p) for p in query.recentProgress
    )


def _told(progress) -> dict:
    return json.loads(progress.json) if hasattr(progress, "json") else progress


def _late_windows(progress) -> int:
    return (_told(progress).get("observedMetrics") or {}).get(LATE, {}).get("windows") or 0


def _operators(progress) -> list[dict]:
    return _told(progress).get("stateOperators", [])
