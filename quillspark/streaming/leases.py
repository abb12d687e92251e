"""The work queue as a stream: one state a robot and reference, a timer a lease, by event time.

Events ask for work (requested), take it with a lease (claimed), prolong the lease (renewed) or end it
with a state of the queue's. A lease that no event ends in time expires when the watermark passes it; the
attempt is then replaced by a new pending one, up to ``MAX_RETRIES``, as :mod:`quillspark.operators.workqueue`
does with tables. An event that comes after a lease's end meets an expired attempt even if its batch
is the same, so what comes out doesn't depend on how events fall into batches, as long as each state's events
arrive in order or in one batch. The checkpoint holds states, timers and watermark for a restart.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quillspark.operators.workqueue import MAX_RETRIES, TRANSITIONS

CHANGES = "robot_id long, reference_id long, attempt int, status string, at timestamp"
_STATE = StructType([StructField("attempt", IntegerType()), StructField("status", StringType()), StructField("until", LongType())])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(state: tuple[int, str, int], at: int, kind: str, minutes: int) -> tuple[tuple[int, str, int], list[tuple[int, str, int]]]:
    """The state after an event, and the changes (attempt, status, time in ms) that it makes.

    A state is (attempt, status, end of the lease); attempt -1 is none. What the queue's rules don't allow is refused.
    """
    state, out = expire(state, at)
    attempt, status, until = state
    if kind == "requested":
        if attempt >= 0 and TRANSITIONS[status]:
            return state, [*out, (attempt, "refused", at)]
        return (attempt + 1, "pending", 0), [*out, (attempt + 1, "pending", at)]
    if kind == "renewed" and status == "processing" and minutes > 0:
        return (attempt, status, at + minutes * 60_000), [*out, (attempt, "renewed", at)]
    after = "processing" if kind == "claimed" else kind
    if attempt < 0 or after not in TRANSITIONS[status] or (kind == "claimed" and minutes <= 0):
        return state, [*out, (attempt, "refused", at)]
    return (attempt, after, at + minutes * 60_000 if after == "processing" else 0), [*out, (attempt, after, at)]


def expire(state: tuple[int, str, int], now: int) -> tuple[tuple[int, str, int], list[tuple[int, str, int]]]:
    """The state once ``now`` has come: a lease that ended before is expired, and the attempt made anew."""
    attempt, status, until = state
    if status != "processing" or until >= now:
        return state, []
    if attempt >= MAX_RETRIES:
        return (attempt, "expired", 0), [(attempt, "expired", until)]
    return (attempt + 1, "pending", 0), [(attempt, "expired", until), (attempt + 1, "pending", until)]


class _Leases(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)

    def _read(self) -> tuple[int, str, int]:
        return tuple(self.state.get()) if self.state.exists() else (-1, "", 0)

    def _write(self, before: tuple[int, str, int], after: tuple[int, str, int]) -> None:
        if before == after:
            return
        self.state.update(after)
        if before[2] != after[2]:
            # A timer fires once the watermark is past the lease's last instant.
            if before[2]:
                self.handle.deleteTimer(before[2] + 1)
            if after[2]:
                self.handle.registerTimer(after[2] + 1)

    def _rows(self, key, changes: list[tuple[int, str, int]]) -> Iterator[Row]:
        for attempt, status, at in changes:
            yield Row(robot_id=key[0], reference_id=key[1], attempt=attempt, status=status, ms=at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted((r["micros"], r["event_id"], r["kind"], r["minutes"]) for r in rows)
        before = state = self._read()
        changes = []
        for micros, _, kind, minutes in events:
            state, made = step(state, micros // 1000, kind, minutes)
            changes += made
        self._write(before, state)
        yield from self._rows(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before = self._read()
        after, changes = expire(before, expiredTimerInfo.getExpiryTimeInMs())
        self.state.update(after)
        yield from self._rows(key, changes)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _states_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Timers need this state store; the session's own choice is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def queue_changes(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Changes of a stream of events (event_id, at, robot_id, reference_id, kind, minutes) as a stream.

    ``at`` orders a state's events, then event_id; events no younger than the watermark, ``late`` behind the
    youngest event of earlier batches, come too late and are dropped. Rows with a null among them are left out.
    """
    rows = events.select("event_id", "at", "robot_id", "reference_id", "kind", "minutes").dropna().withWatermark("at", late)
    # Times go to Python as numbers, and a state's few events as plain rows: a frame for each would cost more than they do.
    timed = rows.withColumn("micros", F.unix_micros("at")).groupBy("robot_id", "reference_id")
    found = timed.transformWithState(_Leases(), "robot_id long, reference_id long, attempt int, status string, ms long", "Append", "EventTime")
    return found.select("robot_id", "reference_id", "attempt", "status", F.timestamp_millis("ms").alias("at"))


def run_queue(events: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Write the changes of all events that are there now to ``folder``; a later run goes on from the checkpoint."""
    with _states_in_rocksdb(events.sparkSession):
        return queue_changes(events, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
