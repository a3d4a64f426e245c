"""Job states from a stream of their events: the last state of each job by event time, until its result expires.

A job is PENDING when it is sent, PROCESSING while it runs, and SUCCESS or FAILURE when it ends; what has ended stays so,
and of two ends the earlier counts. A result is kept for EXPIRY after its end; then it is EXPIRED and forgotten. Events
may be late, out of order and repeated: a job's answer depends on the set of its events alone, as long as it is not
forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a result is kept.
EXPIRY = 3600
#: States in the order of a job's life.
STATES = ("PENDING", "PROCESSING", "SUCCESS", "FAILURE", "EXPIRED")
OUTPUT = "job_id long, state string, at long, events long"
#: The state store that keyed state with timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def later(a: tuple | None, b: tuple) -> tuple:
    """Of two (rank, time) the one that tells the state: an end before what is no end, the earlier of two ends, the later
    rank and then the earlier time otherwise."""
    if a is None:
        return b
    ends = a[0] >= 2, b[0] >= 2
    if all(ends):
        return min(a, b, key=lambda x: (x[1], x[0]))
    return max(a, b, key=lambda x: (x[0], -x[1]))


class JobState(StatefulProcessor):
    """Per job: rank and time of its state, and how many events were seen. A timer runs from its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "rank int, at long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, events = (self.state.get()[:2], self.state.get()[2]) if self.state.exists() else (None, 0)
        before = now
        for part in rows:
            for rank, t in zip(part["rank"].tolist(), part["at"].tolist(), strict=True):
                now = later(now, (int(rank), int(t)))
            events += len(part)
        self.state.update((now[0], now[1], events))
        if now[0] >= 2 and now != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now[1] // 1000 + EXPIRY * 1000)
        yield self.row(key, STATES[now[0]], now[1], events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            _, at, events = self.state.get()
            self.state.clear()
            yield self.row(key, "EXPIRED", at + EXPIRY * 1_000_000, events)

    def row(self, key, state: str, at: int, events: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "state": [state], "at": [at], "events": [events]})

    def close(self) -> None:
        pass


def ranked(events: DataFrame) -> DataFrame:
    """events (job_id, state, ts) with the rank of their state and their time in microseconds; others are left out."""
    rank = F.array_position(F.array(*map(F.lit, STATES[:4])), F.col("state")) - 1
    rank = events.withColumn("rank", rank.cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    return rank.filter("rank >= 0 AND job_id IS NOT NULL AND ts IS NOT NULL").select("job_id", "rank", "ts", F.unix_micros("ts").alias("at"))


def job_states(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A row (job_id, state, since, events) for every change of a job in a batch, and one when its result expires.

    The session's state store must be PROVIDER. Events later than the delay are dropped by the watermark.
    """
    keyed = ranked(stream).withWatermark("ts", delay).groupBy("job_id")
    changed = keyed.transformWithStateInPandas(JobState(), OUTPUT, "Update", "EventTime")
    return changed.select("job_id", "state", F.timestamp_micros("at").alias("since"), "events")


def folded(events: DataFrame, as_of: int | None = None) -> DataFrame:
    """The same by one grouping over a finished table: job_id, state, since, events; with as_of (microseconds), results
    that ended EXPIRY or more before it are EXPIRED."""
    end, kept = F.col("rank") >= 2, EXPIRY * 1_000_000
    g = ranked(events).groupBy("job_id").agg(
        F.min(F.when(end, F.struct("at", "rank"))).alias("e"), F.max(F.when(~end, F.struct("rank", (-F.col("at")).alias("less")))).alias("o"), F.count(F.lit(1)).alias("events"),
    )
    ended = F.col("e").isNotNull()
    gone = ended & (F.lit(as_of) - F.col("e.at") >= kept) if as_of is not None else F.lit(False)
    since = F.when(gone, F.col("e.at") + kept).when(ended, F.col("e.at")).otherwise(-F.col("o.less"))
    state = F.when(gone, "EXPIRED").otherwise(F.element_at(F.array(*map(F.lit, STATES)), F.coalesce("e.rank", "o.rank") + 1))
    return g.select("job_id", state.alias("state"), F.timestamp_micros(since).alias("since"), "events")
