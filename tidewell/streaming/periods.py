"""Life cycles with explicit state: open periods of a posting in value state, closed by event-time timers (L1).

Where session windows give a period only as a window, here every posting has a
state that says since when it is open, and the timer at its closing time writes
the closing and removes the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

STATE = "first_seen array<bigint>, last_seen array<bigint>, n_seen array<bigint>, closes_at array<bigint>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Period = tuple[int, int, int, int]
"""First and last seen, number of sightings, closing time; times in microseconds."""


def merged(periods: list[Period]) -> list[Period]:
    """Periods that touch or overlap as one, in order of time."""
    out: list[Period] = []
    for first, last, n, closes in sorted(periods):
        if out and first <= out[-1][3]:
            a = out[-1]
            out[-1] = (a[0], max(a[1], last), a[2] + n, max(a[3], closes))
        else:
            out.append((first, last, n, closes))
    return out


def periods_of(seen: np.ndarray, closes: np.ndarray) -> list[Period]:
    """Periods of sightings in any order: a new one begins where a sighting is later than all closing times before it."""
    order = np.argsort(seen, kind="stable")
    seen, closes = seen[order], closes[order]
    reach = np.maximum.accumulate(closes)
    starts = np.flatnonzero(np.concatenate(([True], seen[1:] > reach[:-1])))
    stops = np.concatenate((starts[1:], [len(seen)]))
    return [(int(seen[a]), int(seen[b - 1]), int(b - a), int(reach[b - 1])) for a, b in zip(starts, stops)]


def timer_of(closes: int) -> int:
    """Millisecond at which the watermark has reached a closing time."""
    return -(-closes // 1000)


def next_timer(periods: list[Period]) -> int | None:
    """Timer of the period that closes first."""
    return min((timer_of(p[3]) for p in periods), default=None)


class OpenPeriods(StatefulProcessor):
    """State of one key: its open periods, several only as long as sightings in between may still come.

    Every call on state or timers is a message to the JVM and every frame an
    Arrow batch, so a key has one timer, at its earliest closing time, and one
    frame of whatever the watermark has closed when it fires.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", STATE)

    def _held(self) -> list[Period]:
        held = self._open.get()
        return list(zip(*held)) if held else []

    def _keep(self, periods: list[Period]) -> None:
        if periods:
            self._open.update(tuple([int(p[i]) for p in periods] for i in range(4)))
        else:
            self._open.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self._held()
        after = before
        for chunk in rows:  # only periods are kept, however many sightings a key has
            after = merged(after + periods_of(chunk["seen"].to_numpy(np.int64), chunk["until"].to_numpy(np.int64)))
        old, new = next_timer(before), next_timer(after)
        if old != new:
            if old is not None:
                self._handle.deleteTimer(old)
            self._handle.registerTimer(new)
        self._keep(after)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        done, still = [p for p in held if timer_of(p[3]) <= now], [p for p in held if timer_of(p[3]) > now]
        if not done:
            return iter(())
        self._keep(still)
        if still:
            self._handle.registerTimer(next_timer(still))
        times = [pd.to_datetime([p[i] for p in done], unit="us") for i in (0, 1, 3)]
        return iter([pd.DataFrame({"entity": [key[0]] * len(done), "first_seen": times[0], "last_seen": times[1], "n_seen": [p[2] for p in done], "closes_at": times[2]})])

    def close(self) -> None:
        pass


def closed_periods(sightings: DataFrame, key: str, ts: str, failed: Column | None = None, stale: str = "7 days",
                   stale_failed: str = "30 days", lateness: str = "12 hours") -> DataFrame:
    """(key, first_seen, last_seen, n_seen, closes_at) of every period when the watermark reaches its closing time.

    The rows are those of ``lifecycle.lifecycles`` on the same sightings.  The
    session must use the RocksDB state store (see ``with_rocks``).
    """
    down = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    timed = sightings.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", lateness)
    until = F.col("event_time") + F.when(down, F.expr(f"INTERVAL '{stale_failed}'")).otherwise(F.expr(f"INTERVAL '{stale}'"))
    # names that begin with an underscore do not reach the processor
    rows = timed.select(F.col(key).alias("entity"), "event_time", F.unix_micros("event_time").alias("seen"), F.unix_micros(until).alias("until"))
    schema = StructType([StructField("entity", sightings.schema[key].dataType), StructField("first_seen", TimestampType()), StructField("last_seen", TimestampType()),
                         StructField("n_seen", LongType()), StructField("closes_at", TimestampType())])
    return rows.groupBy("entity").transformWithStateInPandas(OpenPeriods(), schema, "append", "EventTime").withColumnRenamed("entity", key)


class with_rocks:
    """The session with the RocksDB state store inside the block, and as it was after it."""

    def __init__(self, spark):
        self._conf = spark.conf

    def __enter__(self) -> None:
        self._before = self._conf.get(PROVIDER, None)
        self._conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_) -> None:
        if self._before is None:
            self._conf.unset(PROVIDER)
        else:
            self._conf.set(PROVIDER, self._before)
