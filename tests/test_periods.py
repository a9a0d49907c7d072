"""Open periods with state and timers against the batch form."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewell.session import scratch_path
from tidewell.streaming import lifecycle, periods

START = datetime(2031, 5, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([3, 9])), min_size=1, max_size=14), st.integers(1, 5))
def test_periods_in_any_order_and_any_chunks(sightings, chunk):
    """Brute force: minutes covered by any sighting, in runs."""
    got = []
    for i in range(0, len(sightings), chunk):
        part = np.array(sightings[i:i + chunk])
        got = periods.merged(got + periods.periods_of(part[:, 0], part[:, 0] + part[:, 1]))
    want = []
    for at, gap in sorted(sightings):
        if want and at <= want[-1][3]:
            first, last, n, closes = want[-1]
            want[-1] = (first, max(last, at), n + 1, max(closes, at + gap))
        else:
            want.append((at, at, 1, at + gap))
    assert got == want


def test_timers_are_never_early():
    assert [periods.timer_of(t) for t in (0, 1, 999, 1000, 1001)] == [0, 1, 1, 1, 2]


def test_stream_of_many_batches_equals_the_table(spark):
    rnd = random.Random(7)
    rows = []
    for hour in range(0, 24 * 20):
        for key in ("hot", *rnd.sample(["a", "b", "c", "d"], 1 if rnd.random() < 0.08 else 0)):
            if key != "hot" or rnd.random() < 0.25:
                rows.append((key, START + timedelta(hours=hour, minutes=rnd.randint(0, 59), microseconds=rnd.randint(0, 999)), rnd.random() < 0.2))
    rows.append((None, START + timedelta(hours=5), False))
    rows.sort(key=lambda r: r[1] + timedelta(hours=rnd.randint(0, 5)))  # late, within the lateness
    end = max(r[1] for r in rows)
    path = scratch_path(spark, "sightings")
    schema = "key string, at timestamp, down boolean"
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i:i + 40], schema).coalesce(1).write.mode("append").parquet(path)
    spans = {"stale": "8 hours", "stale_failed": "16 hours", "lateness": "6 hours"}
    batch = lifecycle.lifecycles(spark.read.parquet(path), "key", "at", F.col("down"), **spans)
    out = scratch_path(spark, "closed")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    with periods.with_rocks(spark):
        query = (periods.closed_periods(stream, "key", "at", F.col("down"), **spans).writeStream.format("parquet").outputMode("append")
                 .option("checkpointLocation", out + "/checkpoint").trigger(availableNow=True).start(out + "/rows"))
        query.awaitTermination()
    got = {(r["key"], r["first_seen"], r["last_seen"], r["n_seen"], r["closes_at"]) for r in spark.read.parquet(out + "/rows").collect()}
    every = {(r["key"], r["first_seen"], r["last_seen"], r["n_seen"], r["closes_at"]) for r in batch.collect()}
    done = {r for r in every if r[4] <= end - timedelta(hours=6)}
    assert got == done and len(query.recentProgress) > 3
    # a closed posting has no state left
    still_open = {r[0] for r in every - done}
    states = spark.read.format("statestore").option("stateVarName", "open").load(out + "/checkpoint")
    assert {r["key"][0] for r in states.select("key").collect()} == still_open


class Handle:
    """Value state and timers of one key, with the calls counted."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_one_timer_and_one_frame_however_many_periods_a_key_has():
    handle, processor, hour = Handle(), periods.OpenPeriods(), 3_600_000_000
    processor.init(handle)
    seen = np.arange(0, 1000) * 10 * hour
    frames = list(processor.handleInputRows((7,), iter([pd.DataFrame({"seen": seen, "until": seen + 8 * hour})]), TimerValues(0, 0)))
    assert not any(len(f) for f in frames) and handle.timers == {8 * hour // 1000} and handle.calls == 1

    def fire(watermark):
        at = min(handle.timers)
        frames = [f for f in processor.handleExpiredTimer((7,), TimerValues(0, watermark), ExpiredTimerInfo(at)) if len(f)]
        handle.timers.discard(at)  # Spark deletes it after the call
        return frames

    first, = fire(5_005 * hour // 1000)
    assert list(first["n_seen"]) == [1] * 500 and first["entity"].unique() == [7] and handle.timers == {5_008 * hour // 1000}
    rest, = fire(20_000 * hour // 1000)
    assert len(rest) == 500 and handle.value is None and not handle.timers
