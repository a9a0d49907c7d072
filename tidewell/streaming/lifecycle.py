"""Structured Streaming forms of what the batch keeps between runs.

All three are built from event-time operators with partial aggregation, so they
give the same rows on a stream and on a table; the batch result is the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lifecycles(sightings: DataFrame, key: str, ts: str, failed: Column | None = None, stale: str = "7 days",
               stale_failed: str = "30 days", lateness: str = "12 hours") -> DataFrame:
    """Open periods of postings (L1): first and last seen, number of sightings, closing time.

    A posting closes when it is not seen for ``stale``; sightings of a failed
    source keep it open for ``stale_failed``.  A new sighting after that opens a
    new period.
    """
    down = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    timed = sightings.withColumn("_down", down).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    gap = F.when(F.col("_down"), F.lit(stale_failed)).otherwise(F.lit(stale))
    until = F.col("_ts") + F.when(F.col("_down"), F.expr(f"INTERVAL '{stale_failed}'")).otherwise(F.expr(f"INTERVAL '{stale}'"))
    # closes_at is an aggregate, not the end of the window: a filter on a grouping key would be
    # pushed below the merging of sessions and cut them short
    return timed.groupBy(F.session_window("_ts", gap).alias("period"), key).agg(
        F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen"), F.count(F.lit(1)).alias("n_seen"), F.max(until).alias("closes_at"),
    ).select(key, "first_seen", "last_seen", "n_seen", "closes_at")


def first_sightings(sightings: DataFrame, keys: list[str], ts: str, lateness: str = "12 hours") -> DataFrame:
    """Stream without repeats inside the watermark (L2)."""
    timed = sightings.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return timed.dropDuplicatesWithinWatermark(keys)


def outage_windows(log: DataFrame, source: str, ts: str, failed: Column, window: str = "1 day", lateness: str = "12 hours") -> DataFrame:
    """Fetches and failures per source and window (L3)."""
    timed = log.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy(F.window("_ts", window).alias("w"), source).agg(
        F.count(F.lit(1)).alias("n_fetches"), F.count_if(failed).alias("n_failed"),
    ).select(F.col("w.start").alias("window_start"), source, "n_fetches", "n_failed")


def run_available(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything that has arrived and stop; appended rows are files."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(out_path))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
