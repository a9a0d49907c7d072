"""Snapshots of the posting table in buckets, published by a manifest.

Rows lie in a table that is bucketed by id, so a run's batch is brought to the
buckets and the state itself is not shuffled.  A run writes only buckets in
which something changes, under a version of its own; the manifest of the run
says which version of each bucket is live.  A run is published by the rename of
its manifest: readers see the whole run or nothing of it, older runs stay
readable until they expire, and of two runs at once the later rename fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.merge import close_stale, merge_resolved, resolve_ids
from ..session import cut_lineage
from .state import STATE_SCHEMA, conform_state


class PublishConflict(RuntimeError):
    """Another run has been published since this one read the state."""


@dataclass(frozen=True)
class Manifest:
    """One published run: the live version of every bucket, and the number of the stream's batch it holds, if any."""

    number: int
    run_date: str
    live: list[str]
    batch: int | None = None


class SnapshotStore:
    """Versions of a table with unique ids under one folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType = STATE_SCHEMA, key: str = "id", buckets: int = 32):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._table = "snapshot_" + hashlib.md5(f"{path}:{buckets}".encode()).hexdigest()[:16]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._of = hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._of(f"{path}/manifest"))
        self._fs.mkdirs(self._of(f"{path}/rows"))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table} ({columns}, version STRING) USING parquet PARTITIONED BY (version) "
                  f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/rows'")

    def bucket(self) -> Column:
        """Bucket of a row, as Spark deals rows out when it writes the table."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets))

    def numbers(self) -> list[int]:
        """Numbers of the published runs."""
        found = self._fs.listStatus(self._of(f"{self.path}/manifest"))
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest | None:
        """A published run, the newest one without a number."""
        known = self.numbers()
        if not known:
            return None
        text = self.spark.read.text(f"{self.path}/manifest/{known[-1] if number is None else number:06d}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame:
        """State after a run; an empty table before the first one."""
        live = self.manifest(number)
        self.spark.catalog.refreshTable(self._table)
        rows = self.spark.table(self._table)
        versions = sorted(set(live.live)) if live else []
        rows = rows.filter(F.col("version").isin(versions)) if versions else rows.filter(F.lit(False))
        if len(versions) > 1:  # rows of buckets that a later version replaced
            rows = rows.filter(F.col("version") == F.element_at(F.array(*[F.lit(v) for v in live.live]), self.bucket() + 1))
        return rows.select(*self.schema.fieldNames())

    def publish(self, rows: DataFrame, run_date: str, touched: list[int] | None = None, batch: int | None = None, after: Manifest | None = None) -> Manifest:
        """Write the touched buckets (all without a list) and publish the run that follows ``after``.

        ``rows`` holds every row of the touched buckets.  Files of a run that
        was not published are under a version no manifest names.
        """
        number = after.number + 1 if after else 1
        version = f"{number:06d}-{uuid.uuid4().hex[:8]}"
        if touched is None or touched:
            rows.select(*self.schema.fieldNames(), F.lit(version).alias("version")).write.mode("append").insertInto(self._table)
        live = list(after.live) if after else [version] * self.buckets
        for b in range(self.buckets) if touched is None else touched:
            live[b] = version
        made = Manifest(number, run_date, live, batch if batch is not None else after.batch if after else None)
        draft, final = self._of(f"{self.path}/manifest/.{version}"), self._of(f"{self.path}/manifest/{number:06d}.json")
        out = self._fs.create(draft, True)
        out.write(json.dumps(asdict(made)).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise PublishConflict(f"run {number} has been published by another writer")
        return made

    def start(self, rows: DataFrame, run_date: str) -> Manifest:
        """First run of any posting table; its rows are dealt to their buckets."""
        return self.publish(conform_state(rows).repartition(self.buckets, self.key), run_date)

    def expire(self, keep: int = 2) -> list[str]:
        """Forget all but the newest ``keep`` runs and delete versions that none of these needs, unpublished ones too."""
        known = self.numbers()
        needed = {v for n in known[-keep:] for v in self.manifest(n).live}
        for n in known[:-keep]:
            self._fs.delete(self._of(f"{self.path}/manifest/{n:06d}.json"), False)
        folders = [f.getPath().getName() for f in self._fs.listStatus(self._of(f"{self.path}/rows")) if f.isDirectory()]
        gone = [f for f in folders if f.startswith("version=") and f[len("version="):] not in needed]
        for f in gone:
            self._fs.delete(self._of(f"{self.path}/rows/{f}"), True)
        self.spark.catalog.refreshTable(self._table)
        return gone


FEW_SOURCES = 10_000
"""Failed sources up to which their names are a list in the plan; more of them are joined as Spark chooses."""


def changed_buckets(store: SnapshotStore, resolved: DataFrame, state: DataFrame, run_date: str,
                    failed_sources: DataFrame | list[str] | None, stale_days: int, failed_days: int) -> list[int]:
    """Buckets with a row of the batch or a posting that closes without one: at most as many numbers as there are buckets."""
    closing = close_stale(state.filter("status = 'open'"), run_date, failed_sources, stale_days, failed_days).filter("status = 'closed'")
    ids = resolved.select(store.key).unionByName(closing.select(store.key))
    return sorted(r[0] for r in ids.select(store.bucket()).distinct().collect())


def merge_run(store: SnapshotStore, batch: DataFrame, run_date: str, failed_sources: DataFrame | None = None, order: str = "batch_pos",
              stale_days: int = 7, failed_days: int = 30, number: int | None = None) -> Manifest:
    """Merge a batch into the newest state and publish it (H1-H11); ``number`` is the stream batch's.

    The wide state is read once, by buckets, and joined where it lies; only the
    narrow columns that resolve ids are shuffled.
    """
    before = store.manifest()
    state = store.read()
    if failed_sources is not None:
        names = failed_sources.select("source").distinct().limit(FEW_SOURCES + 1).collect()
        if len(names) <= FEW_SOURCES:
            failed_sources = [r["source"] for r in names if r["source"] is not None]
    resolved = cut_lineage(resolve_ids(batch, state, order))
    touched = changed_buckets(store, resolved, state, run_date, failed_sources, stale_days, failed_days) if before else None
    if touched is not None:
        state = state.filter(store.bucket().isin(touched))
    merged = merge_resolved(state, resolved, run_date, failed_sources, stale_days, failed_days)
    return store.publish(merged, run_date, touched, number, before)


def upsert_each(store: SnapshotStore, run_date: str, order: str = "batch_pos"):
    """Function for ``foreachBatch``: a batch the manifest already holds is left out, so a replay changes nothing."""
    def run(batch: DataFrame, number: int) -> None:
        last = store.manifest()
        if last is None or last.batch is None or number > last.batch:
            merge_run(store, batch, run_date, order=order, number=number)

    return run
