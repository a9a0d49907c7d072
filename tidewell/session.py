"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster the submitter's session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidewell")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    own = tempfile.mkdtemp(prefix="tidewell-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder for an intermediate table."""
    return os.path.join(shared_dir(spark), "tidewell", f"{name}-{uuid.uuid4().hex}")


def spread(scan: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Even tasks for a scan whose rows lie in few of its splits.

    A file is split by its bytes but read by its row groups, so a large file of
    few row groups has many splits of which few have rows.  Rows per split come
    from the file footers.  Rows are dealt by the hash of their values: dealt in
    turn, they would first be sorted in the few tasks that have them.  ``by``
    names a key of few rows each that stay together, so that later aggregates
    fold them before their shuffle.  Only for
    plain scans; one whose largest split has at most twice an even share is
    returned as it is.
    """
    want = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    if splits >= want:
        per_split = scan.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        most, rows = per_split.agg(F.max("n"), F.sum("n")).first()
        if not rows or most * want <= 2 * rows:
            return scan
    keys = by or [c.name for c in scan.schema if not isinstance(c.dataType, (MapType, VariantType))]
    return scan.repartition(max(want, splits), *keys)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, name: str) -> DataFrame:
    """Written once as a table in the shared folder, which takes a fraction of a checkpoint's bytes."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_TASK = 1 << 16
"""Narrow rows that are worth a task of their own."""


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in fewer tasks if it has few rows: no more than one per ``ROWS_A_TASK``, but one per core at least.

    Every task of a map stage writes files of its own and is logged, so a small
    table in the partitions of a large one costs far more than its rows.  For
    tables that are not read as they were dealt; a large one stays as it is.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)))


def cut_narrow(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage` for a table of narrow rows, read again in as many tasks as its rows are worth; they are counted as they are written."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return gathered(cut, seen.get["rows"])
