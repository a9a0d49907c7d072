"""Files and tables the engine reads between runs, and the ones it writes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..operators.groups import first_by

TEXT = [
    "id", "company", "title", "track", "exp", "posted", "deadline", "link", "source", "snippet",
    "first_seen", "last_seen", "status", "mark", "size", "tier", "location", "edu", "emp_type",
    "deadline_time", "company_full", "verify", "verified_at", "verify_tried_at", "duty",
    "duty_evidence", "duty_flag", "csn", "company_form", "cmp_salary", "cmp_size", "sec",
]
INTEGERS = ["size_rank", "employees", "avg_salary", "salary_year"]

STATE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in TEXT]
    + [T.StructField(c, T.IntegerType()) for c in INTEGERS]
    + [T.StructField("rel_score", T.DoubleType())]
)
LABEL_SCHEMA = "title string, company string, label int"
PROFILE_SCHEMA = (
    "csn string, form string, employees int, salary_year int, avg_salary int, salary_min int, "
    "salary_max int, salary_reliability string, missing boolean, fetched date"
)
GOLD_SCHEMA = "items array<struct<title:string,company:string,size_rank:int,keep:boolean,why:string>>"
REGISTRY_SCHEMA = (
    "name string, type string, url string, company string, `group` string, adapter string, tenant string, "
    "size_filter boolean, groups_only boolean, default_rank int, timeout_sec int, disabled boolean"
)


def merge_settings(base: dict, local: dict) -> dict:
    """Local values override the base, one level deep."""
    out = dict(base)
    for key, value in local.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = {**out[key], **value} if both else value
    return out


def load_settings(spark: SparkSession, base: str, local: str | None = None) -> dict:
    """Settings documents (a few KB of rules) through the session's file system."""
    def read(path: str) -> dict:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])

    return merge_settings(read(base), read(local)) if local else read(base)


def read_registry(spark: SparkSession, path: str, only: str = "") -> DataFrame:
    """Enabled sources whose name contains ``only`` (A1)."""
    rows = spark.read.schema(REGISTRY_SCHEMA).json(path, multiLine=True)
    return active_sources(rows, only)


def active_sources(rows: DataFrame, only: str = "") -> DataFrame:
    return rows.filter(F.contains("name", F.lit(only)) & ~F.coalesce("disabled", F.lit(False)))


def read_state(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Posting snapshot; additive columns are filled with NULL."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    for f in STATE_SCHEMA.fields:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows = rows.select(*STATE_SCHEMA.fieldNames())
    return rows.filter((F.col("status") == "open") | (F.col("last_seen") >= since)) if since else rows


def conform_state(rows: DataFrame) -> DataFrame:
    """Any posting table to the state schema: blanks to NULL, zero figures to NULL."""
    cols = []
    for f in STATE_SCHEMA.fields:
        if f.name not in rows.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name in INTEGERS and f.name != "size_rank":
            cols.append(F.nullif(F.col(f.name).cast("int"), F.lit(0)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(blank_to_null(F.col(f.name).cast("string")).alias(f.name))
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return rows.select(*cols)


def read_feedback(spark: SparkSession, glob: str) -> DataFrame:
    """Exported label files; broken files and rows are skipped."""
    rows = (spark.read.schema(LABEL_SCHEMA).json(glob, multiLine=True)
            .withColumn("file_ts", F.col("_metadata.file_modification_time"))
            .withColumn("file_name", F.col("_metadata.file_path"))
            .withColumn("_row", F.monotonically_increasing_id()))
    return rows.filter(F.col("label").isin(0, 1) & (F.coalesce("title", F.lit("")) != ""))


def merge_feedback(current: DataFrame, feedback: DataFrame) -> DataFrame:
    """User labels with the newest mark per (company, title)."""
    old = current.select("title", F.coalesce("company", F.lit("")).alias("company"), "label",
                         F.lit(None).cast("timestamp").alias("file_ts"), F.lit(None).cast("string").alias("file_name"),
                         F.lit(None).cast("long").alias("_row"))
    new = feedback.select("title", F.coalesce("company", F.lit("")).alias("company"), "label", "file_ts", "file_name", "_row")
    newest = F.struct(F.coalesce(F.col("file_ts").cast("double"), F.lit(-1.0)), F.coalesce("file_name", F.lit("")),
                      F.coalesce("_row", F.lit(-1)))
    return first_by(old.unionByName(new), ["company", "title"], newest, latest=True).select("title", "company", "label")


def read_documents(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Folder of JSON documents, one per file; the id falls back to the file name."""
    rows = spark.read.schema(f"id string, data struct<{schema}>, {schema.replace(':', ' ')}").json(glob, multiLine=True)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.json)?$", 1)
    fields = [f.split(":")[0].strip() for f in schema.split(",")]
    return rows.select(F.coalesce("id", stem).alias("id"),
                       *[F.coalesce(F.col(f"data.{f}"), F.col(f)).alias(f) for f in fields])


# Sinks ----------------------------------------------------------------------

def write_snapshot(state: DataFrame, path: str, run_date: str) -> str:
    """Full snapshot of a run under its own date; earlier snapshots stay readable (B1)."""
    target = f"{path}/run_date={run_date}"
    state.write.mode("overwrite").parquet(target)
    return target


def append_run(runs: DataFrame, new_run: DataFrame) -> DataFrame:
    """Run log with the newest row per run time (B2)."""
    union = runs.withColumn("_new", F.lit(0)).unionByName(new_run.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_by(union, ["run_at"], F.col("_new"), latest=True).drop("_new")


def write_export(jobs: DataFrame, members: DataFrame, meta: DataFrame, path: str) -> None:
    """Export as JSON: one folder of postings, one of their members, one meta row."""
    jobs.write.mode("overwrite").json(f"{path}/jobs")
    members.write.mode("overwrite").json(f"{path}/members")
    meta.write.mode("overwrite").json(f"{path}/meta")


def write_health(health: DataFrame, path: str) -> None:
    """Health findings as JSON."""
    health.write.mode("overwrite").json(path)


def write_registry(groups: DataFrame, path: str) -> None:
    """Group registry as Parquet."""
    groups.write.mode("overwrite").parquet(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """User labels as JSON."""
    labels.write.mode("overwrite").json(path)


def redact(state: DataFrame, blank: tuple[str, ...] = ("cmp_salary", "cmp_size", "mark"),
           hide: Column | None = None) -> DataFrame:
    """Copy of the state without personal values."""
    out = state
    for c in blank:
        out = out.withColumn(c, F.lit(None).cast(state.schema[c].dataType))
    return out.filter(~F.coalesce(hide, F.lit(False))) if hide is not None else out


def redact_cache(profiles: DataFrame, base_company_norm: str) -> DataFrame:
    """Profile cache without entries of the user's own company."""
    if not base_company_norm:
        return profiles
    return profiles.filter(~F.contains("norm", F.lit(base_company_norm)))


def put_profiles(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Profile cache with the newest entry per name."""
    union = cache.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return first_by(union, ["norm"], F.struct("fetched", "_new"), latest=True).drop("_new")


def with_verification(jobs: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Input rows with their verification as one nested column."""
    rest = [c for c in results.columns if c != key]
    return jobs.join(results.select(key, F.struct(*rest).alias("verified")), key, "left")
