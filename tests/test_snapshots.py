"""Bucketed snapshots: what a run writes, what readers see, what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators.merge import merge_resolved, merge_snapshot, resolve_ids
from tidewell.session import cut_lineage, scratch_path
from tidewell.sources.snapshots import PublishConflict, SnapshotStore, merge_run, upsert_each
from tidewell.sources.state import STATE_SCHEMA

BATCH = "batch_pos int, company string, title string, link string, source string, exp string"


def _state(spark, n=120):
    rows = [(f"s-{i}", "한빛", f"안전 {i}", "open" if i % 4 else "closed", "2031-05-01", f"2031-05-{1 + i % 9:02d}", "표" if i % 3 else "줄", f"https://x.example/{i}")
            for i in range(n)]
    return spark.createDataFrame(rows, "id string, company string, title string, status string, first_seen string, last_seen string, source string, link string")


def _batch(spark, keys):
    return spark.createDataFrame([(i, "대솔", f"환경 {k}", f"https://new.example/{k}", "표", None) for i, k in enumerate(keys)], BATCH)


def _rows(df):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())


def _store(spark, buckets=8):
    return SnapshotStore(spark, scratch_path(spark, "store"), buckets=buckets)


def test_runs_equal_plain_merges_and_stay_readable(spark):
    store, plain = _store(spark), _state(spark)
    assert store.read().count() == 0 and store.manifest() is None
    store.start(plain, "2031-05-09")
    states = [store.read().collect()]
    want = spark.createDataFrame(states[0], STATE_SCHEMA)
    failed = spark.createDataFrame([("줄",)], "source string")
    for day, keys in (("2031-05-10", [1, 2, 2]), ("2031-05-12", [2, 3]), ("2031-06-20", [])):
        want = cut_lineage(merge_snapshot(want, _batch(spark, keys), day, failed).drop("is_new"))
        merge_run(store, _batch(spark, keys), day, failed)
        assert _rows(store.read()) == _rows(want)
        states.append(want.collect())
    again = SnapshotStore(spark, store.path, buckets=8)  # a reader of its own
    for number, rows in enumerate(states, 1):
        assert _rows(again.read(number)) == _rows(spark.createDataFrame(rows, STATE_SCHEMA))
    assert again.numbers() == [1, 2, 3, 4] and again.manifest().run_date == "2031-06-20"


def test_a_run_writes_the_buckets_that_change(spark):
    store = _store(spark, buckets=16)
    store.start(_state(spark).withColumn("last_seen", F.lit("2031-05-09")), "2031-05-09")
    made = merge_run(store, _batch(spark, [7]), "2031-05-10")
    own = store.read().filter("company = '대솔'").select(store.bucket()).collect()
    assert [b for b, v in enumerate(made.live) if v == made.live[own[0][0]]] == [own[0][0]] and len(set(made.live)) == 2
    written = spark.read.parquet(f"{store.path}/rows/version={made.live[own[0][0]]}")
    assert written.count() == store.read().filter(store.bucket() == own[0][0]).count()
    assert all("_000" in f for f in written.inputFiles()) and store.read().count() == 121
    # an id that stands in the batch again changes its bucket and no other
    merge_run(store, _batch(spark, [7]), "2031-05-11")
    assert store.read().count() == 121 and store.read().filter("last_seen = '2031-05-11'").count() == 1


def test_the_state_is_not_shuffled(spark):
    store = _store(spark)
    store.start(_state(spark), "2031-05-09")
    merge_run(store, _batch(spark, [1]), "2031-05-10")
    state = store.read()
    resolved = cut_lineage(resolve_ids(_batch(spark, [1, 9]), state))
    merged = merge_resolved(state, resolved, "2031-05-11", ["줄"])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line)
    assert "Bucketed: true" in lines[scan]
    depth = [len(line) - len(line.lstrip(" :+-*|")) for line in lines]
    above, at = [], depth[scan]
    for i in range(scan - 1, -1, -1):  # the operators between the scan and the result
        if depth[i] < at:
            above.append(lines[i])
            at = depth[i]
    assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)


def test_a_replayed_batch_changes_nothing(spark):
    store = _store(spark)
    store.start(_state(spark, 20), "2031-05-09")
    put = upsert_each(store, "2031-05-10")
    put(_batch(spark, [1, 2]), 0)
    rows = _rows(store.read())
    put(_batch(spark, [1, 2, 3]), 0)
    assert _rows(store.read()) == rows and store.numbers() == [1, 2] and store.manifest().batch == 0
    put(_batch(spark, [3]), 1)
    assert store.read().count() == 23 and store.manifest().batch == 1


def test_stream_of_batches_ends_in_the_state_of_one_merge(spark):
    rnd = random.Random(5)
    source, store = scratch_path(spark, "batches"), _store(spark)
    store.start(_state(spark, 30), "2031-05-09")
    for part in range(3):
        _batch(spark, rnd.sample(range(40), 9)).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second query starts from its checkpoint and finds nothing new
        query = (spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(source).writeStream
                 .foreachBatch(upsert_each(store, "2031-05-10")).option("checkpointLocation", source + "-log").trigger(availableNow=True).start())
        query.awaitTermination()
    assert store.numbers() == [1, 2, 3, 4]
    whole = merge_snapshot(store.read(1), spark.read.parquet(source), "2031-05-10").drop("is_new")
    assert _rows(store.read().select("id", "status", "title")) == _rows(whole.select("id", "status", "title"))


def test_of_two_writers_one_publishes(spark):
    store = _store(spark)
    first = store.start(_state(spark, 10), "2031-05-09")
    rows = store.read()
    store.publish(rows, "2031-05-10", after=first)
    with pytest.raises(PublishConflict):
        store.publish(rows.limit(1), "2031-05-10", after=first)
    assert store.read().count() == 10 and store.numbers() == [1, 2]


def test_expired_runs_leave_nothing(spark):
    store = _store(spark)
    store.start(_state(spark, 40), "2031-05-09")
    for day in range(10, 14):
        merge_run(store, _batch(spark, [day]), f"2031-05-{day}")
    rows = _rows(store.read())
    store._fs.mkdirs(store._of(f"{store.path}/rows/version=000009-deadbeef"))  # a run that was never published
    gone = store.expire(keep=1)
    needed = set(store.manifest().live)
    assert _rows(store.read()) == rows and store.numbers() == [5] and "version=000009-deadbeef" in gone
    assert not needed & {g[len("version="):] for g in gone} and len(gone) > 1
