from pyspark.sql import functions as F

from tidewell.operators.components import connected_components
from tidewell.session import ROWS_A_TASK, cut_narrow, gathered


def test_small_tables_are_read_in_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    small = cut_narrow(spark.range(1000, numPartitions=200))
    assert small.rdd.getNumPartitions() == cores and small.agg(F.sum("id")).first()[0] == 499_500
    large = spark.range(10, numPartitions=200)
    assert gathered(large, 50 * ROWS_A_TASK + 1).rdd.getNumPartitions() == max(cores, 51)
    assert gathered(large, 1 << 40).rdd.getNumPartitions() == 200


def test_components_of_few_edges_in_many_partitions(spark):
    """Rings of different lengths: roots by hand, and no round's edges lie in the partitions of the first table."""
    edges = [(k * 100 + i, k * 100 + (i + 1) % (k + 3)) for k in range(20) for i in range(k + 3)]
    had = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(61))
        got = {r["node"]: r["root"] for r in found.collect()}
        stars = found.filter("node <> root").select("node", "root")  # the first half of the union: the edges themselves
        parts = stars.groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", had[1])
    assert got == {n: n // 100 * 100 for edge in edges for n in edge}
    assert parts <= spark.sparkContext.defaultParallelism
