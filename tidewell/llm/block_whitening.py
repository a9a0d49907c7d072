"""Whitening of embeddings with Spark MLlib's BlockMatrix.

Centred rows are indexed into distributed blocks; the transposed matrix times
the matrix is the scatter, whose middle dimension is split so that every task
multiplies its own blocks; only that matrix of dimension x dimension comes to
the driver, for its eigenvectors.  The blocks times the whitening matrix are
the projected rows.  Rows, sums and joins are DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage, scratch_path
from .batches import numbered, shuffle_count
from .vectors import usable

WHOLE = "decimal(38,0)"
LARGEST = 2.0 ** 42
"""Components beyond this size have no exact whole number after scaling; such a vector takes no part."""


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``rows`` vectors: mean, components (columns, unit length, falling variance), variances, share of all variance."""

    rows: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    has_variance: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """What centred rows are multiplied by; a component without variance projects to 0."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.has_variance, 1 / np.sqrt(self.variances), 0.0)
        return self.components * scale


def scaled(vector: Column, factor: int = 1024, offset: int = 100_000) -> Column:
    """floor(factor * c) + offset of each component, c as a double."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * float(factor)).cast("long") + F.lit(offset).cast("long"))


def rows_that_fit(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(id, x) of the vectors that take part, numbered in ``_row``; their number and dimension.

    Vectors that are null, empty or hold null, non-finite or too large components
    take no part, nor do those of another length than the most frequent one (the
    shorter on a tie).  Null and repeated ids are rows like others.
    """
    vector = F.col(vector_col).cast("array<double>")
    fit = usable(vector, zero_counts=True) & ~F.exists(vector, lambda c: F.abs(c) > LARGEST)
    rows = df.select(F.col(id_col).alias("_id"), vector_col).filter(fit).select("_id", scaled(F.col(vector_col)).alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if top is None:
        return rows.withColumn("_row", F.lit(0).cast("long")), 0, 0
    return numbered(rows.filter(F.size("x") == top["d"])), top["n"], top["d"]


def exact_sums(rows: DataFrame) -> list[int]:
    """Sum of every dimension, exactly; one number per dimension comes to the driver."""
    sums = rows.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    return [int(r["s"]) for r in sums.orderBy("dim").collect()]


def deviations(x: Column, n: int, sums: list[int]) -> Column:
    """n * x - S of every dimension, exactly."""
    means = F.array(*[F.lit(str(s)).cast(WHOLE) for s in sums])
    return F.zip_with(x, means, lambda a, s: (a.cast(WHOLE) * F.lit(str(n)).cast(WHOLE) - s).cast(WHOLE))


def squared_length(deviation: Column) -> Column:
    """Sum of the squares, exactly; null if it is no 64-bit number."""
    total = F.aggregate(deviation, F.lit("0").cast(WHOLE), lambda a, v: F.try_add(a, F.try_multiply(v, v)).cast(WHOLE))
    return total.try_cast("long")


def centred_blocks(rows: DataFrame, n: int, d: int, sums: list[int], rows_per_block: int, columns_per_block: int) -> BlockMatrix:
    """The rows less their mean as a distributed block matrix; row ``_row`` of the table is row ``_row`` of the matrix.

    A block is an aggregate of at most ``rows_per_block`` rows.  The blocks are
    written to the shared folder as the fields of a matrix and read as matrices,
    so neither product makes them again, nor does a lost executor.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "centred-blocks")
    centred = F.transform(deviations(F.col("x"), n, sums), lambda v: v.cast("double") / float(n))
    dealt = rows.select(F.floor(F.col("_row") / rows_per_block).alias("_i"), F.struct("_row", centred.alias("v")).alias("_r"))
    grouped = dealt.groupBy("_i").agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
    across = grouped.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit((d - 1) // columns_per_block))))
    first, width = F.col("_j") * columns_per_block, F.least(F.lit(columns_per_block), F.lit(d) - F.col("_j") * columns_per_block)
    values = F.flatten(F.transform("_rows", lambda r: F.slice(r["v"], first + 1, width)))
    matrix = F.struct(F.lit(1).cast("byte").alias("type"), F.size("_rows").alias("numRows"), width.alias("numCols"),
                      F.lit(None).cast("array<int>").alias("colPtrs"), F.lit(None).cast("array<int>").alias("rowIndices"),
                      values.alias("values"), F.lit(True).alias("isTransposed"))
    place = F.struct(F.col("_i").alias("_1"), F.col("_j").cast("long").alias("_2"))
    across.select(place.alias("place"), matrix.alias("matrix")).write.parquet(path)
    schema = StructType([StructField("place", StructType([StructField("_1", LongType()), StructField("_2", LongType())])),
                         StructField("matrix", MatrixUDT())])
    blocks = spark.read.schema(schema).parquet(path)
    java = callMLlibFunc("createBlockMatrix", blocks, rows_per_block, columns_per_block, n, d)
    return BlockMatrix(java, rows_per_block, columns_per_block)


def scatter(blocks: BlockMatrix, splits: int) -> np.ndarray:
    """Transposed blocks times blocks, as a matrix of dimension x dimension.

    The middle dimension, the rows, is dealt to ``splits`` parts, so that no task
    multiplies them all; MLlib offers that on the JVM side of the class only.
    """
    java = blocks._java_matrix_wrapper._java_model
    product = java.transpose().multiply(java, max(1, min(splits, -(-blocks.numRows() // blocks.rowsPerBlock))))
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, n: int, sums: list[int], components: int) -> Whitening:
    """The first components by falling eigenvalue; each is turned so that its largest entry is positive.

    An eigenvalue within rounding of 0, compared with the largest, is no variance.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = np.maximum(values[order], 0.0), vectors[:, order], float(np.trace(covariance))
    lead = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]
    rounding = len(covariance) * np.finfo(float).eps * (values.max() if len(values) else 0.0)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    return Whitening(n, sums, vectors * np.where(lead < 0, -1.0, 1.0), values, explained, values > rounding)


def project(spark: SparkSession, blocks: BlockMatrix, model: Whitening) -> DataFrame:
    """(_row, w): the blocks times the whitening matrix; rows equal to the mean are missing from the result."""
    side, matrix = blocks.colsPerBlock, model.matrix
    parts = [((i, 0), Matrices.dense(len(m), m.shape[1], m.ravel(order="F")))
             for i, m in enumerate(matrix[a:a + side] for a in range(0, len(matrix), side))]
    right = BlockMatrix(spark.sparkContext.parallelize(parts, 1), side, matrix.shape[1], *matrix.shape)
    rows = callMLlibFunc("getIndexedRows", blocks.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("_row"), vector_to_array("vector").alias("w"))


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, over the components with variance."""
    at = [int(i) for i in np.flatnonzero(model.has_variance)]
    pairs = [(i, j) for i in at for j in at if i <= j]
    if not pairs:
        return None
    found = whitened.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, rows_per_block: int = 1024,
           columns_per_block: int = 1024) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per vector that takes part and component.

    See :func:`rows_that_fit` for the vectors that take part; the others give no
    rows.  Repeated rows count as often as they stand in the table.  A component
    without variance (all of them, for a single or only equal vectors) has a null
    ``whitened``, ``identity_error`` is over the others and null if there are
    none.  ``deviation`` is null where it is no 64-bit number.  Vectors of fewer
    dimensions than ``components`` have one component for each.  Other columns
    are not read.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows, n, d = rows_that_fit(df, id_col, vector_col)
    out = [F.col("_id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", "identity_error"]
    if not n:
        empty = rows.select("_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("component", "int"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
        return empty.select(*out)
    sums = exact_sums(rows)
    blocks = centred_blocks(rows, n, d, sums, rows_per_block, columns_per_block)
    model = principal(scatter(blocks, shuffle_count(df)) / n, n, sums, components)
    measured = rows.select("_id", "_row", squared_length(deviations(F.col("x"), n, sums)).alias("deviation"))
    zeros = F.array(*[F.lit(0.0)] * len(model.variances))
    met = measured.join(project(spark, blocks, model), "_row", "left").withColumn("w", F.coalesce("w", zeros))
    whitened = cut_lineage(met.select("_id", "deviation", "w"))
    error = F.lit(identity_error(whitened, model)).cast("double").alias("identity_error")
    known, share = (F.array(*[F.lit(v) for v in values]) for values in (model.has_variance.tolist(), model.explained.tolist()))
    place = F.col("component") - 1
    long = whitened.select("_id", "deviation", F.posexplode("w").alias("_i", "_w")).withColumn("component", F.col("_i") + 1)
    return long.select("*", F.when(known[place], F.col("_w")).alias("whitened"), share[place].alias("explained"), error).select(*out)
