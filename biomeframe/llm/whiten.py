"""Whitening of embeddings with the distributed matrices of Spark MLlib.

Vectors become integers, floor(256 * x). The fit list holds each distinct vector once; its
sums per dimension give the mean. Centred rows are numbered and dealt into the blocks of a
``BlockMatrix``; its transpose times itself is the scatter, of which only the dim x dim result
reaches the driver for ``eigh``. A second multiplication by the whitening matrix (axes over the
square roots of their variances) projects the rows of the table. Products of blocks are spread
over ``numMidDimSplits`` tasks, so that no task reads all blocks. Rows that hold the same vector
are numbered one by one and projected apart, so a vector that holds much of the table meets
in no task.

Bounds: the driver holds dim x dim doubles and one number per dimension, tasks hold blocks of
``ROWS`` x ``COLUMNS`` doubles.

Defined results: rows whose vector is null or holds null, NaN or infinite entries go; shorter
vectors count as padded with zeros, an empty one is all zeros; scaled entries beyond 2^62 count
as 2^62; rows with a null id and repeated rows stay and get rows of their own; components whose
variance is zero (up to rounding) have no whitened values and are left out, so a table with one
distinct vector gives no rows, nor does an empty one; of components with equal variance any
orthonormal choice may come; a deviation beyond 64 bits becomes the largest long; only id
and vector are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.operators.keyed import with_position
from biomeframe.session import materialise

COMPONENTS, SCALE = 4, 256
ROWS, COLUMNS = 1024, 1024
BLOCKS_A_TASK = 8
LONG_MAX, LIMIT = 2**63 - 1, 2.0**62


@dataclass
class Whitening:
    """What the fit list says: its size, sums, variances, and one whitening axis per column."""

    n: int
    sums: list[int]
    variances: np.ndarray
    trace: float
    matrix: np.ndarray
    identity_error: float = 0.0


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the scaled integers of every vector that takes part."""
    v = F.col(vector_col).cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & ~F.exists("v", odd))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(held(c))).alias("x"))


def centred(x: Column, sums: list[int], n: int) -> Column:
    """``x`` minus the mean as a vector."""
    means = F.lit([s / n for s in sums])
    return array_to_vector(F.zip_with(x, means, lambda a, m: a.cast("double") - m))


def blocks(rows: DataFrame, n: int, dim: int) -> BlockMatrix:
    """Rows of ``position`` and ``vector`` as a matrix of blocks."""
    indexed = MLUtils.convertVectorColumnsFromML(rows.select("position", "vector"), "vector")
    return IndexedRowMatrix(indexed, n, dim).toBlockMatrix(ROWS, COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix on the driver; the rows are summed in several tasks."""
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_A_TASK))
    left = matrix.transpose()._java_matrix_wrapper
    # The overload with a number of splits has no Python form.
    product = left.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, axes: np.ndarray) -> BlockMatrix:
    """``matrix`` times the whitening matrix."""
    spark_context = matrix.blocks.context
    dim, k = axes.shape
    parts = [
        ((i, 0), DenseMatrix(len(part), k, part.ravel(order="F").tolist()))
        for i, part in enumerate(axes[at : at + COLUMNS] for at in range(0, dim, COLUMNS))
    ]
    return matrix.multiply(BlockMatrix(spark_context.parallelize(parts, len(parts)), COLUMNS, k, dim, k))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` (all of one length), or None where nothing varies."""
    distinct = rows.select("x").distinct().withColumn("_at", F.xxhash64("x"))
    listed = with_position(distinct, ["_at"]).drop("_at")
    by_dim = (
        listed.select(F.posexplode("x").alias("i", "c"))
        .groupBy("i")
        .agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
        .orderBy("i")
        .collect()
    )
    if not by_dim:
        return None
    n, sums = by_dim[0]["n"], [int(r["s"]) for r in by_dim]
    matrix = blocks(listed.withColumn("vector", centred(F.col("x"), sums, n)), n, len(sums))
    covariance = scatter(matrix) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    real = values[:components] > max(values[0], 0.0) * len(values) * np.finfo(float).eps
    chosen = int(real.sum()) if values[0] > 0 else 0
    if not chosen:
        return None
    found = Whitening(n, sums, values[:chosen], float(np.trace(covariance)), axes[:, :chosen] / np.sqrt(values[:chosen]))
    own = scatter(projected(matrix, found.matrix)) / n
    found.identity_error = float(np.abs(own - np.eye(chosen)).max())
    return found


def deviations(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact, at most the largest long."""
    s = np.array(sums, object)
    reach = n * int(np.abs(x).max(initial=0)) + max(abs(v) for v in sums)
    if x.shape[1] * reach * reach <= LONG_MAX:
        return np.square(n * x - s.astype(np.int64)).sum(1)
    exact = ((n * x.astype(object) - s) ** 2).sum(1)
    return np.array([min(int(v), LONG_MAX) for v in exact], np.int64)


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """vec_id, component (from 1, by falling variance), n, deviation, whitened, explained and
    identity_error of every vector that takes part."""
    rows = materialise(integers(vectors, id_col, vector_col))
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = (
        f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    dim = rows.agg(F.max(F.size("x"))).first()[0]
    model = None
    if dim:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))
        rows = rows.withColumn("x", F.concat("x", zeros))
        model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    placed = with_position(rows.withColumn("_at", F.rand(1)), ["_at"]).drop("_at")
    vector = centred(F.col("x"), model.sums, model.n)
    matrix = blocks(placed.withColumn("vector", vector), rows.count(), dim)
    result = projected(matrix, model.matrix).toIndexedRowMatrix().rows
    values = result.map(lambda r: (r.index, r.vector.toArray().tolist()))
    whitened = rows.sparkSession.createDataFrame(values, "position long, y array<double>", verifySchema=False)
    joined = placed.join(whitened, "position").select("vec_id", "x", "y")
    n, sums = model.n, model.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            far = pa.array(deviations(x, sums, n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), far, batch.column(2)], names=["vec_id", "deviation", "y"])

    measured = joined.mapInArrow(run, f"vec_id {id_type}, deviation long, y array<double>")
    share = F.lit([float(v) / model.trace for v in model.variances])
    return measured.select(
        "vec_id",
        F.posexplode("y").alias("_i", "whitened"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
    ).select(
        "vec_id",
        (F.col("_i") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(share, F.col("_i")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
