"""Whitening of embeddings with MLlib's distributed block matrices.

Components of a vector become whole numbers, floor(scale * c) + shift. The fit list is each distinct vector once. Its
rows are centred exactly (n * x - sums, divided by n), numbered, and indexed into a ``BlockMatrix`` of blocks of
``BLOCK_ROWS`` rows. Transpose times matrix gives the scatter, of which only that one square block of the dimension
comes to the driver, for ``eigh``; the eigenvectors over the roots of the eigenvalues are the whitening matrix, and
block matrix times whitening matrix projects the rows. The product over the rows is split over their blocks and summed
up pairwise (``numMidDimSplits``), so no task sees all rows; beside it the driver gets the places of the blocks, one
pair of numbers for ``BLOCK_ROWS`` vectors.

Rows are projected by a second block matrix that holds every row under a number of its own, not by a join on vectors:
a vector that a third of the rows share is no hot key there. Intermediate tables are written to the shared folder.

Vectors that are null or hold null or non-finite entries are dropped; those without entries have no components. Vectors
of different lengths are fitted apart, each length by itself. Entries whose scaled value has no place in 2^62 count as
the nearest that has; a deviation that needs more than 64 bits is null. Null and repeated ids stay rows of their own. A direction without variance (below ``RANK`` of
the largest eigenvalue; all of them if n is 1) has null ``whitened`` and counts for nothing in ``identity_error``, which
is 0 if no direction has variance. Fewer dimensions give fewer components; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm.common import materialize

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
BLOCK_ROWS = 4096
RANK = 1e-11
_LARGEST = float(1 << 62)
_ROW_BITS = 33  # of monotonically_increasing_id, below which rows of a partition are counted


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): the vectors that take part, in whole numbers."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), c.cast("double") * scale))) + F.lit(shift)

    rows = df.where(v.isNotNull() & finite & (F.size(v) > 0))
    return rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.transform(v, whole).alias("x"))


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``index``: 0, 1, 2, ... in the order of a written table, without sorting or shuffling it."""
    rows = materialize(df.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a number per task
    before, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = rows.withColumn("_part", part).join(F.broadcast(table), "_part")
    return joined.select((F.col("_before") + inside).alias("index"), *[F.col(f"`{c}`") for c in df.columns])


class Blocks:
    """A block matrix of one block column, by its rows (index, values)."""

    def __init__(self, rows: DataFrame, n: int, dim: int):
        vectors = rows.select("index", array_to_vector("values").alias("vector"))
        vectors = MLUtils.convertVectorColumnsFromML(vectors, "vector")
        self.n, self.dim = n, dim
        self.matrix = IndexedRowMatrix(vectors, n, dim).toBlockMatrix(BLOCK_ROWS, dim)

    def times(self, right: np.ndarray) -> BlockMatrix:
        """Rows times a matrix that every task can hold."""
        spark = SparkSession.active()
        block = Matrices.dense(*right.shape, right.ravel(order="F").tolist())
        other = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), *right.shape)
        product = self.matrix.multiply(other)
        return BlockMatrix(product._java_matrix_wrapper._java_model, BLOCK_ROWS, right.shape[1])


def scatter(matrix: BlockMatrix, n: int, dim: int) -> np.ndarray:
    """Transpose times matrix, a square of the dimension; the sum over row blocks is split by blocks."""
    blocks = -(-n // BLOCK_ROWS)
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, blocks)
    return BlockMatrix(product, dim, dim).toLocalMatrix().toArray()


def by_row(matrix: BlockMatrix) -> DataFrame:
    """(index, values) of the rows of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, shares, used): eigenvectors over roots of eigenvalues in columns, shares of the trace, and which of the
    components have variance."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    values = np.maximum(values, 0.0)
    used = values > RANK * max(values[0], 0.0)
    trace = float(np.trace(covariance))
    shares = values / trace if trace > 0 else np.zeros_like(values)
    return vectors / np.sqrt(np.where(used, values, 1.0)), shares, used


def _whiten_length(points: DataFrame, dim: int, components: int) -> DataFrame:
    distinct = numbered(points.select("x").distinct(), "distinct")
    terms = [F.col("x")[i] for i in range(dim)]
    exact = "decimal(38,0)"
    sums = distinct.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(t.cast("decimal(20,0)")) for t in terms]).alias("s"),
        F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"),
    ).first()
    n, total = sums["n"], [int(s) for s in sums["s"]]
    # Whole numbers of 64 bits hold every step if the largest possible sum of squares fits.
    largest = max(n * max(abs(sums["low"]), abs(sums["high"])), dim * (n * (sums["high"] - sums["low"])) ** 2)
    kind = "bigint" if largest < 1 << 62 else exact
    at = F.array(*[F.lit(str(s)).cast(kind) for s in total])

    def centred(frame: DataFrame, *keep: str) -> DataFrame:
        apart = F.zip_with("x", at, lambda x, s: (x.cast(kind) * F.lit(n).cast("bigint") - s).cast(kind))
        return frame.withColumn("y", apart).select(
            *keep, F.transform("y", lambda y: y.cast("double") / F.lit(float(n))).alias("values"), "y"
        )

    fit = Blocks(centred(distinct, "index"), n, dim)
    covariance = scatter(fit.matrix, n, dim) / n
    whiten, shares, used = whitening_matrix(covariance, components)
    error = scatter(fit.times(whiten), n, whiten.shape[1]) / n - np.eye(whiten.shape[1])
    error = float(np.abs(error[np.ix_(used, used)]).max(initial=0.0))

    rows = numbered(points, "rows")
    project = Blocks(centred(rows, "index"), rows.count(), dim)
    def add_square(total: Column, y: Column) -> Column:
        return F.try_add(total, F.try_multiply(y, y)).try_cast(kind)

    squares = F.aggregate("y", F.lit(0).cast(kind), add_square).try_cast("bigint")
    named = centred(rows, "index", "vec_id").select("index", "vec_id", squares.alias("deviation"))
    each = F.array(*[
        F.struct(F.lit(i + 1).alias("component"), F.lit(bool(used[i])).alias("used"), F.lit(float(shares[i])).alias("explained"))
        for i in range(len(shares))
    ])
    spread = named.join(by_row(project.times(whiten)), "index").select(
        "vec_id", "deviation", F.inline(F.zip_with(each, "values", lambda c, w: F.struct(c.alias("c"), w.alias("w")))),
    )
    return spread.select(
        "vec_id", F.col("c.component").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(F.col("c.used"), F.col("w")).alias("whitened"), F.col("c.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


EMPTY = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE, shift: int = SHIFT,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for every vector and component."""
    points = materialize(whole_vectors(df, vec_id, vector, scale, shift), "vectors")
    lengths = [r["dim"] for r in points.select(F.size("x").alias("dim")).distinct().collect()]  # one in sound data
    out = df.sparkSession.createDataFrame([], f"vec_id {df.schema[vec_id].dataType.simpleString()}, {EMPTY}")
    for dim in sorted(lengths):
        found = _whiten_length(points.where(F.size("x") == dim), dim, components)
        out = found if dim == min(lengths) else out.unionByName(found)
    return out
