"""Whitening of vectors by MLlib's BlockMatrix.

Vectors become integers, so their sums are exact, whatever the order of summing. Rows are numbered and
centred, MLlib cuts them into distributed blocks, the transposed blocks times the blocks give the scatter matrix, whose
eigenvectors are found on the driver (a matrix of dimensions times dimensions), and the blocks times the whitening
matrix give the projected rows.

MLlib places a tall matrix's blocks in about the square root of its input's partitions, and gathers the numbers of all
blocks on the driver. So rows are taken in slabs of a bounded number of rows: a slab's scatter is one product, its
projection another, and the slabs' scatters are summed. The multiplication that sums over rows is split along
them (numMidDimSplits), else one task would get all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import written

#: Rows of a block; blocks that one task multiplies in a product along the rows; rows of a slab, roughly (whole partitions).
BLOCK, SPLIT_BLOCKS, SLAB = 1024, 16, 4_000_000
#: monotonically_increasing_id: 33 bits of a row's place in its partition.
PLACE = 33


def quantised(df: DataFrame, vector: str, scale: int, shift: int) -> DataFrame:
    """df's rows whose vector has only finite entries, with __x, the entries as floor(scale * entry) + shift.

    A null vector or entry, and a row whose vector has another length than most rows', are left out (of lengths equally common, the longest counts).
    """
    v = f"`{vector}`"
    whole = df.where(f"size({v}) > 0 AND forall({v}, e -> e IS NOT NULL AND NOT isnan(e) AND abs(double(e)) < double('Infinity'))")
    x = whole.withColumn("__x", F.expr(f"transform({v}, e -> bigint(floor({scale} * double(e))) + {shift})"))
    most = x.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("__x") == (most.d if most else 0))


class Rows:
    """A written table with __x and __at (partition and place in it), in slabs of whole partitions."""

    def __init__(self, table: DataFrame, vector: str, slab: int = SLAB):
        self.table, self.vector = table, vector
        # A row for each partition that was written.
        parts = sorted((r.part, r.n) for r in table.groupBy(F.expr(f"shiftright(`__at`, {PLACE})").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
        self.n = sum(n for _, n in parts)
        self.slabs: list[dict[int, int]] = []  # partition -> its first row in the slab
        self.sizes: list[int] = []
        for part, n in parts:
            if not self.slabs or self.sizes[-1] >= slab:
                self.slabs.append({})
                self.sizes.append(0)
            self.slabs[-1][part] = self.sizes[-1]
            self.sizes[-1] += n

    def numbered(self, s: int) -> DataFrame:
        """The rows of a slab with __row, their number in it."""
        first = self.slabs[s]
        low, high = min(first), max(first)
        firsts = F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(low, high + 1)])
        own = self.table.where((F.col("__at") >= low << PLACE) & (F.col("__at") < (high + 1) << PLACE))
        part = F.expr(f"int(shiftright(`__at`, {PLACE}))")
        return own.withColumn("__row", F.element_at(firsts, part - low + 1) + F.expr(f"`__at` & {(1 << PLACE) - 1}"))

    def blocks(self, s: int, d: int, centred: Column) -> BlockMatrix:
        """A slab's rows, centred, as distributed blocks."""
        vectors = self.numbered(s).select("__row", array_to_vector(centred).alias("v"))
        return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), self.sizes[s], d).toBlockMatrix(BLOCK, d)

    def covariance(self, d: int, centred: Column) -> np.ndarray:
        """The slabs' transposed blocks times their blocks, over the number of rows."""
        total = np.zeros((d, d))
        for s, size in enumerate(self.sizes):
            blocks = self.blocks(s, d, centred)
            total += times(blocks.transpose(), blocks, -(-size // (BLOCK * SPLIT_BLOCKS))).toLocalMatrix().toArray()
        return (total + total.T) / (2 * self.n)


def times(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left times right, with the dimension that they share dealt to so many tasks for each block of the result."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def rows_of(blocks: BlockMatrix) -> DataFrame:
    """(index, vector) of a matrix in blocks, the vector as an array."""
    found = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(found, "vector").select(F.col("index").alias("__row"), vector_to_array("vector").alias("__z"))


def sums(table: DataFrame, column: str) -> list:
    """Sums of an array column by position; each task sends one row for a position."""
    found = {r.at: r.total for r in table.select(F.posexplode(column).alias("at", "x")).groupBy("at").agg(F.sum("x").alias("total")).collect()}
    return [found[i] for i in range(len(found))]


def literals(values: Iterator | list, kind: str) -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 32, scale: int = 64, shift: int = 1_000_000, slab: int = SLAB) -> DataFrame:
    """For each row with a whole vector and each component: the columns in keep, component, n, deviation, whitened, explained, identity_error.

    Components are those of the integer vectors' covariance (divisor n), by falling eigenvalue, as many as asked for and there are;
    such whose eigenvalue is nought up to rounding (as with fewer rows than dimensions, or a constant dimension) have no whitened value and are left out.
    deviation is the squared distance from the mean times n, as an integer, null where it exceeds 64 bits. identity_error is the largest entry of the
    whitened rows' covariance minus the identity. Repeated rows count as so many and give equal rows. An empty df, or one without a whole
    vector or without any spread, gives no rows. Columns of df not in keep are left out; one named like a result is replaced.
    """
    spark = df.sparkSession
    keep = tuple(c for c in keep if c not in ("component", "n", "deviation", "whitened", "explained", "identity_error"))
    x = quantised(df, vector, scale, shift).select(*[f"`{c}`" for c in keep], "__x", F.monotonically_increasing_id().alias("__at"))
    rows = Rows(written(x, "vectors"), "__x", slab)
    n = rows.n
    none = spark.createDataFrame([], df.select(*[f"`{c}`" for c in keep]).schema)
    given = none.select(*[f"`{c}`" for c in keep], *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    if not n:
        return given
    total = sums(rows.table, "__x")
    d = len(total)
    apart = F.zip_with("__x", literals(total, "long"), lambda e, s: e * F.lit(n).cast("long") - s)  # n times the distance from the mean
    v = rows.covariance(d, F.transform(apart, lambda e: e.cast("double") / n))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(min(components, (values > max(values[0], 0) * d * np.finfo(float).eps * 8).sum()))
    if not k:
        return given
    matrix = vectors[:, :k] / np.sqrt(values[:k])
    w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, k, matrix.T.ravel().tolist()))], 1), d, k)
    squared = F.aggregate(apart, F.lit(0).cast("long"), lambda a, e: F.try_add(a, F.try_multiply(e, e)))
    out = None
    for s in range(len(rows.sizes)):
        projected = rows_of(times(rows.blocks(s, d, F.transform(apart, lambda e: e.cast("double") / n)), w))
        own = rows.numbered(s).select(*[f"`{c}`" for c in keep], "__at", squared.alias("deviation"), "__row")
        joined = own.join(projected.hint("merge"), "__row").drop("__row")
        out = joined if out is None else out.unionByName(joined)
    white = Rows(written(out, "whitened"), "__z", slab)
    means = [z / n for z in sums(white.table, "__z")]
    error = float(np.abs(white.covariance(k, F.zip_with("__z", literals(means, "double"), lambda z, m: z - m)) - np.eye(k)).max())
    share = literals([float(e) for e in values[:k] / np.trace(v)], "double")
    long = white.table.select(*[f"`{c}`" for c in keep], "deviation", F.posexplode("__z").alias("__k", "whitened"))
    component = (F.col("__k") + 1).cast("int")
    return long.select(*[f"`{c}`" for c in keep], component.alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, component).alias("explained"), F.lit(error).alias("identity_error"))
