"""Embedding whitening (12) with Spark MLlib's BlockMatrix.

1. The usable vectors become integer rows x = floor(scale * c) + shift, numbered 0 to n - 1 and written once; their
   per-dimension sums are one aggregate.
2. The centred rows x - S / n are an ``IndexedRowMatrix``, cut into a ``BlockMatrix`` of whole-width blocks.  Its
   transpose times itself is the scatter matrix; the product's middle dimension is split, so that each task adds up
   the products of its own blocks before any are shuffled.
3. The scatter matrix (dimension x dimension, however many rows) is the only thing that reaches the driver, where
   ``eigh`` gives the components.
4. The blocks times the whitening matrix (eigenvectors over the roots of their eigenvalues) are the projected rows.
5. The covariance of the projected rows is aggregated again and compared with the identity.

Cases: a vector that is null, empty or holds a null, a non-finite entry or one whose x is beyond 2^52 takes no part,
nor does one of another width than most have (the wider, if as many have either); rows without an id and repeated rows
take part like others; a component without variance (an eigenvalue of no more than rounding) is given, with whitened
and explained 0, and left out of identity_error; eigenvectors are turned so that their largest entry is positive (of
equal ones, the first); equal eigenvalues span a space in which any basis may be given; ``deviation`` is null where it
is beyond a long; an empty table gives no rows; clashing extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.arrowtext import saved, ship

BLOCK_BYTES = 1 << 21       # of doubles in a block: what a task multiplies at once
BLOCKS_A_TASK = 16          # blocks whose products a task adds up
LARGEST = float(1 << 52)    # of an x
ROUNDING = 1e-12            # share of the trace up to which an eigenvalue is no variance


def usable(rows: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """Id and x of the vectors that take part."""
    entries = F.transform(F.col("v"), lambda c: F.floor(c.cast("double") * scale).cast("double") + shift)
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) <= LARGEST / scale))
    x = (rows.select(rows[id_col].alias("id"), rows[vector_col].alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
         .where(finite).select("id", entries.alias("x")).where(fine))
    width = x.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return x.where(F.size("x") == (width["width"] if width else 0)).select("id", F.transform("x", lambda c: c.cast("long")).alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """The rows, written, with ``index`` 0 to n - 1: the place within a part plus the sizes of the parts before it."""
    at = F.monotonically_increasing_id()
    kept = saved(rows.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place")), "whitening")
    sizes = sorted((r["part"], r["n"]) for r in kept.groupBy("part").agg(F.count("*").alias("n")).collect())   # a row a task
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    start = kept.sparkSession.createDataFrame(starts, "part long, start long")
    return kept.join(F.broadcast(start), "part").select((F.col("start") + F.col("place")).alias("index"), "id", "x")


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension (of at most 2^38 - 1 digits, whatever n)."""
    got = x.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("d").collect()   # a row a dimension
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [])


def blocks_of(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """``rows`` (index, v: array of double) as a BlockMatrix of blocks as wide as the rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(1, BLOCK_BYTES // (8 * width)), width)


def scatter(m: BlockMatrix) -> np.ndarray:
    """m' m.  The middle dimension is split so that every task has at most ``BLOCKS_A_TASK`` blocks."""
    blocks = -(-m.numRows() // m.rowsPerBlock)
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, max(1, -(-blocks // BLOCKS_A_TASK)))
    local = BlockMatrix(product, m.colsPerBlock, m.colsPerBlock).toLocalMatrix().toArray()
    return (local + local.T) / 2


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a covariance and their eigenvectors, as columns."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    for j in range(vectors.shape[1]):
        if vectors[np.argmax(np.abs(vectors[:, j])), j] < 0:
            vectors[:, j] = -vectors[:, j]
    return values, vectors


def deviations(n: int, s: list[int]) -> Column:
    """Exact sum over dimensions of (n x - S)^2, null beyond a long."""
    wide = lambda c: c.cast("decimal(19,0)")
    apart = F.zip_with("x", F.array(*[F.lit(v).cast("decimal(38,0)") for v in s]),
                       lambda a, b: (F.lit(n).cast("decimal(18,0)") * a.cast("decimal(19,0)") - b).cast("decimal(38,0)"))
    total = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"),
                        lambda t, d: (t + (wide(d) * wide(d)).cast("decimal(38,0)")).cast("decimal(38,0)"))
    return total.try_cast("long")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000,
           k: int = 8) -> DataFrame:
    """A row for each usable vector: ``id_col``, n, deviation (exact sum over dimensions of (n x - S)^2), whitened
    (array of the first k components), explained (array: share of the trace), identity_error (largest absolute entry
    of the whitened rows' covariance minus the identity)."""
    ship(rows.sparkSession)
    spark = rows.sparkSession
    x = numbered(usable(rows, id_col, vector_col, scale, shift))
    n, s = sums(x)
    kind = f"{rows.schema[id_col].dataType.simpleString()}"
    if not n:
        return spark.createDataFrame([], f"`{id_col}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    mean = F.array(*[F.lit(v / n) for v in s])
    m = blocks_of(x.select("index", F.zip_with("x", mean, lambda a, b: a.cast("double") - b).alias("v")), n, len(s))
    cov = scatter(m) / n
    values, vectors = components(cov, k)
    trace = float(np.trace(cov))
    live = values > ROUNDING * trace if trace > 0 else np.zeros(len(values), bool)
    by = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), 0)
    whitening = DenseMatrix(len(s), len(values), (vectors * by).ravel(order="F").tolist())
    w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), whitening)], 1), m.colsPerBlock, len(values), len(s), len(values))
    z = m.multiply(w).toIndexedRowMatrix().rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
    z = saved(spark.createDataFrame(z, "index long, whitened array<double>"), "whitened")

    error = identity_error(z, n, [i for i, ok in enumerate(live) if ok])
    explained = F.array(*[F.lit(float(max(v, 0) / trace) if ok else 0.0) for v, ok in zip(values, live)])
    return x.join(z, "index").select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), deviations(n, s).alias("deviation"),
                                     "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(z: DataFrame, n: int, live: list[int]) -> float:
    """How far the covariance of ``whitened`` is from the identity, by the components with variance."""
    if not live:
        return 0.0
    at = lambda i: F.col("whitened")[i]
    means = z.agg(*[F.avg(at(i)).alias(f"m{i}") for i in live]).first()
    pairs = [(i, j) for i in live for j in live if i <= j]
    got = z.agg(*[F.sum((at(i) - means[f"m{i}"]) * (at(j) - means[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)
