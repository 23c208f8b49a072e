"""Embedding whitening by shifted CholeskyQR.

The centred rows Y are orthogonalised without being stored: a pass sends each row through the triangular solves of all
factors so far, sums the Gram matrix of what comes out, and its Cholesky factor (of the shifted matrix in the first pass,
and wherever else it isn't definite) is the next one. When the Gram matrix is the identity but for rounding, Y = Q R with R
the product of the factors; the singular values and right vectors of R are those of Y, and so whiten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

PASSES = 8


def solved(y: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows y times the inverses of upper triangular factors, one after the other, by substitution."""
    for r in factors:
        out = np.empty_like(y)
        for j in range(len(r)):
            out[:, j] = (y[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        y = out
    return y


def factor(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper triangular R with R'R = gram, or gram plus a multiple of the identity."""
    d, unit = len(gram), np.finfo(np.float64).eps / 2
    s = 11 * (n * d + d * (d + 1)) * unit * np.linalg.norm(gram, 2) if shift else 0.0
    try:
        return np.linalg.cholesky(gram + s * np.eye(d)).T
    except np.linalg.LinAlgError:
        return factor(gram, n * 10, True)


def components(gram: np.ndarray, factors: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance; each vector's largest entry is positive.

    gram: of the rows after all solves. Its root times the product of the factors has the rows' singular values and right vectors.
    """
    r = np.eye(len(gram))
    for f in factors:
        r = f @ r
    level, turn = np.linalg.eigh((gram + gram.T) / 2)
    _, sigma, v = np.linalg.svd(np.sqrt(np.maximum(level, 0))[:, None] * (turn.T @ r))
    v = v.T * np.where(v[np.arange(len(v)), np.abs(v).argmax(1)] < 0, -1.0, 1.0)
    return sigma**2 / n, v


def _total(sums: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's summed matrix as rows (i, j, x)."""
    out = None
    for x in sums:
        out = x if out is None else out + x
    if out is not None:
        i, j = np.indices(out.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "x": out.ravel()})


def whitened(vectors: DataFrame, top: int = 32, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each kept vector and component up to `top`.

    Kept are vectors that are there and hold numbers only; their entries become x = floor(scale * c) + shift. deviation: sum over
    the dimensions of (n * x - S)**2, exact (more than a long raises). whitened: x - S / n along the component, in units of its
    deviation. Components without variance (a constant dimension, a single vector, vectors that are all alike) can't be whitened
    and have no rows; with equal variances any basis may come out, the same for all rows. identity_error, explained: see
    components(); one value each. Repeated rows and keys and null keys stay and are judged one by one; an empty table gives no
    rows; vectors of different lengths raise; other columns are not read. Tasks send sums of d * d numbers, d being the
    vectors' length; the driver gets their totals.
    """
    from resona.llm.vectors import integers, matrix, whole

    spark = vectors.sparkSession
    rows = vectors.where(whole(vector)).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    schema = StructType([StructField(key, vectors.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for lo in range(0, len(batch), 1 << 14):
                part = batch.slice(lo, 1 << 14)
                yield part, integers(matrix(part.column(1)), scale, shift)

    def column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _total(np.vstack([np.full(x.shape[1], len(x)), x.sum(0)]) for _, x in read(batches) if len(x))

    both = rows.mapInArrow(column_sums, "i int, j int, x long").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # two numbers a dimension
    if not both:
        return spark.createDataFrame([], schema)
    d = 1 + max(r.j for r in both)
    n, sums = np.zeros(d, np.int64), np.zeros(d, np.int64)
    for r in both:
        (sums if r.i else n)[r.j] = r.x
    if (n != n[0]).any():
        raise ValueError("vectors of different lengths in one column")
    n = int(n[0])

    def apart(x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if n * (int(np.abs(x).max(initial=0)) + 1) * 2 >= 1 << 63:
            raise OverflowError("n times an entry is too large for a long")
        return n * x - sums

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for part, x in read(batches):
            exact = apart(x)
            yield part, exact, exact / n

    def summed(f) -> np.ndarray:
        """The sum over all batches of f(centred rows), a matrix of fixed shape."""
        parts = rows.mapInArrow(lambda batches: _total(f(y) for _, _, y in centred(batches)), "i int, j int, x double")
        got = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()  # as many numbers as the matrix has
        out = np.zeros((1 + max(r.i for r in got), 1 + max(r.j for r in got)))
        for r in got:
            out[r.i, r.j] = r.x
        return out

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def one(y: np.ndarray) -> np.ndarray:
            q = solved(y, factors)
            return q.T @ q

        return summed(one)

    factors: list[np.ndarray] = []
    now = gram(factors)
    if now.trace() > 0:
        for number in range(PASSES):
            factors.append(factor(now, n, number == 0))
            before, now = now, gram(factors)
            if np.abs(now - np.eye(d)).max() < 1e-13 * d or number > 2 and np.abs(now - before).max() < 1e-13 * d:
                break
    else:
        return spark.createDataFrame([], schema)
    e, v = components(now, factors, n)
    share = e / e.sum()
    chosen = np.flatnonzero(e > e[0] * d * np.finfo(np.float64).eps)[:top]
    project = v[:, chosen] / np.sqrt(e[chosen])
    mean = summed(lambda y: (y @ project).sum(0)[None, :])[0] / n

    def spread(y: np.ndarray) -> np.ndarray:
        z = y @ project - mean
        return z.T @ z

    error = float(np.abs(summed(spread) / n - np.eye(len(chosen))).max())

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, exact, y in centred(batches):
            if float((exact.astype(np.float64) ** 2).sum(1).max(initial=0)) < 2.0**62:
                deviation = (exact**2).sum(1)
            else:
                deviation = np.array([sum(int(c) ** 2 for c in row) for row in exact], object)
            k, m = len(chosen), len(part)
            at = np.repeat(np.arange(m), k)
            cells = [part.column(0).take(pa.array(at)), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), pa.array(list(deviation[at]) if deviation.dtype == object else deviation[at], pa.int64()), (y @ project).ravel(), np.tile(share[chosen], m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cells], schema.names)

    return rows.mapInArrow(result, schema)
