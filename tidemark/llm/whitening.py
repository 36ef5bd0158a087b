"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass multiplies it with a thin matrix Q: every task centres its
blocks of vectors and adds up X'(XQ), and the tasks' sums are added. A Chebyshev
polynomial of the covariance, evaluated by its three-term recurrence with one pass a degree, is
small on the unwanted part of the spectrum and grows fast above it; after each polynomial the basis
is made orthonormal, and Rayleigh-Ritz gives eigenvalue and vector estimates. This repeats until
the residuals certify the wanted pairs.

Only matrices of dimension x basis size reach the driver. Its own steps keep to plain array
expressions, so that no threaded linear algebra runs beside the gateway's threads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: An entry c becomes floor(SCALE * c) + OFFSET; entries of 2^46 or more in size do not fit.
SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 46)
#: Vectors beside the wanted ones in the basis, most degrees of a polynomial, most rounds.
EXTRA, DEGREE, ROUNDS = 16, 16, 60
#: Residuals, as a share of the largest eigenvalue, that certify a pair, and the rank tolerance.
RESIDUAL, NO_RANK = 2e-14, 1e-13
#: Bytes of vectors in a block and in a partition of the fit list.
BLOCK_BYTES, PARTITION_BYTES = 4 << 20, 64 << 20
#: Sums of tasks that the driver adds itself; more are first added by fewer tasks.
DRIVER_BYTES = 16 << 20


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole: no null, infinite, undefined or huge entry."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False)))
    own = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(good)
    return own.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(OFFSET)).alias("x"))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def pack_blocks(fit: DataFrame, d: int) -> DataFrame:
    """The vectors as binary blocks of int64, so that passes read them without building rows."""
    schema = pa.schema([("block", pa.binary())])
    per = max(1, BLOCK_BYTES // (8 * d))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for f in frames:
            held.append(matrix_of(f.column("x"), d))
            n += len(held[-1])
            if n >= per:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], schema=schema)
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], schema=schema)

    return fit.mapInArrow(run, "block binary")


class Covariance:
    """V = X'X / n of the centred fit list, known by its products alone."""

    def __init__(self, blocks: DataFrame, n: int, mean: np.ndarray):
        self.blocks, self.n, self.mean, self.passes = blocks, n, mean, 0
        self.tasks = blocks.rdd.getNumPartitions()

    def _summed(self, each: Callable[[np.ndarray], np.ndarray], k: int, rows: int) -> np.ndarray:
        """Sum over all blocks of `each`(centred block), a matrix of `rows` x `k`."""
        d, mean = len(self.mean), self.mean
        schema = pa.schema([("part", pa.binary())])

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, k))
            for f in frames:
                for b in f.column("block"):
                    total += each(np.frombuffer(b.as_buffer(), np.int64).reshape(-1, d) - mean)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

        def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(rows * k)
            for f in frames:
                for b in f.column("part"):
                    total += np.frombuffer(b.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

        parts, tasks = self.blocks.mapInArrow(run, "part binary"), self.tasks
        while tasks * rows * k * 8 > DRIVER_BYTES and tasks > 8:
            tasks = int(np.ceil(np.sqrt(tasks)))
            parts = parts.repartition(tasks).mapInArrow(add, "part binary")
        out = np.zeros((rows, k))
        for r in parts.collect():
            out += np.frombuffer(r["part"]).reshape(rows, k)
        return out / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        return self._summed(lambda x: x.T @ (x @ q), q.shape[1], q.shape[0])

    def gram(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the fit list's images XW, centred by their own zero mean."""

        def each(x: np.ndarray) -> np.ndarray:
            y = x @ w
            return y.T @ y

        return self._summed(each, w.shape[1], w.shape[1])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b of thin matrices without the threaded library."""
    return np.einsum("ij,ik->jk", a, b)


def orthonormal(q: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The Q of a QR factorisation by Gram-Schmidt, run twice; a dependent column is replaced by noise."""
    q = q.copy()
    for j in range(q.shape[1]):
        size = np.sqrt((q[:, j] ** 2).sum())
        for _ in range(4):
            for _ in range(2):
                q[:, j] -= (q[:, :j] * (q[:, :j] * q[:, j : j + 1]).sum(axis=0)).sum(axis=1)
            left = np.sqrt((q[:, j] ** 2).sum())
            if left > 1e-10 * size and left > 0:
                break
            q[:, j] = rng.standard_normal(len(q))
            size = np.sqrt((q[:, j] ** 2).sum())
        q[:, j] /= np.sqrt((q[:, j] ** 2).sum())
    return q


def rotate(q: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk->ik", q, u)


def leading(v: Covariance, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The `count` largest eigenvalues, falling, their unit vectors in columns, and the largest
    certified residual as a share of the largest eigenvalue."""
    d = len(v.mean)
    size = min(d, count + EXTRA)
    rng = np.random.default_rng(d)
    q = orthonormal(rng.standard_normal((d, size)), rng)
    best = None
    for round_ in range(ROUNDS):
        image = v.times(q)
        h = product(q, image)
        values, u = np.linalg.eigh((h + h.T) / 2)  # size x size
        values, u = values[::-1], u[:, ::-1]
        q, image = rotate(q, u), rotate(image, u)
        scale = max(values[0], np.finfo(float).tiny)
        residual = float(np.sqrt(((image - q * values) ** 2).sum(axis=0))[:count].max() / scale)
        if best is None or residual < best[2]:
            best, since = (values[:count], q[:, :count], residual), 0
        else:
            since += 1
        # Certified, or as near as rounding lets residuals come: five rounds without a better one.
        if residual <= RESIDUAL or (since >= 5 and best[2] < 1e-10) or size == d and round_ >= 2:
            break
        # Unwanted: from zero to the smallest Ritz value of the basis. First image: q at degree 1.
        top = max(float(values[-1]), 1e-12 * scale)
        if size == d:
            q = orthonormal(image, rng)
            continue
        # A degree that grows the largest pair by at most 1e12 over the rest keeps the basis well conditioned.
        degree = int(np.clip(np.log(2e12) / np.arccosh(max(2 * values[0] / top - 1, 1.0001)), 2, DEGREE))
        half = top / 2
        sigma = half / (values[0] - half) if values[0] > half else 1.0
        first, rate = sigma, sigma
        before, now = q, (image - half * q) * (rate / half)
        for _ in range(degree - 1):
            then = 1 / (2 / first - rate)
            after = 2 * (then / half) * (v.times(now) - half * now) - rate * then * before
            before, now, rate = now, after, then
        q = orthonormal(now, rng)
    return best


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per whole vector and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation, whitened, explained, identity_error.

    A vector is dropped where it is null or empty, holds a null, infinite or undefined entry or one
    of 2^46 or more, or is not of the most frequent length (the smaller on ties). The fit list
    holds each distinct integer vector once, so repeated rows do not weigh more but each get their
    rows. deviation is the exact sum over dimensions of (n x - S)^2, null where a long cannot hold
    it. Components whose eigenvalue is zero to rounding are not returned, as they cannot be scaled
    to variance one: a table with a single distinct vector, or an empty one, gives no rows. Null
    ids are kept. Equal eigenvalues come in any, but one, order.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = scratch.stage(integer_vectors(vectors, id_col, vec_col), "integers")
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    d = lengths["d"]
    x = x.where(F.size("x") == d)
    distinct = scratch.stage(x.select("x").distinct(), "distinct")  # copies meet after a partial aggregate
    n = distinct.count()
    partitions = max(min(spark.sparkContext.defaultParallelism, n // 1024 + 1), n * d * 8 // PARTITION_BYTES + 1)
    blocks = scratch.stage(pack_blocks(distinct.repartition(partitions), d), "blocks")

    # Exact sums: one row per task, added as longs.
    schema = pa.schema([("i", pa.int32()), ("s", pa.int64())])

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, np.int64)
        for f in frames:
            for b in f.column("block"):
                total += np.frombuffer(b.as_buffer(), np.int64).reshape(-1, d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], schema=schema)

    sums = np.zeros(d, np.int64)
    for r in blocks.mapInArrow(add, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = r["s"]
    mean = sums / n
    v = Covariance(blocks, n, mean)
    trace = float(v._summed(lambda b: (b * b).sum(axis=0)[:, None], 1, d).sum())
    values, q, residual = leading(v, min(components, d)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), 0.0)
    rank = int((values > NO_RANK * max(trace, values.max(initial=0))).sum()) if trace > 0 else 0
    if not rank:
        return spark.createDataFrame([], result)
    values, q = values[:rank], q[:, :rank]
    weights = q / np.sqrt(values)
    error = float(np.abs(v.gram(weights) - np.eye(rank)).max())
    explained = values / trace
    out = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
        ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def project(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in frames:
            m = matrix_of(f.column("x"), d)
            far = n * m - sums
            # int64 sums wrap around; where the double says that a long cannot hold it, null.
            fits = (far.astype(float) ** 2).sum(axis=1) < 9.2e18
            deviation = pa.array(np.repeat((far * far).sum(axis=1), rank), pa.int64(), mask=np.repeat(~fits, rank))
            white = (m - mean) @ weights
            rows = len(m)
            yield pa.RecordBatch.from_arrays([
                f.column("vec_id").take(pa.array(np.repeat(np.arange(rows), rank))), pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * rank, n, np.int64)), deviation, pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * rank, error)),
            ], schema=out)

    return x.mapInArrow(project, result)
