"""Embedding whitening: covariance over all vectors, its leading components, every vector projected on them.

Sums, then centred products, are folded into a matrix in each task and added up in a tree of tasks, so that neither a task nor
the driver meets more than `FAN` matrices at a time. The driver gets one d x d matrix (d at most `MOST_DIM`): Householder
reflections make it tridiagonal, Sturm counts bisect for its leading eigenvalues, inverse iteration gives the components. The
components (k x d) are broadcast, and each task projects its own vectors. Nothing is keyed, so no value is a hot one.

Results in special cases:
- rows whose vector is null, empty or holds null or non-finite entries are left out, and don't count for the fit;
- vectors of several lengths: the most frequent length (of a tie the longer) is the dimension, others are left out;
- an entry beyond +-2**40 is an error, as sums would not be exact;
- repeated rows and repeated or null ids each count and come out as rows of their own;
- directions without variance (eigenvalue at most `RANK` of the trace) are no components, so there may be fewer than k; one row,
  equal rows or an empty table give no rows;
- other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SCALE, SHIFT = 1024.0, 100_000
FAN, MOST_DIM, RANK, FAR = 64, 4096, 1e-11, 2.0**40


def quantised(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch take part, and their vectors as whole numbers floor(1024 c) + 100000."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)  # null becomes nan
    good = np.isfinite(flat).all(1)
    scaled = np.floor(SCALE * flat[good])
    if scaled.size and np.abs(scaled).max() > SCALE * FAR:
        raise ValueError("an entry of a vector lies beyond 2**40")
    return rows[good], scaled.astype(np.int64) + SHIFT


def added(vectors: DataFrame, dim: int, shape: tuple[int, ...], kind: type, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of `fold`, an array of the shape for each batch."""

    def add(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, kind), False
        for array in arrays:
            total, some = total + array, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(fold(quantised(batch.column(0), dim)[1]) for batch in batches)

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return add(np.frombuffer(part.as_py(), kind).reshape(shape) for batch in batches for part in batch.column(0))

    parts = vectors.select("embedding").mapInArrow(leaf, "part binary")
    n = parts.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInArrow(node, "part binary")
    found = parts.collect()  # one row, or none
    return np.frombuffer(found[0]["part"], kind).reshape(shape) if found else np.zeros(shape, kind)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of Q' A Q, and the unit vectors whose reflections make up Q."""
    a, n, mirrors = a.copy(), len(a), []
    for j in range(n - 2):
        x = a[j + 1 :, j].copy()
        length = np.linalg.norm(x)
        v = x
        v[0] += np.copysign(length, x[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        mirrors.append(v)
        if size > 0:
            sub = a[j + 1 :, j + 1 :]
            p = sub @ v
            w = 2 * (p - (v @ p) * v)
            sub -= np.outer(v, w) + np.outer(w, v)
            a[j + 1 :, j] = a[j, j + 1 :] = 0
            a[j + 1, j] = a[j, j + 1] = -np.copysign(length, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def reflected(mirrors: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Q y: an eigenvector of the tridiagonal matrix as one of the original."""
    y = y.copy()
    for v in reversed(mirrors):
        y[-len(v) :] -= 2 * (v @ y[-len(v) :]) * v
    return y


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each x."""
    tiny = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0)))
    q = diagonal[0] - x
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], off):
        q = d - x - e * e / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until no double lies between the bounds."""
    n = len(diagonal)
    radius = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    reach = max(np.abs(diagonal).max() + radius.max(), np.finfo(float).tiny)
    low, high = np.full(k, -2 * reach), np.full(k, 2 * reach)
    wanted = n - np.arange(k)  # the eigenvalue is the wanted-th smallest
    while True:
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all() or (high - low).max() <= np.finfo(float).eps * reach * 1e-3:
            return middle
        above = below(diagonal, off, middle) < wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solve(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """y with (T - shift) y = b, by elimination with row exchanges; a vanishing pivot counts as a tiny one."""
    n = len(diagonal)
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    pivot, first, second, y = np.zeros(n), np.zeros(n), np.zeros(n), b.astype(float).copy()
    d, e = diagonal[0] - shift, off[0] if n > 1 else 0.0
    for i in range(n - 1):
        under, d2, e2 = off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < n else 0.0
        if abs(under) > abs(d):
            pivot[i], first[i], second[i] = under, d2, e2
            factor = d / under
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
            d, e = e - factor * d2, -factor * e2
        else:
            pivot[i], first[i] = d if abs(d) > tiny else tiny, e
            factor = under / pivot[i]
            y[i + 1] -= factor * y[i]
            d, e = d2 - factor * e, e2
    pivot[n - 1] = d if abs(d) > tiny else tiny
    for i in range(n - 1, -1, -1):
        later = first[i] * y[i + 1] if i + 1 < n else 0.0
        later += second[i] * y[i + 2] if i + 2 < n else 0.0
        y[i] = (y[i] - later) / pivot[i]
    return y


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Eigenvalues closer than a thousandth of the norm are a cluster: in each step of inverse iteration a vector is made
    orthogonal to those of its cluster that came before it.
    """
    diagonal, off, mirrors = tridiagonal(v)
    values = leading(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0), np.finfo(float).tiny)
    draw, found, start = np.random.default_rng(7), [], 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            start = i
        y = draw.normal(size=len(diagonal))
        for _ in range(5):
            y = solve(diagonal, off, value, y / np.abs(y).max())
            for _ in range(2):  # twice is enough
                for other in found[start:]:
                    y -= (other @ y) * other
            y /= np.linalg.norm(y)
        found.append(y)
    return values, np.stack([reflected(mirrors, y) for y in found])


def whiten(vectors: DataFrame, k: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each vector on up to k whitened components.

    `deviation` is decimal(38, 0): a sum of squares of n * x - S is exact at any number of rows.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    out = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    nothing = vectors.sparkSession.createDataFrame([], out)
    usual = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return nothing
    dim = usual["dim"]
    if dim > MOST_DIM:
        raise ValueError(f"{dim} dimensions: the covariance is for at most {MOST_DIM}")
    sums = added(vectors, dim, (dim + 1,), np.int64, lambda x: np.concatenate([[len(x)], x.sum(0)]))
    n, s = int(sums[0]), sums[1:]
    if n == 0:
        return nothing
    mean = s / n

    def products(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    v = added(vectors, dim, (dim, dim), np.float64, products) / n
    trace = float(np.trace(v))
    if trace <= 0:
        return nothing
    values, rows = components((v + v.T) / 2, min(k, dim))
    keep = values > RANK * trace
    values, rows = values[keep], rows[keep]
    if not len(values):
        return nothing
    model = vectors.sparkSession.sparkContext.broadcast((rows / np.sqrt(values)[:, None], mean, s, n))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, mean, s, n = model.value
        for batch in batches:
            at, x = quantised(batch.column(1), dim)
            far = n * x.astype(object) - s if n * (np.abs(x).max(initial=0) + FAR) > 2**62 else n * x - s
            if far.dtype == object or np.abs(far).max(initial=0) > np.sqrt(2.0**62 / dim):
                far = far.astype(object)
            deviation = [int(d) for d in (far * far).sum(1)]
            w = (x - mean) @ scaled.T
            offsets = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(deviation, pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))],
                names=["vec_id", "deviation", "w"],
            )

    done = cut(vectors.select("vec_id", "embedding").mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    w = [F.col("w")[i] for i in range(len(values))]
    centre = done.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(len(w)) for j in range(i + 1)]
    covariance = done.agg(*[F.avg((w[i] - F.lit(centre[i])) * (w[j] - F.lit(centre[j]))) for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs))
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
