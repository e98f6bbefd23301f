"""Whitening of embeddings: components of unit variance along the leading axes of their covariance.

Vectors become whole numbers first, so sums and distances from the mean are exact. The fit
list is each distinct vector once. Three passes read it, each adding up partial results inside
tasks: sums per dimension; products of centred vectors (a task holds one matrix of dimension
by dimension, and rows of the matrices are added by row number); and the covariance of the
whitened vectors, which tells how far it is from the identity. Only sums, that matrix and the
components come to the driver: their size depends on the dimension, not on the rows.

The matrix is solved on the driver: Householder reflections make it tridiagonal, bisection on
Sturm counts finds the leading eigenvalues, inverse iteration their vectors, made orthogonal
inside clusters of close eigenvalues, and the reflections take them back. The scaled components
are sent to all tasks and each vector is projected where it lies.

Defined cases: vectors that are null or empty, hold a null or non-finite entry, or one whose
whole number is beyond 64 bits take no part; of several lengths the one with most distinct
vectors counts (of equally many the longer) and others take no part. Rows that share an id, or
have none, are projected one by one; repeated vectors count once in the fit. Directions whose
variance is not above 1e-10 of the largest have no component, so equal vectors give no rows, as
does an empty table. ``deviation`` is null where it is beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import only, ship
from freshet.sources.workspace import stored

SCALE, SHIFT = 64, 1_000_000
#: Entries from here on do not fit into 64 bits once scaled.
TOO_LARGE = 2.0**62 / SCALE
#: Least variance of a component, as a share of the largest.
LEAST_SHARE = 1e-10
#: Eigenvalues nearer than this share of the matrix' norm are one cluster.
CLUSTER = 1e-3


# the small symmetric eigenproblem


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit reflectors that bring a symmetric matrix to that form."""
    a, reflectors = matrix.astype(np.float64, copy=True), []
    d = len(a)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm > 0:
            v[0] += np.copysign(norm, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - v * (v @ p)
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues are below each of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q, below = None, np.zeros(at.shape, np.int64)
    for a, b in zip(diagonal, np.insert(off * off, 0, 0.0), strict=True):
        q = a - at - (b / q if q is not None else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a zero counts as negative
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, largest first, by bisection to the last bit that matters."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    least, most = (diagonal - reach).min(), (diagonal + reach).max()
    slack = np.finfo(float).eps * max(abs(least), abs(most)) * d + np.finfo(float).tiny
    low, high = np.full(k, least - slack), np.full(k, most + slack)
    wanted = d - 1 - np.arange(k)  # so many eigenvalues are below the one looked for
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        above = count_below(diagonal, off, middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) x = right for tridiagonal T, rows exchanged for the larger pivot; a zero pivot becomes ``least``."""
    d = len(diagonal)
    main, upper, second, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    for i in range(d - 1):
        below, following, further = off[i], main[i + 1], upper[i + 1] if i + 1 < d - 1 else 0.0
        if abs(below) > abs(main[i]):
            factor = main[i] / below
            main[i], upper[i], second[i], old = below, following, further, upper[i]
            main[i + 1], upper[i + 1] = old - factor * following, -factor * further
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if main[i] == 0:
                main[i] = least
            factor = below / main[i]
            main[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
    for i in range(d - 1, -1, -1):
        x[i] -= upper[i] * x[i + 1] if i + 1 < d else 0.0
        x[i] -= second[i] * x[i + 2] if i + 2 < d else 0.0
        x[i] /= main[i] if abs(main[i]) > least else np.copysign(least, main[i])
    return x


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, one column per value, by inverse iteration.

    Values of one cluster are told apart by a few bits and each iterate is made orthogonal
    to the earlier vectors of its cluster."""
    d, norm = len(diagonal), max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    least, draw = np.finfo(float).eps * norm + np.finfo(float).tiny, np.random.default_rng(12)
    out, first, shift = np.zeros((d, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        shift = min(value, shift - 4 * least) if k > first else value
        x = draw.standard_normal(d)
        for _ in range(rounds):
            x = solve_shifted(diagonal, off, shift, x / np.abs(x).max(), least)
            for _ in range(2 if k > first else 0):
                x -= out[:, first:k] @ (out[:, first:k].T @ (x / np.linalg.norm(x))) * np.linalg.norm(x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = np.abs(matrix).max(initial=0.0)
    if scale == 0 or not k:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for j in range(len(reflectors) - 1, -1, -1):
        v, part = reflectors[j], vectors[j + 1 :]
        part -= 2 * np.outer(v, v @ part)
    return values * scale, vectors


# passes over the vectors


@dataclass(frozen=True)
class Fit:
    """What the projection needs: vectors in the fit list, sums per dimension, and the components as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - sum)^2, exact: in 64 bits where that is safe."""
        whole = np.array([s // self.n for s in self.sums])
        rest = np.array([s % self.n for s in self.sums])
        # whole part first: a difference of 64-bit numbers of one sign fits, others are caught by the bound
        most = max((abs(int(v)) for v in (x.max(axis=0, initial=0), x.min(axis=0, initial=0)) for v in v), default=0)
        bound = self.n * (most + int(np.abs(whole).max()) + 1)
        if bound < 2**62 and bound * bound * x.shape[1] < 2**63:
            return ((self.n * (x - whole) - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the mean; the whole part of the mean is taken off in whole numbers."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


def matrices(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the whole numbers of every vector that takes part."""
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | ~(F.abs(e) < TOO_LARGE))
    kept = only(embeddings, "vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return kept.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE) + SHIFT).alias("x"))


def _column_sums(batches: Iterable[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    high, low = np.zeros(dimension, np.int64), np.zeros(dimension, np.int64)
    for _, x in matrices(batches, dimension):
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(range(dimension), pa.int32()), pa.array(high), pa.array(low)], ["at", "high", "low"])


def column_sums(fit: DataFrame, dimension: int) -> tuple[int, ...]:
    """Exact sum of each dimension; halves of the numbers are added apart."""
    parts = fit.mapInArrow(partial(_column_sums, dimension=dimension), "at int, high long, low long")
    halves = parts.groupBy("at").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    return tuple((int(r.high) << 32) + int(r.low) for r in halves.orderBy("at").collect())


def _products(batches: Iterable[pa.RecordBatch], dimension: int, of) -> Iterator[pa.RecordBatch]:
    """One matrix per task, as rows: products of the vectors ``of`` makes, and below them their sums."""
    total = None
    for _, x in matrices(batches, dimension):
        v = of(x)
        part = np.vstack([v.T @ v, v.sum(axis=0)])
        total = part if total is None else total + part
    if total is not None:
        yield _rows(enumerate(total))


def _rows(rows: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    at, values = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["at", "products"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, row in zip(batch.column("at").to_pylist(), batch.column("products"), strict=True):
            values = row.values.to_numpy()
            total[at] = total[at] + values if at in total else values
    if total:
        yield _rows(total.items())


def products(fit: DataFrame, dimension: int, of) -> np.ndarray:
    """Sums over the fit list of v v' and, as last row, of v; rows are added where their number sends them."""
    kind = "at int, products array<double>"
    parts = fit.mapInArrow(partial(_products, dimension=dimension, of=of), kind)
    added = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism, "at").mapInArrow(_add, kind)
    return np.array([r.products for r in added.orderBy("at").collect()])


def fit_whitening(vectors: DataFrame, components: int) -> tuple[int, Fit | None]:
    """Dimension and fit of the stored distinct vectors ``x``; no fit where nothing varies."""
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return 0, None
    d, n = lengths["d"], lengths["count"]
    rows = vectors.where(F.size("x") == d).select("x")
    sums = column_sums(rows, d)
    covariance = products(rows, d, partial(centred, n=n, sums=sums))[:-1] / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading_components(covariance, min(components, d))
    kept = values > max(values.max(initial=0.0) * LEAST_SHARE, 0)
    if not kept.any():
        return d, None
    found = Fit(n, sums, values[kept], axes[:, kept], float(np.trace(covariance)))
    seen = products(rows, d, found.whitened) / n
    error = np.abs(seen[:-1] - np.outer(seen[-1], seen[-1]) - np.eye(kept.sum())).max()
    return d, Fit(n, sums, found.values, found.vectors, found.trace, float(error))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _project(batches: Iterable[pa.RecordBatch], dimension: int, fit: Fit) -> Iterator[pa.RecordBatch]:
    k = len(fit.values)
    explained = fit.values / fit.trace
    for batch, x in matrices(batches, dimension):
        for at in range(0, len(x), 2048):
            part, ids = x[at : at + 2048], batch.column("vec_id").slice(at, 2048)
            each = pa.array(np.repeat(np.arange(len(part)), k))
            columns = [
                ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))), pa.repeat(pa.scalar(fit.n, pa.int64()), len(each)),
                pa.array(fit.deviations(part), pa.int64()).take(each), pa.array(fit.whitened(part).ravel()),
                pa.array(np.tile(explained, len(part))), pa.repeat(fit.identity_error, len(each)),
            ]
            yield pa.RecordBatch.from_arrays(columns, NAMES)


def whiten_embeddings(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """One row per usable vector and component: its whitened value, the component's share of the
    variance, the vector's exact distance from the mean, and the error of the whitening."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(embeddings)
    # distinct vectors, combined before they move: a vector that a third of the rows have is one row per task
    d, fit = fit_whitening(stored(rows.select("x").distinct(), "whitening-fit"), components)
    if fit is None:
        return spark.createDataFrame([], WHITENED)
    return rows.where(F.size("x") == d).mapInArrow(partial(_project, dimension=d, fit=fit), WHITENED)
