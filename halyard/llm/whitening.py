"""Whitening of embeddings: principal components by cyclic Jacobi rotations, every vector scaled to unit variance.

Entries become whole numbers, ``floor(1024 c) + 100000``, so sums are exact and a vector's distance from the
mean is exact too. Three passes over the vectors, each a map with partial sums a task: the sums, the scatter around the
mean (centred before multiplying, so nothing cancels), and, once the components are known, the covariance of the
whitened rows, whose distance from the identity is reported. Nothing but sums is shuffled; the driver holds one square
matrix a side as long as a vector, and what is broadcast is the mean and the wanted components.

The driver turns the scatter by symmetric Jacobi rotations: a sweep meets every pair of dimensions once, in rounds of
disjoint pairs, and sweeps go on until every off-diagonal entry is below rounding beside its own two diagonal
entries, which keeps small eigenvalues accurate.

Vectors that are null, empty, or hold null or non-finite entries, or one whose whole number is beyond 2^52, are left out. Of vectors of several
lengths only those of the commonest (of equally common ones the longest) are fitted and returned, as others have no covariance with
them. Repeated rows count each; equal eigenvalues take any order. A component without variance has whitened values
of 0 and counts against the identity. A deviation that is no long any more is null. An empty table gives no rows; other
columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 52)
OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
OUT_SQL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a symmetric matrix, by falling eigenvalue.

    A round rotates disjoint pairs at once; the rounds of a sweep are those of a round-robin, so each pair meets
    once. It ends when a sweep finds nothing to rotate."""
    a = np.array(matrix, np.float64)
    n = len(a)
    vectors = np.eye(n)
    seats = np.arange(n + n % 2)  # an odd side has one seat too many
    eps = np.finfo(np.float64).eps
    least = eps * eps * float(np.abs(np.diag(a)).sum()) / max(n, 1)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.minimum(seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]), np.maximum(seats[: len(seats) // 2], seats[::-1][: len(seats) // 2])
            p, q = p[q < n], q[q < n]
            off, x, y = a[p, q], a[p, p], a[q, q]
            go = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(x * y)), least)
            if go.any():
                turned = True
                p, q, off, x, y = p[go], q[go], off[go], x[go], y[go]
                half = (y - x) / (2 * off)
                t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                rows_p, rows_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                cols_p, cols_q = a[:, p].copy(), a[:, q].copy()
                a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
                a[p, p], a[q, q], a[p, q], a[q, p] = x - t * off, y + t * off, 0.0, 0.0
                own_p, own_q = vectors[:, p].copy(), vectors[:, q].copy()
                vectors[:, p], vectors[:, q] = c * own_p - s * own_q, s * own_p + c * own_q
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    else:
        if np.abs(a - np.diag(np.diag(a))).max(initial=0.0) > n * eps * np.abs(np.diag(a)).max(initial=0.0):
            raise RuntimeError("rotations did not settle")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: rows, whole sums a dimension, and the wanted components with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean: n x - S is whole, so there is one rounding."""
        top = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)])
        if top < 1 << 61:
            return (x * self.n - np.array(self.sums, np.int64)).astype(np.float64) / self.n
        return ((x.astype(object) * self.n - np.array(self.sums, object)) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Whole sums of (n x - S)^2 a row; None where it is no long."""
        top = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)])
        if top < 1 << 61:
            d = x * self.n - np.array(self.sums, np.int64)
            if float(np.abs(d).max(initial=0)) ** 2 * x.shape[1] < 2**62:
                return (d * d).sum(axis=1).tolist()
            d = d.astype(object)
        else:
            d = x.astype(object) * self.n - np.array(self.sums, object)
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows projected on the components, each of unit variance; 0 where there is none."""
        some = self.values > np.finfo(np.float64).eps * max(self.trace, 0.0)
        scale = np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), 0.0)
        return self.centred(x) @ self.vectors * scale


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x (whole numbers) of the rows that can be fitted."""
    c = F.transform(column, lambda v: v.cast("double"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > LARGEST / SCALE)
    rows = vectors.select("vec_id", c.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(~F.exists("c", odd))
    rows = rows.select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return rows.filter(F.size("x") == (common["d"] if common else 0))


def matrix_of(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def partial_sums(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], float]:
    """{(i, j): sum} of the square matrices, one a batch, that ``of`` gives of its rows: added a task, then by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                for part in np.array_split(matrix_of(batch), len(batch) // 4096 + 1):
                    m = of(part)
                    total = m if total is None else total + m
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], names=["i", "j", "v"])

    summed = rows.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in summed.collect()}


def square(entries: dict[tuple[int, int], float], side: int) -> np.ndarray:
    out = np.zeros((side, side))
    for (i, j), v in entries.items():
        out[i, j] = out[j, i] = v
    return out


def whole_sums(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """(rows, exact sums a dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if len(batch):
                x = matrix_of(batch)
                # sums of the halves of the numbers cannot overflow
                high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                s = high.astype(object) * (1 << 26) + low.astype(object)
                n, total = n + len(x), s if total is None else total + s
        if total is not None:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(v)) for v in total], kind)], names=["i", "n", "s"])

    summed = rows.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("i").collect()
    return (summed[0]["n"] if summed else 0), tuple(int(r["s"]) for r in summed)


def fit(rows: DataFrame, components: int | None = None) -> Whitening:
    """The whitening of ``rows(x)`` by their first ``components`` components, or all."""
    n, sums = whole_sums(rows)
    side = len(sums)
    if not n:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    mean = Whitening(n, sums, np.zeros(0), np.zeros((side, 0)), 0.0)

    def scatter(x: np.ndarray) -> np.ndarray:
        d = mean.centred(x)
        return d.T @ d

    covariance = square(partial_sums(rows, scatter), side) / n
    values, vectors = jacobi(covariance)
    k = side if components is None else min(components, side)
    return Whitening(n, sums, values[:k], vectors[:, :k], float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance less the identity, in a pass of its own."""

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.concatenate([model.whitened(x), np.ones((len(x), 1))], axis=1)
        return w.T @ w

    k = len(model.values)
    m = square(partial_sums(rows, moments), k + 1) / model.n
    # the rows are centred before they are projected: their mean is what rounding left
    covariance = m[:k, :k] - np.outer(m[:k, k], m[:k, k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whitening_digest(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each fitted row of
    ``vectors(vec_id, embedding)`` and each of the first ``components`` components."""
    rows = whole_vectors(vectors)
    model = fit(rows, components)
    if not model.n:
        return vectors.sparkSession.createDataFrame([], OUT_SQL)
    error = identity_error(rows, model)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.values)
        explained = own.values / own.trace if own.trace > 0 else np.zeros(k)
        for batch in batches:
            if len(batch):
                x, n = matrix_of(batch), len(batch)
                repeat = np.repeat(np.arange(n), k)
                columns = [
                    batch.column("vec_id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, own.n), pa.int64()),
                    pa.array(own.deviations(x), pa.int64()).take(pa.array(repeat)), pa.array(own.whitened(x).reshape(-1), pa.float64()), pa.array(np.tile(explained, n), pa.float64()), pa.array(np.full(n * k, error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=OUT)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, OUT_SQL)
