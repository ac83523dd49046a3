"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Each entry c becomes the integer x = floor(1024 c) + 100000. Four scans of the vectors, none with a shuffle of rows:

1. Their number n and the exact sums S of each dimension (decimals, added natively).
2. The scatter of x - S/n, that is of (n x - S) / n, where n x - S is an exact integer. A task gives one partial matrix; the
   partials are added row by row in several tasks, so the driver gets one matrix, whose size depends on the dimension alone.
3. The covariance of the whitened rows, centred by each task's own mean and put together with the means' distances.
4. The result, eight rows a vector.

Between 2 and 3 the driver factors the scatter, P'VP = LL' with pivots in falling order, and stops where the largest pivot left is rounding
noise: what is left has no variance. One-sided Jacobi turns pairs of columns of L until all are orthogonal. The squared
norms of the turned columns are the eigenvalues of V and the normalised columns its eigenvectors, with high relative accuracy, as
no product of matrices is formed. All pairs of one round of a tournament are turned at once.

Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those not of the most frequent length. Entries
beyond 2^40 are held at 2^40. Repeated rows all count and all return; null ids stay. A direction without variance has no
component, so equal vectors, a single one or an empty table give no row. ``deviation`` is null where it passes a long.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches
from .vectors import dimension, matrix, usable

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MOST = float(1 << 40)
#: Tasks that add the partial matrices up.
ADDERS = 16


class Basis(NamedTuple):
    n: int
    sums: list[int]
    vectors: np.ndarray      # one column a component
    eigenvalues: np.ndarray  # falling
    trace: float


def scaled(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(values * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def distances(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where these hold it, Python's integers where not."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(distance: np.ndarray) -> list[int | None]:
    """Sums of squares of each row; null where a long cannot hold it."""
    most = int(np.abs(distance).max(initial=0))
    if most * most * distance.shape[1] < 1 << 63:
        return (distance.astype(np.int64) ** 2).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) * int(v) for v in row) for row in distance)]


def sums_of(rows: DataFrame, vector: str, width: int) -> tuple[int, list[int]]:
    def add(batches):
        n, total = 0, [0] * width
        for batch in batches:
            x = scaled(matrix(batch.column(0), width))
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(0))]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, width), pa.int32()), "total": pa.array([str(v) for v in (n, *total)])})

    found = (rows.select(vector).mapInArrow(add, "dim int, total string")
             .groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    by_dim = {r["dim"]: int(r["total"]) for r in found.collect()}  # one number a dimension
    return by_dim[-1], [by_dim[d] for d in range(width)]


def summed(partials: DataFrame, width: int) -> np.ndarray:
    """Sum of matrices given as (i, row): the rows of one i are added in one task, as they come."""
    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(blob, "<f8")
                total[i] = total[i] + row if i in total else row
        if total:
            yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "row": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    out = np.zeros((width, width))
    for i, blob in partials.repartition(ADDERS, "i").mapInArrow(add, "i int, row binary").collect():  # one matrix
        out[i] = np.frombuffer(bytes(blob), "<f8")
    return out


def as_rows(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"i": pa.array(range(len(values)), pa.int32()), "row": pa.array([v.tobytes() for v in values], pa.binary())})


def scatter(rows: DataFrame, vector: str, width: int, n: int, sums: list[int]) -> np.ndarray:
    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            centred = distances(scaled(matrix(batch.column(0), width)), n, sums).astype(float) / n
            total += centred.T @ centred
        yield as_rows(total)

    return summed(rows.select(vector).mapInArrow(add, "i int, row binary"), width)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with its rows in the order of ``a`` and L L' = a, as many columns as ``a`` has rank."""
    p = len(a)
    factor, left = np.zeros((p, p)), a.diagonal().copy()
    noise = p * np.finfo(float).eps * left.max(initial=0)
    for k in range(p):
        i = int(np.argmax(left))
        if left[i] <= noise:
            return factor[:, :k]
        column = (a[:, i] - factor[:, :k] @ factor[i, :k]) / np.sqrt(left[i])
        column[left < 0] = 0  # rows already taken as pivots
        column[i] = np.sqrt(left[i])
        factor[:, k] = column
        left = np.where(left < 0, left, np.maximum(left - column ** 2, 0))
        left[i] = -1
    return factor


def rounds(m: int):
    """Pairs of a tournament: in m - 1 rounds everybody (m even) meets everybody, in each round once."""
    seats = list(range(m))
    for _ in range(m - 1):
        yield np.array(seats[: m // 2]), np.array(seats[: m // 2 - 1: -1])
        seats = [seats[0], seats[-1], *seats[1:-1]]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of factor factor': columns are turned in pairs until they are orthogonal."""
    p, rank = factor.shape
    m = rank + rank % 2
    g = np.zeros((p, m))
    g[:, :rank] = factor
    for _ in range(sweeps):
        turned = False
        for a, b in rounds(m):
            x, y = g[:, a], g[:, b]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            open_ = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if not open_.any():
                continue
            turned = True
            zeta = (yy - xx)[open_] / (2 * xy[open_])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            a, b, x, y = a[open_], b[open_], x[:, open_], y[:, open_]
            g[:, a], g[:, b] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    values = (g * g).sum(0)
    order = np.argsort(-values, kind="stable")[:rank]
    vectors = g[:, order] / np.sqrt(values[order])
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(rank)]) if rank else 1.0
    return values[order], vectors * sign


def fitted(rows: DataFrame, vector: str, width: int, components: int) -> Basis:
    n, sums = sums_of(rows, vector, width)
    v = scatter(rows, vector, width, n, sums) / n
    values, vectors = jacobi(pivoted_cholesky(v))
    return Basis(n, sums, vectors[:, :components], values[:components], float(np.trace(v)))


def projected(x: np.ndarray, basis: Basis) -> tuple[np.ndarray, np.ndarray]:
    """(distances, whitened rows)."""
    distance = distances(x, basis.n, basis.sums)
    return distance, (distance.astype(float) / basis.n) @ basis.vectors / np.sqrt(basis.eigenvalues)


def identity_error(rows: DataFrame, vector: str, width: int, basis) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity. ``basis`` is a broadcast."""
    k = len(basis.value.eigenvalues)

    def add(batches):
        n, mean, total = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            _, w = projected(scaled(matrix(batch.column(0), width)), basis.value)
            if not len(w):
                continue
            own = w.mean(0)
            apart, both = own - mean, n + len(w)
            total += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * len(w) / both)
            mean, n = mean + apart * (len(w) / both), both
        # the sums of n, n mean and n mean mean' put the tasks' own scatters together
        wide = np.zeros((2 * k + 1, 2 * k + 1))
        wide[:k, :k], wide[k:2 * k, k:2 * k], wide[-1, :k], wide[-1, -1] = total, n * np.outer(mean, mean), n * mean, n
        yield as_rows(wide)

    wide = summed(rows.select(vector).mapInArrow(add, "i int, row binary"), 2 * k + 1)
    n = wide[-1, -1]
    mean = wide[-1, :k] / n
    covariance = (wide[:k, :k] + wide[k:2 * k, k:2 * k]) / n - np.outer(mean, mean)  # the means are rounding noise about 0
    return float(np.abs(covariance - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, vector: str = "embedding", ids: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    arrow_batches(spark)
    rows = usable(embeddings.select(F.col(ids).cast("long").alias("vec_id"), F.col(vector).alias("vector")), "vector")
    width = dimension(rows, "vector")
    rows = rows.where(F.size("vector") == width)
    basis = fitted(rows, "vector", width, components) if width else None
    if basis is None or not len(basis.eigenvalues):
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(basis)  # a matrix of the dimension
    error = identity_error(rows, "vector", width, shared)

    def give(batches):
        k = len(shared.value.eigenvalues)
        share = shared.value.eigenvalues / shared.value.trace
        for batch in batches:
            distance, w = projected(scaled(matrix(batch.column(1), width)), shared.value)
            m = len(w)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, shared.value.n, np.int64)),
                "deviation": pa.array([d for d in squared(distance) for _ in range(k)], pa.int64()),
                "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(share, m)), "identity_error": pa.array(np.full(m * k, error))})

    return rows.select("vec_id", "vector").mapInArrow(give, RESULT)
