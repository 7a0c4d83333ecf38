"""Whitening of embeddings by a cyclic Jacobi eigenvalue iteration.

Entries become integers, so sums and scatters are exact: tasks sum outer products of
rows centred at the rounded mean, the driver centres the rest exactly, and only then
divides. Jacobi rotations on the driver stop by the size of each off-diagonal entry
against its own two diagonal ones, which keeps small eigenvalues accurate. What goes
through the driver or a broadcast is the square of the dimension, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: The driver holds some squares of the dimension.
MOST_DIMENSIONS = 4096
#: An eigenvalue under so many times the largest one, a dimension, is rounding, no direction.
NOISE = 2.0**-50
SWEEPS = 60
_EXACT = 1 << 53


def grid(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as floor(64 c) + 1000000; rows whose vector is null, or holds null or
    non-finite entries, are gone."""
    c = F.transform(vector, lambda v: v.cast("double"))
    finite = ~F.exists(vector, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return embeddings.filter(F.col(vector).isNotNull() & finite).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


@dataclass
class Whitening:
    """What a fit found: n vectors with sums per dimension, components as columns by falling
    eigenvalue, all eigenvalues' sum."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def deltas(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        return self.n * x - self.sums

    def whiten(self, deltas: np.ndarray) -> np.ndarray:
        return (deltas / self.n) @ self.vectors / np.sqrt(self.values)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(x: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    for at in range(0, len(x), rows):
        yield x[at : at + rows]


def scatter(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """(i, j, s): sums of y_i y_j for i <= j, y = x - centre, exact. Products of blocks are in
    doubles while they stay under 2^53, else in Python integers; sums are decimals."""
    d = len(centre)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            for x in _blocks(_matrix(batch.column(0)), 4096):
                y = x - centre
                high = int(np.abs(y).max(initial=0))
                small = high * high * len(y) < _EXACT
                z = y.astype(np.float64 if small else object)
                product = z.T @ z
                total += product.astype(np.int64).astype(object) if small else product
        found = [str(int(v)) for v in total[upper]]
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(found)], ["i", "j", "s"])

    parts = rows.select("x").mapInArrow(run, "i int, j int, s string")
    return parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of dimensions once, in rounds of disjoint pairs (a round robin)."""
    seats = list(range(d + d % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], reversed(seats[half:]), strict=True) if max(a, b) < d]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix. Sweeps over
    all pairs rotate each off-diagonal entry away until none is above the rounding of the
    two diagonal entries it stands between. Equal eigenvalues keep their order."""
    a, v = np.array(matrix, np.float64), np.eye(len(matrix))
    rounds = _rounds(len(a))
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            turn = (off != 0) & (np.abs(off) > 2.0**-53 * np.sqrt(np.abs(app * aqq)))
            if not turn.any():
                continue
            turned, p, q, off, app, aqq = True, p[turn], q[turn], off[turn], app[turn], aqq[turn]
            with np.errstate(over="ignore"):
                tau = (aqq - app) / (2 * off)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            v[:, p], v[:, q] = v[:, p] * c - v[:, q] * s, v[:, p] * s + v[:, q] * c
            a[p, q] = a[q, p] = 0.0
            # The diagonal by its own short formula, which loses nothing to cancellation.
            a[p, p], a[q, q] = app - t * off, aqq + t * off
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of ``rows`` (vec_id, x), and these vectors. None
    where there are no rows or no direction to scale."""
    # Copies meet partial sums before the shuffle, so a very common vector is one row a task.
    distinct = stored(rows.groupBy("x").agg(F.first(F.lit(1)).alias("one")).select("x"), "whitening-fit")
    sizes = sorted(distinct.agg(F.collect_set(F.least(F.size("x"), F.lit(MOST_DIMENSIONS + 1)))).first()[0])
    if not sizes or sizes == [0]:
        return None, distinct
    if len(sizes) > 1 or sizes[-1] > MOST_DIMENSIONS:
        raise ValueError(f"vectors must have one length, at most {MOST_DIMENSIONS}: {sizes[:5]}")
    d = sizes[0]
    n = distinct.count()
    by_dimension = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted(by_dimension)]
    centre = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre, strict=True)]
    cells = scatter(distinct, np.array(centre, np.int64)).toArrow()
    matrix = np.zeros((d, d))
    for i, j, s in zip(*(cells.column(k).to_pylist() for k in range(3)), strict=True):
        # Integers until the one division: n^2 times the covariance is exact.
        matrix[i, j] = matrix[j, i] = float(Fraction(n * int(s) - rest[i] * rest[j], n * n))
    values, vectors = jacobi(matrix)
    held = (values > NOISE * d * max(values[0], 0.0)) & (np.arange(d) < components)
    if not held.any():
        return None, distinct
    return Whitening(n, np.array(sums, np.int64), np.ascontiguousarray(vectors[:, held]), values[held], float(np.trace(matrix))), distinct


def identity_error(found: Whitening, distinct: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity.
    Whitened rows are centred by their own mean, from sums of rows and of products."""
    k = len(found.values)
    shared = distinct.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        sums = np.zeros((k, k + 1))
        for batch in batches:
            for x in _blocks(_matrix(batch.column(0)), 4096):
                z = w.whiten(w.deltas(x))
                sums += np.column_stack([z.T @ z, z.sum(0)])
        i, j = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(sums.ravel())], ["i", "j", "s"])

    cells = distinct.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect()
    sums = np.zeros((k, k + 1))
    for i, j, s in cells:
        sums[i, j] = s
    mean = sums[:, k] / found.n
    return float(np.abs(sums[:, :k] / found.n - np.outer(mean, mean) - np.eye(k)).max())


def _squares(deltas: np.ndarray) -> list[int]:
    """Sums of squares by row; beyond what longs hold, by Python integers."""
    high = int(np.abs(deltas).max(initial=0))
    if high * high * max(1, deltas.shape[1]) < 1 << 63:
        return (deltas * deltas).sum(1).tolist()
    wide = deltas.astype(object)
    return [int(v) for v in (wide * wide).sum(1)]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row whose
    vector is whole, and each of the first ``components`` principal components.

    Distinct vectors, ``n`` of them, are fitted once each; rows that repeat a vector or an id,
    and rows without an id, each have their own results. Components without spread (all
    vectors equal, more dimensions than vectors) have nothing to divide by and are left
    out. An empty table, or one without a whole vector, has no rows. Vectors of
    different lengths are an error. ``deviation`` is exact; beyond a long it is an error.
    """
    rows = grid(embeddings, vector)
    found, distinct = fit(rows, components)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(found, distinct)
    shared = embeddings.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        k = len(w.values)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                deltas = w.deltas(_matrix(part.column(1)))
                z, m = w.whiten(deltas), part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)),
                    pa.array(_squares(deltas), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(w.values / w.trace, m)), pa.array(np.full(m * k, error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)
