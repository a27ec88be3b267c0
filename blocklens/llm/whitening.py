"""Whitening of embeddings: distributed exact sums, centred scatter, cyclic Jacobi rotations on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import array_rows, summed

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond this aren't exact whole numbers of a double any more; their rows are left out.
EXACT = float(1 << 52)
#: Dimensions at most: the covariance (32 MB at this bound) is held on the driver.
MAX_DIM = 2_048
#: Sweeps of rotations at most; a dozen suffice for any matrix that doubles can hold.
MAX_SWEEPS = 60


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors (columns) and sweeps of the symmetric ``a``, by cyclic Jacobi.

    A sweep visits each pair of rows once, in rounds of disjoint pairs that are rotated together. A pair needs a rotation
    while its entry is above a rounding error of its two diagonal entries' geometric mean, not of the whole matrix: so
    small eigenvalues of a positive matrix keep their relative accuracy. It ends when no pair needs one.
    """
    a = np.array(a, float)
    p = len(a)
    v = np.eye(p)
    even = p + p % 2
    ring, sweeps, eps = np.arange(even), 0, np.finfo(float).eps
    for sweeps in range(1, MAX_SWEEPS + 1):
        turned = False
        for _ in range(even - 1):
            i, j = ring[: even // 2], ring[: even // 2 - 1 : -1]
            both = (i < p) & (j < p)
            i, j = np.minimum(i, j)[both], np.maximum(i, j)[both]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            off = a[i, j]
            some = np.abs(off) > eps * np.sqrt(np.abs(a[i, i] * a[j, j]))
            if not some.any():
                continue
            turned = True
            i, j, off = i[some], j[some], off[some]
            theta = (a[j, j] - a[i, i]) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            x, y = a[:, i].copy(), a[:, j].copy()
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            x, y = a[i].copy(), a[j].copy()
            a[i], a[j] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            a[i, j] = a[j, i] = 0.0
            x, y = v[:, i].copy(), v[:, j].copy()
            v[:, i], v[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order], sweeps


@dataclass
class Whitening:
    """``n`` vectors, per dimension their floored mean and what the sum has above n times it, components by falling
    eigenvalue (those that aren't zero within rounding), share of each in the trace."""

    n: int
    floor: np.ndarray
    rest: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.floor)

    def matrix(self) -> np.ndarray:
        """Directions over the root of their eigenvalues: what whitens a centred vector."""
        return self.directions / np.sqrt(self.values)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers, less the mean, along each component."""
        return ((x - self.floor) - np.array([r / self.n for r in self.rest])) @ self.matrix()

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2 of each row, exact whatever its size."""
        y = x - self.floor
        high = int(np.abs(y).max(initial=0))
        rest = np.array(self.rest)
        if high * high * self.dim < 1 << 62 and high * int(rest.max(initial=0)) * self.dim < 1 << 62:
            squares, cross = (y * y).sum(axis=1).tolist(), (y @ rest).tolist()
        else:
            squares, cross = [sum(int(v) ** 2 for v in row) for row in y], [sum(int(v) * r for v, r in zip(row, self.rest)) for row in y]
        last = sum(r * r for r in self.rest)
        return [self.n * self.n * s - 2 * self.n * c + last for s, c in zip(squares, cross)]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has only finite entries; null vectors, empty ones, null, infinite and NaN entries and entries
    whose scaled value isn't an exact whole number (above 2^52) go."""
    finite = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) <= F.lit(EXACT / SCALE)), F.lit(False)))
    return df.where((F.size(vector) > 0) & finite)


def _whole(column: pa.Array) -> np.ndarray:
    """A batch's vectors as rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(flat * SCALE).astype("int64").reshape(len(column), -1) + SHIFT


def fit(df: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Mean and components of all usable vectors of ``df``; None if there is none.

    Two passes: exact sums, and the scatter about the floored means, a matrix for each task, added up by rows. The
    floored means are whole numbers, so products are of small whole numbers, and what they are off (less than 1) is
    taken from the scatter afterwards; nothing cancels, and the result doesn't depend on the order of rows. Of vectors
    of several lengths the most frequent length counts (of equally frequent ones the longest); others are left out.
    Repeated rows count each time; equal eigenvalues take any basis.
    """
    rows = usable(df, vector).select(F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("k")).first()
    if sizes is None:
        return None
    p, n = sizes.k, sizes.n
    if p > MAX_DIM:
        raise ValueError(f"more than {MAX_DIM} dimensions")
    rows = rows.where(F.size("v") == p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * p
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(0))
                total = [a + (int(hi) << 32) + int(lo) for a, hi, lo in zip(total, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    totals = {r.i: int(r.s) for r in rows.mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # a row for each dimension
    floor, rest = np.array([totals[i] // n for i in range(p)]), [totals[i] % n for i in range(p)]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for batch in batches:
            if batch.num_rows:
                y = (_whole(batch.column(0)) - floor).astype(float)
                total += y.T @ y
        yield array_rows({"i": np.arange(p)}, list(total))

    parts = summed(rows.mapInArrow(scatter, "i long, v array<double>"), "i").collect()  # a row for each dimension
    total = np.array([r.v for r in sorted(parts, key=lambda r: r.i)])
    r = np.array([x / n for x in rest])
    values, directions, _ = jacobi(total / n - np.outer(r, r))
    keep = values > max(values.max(initial=0.0), 0.0) * p * np.finfo(float).eps
    trace = values.sum()
    return Whitening(n, floor, rest, values[keep], directions[:, keep], values[keep] / trace if trace > 0 else values[keep])


def whiten(df: DataFrame, model: Whitening | None, components: int | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key, whitened array<double>, deviation decimal``: each usable row along the first ``components`` directions.

    ``deviation`` is the exact sum over dimensions of (n x - S)^2. Rows that the model can't take (see ``usable``; other
    lengths) are left out, repeated rows stay, null keys stay null, other columns are left out. A model of vectors that
    are all equal has no component, so ``whitened`` is empty; without a model (no usable row) there are no rows.
    """
    spark = df.sparkSession
    schema = "key long, whitened array<double>, deviation decimal(38,0)"
    if model is None:
        return spark.createDataFrame([], schema.replace("key", key))
    rows = usable(df, vector).where(F.size(vector) == model.dim).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    h = len(model.values) if components is None else min(components, len(model.values))
    held = spark.sparkContext.broadcast(model)  # a few matrices of MAX_DIM columns at most

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch.column(1))
                z = held.value.whiten(x)[:, :h]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * h, pa.int32()), pa.array(z.ravel()))
                far = pa.array([Decimal(d) for d in held.value.deviation(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, far], names=["key", "whitened", "deviation"])

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)


def identity_error(whitened: DataFrame) -> float:
    """Largest absolute entry of the rows' covariance (centred, divisor n) minus the identity, in one pass over them.

    0 without rows or components. Whitened rows have mean 0 but for rounding, so centring them afterwards loses nothing.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                z = np.hstack([z, np.ones((len(z), 1))])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield array_rows({"i": np.arange(len(total))}, list(total))

    parts = summed(whitened.select("whitened").mapInArrow(moments, "i long, v array<double>"), "i").collect()  # a row for each component
    if len(parts) < 2:
        return 0.0
    m = np.array([r.v for r in sorted(parts, key=lambda r: r.i)])
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    return float(np.abs(m[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max())


def whitening_digest(df: DataFrame, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and component.

    ``deviation`` is null where a long can't hold it (from some 10^5 rows of such vectors times their spread on).
    """
    df = df.select("vec_id", "embedding")
    model = fit(df)
    rows = whiten(df, model, components)
    error = identity_error(rows) if model else 0.0
    share = [float(e) for e in model.explained[:components]] if model else []
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.element_at(F.lit(share or [0.0]), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
