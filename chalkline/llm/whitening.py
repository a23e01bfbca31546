"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum of its scatter matrix and applies each row as a centred rank-one update: the new
eigenvalues are the roots of a secular equation, after components that the update does not touch and equal
eigenvalues are deflated, and the eigenvectors follow from the roots. Spectra of partitions are combined, some at a time, by rank-one updates
with the scaled eigenvectors of one and the difference of the means. A distributed Rayleigh-Ritz step in
the basis found then removes what the updates have added up in rounding errors: it projects every centred row on the
basis and solves the small eigenproblem of the projections' covariance.

Components are whole numbers x = floor(64 c) + 1000000, so sums and squared deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.session import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Spectra that are combined in one task.
FAN_IN = 16
#: Relative size under which a component of an update, or a gap between eigenvalues, is deflated.
_TOLERANCE = 1e-14
#: Step, as a share of the distance of its poles, at which a root is taken; what that leaves goes in the Rayleigh-Ritz step.
_ROOT = 1e-14
#: Share of the total variance under which a component has no direction that rows could be projected on.
_LEAST_VARIANCE = 1e-13
_ROWS = 4096


# --- rank-one updates -------------------------------------------------------------------

def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z2 / (d - x) = 0 for ascending, distinct d, as (number of the nearest pole below or above, distance).

    A root lies between each pole and the next, the last one within sum(z2) of the last pole. All are found at once by
    rational steps through the poles on either side, kept inside their brackets by bisection.
    """
    n = len(d)
    top = z2.sum()
    gap = np.append(np.diff(d), top)
    at = np.arange(n)
    # the pole that is nearer to the root, by the sign of the function half-way, is the origin of its interval
    middle = d + gap / 2
    half = 1 + (z2[None, :] / (d[None, :] - middle[:, None])).sum(axis=1)
    upper = (half < 0) & (at < n - 1)
    origin = at + upper
    delta = d[None, :] - d[origin][:, None]
    low = np.where(upper, -gap / 2, np.where(half < 0, gap / 2, 0.0))
    high = np.where(upper, 0.0, np.where(half < 0, gap, gap / 2))
    x = (low + high) / 2
    left = (at[None, :] <= at[:, None]).astype(float)
    right_pole = np.append(delta[at[:-1], at[1:]], delta[-1, -1] + 2 * top)
    left_pole = delta[at, at]
    for _ in range(60):
        away = delta - x[:, None]
        terms = z2[None, :] / away
        f = 1 + terms.sum(axis=1)
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        terms /= away
        psi = np.einsum("ij,ij->i", terms, left)
        phi = terms.sum(axis=1) - psi
        a1, a2 = left_pole - x, right_pole - x
        c = f - a1 * psi - a2 * phi
        a = (a1 + a2) * f - a1 * a2 * (psi + phi)
        b = a1 * a2 * f
        with np.errstate(all="ignore"):
            square = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - square) / (2 * c), 2 * b / (a + square))
            new = x + step
        settled = np.abs(new - x) <= _ROOT * gap
        if settled.all():
            break
        good = np.isfinite(new) & (new > low) & (new < high)
        x = np.where(settled, x, np.where(good, new, (low + high) / 2))
    return origin, x


def rank_one_update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending) of vectors diag(values) vectors' + v v'."""
    z = vectors.T @ v
    size = max(abs(values[-1]), float(v @ v))
    if size == 0 or not np.isfinite(size):
        return values, vectors
    # equal eigenvalues: turned so that only the last of them is touched
    group = np.cumsum(np.append(0, np.diff(values) > _TOLERANCE * size))
    if group[-1] < len(values) - 1:
        vectors = vectors.copy()
        starts = np.flatnonzero(np.append(True, np.diff(group) > 0))
        for lo, hi in zip(starts, np.append(starts[1:], len(values))):
            length = np.sqrt((z[lo:hi] ** 2).sum())
            if hi - lo > 1 and length > 0:
                w = z[lo:hi].copy()
                w[-1] += length if w[-1] >= 0 else -length
                turned = -length if z[hi - 1] >= 0 else length
                block = vectors[:, lo:hi]
                vectors[:, lo:hi] = block - np.outer(block @ w, 2 * w / (w @ w))
                z[lo:hi], z[hi - 1] = 0, turned
    live = np.flatnonzero(np.abs(z) > _TOLERANCE * np.sqrt(size))
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    origin, offset = secular_roots(d, w * w)
    away = (d[None, :] - d[origin][:, None]) - offset[:, None]  # away[i, j] = d_j - root_i
    # the update of which the roots are exact: eigenvectors from it are orthogonal to working precision
    poles = d[None, :] - d[:, None]
    np.fill_diagonal(poles, 1.0)
    with np.errstate(all="ignore"):
        # prod_i (root_i - d_j) / prod_{i != j} (d_i - d_j): each root next to the pole below it, or above it from j on
        factors = away[:-1] / np.where(np.tri(len(d), dtype=bool)[:-1], poles[1:], poles[:-1])
        exact = np.sqrt(np.abs(np.prod(factors, axis=0) * away[-1]))
        turn = (np.copysign(exact, w)[None, :] / away).T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    if not np.isfinite(turn).all():
        return np.linalg.eigh((vectors * values) @ vectors.T + np.outer(v, v))
    new_values, new_vectors = values.copy(), vectors.copy()
    new_values[live] = d[origin] + offset
    new_vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_vectors[:, order]


class Spectrum:
    """Number, exact sums, mean and the scatter matrix's spectrum of the rows seen."""

    def __init__(self, width: int):
        self.n, self.sums = 0, [0] * width
        self.mean, self.values, self.vectors = np.zeros(width), np.zeros(width), np.eye(width)

    def add(self, rows: np.ndarray) -> None:
        """Rows of whole numbers."""
        self.sums = [s + int(t) for s, t in zip(self.sums, rows.sum(axis=0))]
        for x in rows.astype(float):
            away = x - self.mean
            self.values, self.vectors = rank_one_update(self.values, self.vectors, away * np.sqrt(self.n / (self.n + 1)))
            self.n += 1
            self.mean = self.mean + away / self.n

    def merge(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> None:
        if not n:
            return
        mean = np.array([s / n for s in sums])
        for value, vector in zip(values, vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one_update(self.values, self.vectors, vector * np.sqrt(value))
        total = self.n + n
        self.values, self.vectors = rank_one_update(self.values, self.vectors, (mean - self.mean) * np.sqrt(self.n * n / total))
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        self.n, self.mean = total, np.array([s / total for s in self.sums])

    def row(self, number: int) -> pa.RecordBatch:
        values = [[number], [self.n], [self.sums], [self.values], [self.vectors.ravel()]]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "n", "sums", "lambda", "basis"])


_SPECTRUM = "part long, n long, sums array<bigint>, lambda array<double>, basis array<double>"


def _matrices(batches: Iterator[pa.RecordBatch], width: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches with the whole numbers of their rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def spectrum(rows: DataFrame, width: int, fan_in: int = FAN_IN) -> Spectrum:
    """The spectrum of all rows (x array<bigint> of one width), from those of the partitions.

    They are combined ``fan_in`` at a time in tables of the shared folder, so neither a task nor the driver holds more than that.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(width)
        for _, x in _matrices(batches, width):
            own.add(x)
        yield own.row(TaskContext.get().partitionId())

    def combine(table: pa.Table) -> pa.Table:
        listed = sorted(table.to_pylist(), key=lambda r: r["part"])
        own = Spectrum(width)
        for r in listed:
            own.merge(r["n"], r["sums"], np.array(r["lambda"]), np.array(r["basis"]).reshape(width, width))
        return pa.Table.from_batches([own.row(listed[0]["part"] // fan_in)])

    parts = written(rows.mapInArrow(grow, _SPECTRUM).where("n > 0"), "spectra")
    while parts.count() > 1:
        parts = written(parts.groupBy(F.floor(F.col("part") / fan_in).alias("g")).applyInArrow(combine, _SPECTRUM), "spectra")
    out = Spectrum(width)
    for r in parts.collect():
        out.n, out.sums = r.n, list(r.sums)
        out.mean = np.array([s / r.n for s in r.sums])
        out.values, out.vectors = np.array(r["lambda"]), np.array(r.basis).reshape(width, width)
    return out


# --- refinement -------------------------------------------------------------------------

def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n of whole numbers, rounded once."""
    low = [s // n for s in sums]
    rest = np.array([(s - n * v) / n for s, v in zip(sums, low)])
    return (x - np.array(low, np.int64)).astype(float) - rest


def _moments(rows: DataFrame, width: int, n: int, sums: list[int], basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of the centred rows' projections on a basis; a sum per task, then per entry."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for _, x in _matrices(batches, width):
            y = centred(x, n, sums) @ basis
            total += np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    added = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()
    v = added.column("v").to_numpy() / n
    mean = v[k * k :]
    return mean, v[: k * k].reshape(k, k) - np.outer(mean, mean)


def refined(rows: DataFrame, found: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling, and unit eigenvectors as columns) of the covariance of all rows."""
    basis, _ = np.linalg.qr(found.vectors[:, ::-1])
    _, small = _moments(rows, len(found.sums), found.n, found.sums, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return np.maximum(values[::-1], 0.0), basis @ turn[:, ::-1]


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id", fan_in: int = FAN_IN
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per row and component up to ``components``.

    Rows take no part if their vector is null or empty, holds null or non-finite entries, or has not the most frequent
    number of entries (of two, the smaller). Null and repeated keys and repeated rows stay, each row by itself. ``deviation`` is null
    where it does not fit a long. A component without variance (less than 1e-13 of all) has whitened null, and is left out of
    identity_error; without any variance explained and identity_error are null. Of equal eigenvalues any orthogonal
    directions may be given. No rows give no rows. Only key and vector are read.
    """
    spark = vectors.sparkSession
    v = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + OFFSET)
    rows = vectors.where(F.coalesce(finite & (F.size(vector) > 0), F.lit(False))).select(whole.alias("x"), F.col(key).alias("key"))
    widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not widths:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    width = widths[0].width
    rows = rows.where(F.size("x") == width)

    found = spectrum(rows.select("x"), width, fan_in)
    values, basis = refined(rows.select("x"), found)
    n, sums, total = found.n, found.sums, float(values.sum())
    k = min(components, width)
    alive = int((values[:k] > _LEAST_VARIANCE * total).sum()) if total > 0 else 0
    scaled = basis[:, :alive] / np.sqrt(values[:alive])
    error = None
    if alive:
        _, seen = _moments(rows.select("x"), width, n, sums, scaled)
        error = float(np.abs(seen - np.eye(alive)).max())
    explained = [float(e) / total if total > 0 else None for e in values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, width):
            y = centred(x, n, sums) @ scaled
            out = np.full((len(x), k), np.nan)
            out[:, :alive] = y
            flat = pa.array(out.ravel(), mask=np.tile(np.arange(k) >= alive, len(x)))
            row = np.repeat(np.arange(len(x)), k)
            columns = [
                part.column(1).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(row), n)), deviations(x, n, sums).take(pa.array(row)), flat,
                pa.array(explained * len(x), pa.float64()), pa.array([error] * len(row), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
            )

    return rows.select("x", "key").mapInArrow(run, schema).withColumnRenamed("key", key)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The exact sums of (n x - S)**2; null where they do not fit a long."""
    largest = max((abs(n * int(v) - s) for s, col in zip(sums, x.T) for v in (col.min(), col.max())), default=0) if len(x) else 0
    if len(sums) * largest**2 < 2**63:
        away = n * x - np.array(sums, np.int64)
        return pa.array((away * away).sum(axis=1))
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())
