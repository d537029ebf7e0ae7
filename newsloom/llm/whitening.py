"""Whitening of embeddings by incremental eigendecomposition.

Every partition keeps the spectrum of the rows it has seen, an orthonormal basis with its eigenvalues, and takes each centred row up as a rank-one
update: in the basis of the spectrum the new matrix is a diagonal plus ``z z'``, its eigenvalues are the roots of the secular equation
``1 + sum(z_i**2 / (d_i - t)) = 0``, one between each two poles, and its eigenvectors follow from them. Directions in which the row has nothing, and all but
one direction of an eigenvalue that comes several times, are deflated: they stay as they are. Spectra of partitions are combined in a tree, the directions of one being taken
up one after another as rank-one updates of the other, scaled by their eigenvalues. A last pass projects all rows on the combined basis, adds up their
products over all partitions and rotates the basis by the eigenvectors of that small matrix (Rayleigh-Ritz), which leaves components at double precision.

A task holds one basis (d x d) and one batch of rows; the driver holds the sums of each dimension and one basis. No pass moves rows between tasks.

Rows whose vector is null or has null or infinite entries or entries that are no number are dropped. Vectors of another length than the most frequent one (the longer, if two
are as frequent) cannot share a covariance with the others and are dropped too; so are empty vectors if that length is 0, which leaves an empty result, as does an empty
table. Repeated rows count as often as they come. A component without variance (eigenvalue at most ``NO_VARIANCE`` of the largest) has a null ``whitened`` and does not count in ``identity_error``;
where no component has any, ``explained`` and ``identity_error`` are null. A ``deviation`` beyond BIGINT is null. Entries beyond ``FAR`` in size count as ``FAR``. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import staged

#: Entries are counted in steps of 1/SCALE from -OFFSET on.
SCALE, OFFSET = 1024, 100_000
#: Entries beyond this size count as that: their steps would not fit a BIGINT.
FAR = 2.0**30
#: Components that are returned.
COMPONENTS = 8
#: Spectra that one task combines.
FAN_IN = 16
#: Halvings of the interval between two poles in which a root lies.
HALVINGS = 40
#: An eigenvalue counts as 0 from this share of the largest on.
NO_VARIANCE = 1e-13
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """What is fitted: rows, sums of each dimension, components (columns) and eigenvalues, falling."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n

    def varying(self) -> np.ndarray:
        return self.eigenvalues > NO_VARIANCE * max(self.eigenvalues[0], 0)


def secular_roots(poles: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``poles[i] - root[j]`` for all i and j; poles rise strictly and no z is 0.

    Roots are sought as distances from the nearer pole, so that differences keep their relative accuracy.
    """
    weight = z * z
    ends = np.append(poles[1:], poles[-1] + weight.sum())
    half = (ends - poles) / 2
    at_half = 1 + (weight / (poles - (poles + half)[:, None])).sum(axis=1)
    right = (at_half < 0) & (np.arange(len(poles)) < len(poles) - 1)
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    low[-1], high[-1] = (half[-1], 2 * half[-1]) if at_half[-1] < 0 else (0.0, half[-1])
    gaps = poles - np.where(right, ends, poles)[:, None]
    for _ in range(HALVINGS):
        middle = (low + high) / 2
        below = (weight / (gaps - middle[:, None])).sum(axis=1) < -1
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    # The end that is not a pole.
    offset = np.where(right, low, high)
    return (gaps - offset[:, None]).T


def rank_one_update(values: np.ndarray, basis: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (rising values, columns of the basis) of ``basis diag(values) basis' + row row'``."""
    z = row @ basis
    norm = float(z @ z)
    if norm == 0:
        return values, basis
    least = 8 * EPS * max(values[-1], norm)
    # Eigenvalues that are as good as equal: one reflection gives all of the row to the last of them.
    starts = np.flatnonzero(np.append(True, np.diff(values) > least))
    if len(starts) < len(values):
        basis = basis.copy()
        for start, end in zip(starts, np.append(starts[1:], len(values))):
            if end - start > 1:
                part = z[start:end].copy()
                size = np.sqrt(part @ part)
                if size == 0:
                    continue
                mirrored = -size if part[-1] >= 0 else size
                part[-1] -= mirrored
                part /= np.sqrt(part @ part)
                block = basis[:, start:end]
                basis[:, start:end] = block - 2 * np.outer(block @ part, part)
                z[start : end - 1] = 0
                z[end - 1] = mirrored
    active = np.abs(z) * np.sqrt(norm) > least
    if not active.any():
        return values, basis
    poles, found = values[active], z[active]
    distance = secular_roots(poles, found)
    # The z of which these roots are the exact ones: it makes the eigenvectors orthogonal.
    ratio = -distance
    gaps = poles[None, :] - poles[:, None]
    np.fill_diagonal(gaps, 1)
    k = len(poles)
    quotient = ratio / gaps
    exact = np.sqrt(np.abs(quotient.prod(axis=1))) if k > 1 else np.sqrt(np.abs(ratio[:, 0]))
    vectors = np.where(found < 0, -exact, exact)[:, None] / distance
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    new_values, new_basis = values.copy(), basis.copy()
    new_values[active] = poles - distance.diagonal()
    new_basis[:, active] = basis[:, active] @ vectors
    order = np.argsort(new_values, kind="stable")
    return new_values[order], new_basis[:, order]


def combine(spectra: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One spectrum for the sum of all: the directions of each further one are taken up as rank-one updates."""
    values, basis = spectra[0]
    for other_values, other_basis in spectra[1:]:
        for value, direction in zip(other_values, other_basis.T):
            if value > 0:
                values, basis = rank_one_update(values, basis, np.sqrt(value) * direction)
    return values, basis


def counted_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that remain, x in whole steps."""
    entry_ok = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    rows = df.select(df[id_column].cast("long").alias("vec_id"), df[column].alias("c"))
    rows = rows.where(F.col("c").isNotNull() & F.forall("c", entry_ok))
    bounded = lambda c: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c.cast("double")))
    steps = F.transform("c", lambda c: F.floor(bounded(c) * SCALE) + F.lit(OFFSET).cast("long"))
    return rows.select("vec_id", steps.alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), dims)


def _sums(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            rows += batch.num_rows
            total += _matrix(batch, dims).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(np.append(total, rows))], names=["dim", "v"])

    found = vectors.select("x").mapInArrow(task, "dim long, v long").groupBy("dim").agg(F.sum("v").alias("v")).orderBy("dim").collect()
    values = [row.v for row in found]
    return (int(values[-1]), np.array(values[:-1], np.int64)) if values else (0, np.zeros(dims, np.int64))


def _spectrum(vectors: DataFrame, dims: int, mean: np.ndarray) -> np.ndarray:
    """The basis of the combined spectrum of all partitions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, basis, rows = np.zeros(dims), np.eye(dims), 0
        for batch in batches:
            for row in _matrix(batch, dims) - mean:
                values, basis = rank_one_update(values, basis, row)
            rows += batch.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([values]), pa.array([basis.ravel()])], names=["k", "d", "q"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        values, basis = combine([(np.array(d), np.array(q).reshape(dims, dims)) for d, q in zip(group["d"], group["q"])])
        return pd.DataFrame({"k": [int(group["k"].iloc[0]) // FAN_IN], "d": [values], "q": [basis.ravel()]})

    schema = "k long, d array<double>, q array<double>"
    level = staged(vectors.select("x").mapInArrow(task, schema), "spectra")
    parts = level.agg(F.max("k").alias("k")).first().k
    while parts > 0:
        level = staged(level.groupBy(F.floor(F.col("k") / FAN_IN).alias("g")).applyInPandas(merged, schema), "spectra")
        parts //= FAN_IN
    return np.array(level.first().q).reshape(dims, dims)


def _products(vectors: DataFrame, dims: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over all rows of the products of their projections on the basis; a row and column of ones is added for their sums."""
    width = basis.shape[1] + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            projected = np.column_stack([(_matrix(batch, dims) - mean) @ basis, np.ones(batch.num_rows)])
            total += projected.T @ projected
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "v"])

    cells = vectors.select("x").mapInArrow(task, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    return np.array([row.v for row in cells]).reshape(width, width)


def fit(vectors: DataFrame) -> tuple[DataFrame, Whitening | None]:
    """The vectors of the most frequent length (vec_id, x), and the whitening fitted to all of them; none without a row."""
    sizes = vectors.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if not sizes or not sizes.dims:
        return vectors.where(F.lit(False)), None
    dims = sizes.dims
    vectors = vectors.where(F.size("x") == dims)
    n, sums = _sums(vectors, dims)
    mean = sums / n
    basis = _spectrum(vectors, dims, mean)
    # Rayleigh-Ritz: the sums in the last row take out what rounding of the mean leaves.
    products = _products(vectors, dims, mean, basis)
    rest = products[:-1, -1] / n
    covariance = products[:-1, :-1] / n - np.outer(rest, rest)
    values, rotation = np.linalg.eigh((covariance + covariance.T) / 2)
    components = (basis @ rotation)[:, ::-1]
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(dims)])
    return vectors, Whitening(n, sums, components * signs, np.maximum(values[::-1], 0), float(np.trace(covariance)))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n*x - S)**2, exact; null beyond BIGINT."""
    rough = n * x.astype(float) - sums
    if not len(x) or (rough * rough).sum(axis=1).max() < 2.0**62:
        far = n * x - sums
        return pa.array((far * far).sum(axis=1), pa.int64())
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whitened(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    dims = len(model.sums)
    top = min(components, dims)
    varying = model.varying()[:top]
    scale = np.where(varying, 1 / np.sqrt(np.where(varying, model.eigenvalues[:top], 1)), 0.0)
    matrix, n, sums, mean = model.components[:, :top] * scale, model.n, model.sums, model.mean
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.eigenvalues[:top]]
    error = None
    if varying.any():
        products = _products(vectors, dims, mean, matrix[:, varying])
        rest = products[:-1, -1] / n
        error = float(np.abs(products[:-1, :-1] / n - np.outer(rest, rest) - np.eye(int(varying.sum()))).max())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dims)
            rows, projected = len(x), (x - mean) @ matrix
            each = np.repeat(np.arange(rows), top)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), rows)), pa.array(np.full(rows * top, n)),
                    _deviations(x, n, sums).take(pa.array(each)), pa.array(projected.ravel(), mask=np.tile(~varying, rows)),
                    pa.array(explained * rows, pa.float64()), pa.array([error] * (rows * top), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """All remaining rows of ``df`` (vec_id, embedding) on the leading components, see the module's text."""
    vectors, model = fit(counted_vectors(df))
    if model is None:
        return vectors.selectExpr(
            "vec_id", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error"
        )
    return whitened(vectors, model, components)
