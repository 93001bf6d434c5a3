"""Embedding whitening by shifted CholeskyQR.

Entries become whole numbers x = floor(64 c) + 1000000, so counts and sums are exact. The
centred rows C are orthogonalised without ever being gathered: a pass over the table sums
the Gram matrix of C, the driver takes its Cholesky factor R1 (with a shift on the first
pass, and on any later one whose matrix is not positive), the next pass sums the Gram matrix
of C / R1 (a triangular solve on each batch), and so on until its eigenvalues are 1, or 0
where dimensions depend on each other. The factors compose to R = ... R2 R1 with C = Q R,
and the singular values and right singular vectors of R are those of C: no eigenvalue is
taken of a squared matrix, so small components keep their digits.

A task sends one row for each dimension; partial matrices are added in two steps. The driver
holds a few matrices of dimensions x dimensions, whatever the number of vectors.

Cases: vectors that are null, empty or of another length than most (of equally frequent
lengths the shorter counts), and vectors with null or non-finite entries or with entries of
2**31 or more in size (their whole numbers and sums would leave a long) take no part. Rows
with equal or null ids stay. An empty table gives no rows. Components without variance do
not exist: where dimensions depend on each other or vectors are fewer, rows have fewer than
``components``. A deviation that does not fit into a long is null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, ORIGIN, LARGEST = 64, 1_000_000, 2.0**31
COMPONENTS = 32
#: Passes at most; two or three are enough unless dimensions depend on each other.
PASSES = 8
#: Singular values below this part of the largest are rounding.
RANK = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: whole sums by dimension, components in columns, their eigenvalues, the trace, and how far whitened is from white."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = float("nan")


def _whole(batch: pa.RecordBatch, dimensions: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the good vectors of one length, or of each length in turn."""
    column = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist() if dimensions is None else [dimensions]:
        rows = np.flatnonzero(sizes == d)
        c = values[first[rows][:, None] + np.arange(d)]
        good = (np.abs(c) < LARGEST).all(1)  # false for NaN
        if good.any():
            yield rows[good], np.floor(SCALE * c[good]).astype(np.int64) + ORIGIN


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and whole sums by dimension, of the most frequent length."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for rows, x in _whole(batch, None):
                mine = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                mine[0] += len(rows)
                mine[1] += x.sum(0)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([s.tolist()], pa.list_(pa.int64()))], ["d", "n", "s"])

    parts = vectors.mapInArrow(run, "d int, n long, s array<long>").select("d", "n", F.posexplode("s").alias("k", "x"))
    totals = parts.groupBy("d", "k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    most = totals.groupBy("d").agg(F.first("n").alias("n"), F.collect_list(F.struct("k", "s")).alias("s")).agg(F.max_by(F.struct("n", "s"), F.struct("n", (-F.col("d")).alias("d"))).alias("m")).first()["m"]
    if most is None:
        return 0, []
    return most["n"], [int(x["s"]) for x in sorted(most["s"], key=lambda x: x["k"])]


def _centre(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x minus the mean: the whole part is taken off exactly, then the fraction."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def _solved(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``r``, column by column."""
    out = np.array(rows.T, order="C")
    for k in range(len(r)):
        if k:
            out[k] -= r[:k, k] @ out[:k]
        out[k] /= r[k, k]
    return out.T


def _add(key: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    """Sum of the rows' vectors, in the order of their tasks."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        rows = table["row"].combine_chunks()
        total = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0)
        return pa.table({"k": table["k"][:1], "task": table["task"][:1], "row": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return add


def _summed(vectors: DataFrame, dimensions: int, of: Callable[[np.ndarray], np.ndarray], gram: bool) -> np.ndarray:
    """Sum over all vectors of y y' (or of y) where y = of(x)."""

    def run(batches):
        total = None
        for batch in batches:
            for _, x in _whole(batch, dimensions):
                y = of(x)
                part = y.T @ y if gram else y.sum(0)[None]
                total = part if total is None else total + part
        if total is not None:
            task = np.full(len(total), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(task, pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["k", "task", "row"])

    schema = "k int, task int, row array<double>"
    parts = vectors.mapInArrow(run, schema).groupBy("k", F.col("task") % 64).applyInArrow(_add(("k", "task")), schema)
    rows = parts.groupBy("k").applyInArrow(_add(("k",)), schema).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["k"])])


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Components of ``column`` over all its vectors."""
    common.arrow_batches(vectors.sparkSession)
    vectors = vectors.select(F.lit(None).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    n, sums = _sums(vectors)
    d = len(sums)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    centre, factors = _centre(n, sums), []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        return functools.reduce(_solved, factors, centre(x))

    r = np.eye(d)
    for k in range(PASSES):
        g = _summed(vectors, d, orthogonal, True)
        spectrum = np.linalg.eigvalsh(g)
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * max(spectrum[-1], np.finfo(float).tiny)
        try:
            factor = np.linalg.cholesky(g + (shift * np.eye(d) if k == 0 else 0))
        except np.linalg.LinAlgError:
            factor = np.linalg.cholesky(g + shift * np.eye(d))
        factors.append(factor.T)
        r = factor.T @ r
        if k and ((np.abs(spectrum - 1) < 1e-8) | (spectrum < 1e-8)).all():
            break
    _, singular, right = np.linalg.svd(r)
    real = (singular > RANK * singular[0]) & (singular > 0)
    values = singular**2 / n
    m = min(components, int(real.sum())) if np.abs(g).max() > 0 else 0
    made = Whitening(n, tuple(sums), right[:m].T.copy(), values[:m], float(values.sum()))
    if not m:
        return made
    white = _white(made)
    mean = _summed(vectors, d, white, False)[0] / n
    covariance = _summed(vectors, d, lambda x: white(x) - mean, True) / n
    return Whitening(n, made.sums, made.components, made.values, made.trace, float(np.abs(covariance - np.eye(m)).max()))


def _white(fitted: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    centre, by = _centre(fitted.n, list(fitted.sums)), fitted.components / np.sqrt(fitted.values)
    return lambda x: centre(x) @ by


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, exact: tuple[int, ...]) -> pa.Array:
    """Sum over dimensions of (n x - S)**2, exactly; null beyond a long.

    Whole numbers wrap around, so differences that fit are right even where n x does not fit.
    """
    about = (((x - sums / n) * float(n)) ** 2).sum(1)
    with np.errstate(over="ignore"):
        m = x * np.int64(n) - np.array([(s + 2**63) % 2**64 - 2**63 for s in exact], np.int64)
        out = (m * m).sum(1).tolist()
    for k in np.flatnonzero(about >= 2.0**62).tolist():
        own = sum((n * int(v) - s) ** 2 for v, s in zip(x[k].tolist(), exact))
        out[k] = own if own < 2**63 else None
    return pa.array(out, pa.int64())


def apply(vectors: DataFrame, fitted: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``key``, component (from 1), n, deviation, whitened, explained and identity_error for each vector and component."""
    common.arrow_batches(vectors.sparkSession)
    schema = T.StructType([vectors.schema[key], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    m, d = len(fitted.values), len(fitted.sums)
    white = _white(fitted) if m else None
    sums = np.array(fitted.sums, np.float64)

    def run(batches):
        for batch in batches:
            for rows, x in _whole(batch, d) if m else ():
                each = np.repeat(np.arange(len(rows)), m)
                ids = batch.column(0).take(pa.array(rows[each]))
                deviation = _deviations(x, fitted.n, sums, fitted.sums).take(pa.array(each))
                count = len(each)
                columns = [ids, pa.array(np.tile(np.arange(1, m + 1), len(rows)), pa.int32()), pa.array(np.full(count, fitted.n)), deviation, pa.array(white(x).ravel()), pa.array(np.tile(fitted.values / fitted.trace, len(rows))), pa.array(np.full(count, fitted.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return vectors.select(F.col(key), F.col(column).alias("__vector")).mapInArrow(run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return apply(vectors, fit(vectors))
