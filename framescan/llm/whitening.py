"""Whitening of embeddings onto their leading principal components.

Every component c of a vector becomes the whole number floor(256 * c).  The fit
list holds each distinct whole-number vector once.  Its sums and, about the
nearest whole-number mean, its centred products are added up as whole numbers
of any size, so the covariance is exact but for one last rounding and does not
depend on how Spark deals the rows.  The leading eigenpairs come from
``spectrum.leading``: LDLᵀ inertia counts isolate each eigenvalue, Rayleigh
quotient iteration finds it, counts certify its number.  Every vector is then
projected, and the covariance of the projected fit list is compared with the
identity.

Only sums go to the driver: at most ``BUCKETS`` rows of one matrix for each
length of vectors.

Edge cases: vectors that are null or hold null or non-finite components are
dropped; an empty vector has no component and so no row; vectors of different
length are fitted apart, each length with its own n and components; vectors
with fewer than ``count`` components give as many rows as they have; a
component without variance (all vectors equal, or fewer than components) has
``whitened`` null and stays out of ``identity_error``, which is null where none
is left; ``explained`` is null where the whole variance is zero; ``deviation``
is null where it passes 64 bits; components whose 256-fold passes 64 bits stand
at the largest long; a null or repeated vec_id is a row like any other; an
empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framescan.session import checkpoint_dir

from .common import session
from .spectrum import leading

SCALE = 256
COUNT = 4
BUCKETS = 64
BLOCK = 8192  # rows multiplied at once
EXACT = 1 << 53  # whole numbers below are exact in double precision
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, name: str = "x") -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of vectors, a block at a time."""
    sizes = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for i in range(0, len(rows), BLOCK):
            yield dim, batch.take(pa.array(rows[i : i + BLOCK]))


def _sum(x: np.ndarray) -> np.ndarray:
    """Column sums of whole numbers, as Python's."""
    if np.abs(x.astype(float)).max(initial=0) * len(x) < EXACT:
        return x.sum(axis=0).astype(object)
    return x.astype(object).sum(axis=0)


def _products(y: np.ndarray) -> np.ndarray:
    """yᵀ y of whole numbers, exact, as Python's."""
    if y.dtype != object and np.abs(y.astype(float)).max(initial=0) ** 2 * len(y) < EXACT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _minus(x: np.ndarray, centre: list[int]) -> np.ndarray:
    c = np.array(centre, object)
    if max(map(abs, centre), default=0) < 1 << 62 and np.abs(x.astype(float)).max(initial=0) < 1 << 62:
        return x - c.astype(np.int64)
    return x.astype(object) - c


def _added(df: DataFrame, dim: str = "dim") -> dict[int, list[int]]:
    """Sums of the whole-number lists of each length, by way of a few buckets."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.array([int(v) for v in row], object) for row in table["sums"].to_pylist()], axis=0)
        return pa.table({"dim": table["dim"][:1], "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    rows = df.groupBy(dim, "bucket").applyInArrow(add, "dim int, sums array<string>").collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        part = [int(v) for v in r["sums"]]
        out[r["dim"]] = [a + b for a, b in zip(out.get(r["dim"], [0] * len(part)), part, strict=True)]
    return out


def _partials(fit: DataFrame, sums_of) -> DataFrame:
    """One row of sums for each length and task; ``sums_of(dim, x)`` gives a list of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in _by_length(b):
                sums = sums_of(dim, _matrix(part.column("x")))
                total[dim] = total[dim] + sums if dim in total else sums
        bucket = TaskContext.get().partitionId() % BUCKETS
        if total:
            rows = [[str(v) for v in s] for s in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["dim", "bucket", "sums"])

    return fit.mapInArrow(run, "dim int, bucket int, sums array<string>")


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x, dim) of the usable vectors, x in whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    top = float((1 << 63) - 1024)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(top)), F.lit(-top))).cast("long"))
    usable = rows.where(F.col("v").isNotNull()).where(~bad & (F.size("v") > 0))
    return usable.select("vec_id", whole.alias("x"), F.size("v").alias("dim"))


class Fit:
    """What is known of the vectors of one length."""

    def __init__(self, dim: int, n: int, sums: list[int]):
        self.dim, self.n, self.sums = dim, n, sums
        self.centre = [round(Fraction(s, n)) for s in sums]
        self.values = np.zeros(0)
        self.vectors = np.zeros((dim, 0))
        self.trace = 0.0

    def learn(self, moments: list[int], count: int) -> None:
        """Eigenpairs from the sums and products about ``centre``."""
        d, n = self.dim, self.n
        t = moments[:d]
        upper = iter(moments[d:])
        v = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                v[i, j] = v[j, i] = Fraction(n * next(upper) - t[i] * t[j], n * n)
        self.trace = float(np.trace(v))
        self.values, self.vectors = leading(v, count)
        # no variance beyond what rounding leaves of none
        self.values[self.values <= 8 * d * np.finfo(float).eps * self.trace] = 0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, one column a component; NaN where it has no variance."""
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, self.centre, strict=True)])
        y = _minus(x, self.centre).astype(float) - rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, y @ self.vectors / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n * x - sums of each row, exact; None beyond 64 bits."""
        top = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x.astype(float)).max(initial=0))
        whole = x if self.dim * top * top < 1 << 62 else x.astype(object)
        away = self.n * whole - np.array(self.sums, whole.dtype)
        return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


def _identity_errors(fit: DataFrame, models: dict[int, Fit]) -> dict[int, float | None]:
    """Largest entry of the projected fit list's covariance minus the identity, from blocks centred each about its own mean."""
    shared = session(fit).sparkContext.broadcast(models)

    def joined(a: tuple, b: tuple) -> tuple:
        (n, mean, m2), (k, other, o2) = a, b
        step = other - mean
        return n + k, mean + step * (k / (n + k)), m2 + o2 + np.outer(step, step) * (n * k / (n + k))

    def state(rows: list[dict]) -> tuple:
        parts = [(r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(len(r["mean"]), len(r["mean"]))) for r in rows]
        total = parts[0]
        for p in parts[1:]:
            total = joined(total, p)
        return total

    kind = pa.schema([("dim", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, tuple] = {}
        for b in batches:
            for dim, part in _by_length(b):
                model = shared.value[dim]
                w = model.project(_matrix(part.column("x")))[:, model.values > 0]
                mean = w.mean(axis=0)
                block = (len(w), mean, (w - mean).T @ (w - mean))
                total[dim] = joined(total[dim], block) if dim in total else block
        bucket = TaskContext.get().partitionId() % BUCKETS
        rows = [{"dim": d, "bucket": bucket, "n": n, "mean": mean.tolist(), "m2": m2.ravel().tolist()} for d, (n, mean, m2) in total.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    def add(table: pa.Table) -> pa.Table:
        n, mean, m2 = state(table.to_pylist())
        return pa.Table.from_pylist([{"dim": table["dim"][0].as_py(), "bucket": 0, "n": n, "mean": mean.tolist(), "m2": m2.ravel().tolist()}], kind)

    spec = "dim int, bucket int, n long, mean array<double>, m2 array<double>"
    rows = [r.asDict() for r in fit.mapInArrow(run, spec).groupBy("dim", "bucket").applyInArrow(add, spec).collect()]
    out: dict[int, float | None] = {}
    for dim in models:
        n, _, m2 = state([r for r in rows if r["dim"] == dim])
        out[dim] = float(np.abs(m2 / n - np.eye(len(m2))).max()) if len(m2) else None
    return out


def whiten(vectors: DataFrame, count: int = COUNT, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = session(vectors)
    rows = whole_vectors(vectors, id_col, vec_col)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/whitening-{uuid.uuid4().hex}"
    rows.groupBy("x").agg(F.first("dim").alias("dim")).write.parquet(folder)
    fit = spark.read.schema("x array<long>, dim int").parquet(folder)

    def count_and_sums(dim: int, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.array([len(x)], object), _sum(x)])

    models = {dim: Fit(dim, s[0], s[1:]) for dim, s in _added(_partials(fit, count_and_sums)).items()}
    centres = {dim: m.centre for dim, m in models.items()}

    def moments(dim: int, x: np.ndarray) -> np.ndarray:
        y = _minus(x, centres[dim])
        return np.concatenate([_sum(y), _products(y)[np.triu_indices(dim)]])

    for dim, m in _added(_partials(fit, moments)).items():
        models[dim].learn(m, count)
    errors = _identity_errors(fit, models) if models else {}
    shared = spark.sparkContext.broadcast((models, errors))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, error = shared.value
        for b in batches:
            for dim, part in _by_length(b):
                model, x = known[dim], _matrix(part.column("x"))
                k, m = len(model.values), len(x)
                if not k:
                    continue
                white = model.project(x).ravel()
                explained = model.values / model.trace if model.trace else np.full(k, np.nan)
                ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
                away = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), away,
                    pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, m), mask=np.isnan(np.tile(explained, m))),
                    pa.array([error[dim]], pa.float64()).take(pa.array(np.zeros(m * k, np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(project, OUT)
