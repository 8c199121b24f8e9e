"""Whitening of vectors: Chebyshev-filtered subspace iteration over the covariance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.operators.common import materialize

EPS = float(np.finfo(float).eps)
LANCZOS_STEPS = 10  # products of one probe vector that bound the spectrum from below
MOST_DEGREE = 16
MOST_ROUNDS = 60
MOST_DECIMAL = 10**38


@dataclass
class Whitening:
    """Mean, unit components by falling eigenvalue, and how well they were met."""

    rows: int
    total: list[int]  # exact sums by dimension
    mean: np.ndarray
    components: np.ndarray  # one column each
    values: np.ndarray
    trace: float
    residuals: np.ndarray  # |V q - e q|
    passes: int  # products with the covariance
    identity_error: float = 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def clean_rows(vectors: DataFrame, vec_id: str, embedding: str, value: Callable[[Column], Column]) -> DataFrame:
    """``vec_id`` and ``vec`` (whole numbers as doubles) of every row whose vector counts."""
    own = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), own.alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.filter(F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    table = materialize(rows.select("vec_id", F.transform("vec", value).cast("array<double>").alias("vec")), "white-rows")
    usual = table.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return table.filter(F.size("vec") == usual["n"]) if usual else table


def sums(table: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension.

    A batch adds up as integers; the parts travel as text, so they have no bound.
    """

    def add(batches):
        rows, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                if np.abs(x).max() * len(x) < 2**53:
                    part = [int(v) for v in x.sum(0)]
                else:
                    part = [sum(int(v) for v in column) for column in x.T]
                total = part if total is None else [a + b for a, b in zip(total, part)]
                rows += len(x)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))],
                ["rows", "at", "total"],
            )

    parts = table.select("vec").mapInArrow(add, "rows long, at int, total decimal(38,0)")
    found = parts.groupBy("at").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).orderBy("at").collect()
    return (found[0]["rows"], [int(r["total"]) for r in found]) if found else (0, [])


class Covariance:
    """Products of the covariance with a few vectors, each one pass over the table.

    A task centres its rows, multiplies them with the vectors and the result with the rows
    again; Spark adds the tasks' sums by dimension. Only vectors go out and sums come back.
    """

    def __init__(self, table: DataFrame, rows: int, mean: np.ndarray):
        self.table, self.rows, self.mean, self.passes = table.select("vec"), rows, mean, 0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        width = q.shape[1]
        shared = self.table.sparkSession.sparkContext.broadcast((self.mean, q))

        def multiply(batches):
            mean, vectors = shared.value
            out = np.zeros(vectors.shape)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0)) - mean
                    out += x.T @ (x @ vectors)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(out)), pa.int32()), pa.array([task] * len(out), pa.int32()), *[pa.array(c) for c in out.T]],
                ["at", "task", *[f"q{j}" for j in range(width)]],
            )

        names = [f"q{j}" for j in range(width)]
        parts = self.table.mapInArrow(multiply, "at int, task int, " + ", ".join(f"{n} double" for n in names))
        found = parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow().sort_by("at")
        shared.unpersist()
        return np.column_stack([found[n].to_numpy() for n in names]) / self.rows

    def trace(self) -> float:
        mean = self.mean
        far = F.aggregate(F.zip_with("vec", F.lit(mean.tolist()), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
        return float(self.table.agg(F.sum(far).alias("t")).first()["t"] or 0.0) / self.rows


class Lanczos:
    """Lower bound of the spectrum from products of one probe vector, taken along in other passes."""

    def __init__(self, size: int, rng: np.random.Generator):
        v = rng.standard_normal(size)
        self.basis, self.alpha, self.beta = [v / np.linalg.norm(v)], [], []

    def open(self) -> bool:
        return len(self.alpha) < min(LANCZOS_STEPS, len(self.basis[0])) and len(self.basis) > len(self.alpha)

    def take(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        for u in self.basis + self.basis:  # twice: orthogonal to rounding
            product = product - (u @ product) * u
        norm = float(np.linalg.norm(product))
        self.beta.append(norm)
        if norm > 1e-10 * max(abs(self.alpha[0]), 1e-300):
            self.basis.append(product / norm)

    def least(self) -> float:
        """Smallest Ritz value less the norm of what is left over; never below 0, the covariance's own bound."""
        if len(self.alpha) < 3:
            return 0.0
        off = self.beta[: len(self.alpha) - 1]
        ritz = np.linalg.eigvalsh(np.diag(self.alpha) + np.diag(off, 1) + np.diag(off, -1))
        return max(0.0, float(ritz[0]) - self.beta[-1])


def filtered(cov: Covariance, q: np.ndarray, low: float, high: float, top: float, degree: int, probe: Lanczos) -> np.ndarray:
    """Chebyshev polynomial of the covariance, times ``q``: small on [low, high], large above.

    Scaled by its value at ``top`` at every step, so that nothing overflows.
    """
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)

    def product(y: np.ndarray) -> np.ndarray:
        if not probe.open():
            return cov @ y
        both = cov @ np.c_[y, probe.basis[-1]]
        probe.take(both[:, -1])
        return both[:, :-1]

    before, now = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(1, degree):
        after = 1 / (2 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def fit(vectors: DataFrame, components: int = 8, spare: int = 24, seed: int = 11) -> Whitening:
    """Mean and leading eigenpairs of the covariance of ``vec`` (divisor n, centred before multiplying).

    Chebyshev-filtered subspace iteration with a block of ``components + spare`` vectors
    (or as many as there are dimensions). Each round damps the unwanted spectrum with a polynomial whose
    products are passes over the rows, makes the block orthonormal (QR) and solves the small
    projected problem (Rayleigh-Ritz). The lower end of the damped interval is a Lanczos
    bound from a probe vector that the first passes take along, the upper end is the
    block's smallest Ritz value.

    Certified means: each wanted pair's residual |V q - e q| is at most 1e-9 of its distance to the next
    eigenvalue, or at the rounding error of a product. Components whose eigenvalue is
    rounding error of the largest are left out, so equal rows give none.
    """
    rows, total = sums(vectors)
    if not rows:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0)
    mean = np.array([float(Decimal(t) / rows) for t in total])
    size = len(total)
    cov, rng = Covariance(vectors, rows, mean), np.random.default_rng(seed)
    trace = cov.trace()
    width, wanted = min(size, components + spare), min(size, components)
    probe = Lanczos(size, rng)
    q = np.linalg.qr(rng.standard_normal((size, width)))[0]
    low, high, top, degree, best, stuck = 0.0, 0.0, 0.0, 0, math.inf, 0
    for _ in range(MOST_ROUNDS):
        if degree:
            q = np.linalg.qr(filtered(cov, q, low, high, top, degree, probe))[0]
            q = np.linalg.qr(q)[0]
        product = cov @ q
        small = q.T @ product
        value, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-value)
        value, turn = np.maximum(value[order], 0), turn[:, order]
        q, product = q @ turn, product @ turn
        residual = np.linalg.norm(product - q * value, axis=0)
        rounding = 16 * EPS * math.sqrt(size) * value[0]
        apart = np.abs(np.subtract.outer(value[:wanted], value))
        apart[np.arange(wanted), np.arange(wanted)] = np.inf
        near = apart.min(1, initial=np.inf)
        worst = float(residual[:wanted].max())
        if width == size or value[0] <= 0 or (residual[:wanted] <= np.maximum(1e-9 * near, rounding)).all():
            break
        best, stuck = (worst, 0) if worst < best / 2 else (best, stuck + 1)
        if stuck >= 5:
            raise ArithmeticError(f"components not certified: residual {worst:.3g}, largest eigenvalue {value[0]:.3g}")
        low, high, top = min(probe.least(), value[-1] * 0.999), float(value[-1]), float(value[0])
        reach = (value[wanted - 1] - (high + low) / 2) / max((high - low) / 2, 1e-300)
        gain = math.acosh(max(reach, 1.0 + 1e-9))  # per degree, as a power of e
        still = math.log(max(worst / max(rounding, 1e-300), 10.0))
        degree = int(min(MOST_DEGREE, max(4, math.ceil(still / gain)), 8 if probe.open() else MOST_DEGREE))
        if high <= 0:  # the block holds the whole range already
            break
    keep = value[:wanted] > size * EPS * max(value[0], float(np.abs(mean).max() ** 2) * EPS)
    n = int(keep.sum())
    return Whitening(rows, total, mean, q[:, :n], value[:n], trace, residual[:n], cov.passes)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    return ((x - model.mean) @ model.components) / np.sqrt(model.values)


def identity_error(table: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by one pass over them."""
    k = len(model.values)
    if not k:
        return 0.0
    shared = table.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = _whitened(shared.value, _matrix(batch.column(0)))
                total, product = total + w.sum(0), product + w.T @ w
        both = np.vstack([total, product])
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), *[pa.array(c) for c in both.T]], ["at", *[f"q{j}" for j in range(k)]])

    names = [f"q{j}" for j in range(k)]
    parts = table.select("vec").mapInArrow(add, "at int, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("at").agg(*[F.sum(n).alias(n) for n in names]).toArrow().sort_by("at")
    both = np.column_stack([found[n].to_numpy() for n in names]) / model.rows
    return float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(k)).max())


def _deviations(x: np.ndarray, rows: int, total: list[int]) -> list[Decimal | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 38 digits."""
    far = np.abs(x - np.array([float(t) for t in total]) / rows).max(initial=0)
    if np.abs(x).max(initial=0) * rows < 2**62 and (far * rows + 2) ** 2 * x.shape[1] < 2**62:
        y = x.astype(np.int64) * rows - np.array(total, np.int64)
        return [Decimal(int(v)) for v in (y * y).sum(1)]
    exact = [sum((int(v) * rows - t) ** 2 for v, t in zip(row, total)) for row in x]
    return [Decimal(v) if v < MOST_DECIMAL else None for v in exact]


def whiten(
    vectors: DataFrame, components: int = 8, value: Callable[[Column], Column] = lambda x: x, vec_id: str = "vec_id", embedding: str = "embedding", spare: int = 24, seed: int = 11
) -> DataFrame:
    """Every vector on the leading principal components, each with variance 1, one row per component.

    Columns: ``vec_id, component`` (from 1, by falling eigenvalue e), ``n`` (rows fitted), ``deviation``
    (decimal(38,0): sum over dimensions of (n x - S)^2, exact), ``whitened``, ``explained`` (e over the trace),
    ``identity_error`` (of the whitened rows' covariance, one value). Components go through ``value``
    as doubles and must then be whole numbers; the fit is over all rows, no sample.

    Left out are rows whose vector is null, empty, holds null or non-finite entries, or is of
    another length than most (the longer in a tie). Rows with a null or repeated id stay, each
    with its own result. An empty table, or one whose rows are all equal, gives an empty table:
    a component without variance has no whitened value. Fewer dimensions give fewer
    components. Other columns are not read. A task holds one batch of rows and
    dimensions x (components + spare) numbers; the driver holds as many.
    """
    spark = vectors.sparkSession
    id_type = vectors.select(vec_id).dtypes[0][1]
    schema = f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    table = clean_rows(vectors, vec_id, embedding, value)
    model = fit(table, components, spare, seed)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], schema)
    model.identity_error = identity_error(table, model)
    shared = spark.sparkContext.broadcast(model)

    def project(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows = np.repeat(np.arange(len(x)), k)
            far = pa.array(_deviations(x, m.rows, m.total), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), m.rows)), far.take(pa.array(rows)), pa.array(_whitened(m, x).reshape(-1)),
                    pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(len(rows), m.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return table.mapInArrow(project, schema)


def floored(scale: int, plus: int) -> Callable[[Column], Column]:
    """``floor(scale * x) + plus`` of a component, as a double that is a whole number."""

    def value(x: Column) -> Column:
        scaled = x * scale
        whole = F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)
        return whole + plus

    return value
