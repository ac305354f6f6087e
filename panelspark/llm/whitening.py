"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are coded as whole numbers, so their sums, and every row's centred difference, are exact. The covariance is never
formed: each pass over the distributed rows takes a block Q of a few columns and returns the centred X'(XQ) / n, summed
in Spark; the driver holds blocks of (dimensions x columns) alone. A Chebyshev polynomial of the covariance, by its
three-term recurrence with one pass a degree, damps the spectrum below the block's smallest Ritz value, QR makes the
block orthonormal again and Rayleigh-Ritz turns it to eigenvectors. The degree is as high as the spread of the wanted
eigenvalues allows without drowning the small ones. Done when every wanted residual is as small as double precision
allows, and a filtered block of fresh directions beside the found ones has no Ritz value above the last of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_batches, written

COMPONENTS = 32
#: Columns of the block beyond the wanted ones, and fresh columns that check that nothing was missed.
GUARD, PROBES = 24, 4
SCALE, OFFSET = 64, 1_000_000
#: Residual of an eigenvector over the largest eigenvalue: aimed at, and accepted when it shrinks no more.
AIM, ACCEPTED = 1e-13, 1e-11
MOST_ROUNDS = 100
#: The filter may grow the largest wanted direction over the smallest by so much at a time.
SPREAD = 1e7
MOST_DEGREE = 40
#: Eigenvalues below this share of the largest are no variance but rounding: such components have no whitened values.
NO_VARIANCE = 1e-12
#: Rows of vectors turned to result rows at a time.
ROWS_AT_A_TIME = 2048


def coded(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and x, floor(64 c) + 1,000,000 of each entry c. Rows whose vector is null, has no entries, holds null or
    non-finite entries or entries of 2^45 or more are left out; so are those of another length than most vectors have
    (of equally frequent lengths the longest counts)."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 45))
    v = F.col(column)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(fine(c), F.lit(False))))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c.cast("double")) + OFFSET).alias("x"))
    rows = written(rows, "coded")
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size("x") == (top[0]["d"] if top else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _summed(rows: DataFrame, of, size: int, kind: str) -> np.ndarray:
    """The sum over all rows of of(matrix of the rows' x), a flat array of a fixed size: summed in each task, then by
    position in Spark."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "v"])

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in rows.select("x").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


@dataclass
class Fit:
    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float


class Covariance:
    """The rows' covariance as an operator: products with blocks, by passes over the rows."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums, self.passes = rows, n, sums, 0
        self.low = np.array([int(s) // n for s in sums], np.int64)
        self.rest = np.array([int(s) % n for s in sums], np.float64) / n

    def centred(self):
        low, rest = self.low, self.rest
        return lambda x: (x - low) - rest  # the whole difference is exact, so only the last step rounds

    def times(self, q: np.ndarray) -> np.ndarray:
        centred, n = self.centred(), self.n
        self.passes += 1

        def of(x):
            c = centred(x)
            return (c.T @ (c @ q) / n).ravel()

        return _summed(self.rows, of, q.size, "double").reshape(q.shape)

    def trace(self) -> float:
        centred, n = self.centred(), self.n
        return float(_summed(self.rows, lambda x: np.array([(centred(x) ** 2).sum() / n]), 1, "double")[0])


def filtered(v: Covariance, q: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times q: at most 1 in size on [low, cut], growing beyond, scaled to 1 at top."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = half / (top - middle)
    tau = 2 / sigma
    y = (v.times(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (tau - sigma)
        q, y = y, 2 * (v.times(y) - middle * y) * (after / half) - sigma * after * q
        sigma = after
    return y


def _ritz(v: Covariance, q: np.ndarray):
    """Ritz values (falling) and vectors of span(q), and the residual norms."""
    q = np.linalg.qr(q)[0]
    vq = v.times(q)
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    q, vq = q @ u, vq @ u
    return values, q, np.linalg.norm(vq - q * values, axis=0)


def _degree(values: np.ndarray, wanted: int, cut: float) -> int:
    growth = lambda e: math.acosh(max(2 * e / cut - 1, 1 + 1e-9))
    return int(np.clip(math.log(SPREAD) / max(growth(values[0]) - growth(values[wanted - 1]), 1e-3), 2, MOST_DEGREE))


def top_eigenvectors(v: Covariance, d: int, components: int = COMPONENTS, seed: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """values, vectors and the largest residual over the largest value, of the largest `components` eigenvalues (fewer where
    the dimensions or the variance end before)."""
    draw = np.random.default_rng(seed).standard_normal
    wanted = min(components, d)
    block = min(d, wanted + GUARD)
    values, q, residual = _ritz(v, draw((d, block)))
    worst = np.inf
    for _ in range(MOST_ROUNDS):
        if values[0] <= 0:
            break
        live = max(1, int((values[:wanted] > NO_VARIANCE * values[0]).sum()))
        now = residual[:live].max() / values[0]
        settled = now <= AIM or (now <= ACCEPTED and now > worst / 4)
        worst = min(worst, now)
        if block == d:
            if settled or now <= ACCEPTED:
                break
            values, q, residual = _ritz(v, q)
            continue
        cut = max(values[-1], NO_VARIANCE * values[0])
        degree = _degree(values, live, cut)
        if settled:
            fresh = draw((d, min(PROBES, d - live)))
            fresh -= q[:, :live] @ (q[:, :live].T @ fresh)
            fresh = filtered(v, np.linalg.qr(fresh)[0], 0.0, cut, values[0], degree)
            fresh -= q[:, :live] @ (q[:, :live].T @ fresh)
            if np.linalg.norm(fresh) == 0 or _ritz(v, fresh)[0][0] <= values[live - 1] * (1 + 1e-9) + ACCEPTED * values[0]:
                break
            q[:, -fresh.shape[1] :], worst = np.linalg.qr(fresh)[0], np.inf  # a direction was missed: go on with it
        values, q, residual = _ritz(v, filtered(v, q, 0.0, cut, values[0], degree))
    else:
        raise ArithmeticError(f"eigenvectors not found in {MOST_ROUNDS} rounds: residual {worst:.1e} of the largest eigenvalue")
    live = int((values[:wanted] > NO_VARIANCE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    q = q[:, :live]
    q = q * np.where(np.take_along_axis(q, np.abs(q).argmax(0)[None], 0) < 0, -1.0, 1.0)
    return values[:live], q, float(residual[:live].max() / values[0]) if live else 0.0


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Eigenvectors of the covariance (divisor n) of all rows (vec_id, x). None where there are no rows."""
    first = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if not first["n"]:
        return None
    bounded_batches(rows.sparkSession)
    n, d = first["n"], first["d"]
    v = Covariance(rows, n, _summed(rows, lambda x: x.sum(0), d, "long"))
    values, vectors, residual = top_eigenvectors(v, d, components)
    return Fit(n, v.sums, vectors, values, v.trace(), residual)


def identity_error(rows: DataFrame, found: Fit) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity: a pass over all rows."""
    k = len(found.values)
    if not k:
        return 0.0
    whiten, n = _whitener(found), found.n

    def of(x):
        z = whiten(x)
        return np.concatenate([(z.T @ z).ravel() / n, z.sum(0) / n])

    total = _summed(rows, of, k * k + k, "double")
    mean = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _whitener(found: Fit):
    centred, scaled = Covariance(None, found.n, found.sums).centred(), found.vectors / np.sqrt(found.values)
    return lambda x: centred(x) @ scaled


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sum over dimensions of (n x - S)^2 of each row, exact; None where that is no long."""
    most = max(abs(n * int(t) - int(s)) for edge in (x.min(0), x.max(0)) for t, s in zip(edge, sums, strict=True))
    if most * most * x.shape[1] < 1 << 63 and n * int(np.abs(x).max()) < 1 << 62:
        return ((n * x - sums) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1).tolist()
    return [t if t < 1 << 63 else None for t in exact]


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row kept by coded() and component (numbered from 1 by falling variance): vec_id, component, n, deviation,
    whitened, explained (share of the whole variance), identity_error, residual.

    A component without variance (fewer dimensions or different rows than components) has no rows; a table of equal
    vectors, or an empty one, gives none at all. Rows that repeat a vec_id, or have none, each give their own. deviation
    is null where it would not fit a long. Extra columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows = coded(vectors, column)
    found = fit(rows, components)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, found), len(found.values)
    whitened, explained = _whitener(found), found.values / found.trace

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_A_TIME):
                batch = whole.slice(at, ROWS_AT_A_TIME)
                x, m = _matrix(batch), batch.num_rows
                repeated = np.repeat(np.arange(m), k)
                ids = batch.column("vec_id").take(pa.array(repeated))
                deviation = pa.array(deviations(x, found.n, found.sums), pa.int64()).take(pa.array(repeated))
                values = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, found.n), deviation, whitened(x).ravel(), np.tile(explained, m), np.full(m * k, error), np.full(m * k, found.residual)]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.mapInArrow(run, schema)
