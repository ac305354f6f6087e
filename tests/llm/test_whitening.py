"""Whitening by passes against a dense decomposition."""

import math

import numpy as np
import pytest

from panelspark.llm import whitening


def table(spark, rows):
    return spark.createDataFrame([(i, v, "a", 7) for i, v in rows], "vec_id long, embedding array<float>, x string, n int")


def dense(rows):
    """n, sums, rows by id, eigenvalues and vectors, with plain Python's whole numbers."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    exact = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return n, centred, exact, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("d,n", [(5, 40), (64, 300), (90, 500)])
def test_against_dense_decomposition(spark, d, n):
    rng = np.random.default_rng(d)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.standard_normal((n, d)) * (0.97 ** np.arange(d)) + rng.standard_normal(d) * 3).astype(np.float32))]
    odd = [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] + [0.0] * (d - 1)), (1004, [0.0] * (d - 1) + [float("inf")]), (1005, [1.0] * (d + 1))]
    got = whitening.whiten(table(spark, rows + odd).repartition(3)).toPandas()
    n, centred, exact, values, vectors = dense(rows)
    k = min(d, 32)
    assert len(got) == n * k and (got.n == n).all() and got.identity_error.max() < 1e-9 and got.residual.max() < 1e-11
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    for c in range(1, k + 1):
        one = got[got.component == c].sort_values("vec_id")
        assert one.deviation.tolist() == exact and one.explained.iloc[0] == pytest.approx(values[c - 1] / values.sum(), rel=1e-10)
        mine = one.whitened.to_numpy()
        assert np.abs(mine * np.sign(mine @ want[:, c - 1]) - want[:, c - 1]).max() < 1e-6


def test_a_direction_that_the_first_block_misses(spark, monkeypatch):
    """The first block has nothing of the largest direction: the fresh directions find it."""
    d = 80
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, d)) * (0.96 ** np.arange(d))
    v = x.T @ x / 400

    class Dense:
        def times(self, q):
            out = v @ q
            return out if self.seen else out * keep[:, None]

        seen = True

    keep = np.ones(d)
    top = np.linalg.eigh(v)[1][:, -1]
    real, drawn = np.random.default_rng, []

    class Draw:
        def __init__(self, seed):
            self.rng = real(seed)

        def standard_normal(self, shape):
            q = self.rng.standard_normal(shape)
            drawn.append(shape)
            return q - np.outer(top, top @ q) if len(drawn) == 1 else q

    monkeypatch.setattr(whitening.np.random, "default_rng", Draw)
    values, vectors, residual = whitening.top_eigenvectors(Dense(), d)
    assert values == pytest.approx(np.linalg.eigvalsh(v)[::-1][:32], rel=1e-9) and residual < 1e-11 and abs(vectors[:, 0] @ top) == pytest.approx(1)


def test_rows_without_variance(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    line = whitening.whiten(table(spark, [(k % 5, [float(k), 2.0 * k, 1.0]) for k in range(10)] + [(None, [100.0, 200.0, 1.0])])).toPandas()
    assert len(line) == 11 and set(line.component) == {1} and line.explained.iloc[0] == pytest.approx(1) and line.identity_error.max() < 1e-9


def test_deviations_beyond_long():
    x = np.array([[1 << 40, 3], [5, 7]], np.int64)
    want = [sum((2 * int(c) - s) ** 2 for c, s in zip(r, x.sum(0).tolist(), strict=True)) for r in x]
    assert whitening.deviations(x, 2, x.sum(0)) == [None if t >= 1 << 63 else t for t in want]
    small = np.array([[1_000_004, 999_990], [1_000_000, 1_000_001]], np.int64)
    assert whitening.deviations(small, 2, small.sum(0)) == [(4) ** 2 + 11**2] * 2
