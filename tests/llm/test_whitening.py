"""Whitening against numpy's eigenvalues and against exact integers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import queries, whitening
from runlens.llm.arrow import table
from tests.llm.tables import FOLDER

DDL = "vec_id long, embedding array<double>, component int, n string, whitened string, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 9, "x", "x", 1) for i, v in rows], DDL)


def exact(vectors, scale=64, offset=1_000_000):
    """x, n, S and the covariance in whole numbers."""
    x = [[int(np.floor(scale * float(c))) + offset for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    d = [[n * a - s for a, s in zip(row, sums)] for row in x]
    dims = range(len(sums))
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in dims] for i in dims])
    return x, n, sums, d, cov


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40])
def test_leading_against_numpy(size):
    rng = np.random.default_rng(size)
    for m in (rng.standard_normal((size, 2 * size)), rng.standard_normal((size, 2 * size)) * 10.0 ** rng.integers(-3, 4, (size, 1))):
        m = m @ m.T
        values, vectors = whitening.leading(m, 32)
        want = np.linalg.eigvalsh(m)[::-1][:32]
        want = want[want > size * 2.3e-16 * np.abs(m).sum(axis=1).max()]
        assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * want[0])
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * want[0]


@pytest.mark.parametrize("diagonal", [[3.0] * 6, [5, 5, 2, 2, 0, 0], [1.0, 1 + 1e-15, 1 - 1e-15], [1e9, 1e-3, 1e-3], [7.0]])
def test_equal_and_zero_eigenvalues(diagonal):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(diagonal),) * 2))[0]
    for m in (np.diag(diagonal).astype(float), q @ np.diag(diagonal) @ q.T):
        m = (m + m.T) / 2
        values, vectors = whitening.leading(m, 4)
        want = sorted((d for d in diagonal if d > 0), reverse=True)[:4]
        if max(diagonal) / min(want) < 1e10:
            assert np.allclose(values, want, rtol=1e-6 if max(diagonal) > 1e6 else 1e-12)
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9
    assert len(whitening.leading(np.zeros((3, 3)))[0]) == 0


def test_inertia_counts_signs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        m = rng.integers(-2, 3, (6, 6)).astype(float)
        m = m + m.T
        e = np.linalg.eigvalsh(m)
        if np.abs(e).min() > 1e-9:
            assert whitening.inertia(m) == ((e > 0).sum(), (e < 0).sum())


def test_query_against_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").select("vec_id", "embedding").collect()]
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x, n, sums, d, cov = exact([v for _, v in good])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    projected = (np.array(d, dtype=float) / n) @ vectors / np.sqrt(values)
    got = queries.queries()["op12_embedding_whitening"](spark, FOLDER).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 32 * len(good) and set(got.n) == {n}
    mine = got.whitened.to_numpy().reshape(-1, 32)
    order = np.argsort([i for i, _ in good])
    want = projected[order] * np.sign((projected[order] * mine).sum(axis=0))
    assert np.abs(mine - want).max() < 1e-8
    assert got.deviation.to_numpy().reshape(-1, 32)[:, 0].tolist() == [sum(a * a for a in d[k]) for k in order]
    assert np.allclose(got.explained.to_numpy()[:32], values / np.trace(cov), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    base = [(i, rng.standard_normal(3).tolist()) for i in range(30)]
    odd = [(100, None), (101, [None, 1.0, 1.0]), (102, [float("nan")] * 3), (103, [float("inf"), 0.0, 0.0]), (104, [1.0]), (105, []),
           (106, [1e300, 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (3, base[3][1])]
    rows = base + odd[-2:]
    out = whitening.whiten(frame(spark, base + odd)).toPandas()
    _, n, _, d, cov = exact([v for _, v in rows])
    assert n == 32 and set(out.n) == {32} and len(out) == 32 * 3
    assert sorted(out.deviation[out.component == 1]) == sorted(sum(a * a for a in row) for row in d)
    assert np.allclose(np.sort(out.explained.unique())[::-1] * np.trace(cov), np.linalg.eigvalsh(cov)[::-1])
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        empty = whitening.whiten(frame(spark, few))
        assert empty.count() == 0 and empty.columns == out.columns.tolist()


def test_large_components_stay_exact(spark):
    rows = [(0, [1e9, 0.5]), (1, [-3e9, 0.25]), (2, [2e9 + 0.125, 0.0]), (3, [1.0, -4.0])]
    fit = frame(spark, rows).select("embedding")
    got = whitening.moments(fit, "embedding", 2)
    _, n, sums, _, cov = exact([v for _, v in rows])
    assert (got.n, got.sums) == (n, sums) and (got.covariance == cov).all()


def test_covariance_does_not_depend_on_partitions(spark):
    df = table(spark, FOLDER, "embeddings")
    one, many = (whitening.moments(df.repartition(k).where(F.col("embedding").isNotNull()), "embedding", 64) for k in (1, 7))
    assert (one.n, one.sums) == (many.n, many.sums) and (one.covariance == many.covariance).all()
