"""Whitening against the eigenvectors of the covariance matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import queries, whitening

ROWS = "vec_id long, embedding array<double>, label int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], ROWS).repartition(6)


def grid(vectors):
    return np.floor(np.array(vectors) * 1024).astype(np.int64) + 100_000


def check(rows, vectors, k=8):
    """Columns against plain numpy, the sign of a component aside."""
    x = grid(vectors)
    n = len(x)
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    w = c @ v[:, :k] / np.sqrt(e[:k])
    got = np.array([[r.whitened for r in sorted(rows, key=lambda r: r.component) if r.vec_id == i] for i in range(n)])
    for j in range(got.shape[1]):
        sign = np.sign(got[:, j] @ w[:, j])
        assert np.abs(got[:, j] * sign - w[:, j]).max() < 1e-6
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    assert all(r.deviation == dev[r.vec_id] and r.n == n for r in rows)
    assert all(abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 for r in rows)
    assert max(r.identity_error for r in rows) < 1e-6


def test_query_equals_numpy(spark, sf):
    vectors = [r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = queries.embedding_whitening(spark, sf).collect()
    assert len(rows) == 8 * len(vectors)
    check(rows, vectors)


def test_narrow_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 3)) * [5.0, 1.0, 0.1]).tolist()
    rows = whitening.report(table(spark, vectors)).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    check(rows, vectors, 3)
    # a third of all vectors are one and the same
    check(whitening.report(table(spark, vectors + vectors[:1] * 150)).collect(), vectors + vectors[:1] * 150, 3)


def test_rotations_keep_small_deviations():
    """Lengths of a matrix with columns of very different size, to relative precision."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    size = 10.0 ** -np.arange(0, 14, 2)
    lengths, v = whitening.jacobi(q * size)
    assert np.abs(lengths / size - 1).max() < 1e-12
    assert np.abs(v.T @ v - np.eye(7)).max() < 1e-13
    a = rng.normal(size=(40, 9))
    lengths, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
    assert np.abs(lengths - np.linalg.svd(a, compute_uv=False)).max() < 1e-12
    assert np.abs(a @ v - a @ v @ np.diag(1 / lengths) * lengths).max() < 1e-12


def test_many_factors_are_stacked_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(90, 5)).tolist()
    check(whitening.report(table(spark, vectors)).collect(), vectors, 5)


def test_edges(spark):
    """Nulls in every column, ragged, non-finite and huge vectors, no spread, no rows."""
    rows = [(1, [1.0, 2.0], 0), (None, [2.0, 1.0], None), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [], 1), (8, [1.0], 1), (9, [0.5, -3.0], 0), (9, [0.5, -3.0], 0)]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("component", "n", "whitened", "deviation", "id", "vector")})
    got = whitening.report(df).collect()
    assert sorted(((r.vec_id or 0), r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (9, 1), (9, 1), (9, 2), (9, 2)]
    assert {r.n for r in got} == {4}
    same = whitening.report(table(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and {r.whitened for r in same} == {None} and {r.deviation for r in same} == {0} and {r.explained for r in same} == {0.0}
    line = whitening.report(table(spark, [[float(i), 2.0 * i] for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2}
    huge = whitening.report(table(spark, [[1e12, 0.0], [-1e12, 1.0], [0.0, 5.0]])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id < 2) and max(r.identity_error for r in huge) < 1e-4
    assert whitening.report(spark.createDataFrame([], ROWS)).count() == 0
    assert whitening.report(spark.createDataFrame([(1, None, 1)], ROWS)).count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
def test_any_id_type(spark, kind):
    df = table(spark, np.random.default_rng(0).normal(size=(30, 4)).tolist()).withColumn("vec_id", F.col("vec_id").cast(kind))
    assert dict(whitening.report(df).dtypes)["vec_id"] == kind and whitening.report(df).count() == 120
