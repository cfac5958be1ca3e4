"""Whitening against a library's eigenvectors and exact sums."""

import numpy as np
import pytest

from quernstone.llm import whitening
from quernstone.llm.whitening import below, components, leading, tridiagonal, whiten


def matrices():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40))
    yield a @ a.T
    yield np.diag(np.arange(1.0, 13))
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    yield q @ np.diag([5.0] * 4 + [5 - 1e-9, 3, 3, 3] + list(np.linspace(1, 0, 22))) @ q.T  # clusters
    yield np.eye(9)
    yield np.array([[4.0]])
    yield np.array([[2.0, 1.0], [1.0, 2.0]])
    b = rng.normal(size=(3, 20))
    yield b.T @ b  # rank 3
    yield 1e-3 * np.cov(rng.normal(size=(200, 64)).T)
    yield np.kron(np.eye(5), np.array([[2.0, 1.0], [1.0, 2.0]]))  # equal blocks


@pytest.mark.parametrize("v", list(matrices()))
def test_against_a_library(v):
    k = min(8, len(v))
    norm = np.abs(v).max()
    wanted = np.linalg.eigvalsh(v)[::-1][:k]
    values, rows = components(v, k)
    assert np.allclose(values, wanted, rtol=1e-12, atol=1e-13 * norm * len(v))
    assert np.allclose(rows @ rows.T, np.eye(k), atol=1e-11)
    assert np.abs(v @ rows.T - rows.T * values).max() < 1e-11 * norm * len(v)
    d, e, _ = tridiagonal(v)
    assert np.allclose(np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))[::-1][:k], wanted, atol=1e-12 * norm * len(v))
    assert (below(d, e, np.array([wanted[0] + norm, wanted[0] - norm * 1e3])) == [len(v), 0]).all()
    assert (np.diff(leading(d, e, k)) <= 1e-12 * norm).all()


def check(found, kept, k=8):
    """The result's rows against sums of Python integers and a library's eigenvectors."""
    x = np.floor(1024.0 * np.array([v for _, v in kept])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    v = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    many = int((values[:k] > 1e-11 * np.trace(v)).sum())
    white = (x - s / n) @ vectors[:, :many] / np.sqrt(values[:many])
    assert len(found) == n * many
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-8 and r["identity_error"] < 1e-6
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for (i, _), row in zip(kept, x)}
    for c, rows in by.items():
        mine = {r["vec_id"]: r["whitened"] for r in rows}
        a, b = np.array([mine[i] for i, _ in kept]), white[:, c - 1]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert {r["vec_id"]: int(r["deviation"]) for r in rows} == exact


def test_whitened(spark):
    rng = np.random.default_rng(4)
    kept = [(i, [float(np.float32(c)) for c in rng.normal(size=12) * np.arange(1, 13) / 7]) for i in range(300)]
    df = spark.createDataFrame(kept, "vec_id long, embedding array<float>").repartition(9)
    check(whiten(df).collect(), kept)


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(4)
    kept = [(i, rng.normal(size=3).tolist()) for i in range(60)]
    check(whiten(spark.createDataFrame(kept, "vec_id long, embedding array<double>").repartition(13)).collect(), kept)


def test_odd_rows(spark):
    kept = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(None, [3.0, 1.0, 1.0])]  # the last dimension never varies
    odd = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]), (54, [float("inf"), 1.0, 1.0]), (55, [1.0]), (56, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(kept + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n", "2 AS w", "3 AS part", "4 AS dim", "5 AS count", "6 AS component")
    check(whiten(df).collect(), kept)


def test_repeated_rows_and_few_rows(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 5.0])]
    found = whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r["vec_id"] for r in found) == [1, 1, 2] and {r["component"] for r in found} == {1}
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [None])]):
        assert whiten(spark.createDataFrame(few, kind)).collect() == []


def test_large_values_stay_exact(spark):
    kept = [(i, [float(i) * 2**28, -float(i) * 2**27, float(i * i)]) for i in range(30)]
    check(whiten(spark.createDataFrame(kept, "vec_id long, embedding array<double>")).collect(), kept)
    with pytest.raises(Exception, match="beyond"):
        whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], "vec_id long, embedding array<double>")).collect()


def test_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kept = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    check(whiten(df).collect(), kept)
