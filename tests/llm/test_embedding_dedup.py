import math

import numpy as np
import pytest

from quernstone.llm import embedding_dedup as ed


def brute(rows):
    n = len(rows)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links, root = [0] * n, list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if good[a] and good[b] and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for a in range(n):
        least[find(a)] = min(rows[a][0], least.get(find(a), rows[a][0]))
    return {i: (links[a], least[find(a)], i == least[find(a)]) for a, (i, _) in enumerate(rows)}


def cloud(seed, n=300, dim=32):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n // 3)]
    while len(rows) < n:
        v = rows[rng.integers(len(rows))]
        rows.append(v + rng.normal(size=dim) * np.linalg.norm(v) / math.sqrt(dim) * rng.choice([0.02, 0.1, 0.2, 0.3]))
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("chunk", [1024, 7])
def test_links_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ed, "CHUNK", chunk)
    rows = cloud(4)
    want = brute(rows)
    found = {r[0]: tuple(r)[1:] for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    total = sum(w[0] for w in want.values())
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(f[0] for f in found.values()) >= 0.97 * total
    assert sum(found[i] == want[i] for i in want) >= 0.95 * len(want)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(600, 64)), rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    for cosine in (0.3, 0.95, 0.99):
        z = cosine * x + math.sqrt(1 - cosine**2) * y
        left, right = (ed.decode(*ed.encode(v), 64) for v in (x, z))
        estimate = ((left[0] * right[1]).sum(1) + (left[1] * right[0]).sum(1)) / 2
        assert abs(estimate.mean() - cosine) < 0.015
        passed = np.diag(ed.may_link(left, right, 0.95, 64))
        assert passed.mean() >= 0.997 if cosine >= 0.95 else passed.mean() <= 0.01
    codes, factors = ed.encode(x)
    assert codes.shape == (600, 64 * ed.ROTATIONS // 8) and factors.shape == (600, ed.ROTATIONS)


def test_recall_at_the_threshold(spark):
    """Pairs between 0.95 and 0.97: nearly all are found, and none below."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        v = rng.normal(size=48)
        v /= np.linalg.norm(v)
        w = rng.normal(size=48)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        cosine = rng.uniform(0.93, 0.97)
        rows += [(2 * i, v.tolist()), (2 * i + 1, (cosine * v + math.sqrt(1 - cosine**2) * w).tolist())]
    want = brute(rows)
    found = {r[0]: tuple(r)[1:] for r in ed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(f[0] for f in found.values()) >= 0.99 * sum(w[0] for w in want.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, 1.0]), (11, [-1.0, 0.0]), (12, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, code int")
    found = {r[0]: tuple(r)[1:] for r in ed.near_duplicates(df).collect()}
    assert found == brute(rows)
    assert ed.near_duplicates(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [2.0, -1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ed.near_duplicates(nulls).collect()), key=str) == [(5, 0, 5, True), (None, 1, None, False), (None, 1, None, False)]
    big = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1.01e-200])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in ed.near_duplicates(big).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_plan_misses_little():
    for n in (10, 10_000, 10**9):
        bits, tables = ed.plan(n)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= ed.MISSED
