"""Seeds, Lloyd's rounds and silhouettes of all bases against plain numpy; training that follows growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import kmeans
from quernstone.streaming import training

KIND = "kb_id string, vec_id long, embedding array<double>"


def made(spark, n=240, dim=4, bases=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dim)) * 20
    rows = [(bases[i % len(bases)], i, (centres[i % 3] + rng.normal(size=dim)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, KIND)


def nearest(x, c):
    return np.round(((x[:, None] - c[None]) ** 2).sum(2), 6).argmin(1)


@pytest.fixture(params=[16_000_000, 0])
def packed(request, monkeypatch):
    """0: centres are joined, not sent to all tasks; parts of 50 rows."""
    monkeypatch.setattr(kmeans, "PACKED", request.param)
    monkeypatch.setattr(kmeans, "PART", 50)


def test_lloyd_of_bases(spark, packed):
    rows, df = made(spark)
    seeds = df.where("vec_id < 6").select("kb_id", F.col("vec_id").alias("cluster_id"), F.col("embedding").alias("centroid"))
    found = {(r["kb_id"], r["cluster_id"]): r for r in kmeans.lloyd(df, seeds, 3).collect()}
    for kb, start in (("a", [0, 2, 4]), ("b", [1, 3, 5])):
        x = np.array([v for k, _, v in rows if k == kb])
        c = np.array([rows[i][2] for i in start])
        for _ in range(3):
            own = nearest(x, c)
            c = np.stack([x[own == i].mean(0) for i in range(3)])
        for i, s in enumerate(start):
            assert np.allclose(found[(kb, s)]["centroid"], c[i]) and found[(kb, s)]["size"] == (own == i).sum()


def test_seeds_spread_out(spark, packed):
    rows, df = made(spark, n=300)
    ks = spark.createDataFrame([("a", 3), ("b", 2), ("c", 4)], "kb_id string, k int")
    once = {(r["kb_id"], r["cluster_id"]) for r in kmeans.seeds(df, ks).collect()}
    assert once == {(r["kb_id"], r["cluster_id"]) for r in kmeans.seeds(df.repartition(7), ks).collect()}  # draws don't hang on the task
    assert sorted(k for k, _ in once) == ["a"] * 3 + ["b"] * 2
    assert len({i % 3 for k, i in once if k == "a"}) == 3  # one of each cloud


def test_train_finds_the_clouds(spark):
    rows, df = made(spark, n=300, bases=("a",))
    done = kmeans.train(df, spark.createDataFrame([("a", 3)], "kb_id string, k int")).collect()
    assert sorted(r["size"] for r in done) == [100, 100, 100] and [r["cluster_id"] for r in sorted(done)] == [0, 1, 2]
    own = {r["vec_id"]: r["cluster_id"] for r in kmeans.assign(df, spark.createDataFrame(done)).collect()}
    assert len({(i % 3, c) for i, c in own.items()}) == 3


def test_odd_vectors(spark):
    rows = [("a", 1, None), ("a", 2, []), ("a", 3, [None, 1.0]), ("a", 4, [float("nan"), 0.0]), (None, 5, [1.0, 1.0]), ("a", 6, [1.0, 1.0]), ("a", 6, [1.0, 1.0]), ("a", 7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, KIND)
    done = kmeans.train(df, spark.createDataFrame([("a", 5), ("b", 2), ("c", None)], "kb_id string, k int")).collect()
    assert [(r["kb_id"], r["cluster_id"], r["size"], r["centroid"]) for r in done] == [("a", 0, 3, [1.0, 1.0])]
    assert kmeans.train(df.limit(0), spark.createDataFrame([("a", 5)], "kb_id string, k int")).count() == 0


def test_silhouette(spark, packed):
    rows, _ = made(spark, n=90)
    rows = [(kb, i, v, i % 4 if kb == "a" else 0) for kb, i, v in rows] + [("a", 900, [9.0] * 4, 77), ("a", 901, None, 1), ("a", 902, [1.0] * 4, None)]
    df = spark.createDataFrame(rows, KIND + ", cluster_id int")
    found = {(r["kb_id"], r["cluster_id"]): (r["size"], r["silhouette"]) for r in kmeans.silhouette(df).collect()}
    for kb in "ab":
        own = [(np.array(v), c) for k, _, v, c in rows if k == kb and v is not None and c is not None]
        scores = {}
        for i, (v, c) in enumerate(own):
            far = {}
            for j, (w, d) in enumerate(own):
                if i != j:
                    far.setdefault(d, []).append(((v - w) ** 2).sum())
            others = [np.mean(f) for d, f in far.items() if d != c]
            s = 0.0
            if c in far and others:
                a, b = np.mean(far[c]), min(others)
                s = (b - a) / max(a, b)
            scores.setdefault(c, []).append(s)
        for c, s in scores.items():
            assert found[(kb, c)][0] == len(s) and abs(found[(kb, c)][1] - np.mean(s)) < 2e-6
    assert found[("a", 77)] == (1, 0.0) and found[("b", 0)][1] == 0.0


def test_training_follows_growth(spark, tmp_path):
    rows, df = made(spark, n=300, bases=("a", "b", "b"))
    ks = spark.createDataFrame([("a", 2), ("b", 3)], "kb_id string, k int")
    store, drop = f"{tmp_path}/store", f"{tmp_path}/in"

    def events():
        return sorted((r["batch"], r["kb_id"]) for r in training.read(spark, store, "event", training.EVENTS).collect())

    def arrive(part):
        part.withColumn("embedding", F.col("embedding").cast("array<float>")).coalesce(1).write.mode("append").parquet(drop)
        training.run(spark.readStream.schema("kb_id string, vec_id long, embedding array<float>").parquet(drop), store, f"{tmp_path}/state", ks)

    arrive(df.where("vec_id < 150"))
    assert events() == [(0, "a"), (0, "b")]
    arrive(df.where("vec_id between 150 and 165"))  # grown by a tenth: nothing
    assert events() == [(0, "a"), (0, "b")]
    arrive(df.where("vec_id > 165 and kb_id = 'b'"))
    assert events() == [(0, "a"), (0, "b"), (2, "b")]
    now = {(r["kb_id"], r["cluster_id"]): r["size"] for r in training.centroids(spark, store).collect()}
    assert sum(n for (kb, _), n in now.items() if kb == "b") == 200 and sum(n for (kb, _), n in now.items() if kb == "a") == 50
    ids = [r["event_id"] for r in training.read(spark, store, "event", training.EVENTS).where("kb_id = 'b'").collect()]
    assert len(set(ids)) == 2
    training.take_up(df.where("vec_id > 165 and kb_id = 'b'"), 2, store, ks)  # a repeated batch replaces itself
    assert events() == [(0, "a"), (0, "b"), (2, "b")]
