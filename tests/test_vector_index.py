"""The stored index against exact retrieval: recall, copies, bases, appending."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import mutations, retrieval, vector_index


def frame(spark, x, ids=None, part="p"):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(part, int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "kb_part string, vec_id long, embedding array<float>")


def clouds(n, dim, centres, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("centres, spread", [(1, 1.0), (40, 0.05), (300, 0.2)])
def test_recall(spark, tmp_path, centres, spread):
    x = clouds(3000, 24, centres, spread=spread)
    rows = frame(spark, x)
    vector_index.build(rows, f"{tmp_path}/index")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = {(r["query_id"], r["vec_id"]): r["score"] for r in vector_index.nearest(vector_index.stored(spark, f"{tmp_path}/index"), queries, 10).collect()}
    exact = {(r["query_id"], r["vec_id"]): r["score"] for r in retrieval.vector_topk(rows, queries, 10).collect()}
    assert len(found) == len(exact) == 1500
    assert len(found.keys() & exact.keys()) >= 0.95 * len(exact)
    assert all(abs(found[k] - exact[k]) < 2e-6 for k in found.keys() & exact.keys())


@pytest.mark.parametrize("breadth, spread", [(10, 1.0), (64, 1.0), (10, 0.05)])
def test_finds_what_the_walk_misses(spark, tmp_path, breadth, spread):
    rows = frame(spark, clouds(2500, 64, 40, spread=spread))
    vector_index.build(rows, f"{tmp_path}/index")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.nearest(vector_index.stored(spark, f"{tmp_path}/index"), queries, 10, breadth=breadth)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.vector_topk(rows, queries, 10).collect()))


def test_cells_that_cannot_reach_the_bar_are_left_out():
    x = clouds(2000, 16, 8, spread=0.02)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = np.arange(0, 2000, 40)
    own, angles = vector_index.cells(x, pivots)
    q, bars = x[:100], np.sort(np.round(x[:100] @ x.T, 6), axis=1)[:, -10]
    who, node, score = vector_index.above(x, q, bars, pivots, own, angles)
    all_ = np.round(q @ x.T, 6)
    assert set(zip(who.tolist(), node.tolist())) == set(map(tuple, np.argwhere(all_ >= bars[:, None]).tolist()))
    assert (np.arccos(np.clip(q @ x[pivots].T, -1, 1)) - angles > np.arccos(bars)[:, None] + 1e-5).mean() > 0.5


def test_walks_through_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SEGMENT", 400)
    rows = frame(spark, clouds(1500, 8, 30)).withColumn("kb_part", F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b"))
    vector_index.build(rows, f"{tmp_path}/index")
    index = vector_index.stored(spark, f"{tmp_path}/index")
    assert index.count() == 2 + 3
    queries = rows.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), "embedding")
    for part, own in ((None, rows), ("a", rows.where("kb_part = 'a'"))):
        found = {tuple(r) for r in vector_index.nearest(vector_index.stored(spark, f"{tmp_path}/index", part), queries, 5).select("query_id", "vec_id").collect()}
        exact = {tuple(r) for r in retrieval.vector_topk(own, queries, 5).select("query_id", "vec_id").collect()}
        assert len(found & exact) >= 0.95 * len(exact)


def test_is_not_built_again(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/source"
    frame(spark, clouds(600, 6, 10)).write.parquet(source)
    queries = frame(spark, clouds(600, 6, 10)[:5]).select(F.col("vec_id").alias("query_id"), "embedding").cache()
    first = queries.count()
    vector_index.build(spark.read.parquet(source), f"{tmp_path}/index")
    monkeypatch.setattr(vector_index, "graph", None)
    mutations.remove(spark, source)
    index = vector_index.stored(spark, f"{tmp_path}/index")
    once = sorted(map(tuple, vector_index.nearest(index, queries, 3).collect()))
    assert once == sorted(map(tuple, vector_index.nearest(index, queries, 3).collect())) and len(once) == 3 * first


def test_append_and_drop(spark, tmp_path):
    path, x = f"{tmp_path}/index", clouds(300, 6, 5)
    vector_index.build(frame(spark, x[:200]), path)
    vector_index.append(frame(spark, x[200:], range(200, 300)), path)
    vector_index.append(frame(spark, x[:10], range(900, 910), part="q"), path)
    assert {r["vec_id"] for r in vector_index.contents(vector_index.stored(spark, path, "p")).collect()} == set(range(300))
    query = frame(spark, x[250:251]).select(F.lit(1).alias("query_id"), "embedding")
    assert vector_index.nearest(vector_index.stored(spark, path), query, 1).first()["vec_id"] == 250
    mutations.drop_partition(spark, path, "kb_part", "p")
    assert {r["vec_id"] for r in vector_index.contents(vector_index.stored(spark, path)).collect()} == set(range(900, 910))


def test_odd_rows(spark, tmp_path):
    rows = [("p", 1, [1.0, 0.0]), ("p", 1, [1.0, 0.0]), ("p", 2, [2.0, 0.0]), ("p", 3, None), ("p", 4, []), ("p", 5, [0.0, 0.0]), ("p", 6, [None, 1.0]), ("p", 7, [float("nan"), 1.0]), ("p", 8, [1.0, 2.0, 3.0]), (None, 9, [1.0, 1.0]), ("p", None, [1.0, 1.0])]
    rows += [("p", 100 + i, [0.0, 3.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "kb_part string, vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    vector_index.build(df, f"{tmp_path}/index")
    index = vector_index.stored(spark, f"{tmp_path}/index")
    assert sorted(r["vec_id"] for r in vector_index.contents(index).collect()) == [1, 2, 8, *range(100, 150)]
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "query_id long, embedding array<double>")
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vector_index.nearest(index, asked, 3, min_score=0.5).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 100, 1.0), (1, 2, 101, 1.0), (1, 3, 102, 1.0), (2, 1, 8, 1.0)]
    assert vector_index.nearest(index, asked.limit(0), 3).count() == 0


def test_many_queries_take_more_passes(spark, tmp_path, monkeypatch):
    rows = frame(spark, clouds(200, 4, 3))
    vector_index.build(rows, f"{tmp_path}/index")
    queries = rows.select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.stored(spark, f"{tmp_path}/index")
    once = sorted(map(tuple, vector_index.nearest(index, queries, 2).collect()))
    monkeypatch.setattr(vector_index, "PACKED", 2_000)
    assert sorted(map(tuple, vector_index.nearest(index, queries, 2).collect())) == once


def test_query_finds_vectors_without_a_label(spark, save):
    from quernstone.jobs.queries import QUERIES

    rows = frame(spark, clouds(200, 6, 4)).withColumn("label", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 5).cast("int")).drop("kb_part")
    folder = save(embeddings=rows)
    found = sorted(map(tuple, QUERIES["vector_index_topk"](spark, folder).collect()))
    assert found == sorted(map(tuple, QUERIES["vector_topk"](spark, folder).collect())) and len(found) == 100
    assert QUERIES["vector_index_contents"](spark, folder).count() == rows.where("label <> 3").count()


def test_graph_reaches_everything():
    rng = np.random.default_rng(3)
    x = np.concatenate([vector_index._units(rng.normal(size=(300, 5)) * 0.01 + c) for c in rng.normal(size=(6, 5)) * 5])
    links, pivots = vector_index.graph(x)
    seen, todo = set(pivots.tolist()), pivots.tolist()
    while todo:
        for b in links[todo.pop()]:
            if b >= 0 and b not in seen:
                seen.add(int(b))
                todo.append(int(b))
    assert len(seen) == len(x)
