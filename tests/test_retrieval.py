import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.jobs.queries import QUERIES
from quernstone.operators import clusters, retrieval, trigrams
from quernstone.sources.tables import documents, inline, table


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "red apple pie with apples", "en"), (2, "green pear cake", "en"), (3, "apple apple apple", "de"), (4, "", "en"), (5, "red apple pie with apples", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    return docs, spark.createDataFrame([(0, "apple pie")], "query_id long, text string")


def ids(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def test_topk_is_a_prefix(corpus):
    docs, asked = corpus
    assert ids(retrieval.query(docs, asked, 2)) == ids(retrieval.query(docs, asked, 3))[:2]


def test_ties_go_to_the_smaller_id(corpus):
    docs, asked = corpus
    found = ids(retrieval.query(docs, asked, 5))
    assert found.index(1) + 1 == found.index(5)


def test_weight_zero_is_the_vector_score(corpus):
    docs, asked = corpus
    for r in retrieval.query(docs, asked, 5, keyword_weight=0.0).collect():
        assert r["score"] == r["vector_score"]


def test_higher_threshold_gives_a_subset(corpus):
    docs, asked = corpus
    low, high = set(ids(retrieval.query(docs, asked, 5, min_score=0.1))), set(ids(retrieval.query(docs, asked, 5, min_score=0.99)))
    assert high < low


def test_filters(corpus):
    docs, asked = corpus
    assert ids(retrieval.query(docs, asked, 5, where={"field": "lang", "op": "=", "value": "de"})) == [3]
    spec = {"or": [{"field": "doc_id", "op": "in", "value": [2]}, {"and": [{"field": "doc_id", "op": ">=", "value": 5}, {"field": "lang", "op": "exists"}]}]}
    assert {r["doc_id"] for r in docs.where(retrieval.compile_filter(spec, docs.columns)).collect()} == {2, 5}
    with pytest.raises(ValueError):
        retrieval.compile_filter({"field": "nothing", "op": "=", "value": 1}, docs.columns)
    with pytest.raises(ValueError):
        retrieval.compile_filter({"field": "lang", "op": "~", "value": 1}, docs.columns)


def test_content_only_on_request(corpus):
    docs, asked = corpus
    assert "content" not in retrieval.query(docs, asked, 1).columns
    assert retrieval.query(docs, asked, 1, include_content=True).first()["content"]


def test_excluded_rows_never_match(corpus):
    docs, asked = corpus
    assert 3 not in ids(retrieval.query(docs.withColumn("included", F.col("doc_id") != 3), asked, 5))


def test_unknown_mode(corpus):
    with pytest.raises(ValueError):
        retrieval.query(*corpus, mode="other")


def test_vectors_with_zero_and_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)] + [(9, [0.0, 0.0])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id in (0, 9)").withColumnRenamed("vec_id", "query_id")
    for packed in (0, 10**6):
        found = retrieval.vector_topk(rows, asked, 3, size=2, packed=packed).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 0, 1.0), (0, 3, 1.0), (0, 6, 1.0)]


def test_clusters_in_blocks_and_packed(spark):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)], i % 4) for i in range(60)], "vec_id long, embedding array<double>, cluster_id int")
    asked = rows.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), "embedding")
    allowed = spark.createDataFrame([(q, c) for q in range(6) for c in (q % 4, (q + 1) % 4)], "query_id long, cluster_id int")
    one, two = (sorted(map(tuple, retrieval.vector_topk(rows, asked, 7, size=5, packed=p, allowed=allowed).collect())) for p in (0, 10**6))
    assert one == two and len(one) == 42 and all(r[2] % 4 in (r[0] % 4, (r[0] + 1) % 4) for r in one)


def test_all_clusters_is_no_pruning(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    centroids = clusters.centroids_of(rows, "label")
    asked = rows.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert clusters.nearest_clusters(asked, centroids, 99).count() == centroids.count()


def test_training_trigger():
    assert clusters.needs_training(120, 100) and not clusters.needs_training(119, 100) and not clusters.needs_training(0, 0)


def test_usage_and_inline(spark, corpus):
    docs, asked = corpus
    row = retrieval.usage(docs, retrieval.query(docs, asked, 2)).first()
    assert (row["scanned"], row["returned"]) == (5, 2)
    made = inline(spark, [{"doc_id": 1, "filename": "a.txt", "text": "x"}])
    assert made.first()["tags"] is None and made.count() == 1



def test_fixture_queries(spark):
    from pathlib import Path

    from quernstone.jobs.fixtures import known_answers
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    asked = known_answers(spark, folder).cache()
    assert asked.count() == 10
    top = retrieval.keyword_matches(documents(spark, folder), asked, 5).join(asked.select("query_id", "holders"), "query_id")
    assert top.where(F.array_contains("holders", F.col("doc_id"))).select("query_id").distinct().count() == 10


def test_hybrid_query_asks_every_item(spark, save):
    rows = [(i, f"text number{i} of words") for i in (1, 2, 19, 20, 21, 40)]
    folder = save(
        documents=spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"),
        benchmark=spark.createDataFrame([*rows, (None, "words")], "item_id long, text string"),
    )
    first = QUERIES["hybrid_query"](spark, folder).where("rank = 1").collect()
    assert sorted((r["query_id"], r["doc_id"]) for r in first) == [(i, i) for i, _ in rows]


def cloud(spark, n, clusters_of, spread):
    import numpy as np

    rng = np.random.default_rng(n)
    x = rng.normal(size=(clusters_of, 64))[rng.integers(clusters_of, size=n)] + spread * rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4).cache()


@pytest.mark.parametrize("block", [2_000, 150])
@pytest.mark.parametrize("n, clusters_of, spread, hashed", [(1_500, 1, 9.0, False), (6_000, 600, 0.3, True)])
def test_lsh_recall_against_all_pairs(spark, monkeypatch, n, clusters_of, spread, hashed, block):
    plans = []
    plan = clusters.lsh_plan
    monkeypatch.setattr(clusters, "LSH_BLOCK", block)
    monkeypatch.setattr(clusters, "lsh_plan", lambda *a: plans.append(plan(*a)) or plans[-1])
    vectors = cloud(spark, n, clusters_of, spread)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    want, found = pairs(retrieval.vector_topk(vectors, asked, 10)), pairs(clusters.lsh_topk(vectors, asked, 10))
    assert len(want & found) >= 0.9 * len(want) and len(found) <= len(want)
    assert (plans[0][0] > 0) == hashed


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc, java = spark.sparkContext._jsc.sc(), spark._jvm.java.util
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(java.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), java.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.length()))


def test_lsh_shuffles_no_vectors(spark, monkeypatch):
    vectors = cloud(spark, 6_000, 600, 0.3)
    vectors.count()
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    before = shuffled(spark)
    once = sorted(map(tuple, clusters.lsh_topk(vectors, asked, 10).collect()))
    assert len(once) > 1_000 and shuffled(spark) - before < 6_000 * 64 * 8 / 4
    monkeypatch.setattr(clusters, "LSH_PACKED", 100_000)  # further passes
    assert sorted(map(tuple, clusters.lsh_topk(vectors, asked, 10).collect())) == once


def test_lsh_odd_rows(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(40, [0.0, 1.0]), (41, None), (42, [float("nan"), 1.0]), (43, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [float("nan"), 0.0]), (9, None)], "query_id long, embedding array<double>")
    assert sorted(map(tuple, clusters.lsh_topk(vectors, asked, 4).collect())) == [(7, i, 0.0, i + 1) for i in range(4)]
    found = clusters.lsh_topk(vectors, asked, 40).where("rank > 29")
    assert sorted(map(tuple, found.collect())) == [(7, 29, 0.0, 30), (7, 40, 1.414214, 31)]  # the opposite one is not within the radius
    assert clusters.lsh_topk(vectors, asked.limit(0), 4).count() == clusters.lsh_topk(vectors.limit(0), asked, 4).count() == 0


@pytest.mark.parametrize("held", [50, 1_000_000])
def test_nearest_of_buckets_against_all_pairs(monkeypatch, held):
    import numpy as np

    rng = np.random.default_rng(4)
    monkeypatch.setattr(clusters, "LSH_HELD", held)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # many ties and copies
    q, ids = x[:40], rng.permutation(300)
    best = clusters._Nearest(q, 5, 2.0)
    for _ in range(2):  # as from two tables
        for part in (np.arange(150), np.arange(150, 300)):
            best.meet(ids[part], x[part], [(0, 70, np.arange(40)), (70, 150, np.arange(40))])
    best.drop()
    far = np.round(np.sqrt(((x[None] - q[:, None]) ** 2).sum(2)), 6)
    want = [(i, ids[j], far[i, j]) for i in range(40) for j in np.lexsort((ids, far[i]))[:5] if far[i, j] < 2]
    assert sorted(zip(*(c.tolist() for c in best.kept))) == sorted(want)


def test_projection_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = np.array([r["projected"] for r in clusters.project(rows, "vec_id").orderBy("vec_id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ axes[:2].T
    assert np.allclose(np.abs(found), np.abs(want), atol=1e-6)


def test_nested_filters(spark):
    rows = [
        (1, '{"n": 5, "s": "five", "l": [1, "x", 2.5], "d": {"e": [{"f": true}]}}'), (2, '{"n": 5.5, "s": 5, "l": []}'), (3, '{"n": "5", "l": "text with x"}'),
        (4, '{"n": null}'), (5, None), (6, "no json"), (7, '{"n": 9007199254740993, "d": {"e": []}}'), (8, '{"n": 9007199254740992}'),
    ]
    df = spark.createDataFrame(rows, "id int, json string").select("id", F.try_parse_json("json").alias("m"))

    def kept(spec):
        return [r["id"] for r in retrieval.filtered(df, where=spec).orderBy("id").collect()]

    def one(path, op, value):
        return kept({"field": f"m{path}", "op": op, "value": value})

    assert one(".n", "=", 5) == [1] and one(".n", ">", 5) == [2, 7, 8] and one(".n", "<=", 5.5) == [1, 2]
    assert one(".n", "=", 9007199254740993) == [7]
    assert one(".n", "=", "5") == [3] and one(".s", "<>", "five") == [] and one(".s", "in", ["five", 5]) == [1, 2] and one(".s", "in", []) == []
    assert one(".l", "contains", "x") == [1, 3] and one(".l", "contains", 2.5) == [1] and one(".l", "contains", 7) == []
    assert one(".d.e[0].f", "=", True) == [1] and one(".d.e[0]", "exists", True) == [1] and one(".n", "exists", False) == [4, 5, 6]
    assert kept({"not": {"field": "m.n", "op": ">", "value": 5}}) == [1]  # neither a text nor what is missing
    with pytest.raises(ValueError):
        one(".n; drop", "=", 1)
    with pytest.raises(ValueError):
        one(".n", "like", 1)


def test_trigrams_are_counted_in_parts_of_bounded_size(monkeypatch):
    texts = ["", "ab", "hello world", "größe " * 40, "x" * 103, "abc"]
    whole, sizes, plain = trigrams.bucket_counts(texts, 32), [], trigrams._counts
    monkeypatch.setattr(trigrams, "CHARS", 50)
    monkeypatch.setattr(trigrams, "_counts", lambda held, n: sizes.append(sum(map(len, held))) or plain(held, n))
    assert (trigrams.bucket_counts(texts, 32) == whole).all() and whole.sum() == 9 + 238 + 101 + 1
    assert max(sizes) < 2 * 50 + 4 and len(sizes) > 5


def test_a_task_holds_the_best_matches_only(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"word{i % 7} common text {i % 13}") for i in range(400)], "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "word3 common"), (2, "text 5")], "query_id long, text string")
    once = sorted(map(tuple, retrieval.scored(rows, queries, {"hybrid": 4, "vector": 3}).drop("rank").collect()))
    assert len(once) == 14
    found = [(np.array([0, 1, 0, 0]), np.array([7, 1, 5, 3], object), np.array([0.5, 0.1, 0.5, 0.9]))]
    q, ids, score = retrieval._best_matches(found, 2)
    assert list(zip(q, ids, score)) == [(0, 3, 0.9), (0, 5, 0.5), (1, 1, 0.1)]
    monkeypatch.setattr(retrieval, "HELD", 3)
    assert sorted(map(tuple, retrieval.scored(rows, queries, {"hybrid": 4, "vector": 3}).drop("rank").collect())) == once


def test_a_task_holds_k_rows_of_each_query(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 4)), np.ones((40, 4)), np.zeros((3, 4))])
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    queries = rows.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = {}
    for r in retrieval.vector_topk(rows, queries, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    f = x.astype(np.float32).astype(float)
    unit = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-300)
    for query in range(0, 340, 3):
        score = np.round(unit[:340] @ unit[query], 6)
        order = np.lexsort((np.arange(340), -score))[:4]
        assert [(n, i) for n, i, _ in sorted(got[query])] == [(n + 1, int(i)) for n, i in enumerate(order)]
    assert 342 not in got
