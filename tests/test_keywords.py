import math
import random
from collections import Counter

import pytest

import pyarrow as pa
from quernstone.operators import keywords


def brute(texts, most):
    bags = {k: Counter(w for w in (t or "").split(" ") if w) for k, t in texts}
    df = Counter(w for bag in bags.values() for w in bag)
    best = {}
    for k, bag in bags.items():
        scored = sorted((-round(tf * math.log(len(texts) / df[w]), 6), w, tf) for w, tf in bag.items())
        best[k] = [(w, tf, -s) for s, w, tf in scored[:most]]
    return best


@pytest.mark.parametrize("frequent", [1, 3, 20_000])
def test_best_words_whatever_the_tasks_know(spark, monkeypatch, frequent):
    monkeypatch.setattr(keywords, "FREQUENT", frequent)
    draw = random.Random(frequent)
    vocabulary = [f"w{i}" for i in range(40)] + ["x" * 80, "y" * 90]
    weights = [1 / (i + 1) for i in range(40)] + [0.5, 0.02]
    texts = [(i, " ".join(draw.choices(vocabulary, weights, k=draw.randrange(1, 60)))) for i in range(120)]
    texts += [(200, None), (201, ""), (202, "only"), (203, "b a b a c"), (204, "w0 " * 5000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {}
    for r in keywords.tfidf(df.repartition(3), 4).orderBy("doc_id", "rank").collect():
        found.setdefault(r["doc_id"], []).append((r["keyword"], r["tf"], r["score"]))
    want = {k: v for k, v in brute(texts, 4).items() if v}
    assert {k: [(w, tf) for w, tf, _ in v] for k, v in found.items()} == {k: [(w, tf) for w, tf, _ in v] for k, v in want.items()}
    assert all(abs(a[2] - b[2]) < 1e-6 for k in want for a, b in zip(found[k], want[k]))


def test_no_documents(spark):
    assert keywords.tfidf(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0


def test_words_are_taken_in_parts_of_bounded_size():
    rows = [["a"] * n for n in (3, 0, 2, 9, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "words"])
    parts = list(keywords._by_words(batch.slice(0), 5))
    assert [p["doc_id"].to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
    assert [p["doc_id"].to_pylist() for p in keywords._by_words(batch.slice(2, 3), 5)] == [[2], [3], [4]]


def test_chunks_meet_their_documents_keywords_without_counting_other_words(spark):
    docs = spark.createDataFrame([(1, "k", "p", "one two one\nTWO three"), (2, "k", "p", "one"), (3, "k", "p", None)], "doc_id long, kb_id string, kb_part string, text string")
    found = spark.createDataFrame([(1, "one"), (1, "two"), (3, "x")], "doc_id long, keyword string")
    made = keywords.of_chunks(docs, found, "line")
    assert sorted(map(tuple, made.collect())) == [(1, "1:0", "one", 2), (1, "1:0", "two", 1), (1, "1:1", "two", 1)]
    assert "LeftSemi" not in made._jdf.queryExecution().toString()
