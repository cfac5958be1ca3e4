import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import sharding
from quernstone.llm.sharding import differencing, shard_documents


@given(st.lists(st.lists(st.integers(0, 50), min_size=3, max_size=3), min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_differencing_places_every_part(parts):
    sums, went = differencing(parts)
    for one in went:
        assert sorted(one) == [0, 1, 2]
    assert sums == [sum(p[j] for p, w in zip(parts, went) for j in range(3) if w[j] == shard) for shard in range(3)]


def test_differencing_known():
    sums, _ = differencing([[n, 0] for n in (8, 7, 6, 5, 4)])
    assert sorted(sums) == [14, 16]  # the textbook example: one off the optimum of 15


def check(rows, texts, shards=8):
    assert sorted(r["slot"] for r in rows if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in rows)))
    for s in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    for r in rows:
        text = texts.get(r["doc_id"], "")
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())


def test_documents(spark):
    texts = {i: "x" * (i % 97) + str(i % 450) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = shard_documents(df).collect()
    assert len(rows) == 600
    check(rows, texts)
    groups = {}
    for r in rows:
        assert groups.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 10


def test_levels_agree_with_sizes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PER_BUCKET", 10)
    monkeypatch.setattr(sharding, "FAN", 3)
    texts = {i: "y" * (i % 31) + str(i) for i in range(300)}
    rows = shard_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check(rows, texts)
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(sums) - min(sums) <= 30


def test_odd_rows(odd):
    df = odd(["a", "b", "a"])
    rows = shard_documents(df).collect()
    assert len(rows) == df.count()
    assert {r["size"] for r in rows if r["doc_id"] in (900, 901)} == {1}
    assert len({r["shard"] for r in rows if r["doc_id"] == 903}) == 1
    assert shard_documents(df.limit(0)).count() == 0


def best_spread(sizes, k):
    """The smallest spread over all ways to deal the sizes."""
    import itertools

    best = None
    for way in itertools.product(range(k), repeat=len(sizes) - 1):
        sums = [0] * k
        sums[0] += sizes[0]
        for size, shard in zip(sizes[1:], way):
            sums[shard] += size
        spread = max(sums) - min(sums)
        best = spread if best is None else min(best, spread)
    return best


def test_against_the_optimum_and_greedy():
    import random

    rng = random.Random(2)
    near = beaten = 0
    for _ in range(60):
        k, n = rng.choice([2, 3]), rng.randrange(4, 9)
        sizes = sorted((rng.randrange(1, 200) for _ in range(n)), reverse=True)
        sums, went = sharding.differencing([[s] + [0] * (k - 1) for s in sizes])
        own = [sum(s for s, w in zip(sizes, went) if w[0] == j) for j in range(k)]
        assert sorted(own) == sorted(sums)
        greedy = [0] * k
        for s in sizes:
            greedy[greedy.index(min(greedy))] += s
        spread, least = max(sums) - min(sums), best_spread(sizes, k)
        assert spread >= least
        near += spread - least <= sizes[-1]
        beaten += spread <= max(greedy) - min(greedy)
    assert near >= 50 and beaten >= 50


def test_very_long_text_and_many_copies(spark):
    texts = {i: "copy of a text" for i in range(300)} | {1_000: "y" * 5_000_000} | {2_000 + i: f"small {i}" for i in range(100)}
    rows = shard_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    check(rows, texts)
    assert len({r["shard"] for r in rows if r["doc_id"] < 300}) == 1 and len(rows) == len(texts)
