import random
import re

import pytest

from quernstone.llm import ngram_join as nj

UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), least.get(find(a))) for a, (i, s) in enumerate(sets)), key=str)


def corpus(seed):
    """Copies, edited copies of several strengths, chains of edits, shared passages, short texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    for _ in range(120):
        words = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            at = rng.randrange(len(words) + 1)
            words[at : at + 1] = rng.choice([[word()], [], [word(), word()]])
        if rng.random() < 0.2:
            words += passage.split()
        texts.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    texts += ["", "one", "One", "one two", "a b c d", "a b c d e", " a  b\tc\nd e ", "ONE TWO"]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,chunk", [(1, 64), (2, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(nj, "CHUNK", chunk)
    rows = corpus(seed)
    found = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(11)]  # 7 shingles; one word more at the end adds one: 7 of 8
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "x", "y"])), (4, " ".join([*base, "x", "y", "z"]))]
    found = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_large_groups(spark):
    """A group of near copies larger than several chunks, and a passage that others share."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(200):
        words = list(base)
        words[rng.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join([*base[:12], *[f"o{i}x{j}" for j in range(40)]])) for i in range(100)]
    found = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_odd_rows(odd):
    df = odd(["a b c d e f g", "a b c d e f g"])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = nj.link_documents(df).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert nj.link_documents(df.limit(0)).count() == 0
    kept = nj.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 900, 901, 902, 903, 904, None], key=str)


def test_words_are_split_on_bytes_only():
    import pyarrow as pa

    texts = ["é x y a b c d", None, "", "x" * 70, "A\x0bB\x1cC d e f"]
    assert [len(s) for s in nj.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    assert [len(s) for s in nj.shingle_sets(pa.array(texts).slice(3))] == [len(shingles(t)) for t in texts[3:]]


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    other = list(words)
    for at in range(0, len(other), 60):
        other[at] = "x"
    half = words[:75_000] + [f"y{i}" for i in range(75_000)]
    rows = [(7, " ".join(words)), (3, " ".join(other)), (5, " ".join(half)), (9, "z" * 2_000_000)]
    found = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_salted_tokens_give_the_same(spark, monkeypatch):
    """Slots of more than two tokens are salted: what the holders of a token have in common is found over the salts."""
    monkeypatch.setattr(nj, "salting", lambda tokens, partitions: 2)
    rows = corpus(4)[:110]
    rows += [(1_000 + i, rows[3][1] + f" own{i}") for i in range(25)]
    found = nj.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
