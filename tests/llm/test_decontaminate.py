import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import decontaminate as d

ITEM = "the quick brown fox jumps over the lazy dog and runs away from it all the time in summer"


def test_exact_case_and_space():
    index = d.Index([(7, ITEM)])
    for text in (ITEM, ITEM.upper(), f"aa {ITEM} bb", ITEM.replace(" ", " \n ")):
        [(item, start, end, cost)] = d.occurrences([text], index)[0]
        assert (item, cost) == (0, 0) and text[start:end].lower().split() == ITEM.split()


def test_partial_is_none():
    assert d.occurrences([ITEM[:60], "", "unrelated " * 40], d.Index([(7, ITEM)])) == [[], [], []]


def best(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@given(st.integers(0, 10**6), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_against_full_alignment(seed, changes):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcd efg") for _ in range(90)).strip()
    item = " ".join(item.split())
    text = list(item)
    for _ in range(changes):
        at = rng.randrange(len(text))
        text[at : at + 1] = rng.choice([[], ["z"], [text[at], "y"]])
    whole = " ".join(("start of it " + "".join(text) + " and its end").split())
    index = d.Index([(1, item)])
    want = best(item, whole)
    found = d.occurrences([whole], index)[0]
    if want <= index.k[0]:
        assert min(c for *_, c in found) == want
    else:
        assert not found


def every(item, text, k):
    """Occurrences by the full table: each end's fewest edits and latest start, then the best that don't overlap."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for c in item:
        new = [(row[0][0] + 1, row[0][1])]
        for j, t in enumerate(text, 1):
            new.append(min((row[j - 1][0] + (c != t), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    kept = []
    for cost, start, end in sorted((c, -s, e) for e, (c, s) in enumerate(row) if c <= k):
        if all(end <= s or e <= start for s, e, _ in kept):
            kept.append((start, end, cost))
    return sorted(kept)


def test_neighbouring_texts_beside_a_long_item():
    rng = random.Random(1)
    short, long = ("".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (60, 1000))
    found = d.occurrences([short, short, short + short], d.Index([(1, short), (2, long)]))
    assert found == [[(0, 0, 60, 0)], [(0, 0, 60, 0)], [(0, 0, 60, 0), (0, 60, 120, 0)]]


@given(st.integers(0, 10**6), st.sampled_from([25, 40, 60, 90]))
@settings(max_examples=12, deadline=None)
def test_short_and_long_items_against_full_tables(seed, size):
    rng = random.Random(seed)
    items = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (size, 400)]
    index = d.Index(list(enumerate(items)))
    texts = []
    for _ in range(4):
        pieces = []
        for _ in range(rng.randrange(4)):
            piece = list(items[rng.random() < 0.2])
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(piece))
                piece[at : at + 1] = rng.choice([[], ["z"], [piece[at], "y"]])
            pieces.append("".join(piece) + "w" * rng.choice([0, 0, 3]))
        texts.append("".join(pieces))
    for text, found in zip(texts, d.occurrences(texts, index)):
        for i, item in enumerate(items):
            assert sorted(f[1:] for f in found if f[0] == i) == every(item, text, index.k[i])


def test_windows_do_not_matter(monkeypatch):
    text = "filler words " * 30 + ITEM + " more words" * 30
    index = d.Index([(1, ITEM)])
    want = d.occurrences([text], index)
    monkeypatch.setattr(d, "WINDOW", 17)
    assert d.occurrences([text], index) == want and want[0]


def test_parts_of_items(spark, monkeypatch):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, "short"), (4, ITEM + " again")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {ITEM} again y"), (2, None)], "doc_id long, text string")
    want = {tuple(r) for r in d.contaminated(docs, items).collect()}
    assert {(r[0], r[1]) for r in want} == {(1, 1), (1, 4)}
    monkeypatch.setattr(d, "ITEM_CHARS", 50)
    assert {tuple(r) for r in d.contaminated(docs, items).collect()} == want


def test_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    df = odd([f"{ITEM}.", "clean"])
    kept = d.drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert d.drop_contaminated(df, items.limit(0)).count() == df.count()
    assert d.contaminated(df.limit(0), items).count() == 0


def test_very_long_text_and_equal_items():
    """Equal items are separate: each is found at every place."""
    rng = random.Random(3)
    filler = lambda: " ".join("".join(rng.choice("etaoinsh") for _ in range(6)) for _ in range(40_000))
    text = f" {ITEM} ".join(filler() for _ in range(4))
    found = d.occurrences([text, "x"], d.Index([(1, ITEM), (2, ITEM)]))
    assert [text[s:e] for item, s, e, _ in found[0] if item == 0] == [ITEM] * 3 == [text[s:e] for item, s, e, _ in found[0] if item == 1]
    assert len(found[0]) == 6 and not found[1]


def test_progressions():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        rows = sorted({(rng.randrange(3), rng.randrange(40) * rng.choice([1, 1, 100])) for _ in range(rng.randrange(30))})
        group, at = np.array([g for g, _ in rows], np.int64), np.array([x for _, x in rows], np.int64)
        first, step, times = d.progressions(group, at)
        back = [(int(group[f]), int(at[f] + s * i)) for f, s, n in zip(first, step, times) for i in range(n)]
        assert back == rows
    assert [x.tolist() for x in d.progressions(np.zeros(50, np.int64), np.arange(50) * 2)] == [[0, 49], [2, 1], [49, 1]]


def test_repeated_characters_take_little_memory():
    import time
    import tracemalloc

    rng = random.Random(2)
    side = lambda n: "".join(rng.choice("abcdefgh jklm") for _ in range(n))
    for text, item in (("=" * 200_000, side(260) + "=" * 480 + side(260)), ("=" * 400_000, side(500) + "=" * 1000 + side(500)), ("- " * 100_000, side(260) + "- " * 240 + side(260))):
        index = d.Index([(1, item)])
        began = time.time()
        assert d.occurrences([text, item], index)[0] == []
        assert time.time() - began < 20
        tracemalloc.start()
        assert len(d.occurrences([text[:50_000] + item], index)[0]) == 1
        assert tracemalloc.get_traced_memory()[1] < 300e6
        tracemalloc.stop()


@given(st.integers(0, 10**6))
@settings(max_examples=25, deadline=None)
def test_rules_and_repeats_against_full_tables(seed):
    rng = random.Random(seed)
    piece = lambda: rng.choice(["=" * rng.randrange(1, 60), "-=" * rng.randrange(1, 30), "abc" * rng.randrange(1, 15), "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))])
    items = ["".join(piece() for _ in range(rng.randrange(1, 5))) for _ in range(3)]
    index = d.Index(list(enumerate(items)))
    texts = ["".join(rng.choice([piece(), *items]) for _ in range(rng.randrange(1, 5))) for _ in range(3)]
    for text, found in zip(texts, d.occurrences(texts, index)):
        for at, item in enumerate(index.ids):
            assert sorted((s, e, c) for i, s, e, c in found if i == at) == every(items[item], text, int(index.k[at]))


def test_short_items_are_found_exactly(spark):
    rng = random.Random(3)
    items = ["a", "b ", "ab", "abc", "aaaaaaaaa", "abcabcab", "", "a b", "\u00e9a"]
    index = d.Index(list(enumerate(items)))
    for _ in range(30):
        text = " ".join("".join(rng.choice("aabc\u00e9 ") for _ in range(rng.randrange(60))).split())
        found = d.occurrences([text], index)[0]
        for at, item in enumerate(index.ids):
            want, start = [], 0
            while (start := text.find(items[item].strip(), start)) >= 0:
                want.append((start, start + len(items[item].strip()), 0))
                start = want[-1][1]
            assert sorted((s, e, c) for i, s, e, c in found if i == at) == want
    docs = spark.createDataFrame([(1, "xx abc xx"), (2, None), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "abc"), (2, ""), (3, None)], "item_id long, text string")
    assert [tuple(r) for r in d.contaminated(docs, bench).collect()] == [(1, 1, 3, 6, 0)]
    assert d.drop_contaminated(docs, bench).count() == 3 and d.drop_contaminated(docs, bench, shortest=1).count() == 2
