import os
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"

from quernstone.llm import packing, tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [e.ids for e in tokens.encoder(PATH).tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]


@given(st.lists(st.text(alphabet=st.sampled_from(list("'strevmlld SaZé1²!-\n\t\x1c 世😀_")), max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(texts):
    assert [x.tolist() for x in tokens.encoder(PATH).encode(texts)] == library(texts)


def test_full_tables_start_anew(monkeypatch):
    own = tokens.Encoder(PATH)
    monkeypatch.setattr(tokens, "MOST", 40)
    texts = [f"word{i} and w{i * 7}" for i in range(30)]
    for a in range(0, 30, 3):
        assert [x.tolist() for x in own.encode(texts[a : a + 3])] == library(texts[a : a + 3])


def check(rows, texts):
    """Every id lies in exactly one piece, pieces fill their sequences without gaps."""
    ids = {i: [*x, 1] for i, x in zip(texts, library(texts.values()))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[doc])
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[doc][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    return by_sequence


def corpus(n, seed):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 1500))) for i in range(n)}


@pytest.mark.parametrize("shard", [1_500_000, 5_000])
def test_pieces(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_TOKENS", shard)
    texts = corpus(80, 1)
    found = check(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect(), texts)
    assert sum(sum(r["length"] for r in p) < packing.WINDOW for p in found.values()) <= 1


def test_neighbours_by_score():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3, 900, 901], [1, 2, 3, 4], [900, 901, 5], [6, 7])]
    idf = np.ones(1 << 16)
    idf[[900, 901]] = 5
    shard = packing.Shard(docs, idf, 4.0)
    shard.used[0] = True
    assert list(shard.neighbours(0)) == [2, 1]
    shard.used[2] = True
    assert list(shard.neighbours(0)) == [1]


def test_neighbours_against_brute_force():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(1, 60)).clip(0, 300).astype(np.uint16) for _ in range(150)]
    docs += [docs[5].copy(), docs[5].copy()]  # ties go to the first
    n, mean = len(docs), np.mean([len(d) for d in docs])
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def score(seed, doc):
        out = 0.0
        for t in np.unique(docs[seed]):
            tf = (docs[doc] == t).sum()
            out += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[doc]) / mean))
        return out

    shard = packing.Shard(docs, idf, mean)
    for seed in range(0, n, 7):
        shard.used[:] = False
        shard.used[[seed, (seed + 3) % n]] = True
        scores = {d: score(seed, d) for d in range(n) if not shard.used[d]}
        found = list(shard.neighbours(seed))
        assert sorted(found) == sorted(d for d, s in scores.items() if s > 0)
        got = [scores[d] for d in found]
        assert np.allclose(got, sorted(got, reverse=True), atol=1e-3)
        assert all(a < b for a, b in zip(found, found[1:]) if docs[a].tolist() == docs[b].tolist())


def test_windows_are_filled_from_their_seed():
    """With many small documents of two kinds, a seed's window takes its own kind as long as there is any."""
    docs = [np.array([k * 10, k * 10 + 1, 100 + i], np.uint16) for i in range(40) for k in (1, 2)]
    shard = packing.Shard(docs, np.ones(1 << 16), 3.0)
    walk = shard.order()
    order = [next(walk)]
    try:
        while True:
            order.append(walk.send(False))
    except StopIteration:
        pass
    assert sorted(order) == list(range(80)) and [d % 2 for d in order] == [0] * 40 + [1] * 40


def test_odd_rows(odd):
    df = odd(["a b c", "same", "same"])
    rows = packing.pack(df, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in library([r["text"] or "" for r in df.collect()]))
    assert {r["doc_id"] for r in rows} == set(texts)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_very_long_text(spark):
    texts = {0: "long words of a text " * 60_000, 1: "x", 2: "long words " * 300}
    check(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect(), texts)
