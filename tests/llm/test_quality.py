import random
import zlib

import numpy as np
import pytest

from quernstone.llm import quality


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 400))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w for w in words[:5] for _ in range(40)], [w + "###" for w in words]])
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(500, 1)
    found = quality.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in found)


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(150, 2)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one, two = (sorted(map(tuple, quality.classify(frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())) for x in (labels, flipped))
    assert one == two


def test_gradient():
    rng = np.random.default_rng(0)
    model = quality.Attention()
    x, counts, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0, 1])
    loss = lambda: (np.logaddexp(0, model.forward(x, counts)[0]) - y * model.forward(x, counts)[0]).sum()
    logit, kept = model.forward(x, counts)
    for name, g in model.backward(kept, 1 / (1 + np.exp(-logit)) - y).items():
        for _ in range(5):
            at = tuple(rng.integers(s) for s in model.w[name].shape)
            old = model.w[name][at]
            model.w[name][at] = old + 1e-6
            up = loss()
            model.w[name][at] = old - 1e-6
            down = loss()
            model.w[name][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6), name


def test_attention_beats_the_mean():
    """Bags of many passages of which a marked one tells: attention finds it, plain averaging drowns it."""
    rng = np.random.default_rng(7)
    bags, labels = [], rng.integers(0, 2, 900).astype(float)
    for y in labels:
        x = rng.normal(0, 0.1, (rng.integers(8, 16), quality.N_FEATURES))
        x[:, 1:6] = rng.choice([-1.0, 1.0], len(x))[:, None]
        at = rng.integers(len(x))
        x[at, 6:14], x[at, 1:6] = 2.0, 2 * y - 1
        bags.append(x.astype(np.float32))
    right = {}
    for attend in (True, False):
        model = quality.Attention(attend=attend).fit(bags[:700], labels[:700])
        x = (np.concatenate(bags[700:]) - model.mean) / model.spread
        logit = model.forward(x, np.array(list(map(len, bags[700:]))))[0]
        right[attend] = ((logit > 0) == (labels[700:] == 1)).mean()
    assert right[True] >= 0.9 and right[True] >= right[False] + 0.1, right


def test_the_sample_is_bounded_by_passages(spark, monkeypatch):
    docs, labels = corpus(80, 3)
    docs += [(i, "x" * 50_000) for i in range(3)] * 4  # ids that repeat, with another text
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    fit = quality.Attention.fit
    monkeypatch.setattr(quality.Attention, "fit", lambda self, bags, y: seen.append(sum(map(len, bags))) or fit(self, bags, y, epochs=1))
    for most in (100_000, 60):
        monkeypatch.setattr(quality, "TRAIN_PASSAGES", most)
        quality.train(*frames)
    assert 0 < seen[1] <= 60 < seen[0]


def test_scores_do_not_depend_on_neighbours():
    model = quality.Attention()
    texts = ["", "short", "x " * 3000, "Ünï cödé " * 90, "\n\n", "A" * 801]
    together = model.score(texts)
    assert np.allclose(together, [model.score([t])[0] for t in texts])


def test_passages_cover_whole_texts():
    for n in (0, 1, 399, 400, 800, 1199, 1200, 5000):
        codes, starts, counts = quality.passages(["a" * n, "b" * 10])
        assert counts.sum() == len(starts) and starts[0] == 0 and len(codes) == n + 10
        assert starts[counts[0]] == n


def test_odd_rows(odd, spark):
    df = odd(["some text here", "other text"])
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(df, labels)
    assert found.count() == df.count() and found.where("score is null or held_out is null").count() == 0
    assert quality.classify(df, labels.limit(0)).select("score").distinct().collect()[0][0] == 1.0
    assert quality.classify(df.limit(0), labels).count() == 0
    assert quality.keep_good(df, labels.limit(0)).columns == df.columns and quality.keep_good(df, labels.limit(0)).count() == df.count()
