import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def tables(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    docs = [(i, text(rng.randrange(60, 300))) for i in range(300)]
    docs += [(300 + i, " ".join(w.upper() + "!!" for w in text(120).split())) for i in range(100)]
    docs += [(400, docs[5][1]), (401, docs[6][1] + " " + word())]
    docs += [(402, f"{text(60)} {item.upper()} {text(50)}"), (403, f"{text(60)} token = {hashlib.sha1(b'x').hexdigest()} {text(20)}")]
    labels = [(i, int(i < 300), 0) for i in range(400) if i % 4]
    frame = spark.createDataFrame([(i, t, "xx", f"src{i % 3}", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    return dict(docs), {"documents": frame, "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"), "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}


def test_stages(spark, save):
    texts, made = tables(spark)
    folder = save(**made)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder), name)
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == made["documents"].columns
        if name == "secrets":
            hidden = {r["doc_id"]: r["text"] for r in docs.collect()}
    good, single, clean, safe, packed = left
    assert len([i for i in range(300, 400) if i not in good]) >= 97 and len([i for i in range(300) if i in good]) >= 295
    assert good - single == {400, 401} & good
    assert single - clean == {402} & single
    assert safe == clean == packed
    assert hashlib.sha1(b"x").hexdigest() not in hidden[403] and all(hidden[i] == texts[i] for i in hidden if i != 403)


def test_run_is_all_stages(spark, save):
    _, made = tables(spark)
    folder = save(**made)
    found = corpus_pipeline.run(spark, folder)
    assert found.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and found.count() >= 290
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_odd_rows(spark, save, odd):
    """Nulls, empty texts, repeated and missing ids, clashing columns, a very long text; then tables without rows."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    docs = odd([text(80) for _ in range(40)] + [text(60_000)])
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, text(30)), (2, None), (None, "")], "item_id long, text string")
    folder = save(documents=docs, labels=labels, benchmark=bench)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        now = corpus_pipeline.cut(stage(spark, now, folder), name)
        assert name == "packing" or now.columns == columns
    assert now.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_no_rows(spark, save):
    _, made = tables(spark)
    folder = save(**{name: df.limit(0) for name, df in made.items()})
    assert corpus_pipeline.run(spark, folder).collect() == []
