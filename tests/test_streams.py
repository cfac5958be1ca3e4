"""Streams with state and jobs that go on: deliveries, sweeps, urls, the dictionary, embedding in batches, the queue."""

import datetime as dt
import hashlib
import hmac
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.functions.keys import seal
from quernstone.functions.text import tokens
from quernstone.jobs.oracle import ORACLE_SQL
from quernstone.jobs.queries import QUERIES
from quernstone.operators import dictionary
from quernstone.operators.trigrams import TrigramEmbedder
from quernstone.sources import urls
from quernstone.operators.embedding import EndpointRegistry
from quernstone.streaming import delivery, embedding, events, ingest, sweep
from quernstone.streaming.worker import EVENTS, STATUS, TIGHT, Worker

T = dt.datetime(2024, 1, 1, 12)


# deliveries


def hooks_of(spark, names):
    keys = spark.sql("SELECT unhex('000102030405060708090a0b0c0d0e0f') AS key")
    rows = spark.createDataFrame([(n, f"https://x.example/{n}", ["document.ingested"], f"s-{n}") for n in names], "id string, url string, events array<string>, secret string")
    return keys, rows.crossJoin(keys).withColumn("secret_ciphertext", seal(F.col("secret"), F.col("key"))).drop("secret", "key")


def stream_of(spark, path):
    return spark.readStream.schema("event_id string, event_type string, payload string").parquet(path)


def put(spark, path, ids):
    spark.createDataFrame([(i, "document.ingested", f"body {i}") for i in ids], "event_id string, event_type string, payload string").coalesce(1).write.mode("append").parquet(path)


def test_each_hook_signs_with_its_secret(spark):
    keys, hooks = hooks_of(spark, ["a", "b"])
    rows = spark.createDataFrame([("e1", "document.ingested", "body"), ("e2", "document.failed", "x"), ("e3", "document.ingested", None)], "event_id string, event_type string, payload string")
    due = delivery.signed(rows, hooks, keys)
    got = {(r["webhook_id"], r["event_id"]): r["signature"] for r in due.collect()}
    assert got[("a", "e1")] == "sha256=" + hmac.new(b"s-a", b"body", hashlib.sha256).hexdigest()
    assert got[("b", "e1")] != got[("a", "e1")] and len(got) == 4
    assert "s-a" not in due._jdf.queryExecution().toString()


def test_waits_double_and_a_restart_repeats_nothing(spark, tmp_path):
    log, place = tmp_path / "log", f"{tmp_path}/in"
    log.mkdir()

    def send(url, body, headers):
        name = f"{url[-1]}-{headers['x-event-id']}-{headers['x-attempt']}"
        (log / f"{name}-{time.time_ns()}").touch()
        assert headers["x-signature"] == "sha256=" + hmac.new(f"s-{url[-1]}".encode(), body.encode(), hashlib.sha256).hexdigest()
        attempt = int(headers["x-attempt"])
        return "refused" if headers["x-event-id"] == "never" or headers["x-event-id"] == "late" and attempt < 3 else None

    def run(settled):
        keys, hooks = hooks_of(spark, ["a", "b"])
        stream = delivery.start(delivery.signed(stream_of(spark, place), hooks, keys), f"{tmp_path}/ledger", f"{tmp_path}/state", send, first_ms=1500, most=4, slots=2)
        if settled:
            delivery.settle(stream, spark, f"{tmp_path}/ledger", 120)
            return
        while stream.lastProgress is None and stream.isActive:
            time.sleep(0.1)
        stream.stop()

    put(spark, place, ["now", "late", "never", "late"])
    run(False)  # stopped after the first batch, while deliveries wait
    first = {(r["webhook_id"], r["event_id"]) for r in delivery.ledger(spark, f"{tmp_path}/ledger").where("status = 'delivered'").collect()}
    assert first == {("a", "now"), ("b", "now")}
    put(spark, place, ["more"])
    run(True)
    rows = [r.asDict() for r in delivery.ledger(spark, f"{tmp_path}/ledger").collect()]
    for hook in "ab":
        mine = {e: sorted((r["attempts"], r["status"], r["wait_ms"]) for r in rows if (r["webhook_id"], r["event_id"]) == (hook, e)) for e in ("now", "more", "late", "never")}
        assert mine["now"] == mine["more"] == [(1, "delivered", None)]
        assert mine["late"] == [(1, "retry", 1500), (2, "retry", 3000), (3, "delivered", None)]
        assert mine["never"] == [(1, "retry", 1500), (2, "retry", 3000), (3, "retry", 6000), (4, "failed", None)]
        at = sorted(r["created_at"] for r in rows if (r["webhook_id"], r["event_id"]) == (hook, "never"))
        assert all((b - a).total_seconds() >= wait for a, b, wait in zip(at, at[1:], (1.5, 3, 6)))
    sent = [p.name.rsplit("-", 1)[0] for p in log.iterdir()]
    assert sent.count("a-now-1") == sent.count("b-now-1") == 1 and len(sent) == len(set(sent)) == len(rows)


def test_long_secrets_sign_as_hmac_does(spark):
    keys, hooks = hooks_of(spark, ["ä", "x" * 90])
    rows = spark.createDataFrame([("e1", "document.ingested", "grüße")], "event_id string, event_type string, payload string")
    got = {r["webhook_id"]: r["signature"] for r in delivery.signed(rows, hooks, keys).collect()}
    assert got == {n: "sha256=" + hmac.new(f"s-{n}".encode(), "grüße".encode(), hashlib.sha256).hexdigest() for n in ("ä", "x" * 90)}


def test_settling_takes_longer_than_its_patience(spark, tmp_path):
    """Waits of 0.4 + 0.8 + 1.6 s and a patience of 2.5 s; deliveries that wait are many values of the state."""
    keys, hooks = hooks_of(spark, ["a"])
    put(spark, f"{tmp_path}/in", [f"e{i}" for i in range(1000)])

    def send(url, body, headers):
        return "refused" if headers["x-event-id"] != "e7" else None

    stream = delivery.start(delivery.signed(stream_of(spark, f"{tmp_path}/in"), hooks, keys), f"{tmp_path}/ledger", f"{tmp_path}/state", send, first_ms=400, most=4, slots=1)
    delivery.settle(stream, spark, f"{tmp_path}/ledger", 2.5)
    got = {(r["attempts"], r["status"]): r["count"] for r in delivery.ledger(spark, f"{tmp_path}/ledger").groupBy("attempts", "status").count().collect()}
    assert got == {(1, "delivered"): 1, (1, "retry"): 999, (2, "retry"): 999, (3, "retry"): 999, (4, "failed"): 999}


def test_deliveries_reach_the_state_packed(spark):
    """A row of the state's input holds many deliveries of one webhook, url and slot, and none is lost."""
    rows = [(h, f"e{i}", f"https://x.example/{h}/{i % 2}", f"body {i}", f"s{i}") for i in range(2_000) for h in ("a", "b")] + [(None, "e1", None, None, "s")]
    due = spark.createDataFrame(rows, "webhook_id string, event_id string, url string, payload string, signature string").repartition(2)
    made = delivery.packs(due, 3).cache()
    assert made.count() < len(rows) / 8 and made.where(F.size("event_id") > delivery.PACKED).isEmpty()
    each = made.select("webhook_id", "url", "slot", F.explode(F.arrays_zip("event_id", "payload", "signature")).alias("d"))
    assert sorted(map(str, each.select("webhook_id", "d.event_id", "url", "d.payload", "d.signature").collect())) == sorted(map(str, due.collect()))
    assert each.where(F.col("slot") != F.pmod(F.xxhash64("d.event_id"), F.lit(3))).isEmpty()


def test_signing_is_spread_over_tasks(spark):
    """Events of one file and one type are signed by all tasks, not by those of the file or the type."""
    keys, hooks = hooks_of(spark, ["a", "b"])
    rows = spark.range(1_000).coalesce(1).select(F.concat(F.lit("e"), "id").alias("event_id"), F.lit("document.ingested").alias("event_type"), F.lit("body").alias("payload"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream
    try:
        parts = delivery.signed(rows, hooks, keys).groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sum(r["count"] for r in parts) == 2_000 and len(parts) > 1 and max(r["count"] for r in parts) < 1_000


# the sweep


def run_sweep(spark, path, tmp_path):
    changes = spark.readStream.schema("doc_id long, status string, at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    late = sweep.swept(changes, 60, slots=3, event_time=True)
    late.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted(r["doc_id"] for r in spark.read.schema("doc_id long").parquet(f"{tmp_path}/out").collect())


def test_sweep(spark, tmp_path):
    path = f"{tmp_path}/in"

    def change(*rows):
        spark.createDataFrame([(d, s, T + dt.timedelta(minutes=m)) for d, s, m in rows], "doc_id long, status string, at timestamp").coalesce(1).write.mode("append").parquet(path)

    change((1, "processing", 0), (2, "processing", 0), (3, "processing", 1), (None, "processing", 0))
    assert run_sweep(spark, path, tmp_path) == []
    change((2, "completed", 30), (4, "processing", 31))
    assert run_sweep(spark, path, tmp_path) == []
    change((9, "completed", 62))
    assert run_sweep(spark, path, tmp_path) == [1, 3]
    change((9, "completed", 200))
    assert run_sweep(spark, path, tmp_path) == [1, 3, 4]  # once each; 2 was completed in time
    batch = spark.read.parquet(path).where("doc_id in (1, 3, 4)").select("doc_id", "status", F.col("at").alias("started_at"))
    assert {r["doc_id"] for r in ingest.timed_out(batch, F.lit(T + dt.timedelta(minutes=200)), 60).collect()} == {1, 3, 4}


# urls


class Net:
    """A transport over a dictionary; a list answers in turn."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def __call__(self, url):
        self.asked.append(url)
        page = self.pages[url]
        return page.pop(0) if isinstance(page, list) else page


def test_retrieve():
    ok = urls.Answer(200, "text/plain", b"hi")
    net = Net({"u": [urls.Answer(503), urls.Answer(429), ok], "gone": urls.Answer(404), "move": urls.Answer(301, location="/there"), "http://h/a": urls.Answer(302, location="/b"), "http://h/b": ok, "http://h/loop": urls.Answer(302, location="/loop"), "big": urls.Answer(200, "text/html; charset=x", b"x" * 11), "down": urls.Answer(500)})
    waits = []
    rules = urls.Rules(tries=3, first_wait=1, most_bytes=10)
    get = lambda u: urls.retrieve(net, u, rules, waits.append)
    assert get("u") == ("u", "u", 200, "text/plain", b"hi", None, 3) and waits == [1, 2]
    assert get("gone")[2:] == (404, None, None, "status 404", 1)
    assert get("http://h/a")[:5] == ("http://h/a", "http://h/b", 200, "text/plain", b"hi")
    assert get("http://h/loop")[5] == "too many redirects"
    assert get("big")[5] == "more than 10 bytes"
    assert get("unknown")[5].startswith("KeyError") and get("down")[5] == "status 500"


def test_ingest_by_url(spark):
    pages = {"http://a/x.html": ("text/html", "<p>one</p>"), "http://a/y": ("text/plain", "two"), "http://b/z": ("application/pdf", "%PDF")}

    def transport(url):
        if url not in pages:
            raise ConnectionError("no host")
        return urls.Answer(200, pages[url][0], pages[url][1].encode())

    rows = spark.createDataFrame([(1, "http://a/x.html"), (2, "http://a/y"), (3, "http://b/z"), (4, "http://c/"), (5, None), (6, "http://a/y"), (7, ""), (8, "not a url")], "doc_id long, url string")
    found = {r["doc_id"]: r for r in urls.ingest_urls(rows, "doc_id", transport, urls.Rules(tries=1)).collect()}
    assert len(found) == 8 and found[1]["text"].strip() == "one" and found[2]["text"] == found[6]["text"] == "two"
    assert [found[i]["status"] for i in range(1, 9)] == ["completed"] * 3 + ["failed", "failed", "completed", "failed", "failed"]
    assert found[4]["error"] == "ConnectionError: no host" and found[5]["error"] == "no url" and found[3]["text"] is None
    assert urls.fetch(rows, transport, urls.Rules(tries=1)).count() == 6  # equal urls once


def test_source(spark, tmp_path):
    def transport(url):
        return urls.Answer(200, "text/plain", url.encode())

    listed = tmp_path / "listed"
    listed.write_text("http://a/1\nhttp://b/2\n")
    spark.dataSource.register(urls.source("kb_urls", transport, lambda at: listed.read_text().split("\n")[at:-1]))
    rows = spark.read.format("kb_urls").option("urls", urls.urls_option(["http://a/1", "http://a/1", "http://b/2"])).load()
    assert rows.rdd.getNumPartitions() == 2 and {bytes(r["content"]) for r in rows.collect()} == {b"http://a/1", b"http://b/2"}
    with pytest.raises(ValueError):
        urls.urls_option(["a\nb"])

    def run():
        stream = spark.readStream.format("kb_urls").load().select("url")
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start().awaitTermination()
        return sorted(r["url"] for r in spark.read.schema("url string").parquet(f"{tmp_path}/out").collect())

    assert run() == ["http://a/1", "http://b/2"]
    listed.write_text(listed.read_text() + "http://c/3\n")
    assert run() == ["http://a/1", "http://b/2", "http://c/3"]


# the dictionary

CHANGE = "doc_id long, kb_id string, text string, version int, deleted boolean"


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_dictionary_follows_changes(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(dictionary, "FEW_CHANGES", few)
    store = f"{tmp_path}/store"
    batches = [
        [(1, "a", "x y y", 1, False), (2, "a", "x z", 1, False), (3, "b", "x", 1, None), (4, "b", None, 1, False), (None, "a", "lost", 1, False)],
        [(1, "a", "y w", 2, False), (2, None, None, 2, True), (5, "a", "x", 1, False), (5, "a", "x q", 2, False)],
        [(3, "a", "x", 3, False), (1, "a", "gone", 3, False), (1, None, None, 4, True), (77, None, None, 1, True)],
    ]
    wanted = [
        {("a", "x"): 2, ("a", "y"): 1, ("a", "z"): 1, ("b", "x"): 1},
        {("a", "y"): 1, ("a", "w"): 1, ("a", "x"): 1, ("a", "q"): 1, ("b", "x"): 1},
        {("a", "x"): 2, ("a", "q"): 1},
    ]
    for number, (rows, state) in enumerate(zip(batches, wanted)):
        for _ in range(2):  # a repeated batch changes nothing
            dictionary.update(spark.createDataFrame(rows, CHANGE), store, number)
            assert {(r["kb_id"], r["keyword"]): r["df"] for r in dictionary.current(spark, store).collect()} == state
    dictionary.fold(spark, store, f"{tmp_path}/folded")
    dictionary.update(spark.createDataFrame([(5, None, None, 9, True)], CHANGE), f"{tmp_path}/folded", 3)
    assert {(r["kb_id"], r["keyword"]): r["df"] for r in dictionary.current(spark, f"{tmp_path}/folded").collect()} == {("a", "x"): 1}
    assert dictionary.current(spark, f"{tmp_path}/nothing").count() == 0


def test_dictionary_equals_a_rebuild(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("kb_id"), "text", F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    store = f"{tmp_path}/store"
    dictionary.update(docs, store, 0)
    dictionary.update(docs.where("doc_id % 3 = 0").withColumn("text", F.substring("text", 1, 50)), store, 1)
    dictionary.update(docs.where("doc_id % 5 = 0").withColumn("deleted", F.lit(True)), store, 2)
    left = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 50)).otherwise(F.col("text")))
    fresh = left.select("kb_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("keyword")).groupBy("kb_id", "keyword").count()
    assert sorted(map(tuple, dictionary.current(spark, store).collect())) == sorted(map(tuple, fresh.collect()))


# embedding in batches


def counted(log, bad=()):
    """An embedder that writes a file for each call and fails where a batch starts with such a text."""
    log = str(log)

    class Counted:
        dimension = 2

        def embed(self, texts):
            import uuid
            from pathlib import Path

            (Path(log) / f"{len(texts)}-{uuid.uuid4().hex}").touch()
            if texts.iloc[0] in bad:
                raise TimeoutError("no answer")
            return pd.Series([[float(len(t)), 1.0] for t in texts])

    return Counted()


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    chunks = spark.createDataFrame([(1, i, f"c{i}", f"text {i}") for i in range(10)] + [(2, 0, "d0", None)], "doc_id long, chunk_ix int, chunk_id string, content string")
    logs = [tmp_path / n for n in ("first", "second", "third")]
    for log in logs:
        log.mkdir()
    store = f"{tmp_path}/store"
    assert embedding.resume(chunks, store, counted(logs[0], bad=("text 4",)), per_batch=2) == 1  # the third of five batches fails
    assert len(list(logs[0].iterdir())) == 6
    state = {(r["doc_id"], r["batch_ix"]): (r["done"], r["last_error"]) for r in embedding.ledger(spark, store).collect()}
    assert state[(1, 2)] == (False, "TimeoutError: no answer") and sum(done for done, _ in state.values()) == 5
    assert embedding.pending(embedding.in_batches(chunks, 2), store).count() == 2
    more = chunks.unionByName(spark.createDataFrame([(3, 0, "e0", "new")], chunks.schema))
    assert embedding.resume(more, store, counted(logs[1]), per_batch=2, waves=3) >= 1
    assert len(list(logs[1].iterdir())) == 2  # the failed batch and the new document's
    assert embedding.resume(more, store, counted(logs[2]), per_batch=2) == 0 and not list(logs[2].iterdir())
    assert sorted((r["doc_id"], r["chunk_ix"]) for r in embedding.vectors(spark, store).collect()) == [*((1, i) for i in range(10)), (2, 0), (3, 0)]
    assert {r["tries"] for r in embedding.ledger(spark, store).where("doc_id = 1 and batch_ix = 2").collect()} == {2}


def test_an_embedder_with_too_few_vectors_fails_its_batch(spark, tmp_path):
    class Short(TrigramEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    chunks = spark.createDataFrame([(1, 0, "c0", "a"), (1, 1, "c1", "b")], "doc_id long, chunk_ix int, chunk_id string, content string")
    embedding.resume(chunks, f"{tmp_path}/store", Short(8))
    assert embedding.ledger(spark, f"{tmp_path}/store").first()["last_error"] == "ValueError: 1 vectors for 2 texts"


# the queue and events


def test_ingest_to_end_of_odd_texts_equals_its_sql(spark, tmp_path):
    """Empty, null and one-character texts, and ids that several rows share, in one batch of the stream and in several."""
    rows = [(1, "", "src0"), (2, None, "src0"), (3, "x", "src1"), (4, "word " * 2000, "src1"), (5, "same", "src2"), (5, "same " * 60, "src2"), (6, " ", "src2"), (7, "no base", None), (None, "no id", "src0")]
    for i in range(10):
        some = rows if i == 0 else [(6, "again " * i, "src2"), (100 + i, "" if i % 2 else "more", "src0")]
        spark.createDataFrame(some, "doc_id long, text string, source string").selectExpr("doc_id", "text", "'en' AS lang", "source", "length(text)::long AS n_chars").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id, event_type, kb_id, n_chunks, n_embedded, n_batches"
    want = con.sql(f"SELECT {names} FROM ({ORACLE_SQL['ingest_to_end']}) ORDER BY ALL").fetchall()
    got = QUERIES["ingest_to_end"](spark, str(tmp_path)).select(*names.split(", "))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and (1, "document.ingested", "src0", 1, 1, 1) in want


def test_jobs_wait_for_a_worker_that_handles_them(spark, tmp_path):
    queue, state, seen = f"{tmp_path}/queue", f"{tmp_path}/state", []
    kind = "job string, kb_id string, doc_id long"
    ingest.enqueue(spark.createDataFrame([("ingest.document", "k", 1), ("embed.batch", "k", 2)], kind), queue)

    def handler(jobs, number):
        seen.extend((r["job"], r["doc_id"]) for r in jobs.collect())

    ingest.work(spark, queue, state, {"ingest.document": handler})
    assert seen == [("ingest.document", 1)]
    ingest.work(spark, queue, state, {"ingest.document": handler, "embed.batch": handler})
    assert seen == [("ingest.document", 1), ("embed.batch", 2)]
    with pytest.raises(ValueError):
        ingest.work(spark, queue, state, {"fly": handler})


def test_a_document_that_comes_again_raises_another_event(spark):
    rows = spark.createDataFrame([(1, "k", True)], "doc_id long, kb_id string, finished boolean")
    ids = [events.of_documents(rows.withColumn("version", F.lit(v))).first()["event_id"] for v in (1, 1, 2)]
    assert ids[0] == ids[1] != ids[2]


def test_worker(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "some text to cut into chunks " * 6), (2, "b", "short"), (3, "b", None), (4, "a", "other words here " * 9)], "doc_id long, kb_id string, text string")
    bound = spark.createDataFrame([("a", "c", "e1"), ("b", "c", "e2")], "kb_id string, paired_client_id string, embedding_endpoint_id string")

    class Down(TrigramEmbedder):
        def embed(self, texts):
            raise TimeoutError("down")

    registry = EndpointRegistry()
    registry.add_local("e1", TrigramEmbedder(16))
    registry.add_local("e2", Down(8))
    queue, store, state = f"{tmp_path}/queue", f"{tmp_path}/store", f"{tmp_path}/state"

    def put(job, kb, doc):
        ingest.enqueue(spark.createDataFrame([(job, kb, doc)], "job string, kb_id string, doc_id long"), queue)

    for doc, kb in ((1, "a"), (2, "b"), (3, "b")):
        put("ingest.document", kb, doc)
    put("keywords.extract", "a", None)
    worker = Worker(spark, store, queue, docs, bound, registry, 40, 10, per_batch=2, minutes=0)
    first = ("ingest.document", "embed.batch", "embed.finalize", "keywords.extract")
    worker.run(state, first)

    def raised():
        return sorted((r["event_type"], r["payload"].split('"doc_id":')[1].rstrip("}")) for r in worker.read("event", EVENTS).collect())

    assert raised() == [("document.failed", "2"), ("document.failed", "3"), ("document.ingested", "1")]
    worker.run(state, first)
    assert len(raised()) == 3  # nothing is handed out again
    assert {r["keyword"] for r in dictionary.current(spark, f"{store}/dictionary").collect()} >= {"some", "other"}
    registry.add_local("e2", TrigramEmbedder(8))
    put("embed.batch", "b", 2)  # asked for again, the endpoint answers
    worker.run(state, first)
    assert ("document.ingested", "2") in raised()
    assert {r["doc_id"] for r in embedding.vectors(spark, f"{store}/vector").collect()} == {1, 2}
    # clusters and the sweep
    spark.createDataFrame([("a", 0, [1.0] * 16, 1), ("a", 1, [0.0] * 16, 1)], "kb_id string, cluster_id long, centroid array<double>, size long").write.parquet(f"{store}/centroid")
    put("clusters.validate", "a", None)
    put("ingest.document", "a", 4)
    worker.run(state, ("clusters.validate", "ingest.document"))
    assert worker.read("validation", TIGHT).agg(F.sum("size")).first()[0] == worker.chunks().where("doc_id = 1").count()
    time.sleep(0.1)
    put("document.timeout-sweep", None, None)
    worker.run(state, ("document.timeout-sweep",))
    assert ("document.failed", "4") in raised()
    assert {r["doc_id"] for r in worker.read("status_end", STATUS).collect()} == {1, 2, 3, 4}


@pytest.fixture
def no_broadcasts(spark):
    """Small tables are joined as large ones are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_worker_shuffles_texts_once_to_embed_them(spark, tmp_path, no_broadcasts):
    import random

    draw, java, sc = random.Random(2), spark._jvm.java.util, spark.sparkContext
    rows = [(d % 2 and "a" or "b", d, c, f"{d}:{c}", "".join(chr(draw.randrange(33, 126)) for _ in range(2_000)), b) for d in range(40) for c in range(8) for b in ((0, 1) if d < 4 else (0,))]
    size = sum(len(r[4]) for r in rows)
    spark.createDataFrame(rows, "kb_id string, doc_id long, chunk_ix int, chunk_id string, content string, batch long").write.partitionBy("batch").parquet(f"{tmp_path}/store/chunk")
    bound = spark.createDataFrame([("a", "c", "e1"), ("b", "c", "e2")], "kb_id string, paired_client_id string, embedding_endpoint_id string")
    registry = EndpointRegistry()
    registry.add_local("e1", TrigramEmbedder(16))
    registry.add_local("e2", TrigramEmbedder(8))
    worker = Worker(spark, f"{tmp_path}/store", f"{tmp_path}/queue", None, bound, registry, per_batch=4)

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(java.ArrayList(), False, False, sc._gateway.new_array(spark._jvm.double, 0), java.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.length()))

    before = shuffled()
    jobs = spark.createDataFrame([("embed.batch", "a" if d % 2 else "b", d) for d in range(39)], "job string, kb_id string, doc_id long")
    worker.embed_batch(jobs, 0)
    assert shuffled() - before < 1.3 * size
    made = embedding.attempts(spark, f"{tmp_path}/store/vector")
    assert made.count() == made.select("doc_id", "chunk_ix").distinct().count() == 39 * 8  # of each document its last ingest
    assert {(r["odd"], r["n"]) for r in made.selectExpr("doc_id % 2 = 1 AS odd", "size(embedding) AS n").distinct().collect()} == {(True, 16), (False, 8)}
    before = shuffled()
    worker.embed_batch(jobs, 1)
    assert shuffled() - before < 0.2 * size and embedding.attempts(spark, f"{tmp_path}/store/vector").count() == 39 * 8  # all are done


def test_waves_that_nothing_is_done_of_join_no_ledger(spark, tmp_path):
    chunks = spark.createDataFrame([(d, c, f"{d}:{c}", f"text {c}") for d in range(6) for c in range(5)], "doc_id long, chunk_ix int, chunk_id string, content string")
    numbered, store = embedding.in_batches(chunks, 2), f"{tmp_path}/store"
    parts = [embedding._share(2, share) for share in (0, 1)]
    embedding.embed_batches(numbered.where(parts[0]), TrigramEmbedder(8)).write.parquet(f"{store}/wave=0")
    left = [embedding.pending(numbered.where(p), store, p) for p in parts]
    assert "LeftAnti" in left[0]._jdf.queryExecution().toString() and "LeftAnti" not in left[1]._jdf.queryExecution().toString()
    assert left[0].isEmpty() and left[1].count() + spark.read.parquet(store).count() == 30
    assert embedding.resume(chunks, store, TrigramEmbedder(8), 2, 2) == 1
    assert embedding.vectors(spark, store).select("chunk_id").distinct().count() == embedding.vectors(spark, store).count() == 30
