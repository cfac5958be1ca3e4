import datetime as dt

import pytest
from pyspark.sql import functions as F

from quernstone.operators import access, catalog, mutations
from quernstone.operators.embedding import EndpointRegistry
from quernstone.schemas import MODEL_ENDPOINT, TABLES
from quernstone.streaming import events, ingest

T = dt.datetime(2024, 1, 1, 12)


def test_migrate_twice(spark):
    assert mutations.migrate(spark, "kb_test") == mutations.migrate(spark, "kb_test") == 1
    assert {t.name for t in spark.catalog.listTables("kb_test")} == {*TABLES, "schema_version"}
    assert spark.table("kb_test.schema_version").count() == 1


def test_partitions(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, kb_part string")
    mutations.overwrite_partitions(rows, path)
    mutations.overwrite_partitions(spark.createDataFrame([(3, "b")], "id long, kb_part string"), path)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (3, "b")}
    assert mutations.drop_partition(spark, path, "kb_part", "a")
    assert not mutations.drop_partition(spark, path, "kb_part", "a")
    assert spark.read.schema("id long, kb_part string").parquet(path).count() == 1


def test_mutations(spark):
    old = spark.createDataFrame([(1, "k", 1), (2, "l", 5)], "id long, key string, version long")
    new = spark.createDataFrame([(3, "k", 2), (4, "l", 4)], "id long, key string, version long")
    assert {r["id"] for r in mutations.upsert_latest(old, new, ["key"], "version", "id").collect()} == {2, 3}
    assert {r["id"] for r in mutations.replace_set(old, new.where("key = 'k'"), "key").collect()} == {2, 3}
    patched = mutations.patch(old.unionByName(spark.createDataFrame([(9, None, 1)], old.schema)), F.col("key") == "k", version=F.lit(0).cast("long"))
    assert {r["id"]: r["version"] for r in patched.collect()} == {1: 0, 2: 5, 9: 1}
    marked = mutations.set_included(old.withColumn("included", F.lit(True)), new.where("id = 9").unionByName(old.where("id = 1")), "id", False)
    assert {r["id"]: r["included"] for r in marked.collect()} == {1: False, 2: True}


def test_slots(spark):
    used = spark.createDataFrame([("a", "tag1"), ("a", "tag2"), ("b", "tag2"), *[("c", s) for s in catalog.SLOTS]], "kb_id string, slot string")
    assert {r[0]: r[1] for r in catalog.next_available_slot(used).collect()} == {"a": "tag3", "b": "tag1", "c": None}


def test_scope(spark):
    clients = spark.createDataFrame([("some", ["k1"], None), ("all", None, None), ("gone", None, T)], "id string, kb_ids array<string>, revoked_at timestamp")
    rows = spark.createDataFrame([(1, "k1"), (2, "k2")], "doc_id long, kb_id string")
    seen = lambda who: {r["doc_id"] for r in access.scoped(rows, clients, who).collect()}
    assert (seen("some"), seen("all"), seen("gone"), seen("nobody")) == ({1}, {1, 2}, set(), set())


def test_permissions():
    assert access.allows(["admin"], "read") and access.allows(["write"], "write") and not access.allows(["read"], "write")
    with pytest.raises(ValueError):
        access.allows(["read"], "fly")


def test_codes(spark):
    rows = [("ok", T + dt.timedelta(minutes=5), None, 0), ("late", T, None, 0), ("used", T + dt.timedelta(minutes=5), T, 0), ("tried", T + dt.timedelta(minutes=5), None, 5)]
    codes = spark.createDataFrame(rows, "code string, expires_at timestamp, consumed_at timestamp, attempts int")
    assert [r["code"] for r in access.valid_codes(codes, F.lit(T)).collect()] == ["ok"]


def test_active_clients(spark):
    clients = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", "3", T)], "id string, cert_serial string, revoked_at timestamp")
    assert [r["id"] for r in access.active_clients(clients, spark.createDataFrame([("2",)], "cert_serial string")).collect()] == ["a"]


def test_endpoints(spark):
    rows = spark.createDataFrame([("e", *[None] * (len(MODEL_ENDPOINT) - 1))], MODEL_ENDPOINT)
    assert "key_ciphertext" not in catalog.public_endpoints(rows).columns
    assert catalog.capabilities(spark).first()["schema_version"] == 1


def test_registry():
    registry = EndpointRegistry()
    registry.add_local("e", "local")
    assert registry.lookup("c", "e") == "local"
    registry.declare("c", "mirrored", {"e": "far"})
    assert registry.lookup("c", "e") == "far"
    registry.declare("c", "local")
    assert registry.lookup("c", "e") == "local"
    with pytest.raises(ValueError):
        registry.declare("c", "elsewhere")


def test_sweep_and_finalize(spark):
    rows = spark.createDataFrame([(1, "processing", T - dt.timedelta(hours=2)), (2, "processing", T), (3, "completed", T - dt.timedelta(hours=2))], "doc_id long, status string, started_at timestamp")
    assert [r["doc_id"] for r in ingest.timed_out(rows, F.lit(T), 60).collect()] == [1]
    done = ingest.finalize(spark.createDataFrame([(1, True), (1, False), (2, True)], "doc_id long, done boolean"))
    assert {r[0]: r[1] for r in done.collect()} == {1: False, 2: True}


def test_ledger(spark):
    rows = [("w", 1, "failed", 1, "boom", T), ("w", 1, "delivered", 2, None, T + dt.timedelta(seconds=1)), ("w", 2, "failed", 3, "bang", T)]
    row = events.ledger(spark.createDataFrame(rows, "webhook_id string, event_id long, status string, attempts int, last_error string, created_at timestamp")).first()
    assert tuple(row) == ("w", 2, 1, 3, "bang")


def test_retry_doubles(spark):
    waits = spark.createDataFrame([(1,), (2,), (30,)], "n int").select(events.retry_at(F.col("n"))).collect()
    assert [r[0] for r in waits] == [30, 60, 86_400]


def test_command_line():
    from quernstone.jobs.cli import parser

    args = parser().parse_args(["query", "/x", "words", "--top-k", "3"])
    assert (args.command, args.top_k, args.text) == ("query", 3, "words")
    with pytest.raises(SystemExit):
        parser().parse_args(["fly"])


def test_feed(spark, tmp_path):
    rows = spark.createDataFrame([(1, T, "a"), (1, T, "a"), (2, T, "b")], "event_id long, ts timestamp, event_type string")
    rows.write.parquet(f"{tmp_path}/in")
    stream = events.event_stream(spark, f"{tmp_path}/in", rows.schema)
    events.append_to(events.deduplicated(stream).select("event_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_lake_by_command_line(spark, tmp_path, capsys):
    from quernstone.jobs import cli

    lake, drop = f"{tmp_path}/lake", tmp_path / "drop"
    drop.mkdir()
    (drop / "a.txt").write_text("one " * 100)
    (drop / "b.html").write_text("<p>two</p>")
    (drop / "c.bin").write_bytes(b"\x00")
    for argv in (["kb", "create", lake, "k"], ["kb", "create", lake, "k"], ["kb", "create", lake, "other"], ["ingest", lake, "k", str(drop)], ["ingest", lake, "other", str(drop)]):
        cli.main(argv, spark)
    assert "create k: done\ncreate k: taken" in capsys.readouterr().out
    counts = lambda: {r["kb_id"]: (r["n_docs"], r["n_chunks"], r["n_embedded"]) for r in cli.status(spark, lake).collect()}
    assert counts() == {"k": (2, 4, 4), "other": (2, 4, 4)}
    (drop / "a.txt").write_text("short")
    cli.main(["ingest", lake, "k", str(drop)], spark)
    assert counts() == {"k": (2, 2, 2), "other": (2, 4, 4)}
    cli.main(["kb", "rm", lake, "k"], spark)
    assert counts() == {"other": (2, 4, 4)}
    with pytest.raises(ValueError):
        cli.main(["ingest", lake, "k", str(drop)], spark)


def test_only_the_base_s_partition_is_read(spark, sf_dir):
    from quernstone.jobs.queries import QUERIES

    plan = QUERIES["kb_partition_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kb_part" in plan


def test_new_bases(spark):
    old = spark.createDataFrame([("a", "p", 1, 2, 3)], "kb_id string, kb_part string, chunk_size long, chunk_overlap long, kmeans_k long")
    new = spark.createDataFrame([("a", 9, 9, 9), ("b", None, 7, None), ("b", None, 8, None)], "kb_id string, chunk_size long, chunk_overlap long, kmeans_k long")
    assert {(r["kb_id"], r["chunk_size"], r["chunk_overlap"], r["kmeans_k"]) for r in catalog.create_kbs(old, new).collect()} == {("a", 1, 2, 3), ("b", 200, 7, 8)}


def test_declared_endpoints_replace(spark):
    schema = "paired_client_id string, id string, source string, external_id string, model string"
    old = spark.createDataFrame([("c", "1", "local", "x", "m"), ("d", "2", "local", "y", "m")], schema)
    new, ids = mutations.put_endpoints(old, spark.createDataFrame([("c", "mirrored", "z", "n")], "paired_client_id string, source string, external_id string, model string"))
    rows = {r["external_id"]: r["id"] for r in new.collect()}
    assert set(rows) == {"y", "z"} and [(r["id"], r["external_id"]) for r in ids.collect()] == [(rows["z"], "z")]


def test_failed_deliveries_are_tried_again(spark, tmp_path):
    hooks = spark.createDataFrame([("h", "http://a", ["document.ingested"]), ("g", "http://b", ["document.failed"])], "id string, url string, events array<string>")
    docs = spark.createDataFrame([(1, "k", True), (2, "k", True), (3, "k", False)], "doc_id long, kb_id string, finished boolean")
    due = events.due_deliveries(events.of_documents(docs), hooks)
    assert due.count() == 3 and events.due_deliveries(events.of_documents(docs), hooks, few=0).count() == 3
    log = tmp_path / "sent"

    def send(url, body, headers):
        from quernstone.functions.keys import signature

        assert headers["x-signature"] == signature("s", body) and headers["x-event-id"]
        with open(log, "a") as f:
            f.write(f"{url}\n")
        return "refused" if url == "http://b" else None

    def keep(rows):
        path = f"{tmp_path}/round-{len(list(tmp_path.iterdir()))}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    rows = events.deliver(due, send, "s", keep, most=3).collect()
    assert sorted((r["webhook_id"], r["status"], r["attempts"]) for r in rows) == [("g", "failed", 1), ("g", "failed", 2), ("g", "failed", 3), ("h", "delivered", 1), ("h", "delivered", 1)]
    assert sorted(log.read_text().split()) == ["http://a"] * 2 + ["http://b"] * 3


def test_training_event(spark):
    rows = spark.createDataFrame([(0, 3), (1, 4)], "cluster_id int, size long")
    row = events.of_clusters("k", rows).first()
    assert row["event_type"] == "clusters.retrained" and row["payload"] == '{"event_type":"clusters.retrained","kb_id":"k","n_clusters":2,"n_rows":7}'


def test_only_changed_chunks_are_embedded(spark):
    class Loud:
        dimension = 1

        def embed(self, texts):
            assert not any(t == "kept" for t in texts)
            return texts.map(lambda t: [float(len(t))])

    rows = spark.createDataFrame([(1, "kept", [9.0]), (2, "old", [9.0])], "id long, content string, embedding array<float>")
    new = mutations.patch_chunks(rows, F.col("id") == 2, Loud(), content=F.lit("newer"))
    assert {r["id"]: (r["content"], r["embedding"]) for r in new.collect()} == {1: ("kept", [9.0]), 2: ("newer", [5.0])}


def test_unknown_jobs_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest.enqueue(spark.createDataFrame([("fly", "k", 1)], "job string, kb_id string, doc_id long"), f"{tmp_path}/queue")


def test_jobs_are_handed_out_once(spark, tmp_path):
    queue, state, seen = f"{tmp_path}/queue", f"{tmp_path}/state", []
    for doc in (1, 2):
        ingest.enqueue(spark.createDataFrame([("embed.batch", "k", doc)], "job string, kb_id string, doc_id long"), queue)
        ingest.work(spark, queue, state, {"embed.batch": lambda jobs, number: seen.extend(r["doc_id"] for r in jobs.collect())})
    assert seen == [1, 2]


def test_redeems(spark):
    rows = spark.createDataFrame([("a", False)] * 5 + [("b", True), ("b", False)], "code string, ok boolean")
    assert {tuple(r) for r in access.failed_redeems(rows).collect()} == {("a", 5, True), ("b", 1, False)}
