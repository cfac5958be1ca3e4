"""A worker behind the queue: a handler for each kind of job, over one store of tables.

`ingest.document` cuts documents into chunks and asks for their embedding; `embed.batch` embeds what no finished batch covers, each
base by the endpoint that it is bound to, and asks for the end; `embed.finalize` tells by the ledger whether all batches of a
document are done and raises its event; `keywords.extract` takes documents up into the dictionary; `clusters.validate` measures
a base's clusters; `document.timeout-sweep` fails what has been in process for too long. Every handler writes to a directory of
its batch, or skips what is done, so a repeated batch of jobs changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import kb_part
from ..jobs.scratch import exists
from ..operators import dictionary, kmeans
from ..operators.embedding import EndpointRegistry
from ..operators.spread import cut
from ..operators.vector_index import FEW_BASES
from ..sources.tables import chunk_table
from . import embedding, ingest
from .events import of_documents

CHUNKS = "kb_id string, doc_id long, chunk_ix int, chunk_id string, content string, batch long"
STATUS = "doc_id long, kb_id string, status string, started_at timestamp, batch long"
EVENTS = "event_id string, event_type string, kb_id string, payload string, batch long"
TIGHT = "kb_id string, cluster_id long, size long, silhouette double, batch long"


class Worker:
    """Handlers over documents (doc_id, kb_id, text) and bindings (kb_id, paired_client_id, embedding_endpoint_id) of bases."""

    def __init__(self, spark: SparkSession, store: str, queue: str, documents: DataFrame, bindings: DataFrame, registry: EndpointRegistry, size: int = 200, overlap: int = 50, per_batch: int = 32, minutes: int = 60) -> None:
        self.spark, self.store, self.queue = spark, store, queue
        self.documents, self.bindings, self.registry = documents, bindings, registry
        self.size, self.overlap, self.per_batch, self.minutes = size, overlap, per_batch, minutes

    def read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.store}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.store}/{name}/batch={number}")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The chunks of each document's last ingest."""
        last = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["doc_id", "batch"], "left_semi")

    def chunks(self) -> DataFrame:
        return self._latest(self.read("chunk", CHUNKS))

    def _asked(self, jobs: DataFrame) -> DataFrame:
        return jobs.select("doc_id").where("doc_id is not null").distinct()

    def _next(self, jobs: DataFrame, job: str) -> None:
        ingest.enqueue(jobs.select(F.lit(job).alias("job"), "kb_id", "doc_id").distinct(), self.queue)

    def ingest_document(self, jobs: DataFrame, number: int) -> None:
        docs = self.documents.join(self._asked(jobs), "doc_id", "left_semi").withColumn("kb_part", kb_part(F.col("kb_id")))
        made = chunk_table(docs, "fixed", self.size, self.overlap)
        self._write(made.select("kb_id", "doc_id", F.col("chunk_ix").cast("int").alias("chunk_ix"), "chunk_id", "content"), "chunk", number)
        self._write(docs.select("doc_id", "kb_id", F.lit("processing").alias("status"), F.current_timestamp().alias("started_at")), "status", number)
        self._next(jobs, "embed.batch")

    def embed_batch(self, jobs: DataFrame, number: int) -> None:
        stored = self.read("chunk", CHUNKS)
        last = stored.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("kb_id", "batch").alias("kb_id"))
        asked = cut(last.join(self._asked(jobs), "doc_id", "left_semi"), "asked")  # ids alone; texts are shuffled once, to where they are embedded
        bases = asked.select("kb_id").distinct().join(self.bindings, "kb_id")
        for bound in bases.select("paired_client_id", "embedding_endpoint_id").distinct().collect():  # endpoints, not bases
            embedder = self.registry.lookup(bound["paired_client_id"], bound["embedding_endpoint_id"])
            own = self.bindings.where((F.col("paired_client_id") == bound["paired_client_id"]) & (F.col("embedding_endpoint_id") == bound["embedding_endpoint_id"]))
            own = cut(own.join(bases.select("kb_id"), "kb_id", "left_semi").select("kb_id").distinct(), "bases")
            own = F.broadcast(own) if own.count() <= FEW_BASES else own
            embedding.resume(stored.join(own, "kb_id", "left_semi"), f"{self.store}/vector", embedder, self.per_batch, asked=asked.select("doc_id", "batch"))
        self._next(jobs, "embed.finalize")

    def embed_finalize(self, jobs: DataFrame, number: int) -> None:
        asked = jobs.select("doc_id", "kb_id").where("doc_id is not null").distinct()
        batches = embedding.in_batches(self.read("chunk", CHUNKS), self.per_batch).select("doc_id", "batch", "batch_ix").distinct()
        wanted = self._latest(batches).join(self._asked(jobs), "doc_id", "left_semi").select("doc_id", "batch_ix")
        ledger = embedding.ledger(self.spark, f"{self.store}/vector").select("doc_id", "batch_ix", "done")
        batches = wanted.join(ledger, ["doc_id", "batch_ix"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
        ended = cut(asked.join(ingest.finalize(batches), "doc_id", "left").withColumns({"finished": F.coalesce("finished", F.lit(False)), "version": F.lit(number)}), "ended")
        self._write(of_documents(ended), "event", number)
        self._write(ended.select("doc_id", "kb_id", F.when(F.col("finished"), "completed").otherwise("failed").alias("status"), F.current_timestamp().alias("started_at")), "status_end", number)

    def keywords_extract(self, jobs: DataFrame, number: int) -> None:
        """Of the documents that jobs name; a job without a document asks for its whole base."""
        whole = jobs.where("doc_id is null").select("kb_id").distinct()
        docs = self.documents.select("doc_id", "kb_id", "text")
        mine = docs.join(whole, "kb_id", "left_semi").unionByName(docs.join(whole, "kb_id", "left_anti").join(self._asked(jobs), "doc_id", "left_semi"))
        dictionary.update(mine.withColumns({"version": F.lit(number), "deleted": F.lit(False)}), f"{self.store}/dictionary", number)

    def clusters_validate(self, jobs: DataFrame, number: int) -> None:
        """Silhouettes of the clusters that the bases' vectors now have; centroids come from the store's `centroid` table."""
        bases = jobs.select("kb_id").distinct()
        centroids = self.read("centroid", "kb_id string, cluster_id long, centroid array<double>, size long").join(bases, "kb_id", "left_semi")
        rows = embedding.vectors(self.spark, f"{self.store}/vector").join(self.documents.select("doc_id", "kb_id"), "doc_id").join(bases, "kb_id", "left_semi")
        rows = rows.select("kb_id", F.xxhash64("chunk_id").alias("vec_id"), "embedding")
        own = kmeans.assign(rows, centroids).select("kb_id", "vec_id", "cluster_id")
        self._write(kmeans.silhouette(rows.join(own, ["kb_id", "vec_id"])), "validation", number)

    def timeout_sweep(self, jobs: DataFrame, number: int) -> None:
        ended = self.read("status_end", STATUS).select("doc_id").distinct()
        open_ = self.read("status", STATUS).join(ended, "doc_id", "left_anti").groupBy("doc_id", "kb_id").agg(F.max("started_at").alias("started_at"))
        late = ingest.timed_out(open_.withColumn("status", F.lit("processing")), F.current_timestamp(), self.minutes)
        failed = late.select("doc_id", "kb_id", F.lit("failed").alias("status"), "started_at")
        self._write(failed, "status_end", number + (1 << 40))  # beside the batches of `embed.finalize`
        swept = self.read("status_end", STATUS).where(F.col("batch") == number + (1 << 40))
        self._write(of_documents(swept.select("doc_id", "kb_id", F.lit(False).alias("finished"), F.lit(f"sweep {number}").alias("version"))), "event", number + (1 << 40))

    def handlers(self) -> dict[str, Callable[[DataFrame, int], None]]:
        """In the order in which one asks for the next, so one round takes a document from text to event."""
        return dict(zip(ingest.JOBS, (self.ingest_document, self.embed_batch, self.embed_finalize, self.clusters_validate, self.keywords_extract, self.timeout_sweep)))

    def run(self, checkpoint: str, kinds: tuple[str, ...] = ingest.JOBS) -> None:
        """Work off what waits, of some kinds of jobs or all."""
        mine = self.handlers()
        ingest.work(self.spark, self.queue, checkpoint, {job: mine[job] for job in kinds})
