"""Embedding of chunks in batches that can be resumed: a ledger says which batches are done, and only the others are embedded.

A batch is `per_batch` chunks of one document, one call of the embedder. A wave is a share of all batches, dealt by a hash; its
vectors are written before the next wave starts. A batch whose call fails is written with its error and its chunks without
vectors, and the others go on. `resume` embeds what no finished batch covers, so a repeated run embeds nothing twice. Chunks without a document's id belong to no batch and are left
out; a null text is embedded as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.scratch import exists
from ..operators.embedding import Embedder
from ..operators.spread import cut

VECTORS = "doc_id long, chunk_ix int, chunk_id string, batch_ix int, embedding array<float>, error string, wave long"


def in_batches(chunks: DataFrame, per_batch: int) -> DataFrame:
    """Chunks (doc_id, chunk_ix, ...) with the number of their batch."""
    return chunks.withColumn("batch_ix", F.floor(F.col("chunk_ix") / per_batch).cast("int"))


def attempts(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(store) if exists(spark, store) else spark.createDataFrame([], VECTORS)


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, batch_ix, done, last_error, tries): the state of each batch that was tried."""
    tried = attempts(spark, store).groupBy("doc_id", "batch_ix", "wave").agg(F.max("error").alias("error"))
    return tried.groupBy("doc_id", "batch_ix").agg(F.bool_or(F.col("error").isNull()).alias("done"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("wave"))).alias("last_error"), F.count("*").alias("tries"))


def vectors(spark: SparkSession, store: str) -> DataFrame:
    """(doc_id, chunk_ix, chunk_id, embedding) of all finished batches."""
    return attempts(spark, store).where("error is null").select("doc_id", "chunk_ix", "chunk_id", "embedding")


def _share(waves: int, share: int) -> Column:
    """Whether a batch belongs to this wave."""
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("batch_ix").cast("int")), F.lit(waves)) == share


def pending(chunks: DataFrame, store: str, only: Column | None = None) -> DataFrame:
    """Chunks with a batch number that no finished batch covers; `only` tells which finished ones can be among these chunks."""
    done = ledger(chunks.sparkSession, store).where("done").select("doc_id", "batch_ix")
    done = done if only is None else done.where(only)
    if done.isEmpty():  # the chunks' texts need not be shuffled to find that out
        return chunks
    return chunks.join(done, ["doc_id", "batch_ix"], "left_anti")


def _open(numbered: DataFrame, done: DataFrame, asked: DataFrame | None) -> DataFrame:
    """The ids of batches that are asked for and not done; no text takes part in finding them."""
    ids = numbered.where("doc_id is not null").select(*(["doc_id"] if asked is None else asked.columns), "batch_ix").distinct()
    ids = ids if asked is None else ids.join(asked, asked.columns, "left_semi")
    return ids.join(done, ["doc_id", "batch_ix"], "left_anti")


def embed_batches(chunks: DataFrame, embedder: Embedder, todo: DataFrame | None = None) -> DataFrame:
    """(doc_id, chunk_ix, chunk_id, batch_ix, embedding, error): one call of the embedder for each batch, in the tasks.

    With `todo`, different rows of doc_id, batch_ix and maybe further columns of the chunks, only these batches.
    """
    names = ["doc_id", "chunk_ix", "chunk_id", "batch_ix", "embedding", "error"]

    def called(texts: pd.Series) -> tuple[list, str | None]:
        try:
            made = list(embedder.embed(texts))
            if len(made) != len(texts):
                raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
            return made, None
        except Exception as e:  # noqa: BLE001  (an embedder's failure is the batch's error)
            return [None] * len(texts), f"{type(e).__name__}: {e}"[:500]

    def embedded(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Whole batches, each from one of the starts on."""
        texts, vectors, errors = part["content"].to_pandas().fillna("").to_numpy(object), [], []
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            made, error = called(pd.Series(texts[at:to], dtype=object))
            vectors += made
            errors += [error] * len(made)
        sizes = np.array([0 if v is None else len(v) for v in vectors])
        flat = np.concatenate([np.asarray(v, np.float32) for v in vectors if v is not None] or [np.zeros(0, np.float32)])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pa.array([v is None for v in vectors]))
        columns = [part[n].combine_chunks() for n in names[:4]] + [lists, pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            part = pa.Table.from_batches(held)
            doc, number = part["doc_id"].to_numpy(), part["batch_ix"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])]))
            if len(starts) > 1:  # the last batch may go on
                yield embedded(part.slice(0, int(starts[-1])), starts[:-1])
                held = part.slice(int(starts[-1])).combine_chunks().to_batches()
        if held:
            part = pa.Table.from_batches(held)
            yield embedded(part, np.zeros(1, int))

    by = ["doc_id", "batch_ix"] if todo is None else todo.columns
    further = [c for c in by if c not in names]
    rows = chunks.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_ix").cast("int").alias("chunk_ix"), "chunk_id", F.col("batch_ix").cast("int").alias("batch_ix"), "content", *further)
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number, as an embedder's time doesn't go by bytes
    dealt = rows.repartition(parts, *by)
    if todo is not None:  # ids meet the texts where these are dealt to; an inner join, as a semi join would be put before the dealing
        ids = todo.withColumns({"doc_id": F.col("doc_id").cast("long"), "batch_ix": F.col("batch_ix").cast("int")})
        dealt = dealt.join(ids.hint("shuffle_hash"), by).select(*rows.columns)
    dealt = dealt.drop(*further).sortWithinPartitions("doc_id", "batch_ix", "chunk_ix")
    return dealt.mapInArrow(run, "doc_id long, chunk_ix int, chunk_id string, batch_ix int, embedding array<float>, error string")


def resume(chunks: DataFrame, store: str, embedder: Embedder, per_batch: int = 32, waves: int = 1, asked: DataFrame | None = None) -> int:
    """Embed what is pending, in waves; how many waves were written. What a lost run had finished stays.

    With `asked`, different rows of doc_id and maybe further columns of the chunks, only what these name.
    """
    spark = chunks.sparkSession
    numbered, written = in_batches(chunks, per_batch), 0
    for share in range(waves):
        mine = _share(waves, share)
        some, todo = numbered.where(mine), None
        done = ledger(spark, store).where("done").select("doc_id", "batch_ix").where(mine)
        if asked is not None or not done.isEmpty():  # else all are pending
            todo = cut(_open(some, done, asked), "batches")
        if (some if todo is None else todo).isEmpty():
            continue
        last = attempts(spark, store).agg(F.max("wave")).first()[0]
        embed_batches(some, embedder, todo).write.mode("overwrite").parquet(f"{store}/wave={0 if last is None else last + 1}")
        written += 1
    return written
