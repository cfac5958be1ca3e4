"""A keyword dictionary that is kept up to date: batches of added, replaced and deleted documents change its counts.

Two tables below one folder. `words` holds the words of each version of a document, by batch; `delta` holds what a batch changed:
+1 for a word that a document got, -1 for one that it lost. The dictionary is the sum of all deltas, which `fold` sums up into one
batch from time to time. A batch reads only words of earlier batches and writes to its own directory, so a repeated one
replaces itself. A document is known by doc_id; within a batch its row with the highest version counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..jobs.scratch import exists

WORDS = "doc_id long, kb_id string, words array<string>, batch long"
DELTA = "kb_id string, keyword string, df long, batch long"
FEW_CHANGES = 1_000_000  # changed documents whose ids go to all tasks; more are joined by a shuffle


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def update(changes: DataFrame, store: str, batch: int) -> None:
    """Take up a batch of changes (doc_id, kb_id, text, version, deleted)."""
    spark = changes.sparkSession
    latest = F.max_by(F.struct("kb_id", "text", "deleted"), F.struct("version", F.coalesce("deleted", F.lit(False)), F.xxhash64("text")))
    now = changes.where("doc_id is not null").groupBy("doc_id").agg(latest.alias("row_")).select("doc_id", "row_.*")
    kept = ~F.coalesce("deleted", F.lit(False)) & F.col("kb_id").isNotNull()
    words = now.select("doc_id", F.when(kept, F.col("kb_id")).alias("kb_id"), F.when(kept, F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).otherwise(F.array().cast("array<string>")).alias("words"))
    words.write.mode("overwrite").parquet(f"{store}/words/batch={batch}")
    new = spark.read.schema(WORDS).parquet(f"{store}/words").where(F.col("batch") == batch)
    before = spark.read.schema(WORDS).parquet(f"{store}/words").where(F.col("batch") < batch)
    ids = new.select("doc_id")
    touched = before.join(F.broadcast(ids) if ids.count() <= FEW_CHANGES else ids, "doc_id", "left_semi")
    old = touched.groupBy("doc_id").agg(F.max_by(F.struct("kb_id", "words"), "batch").alias("row_")).select("doc_id", "row_.*")
    signed = new.select("kb_id", F.explode("words").alias("keyword"), F.lit(1).alias("n")).unionByName(old.select("kb_id", F.explode("words").alias("keyword"), F.lit(-1).alias("n")))
    delta = signed.groupBy("kb_id", "keyword").agg(F.sum("n").alias("df")).where("df <> 0")
    delta.write.mode("overwrite").parquet(f"{store}/delta/batch={batch}")


def current(spark: SparkSession, store: str) -> DataFrame:
    """(kb_id, keyword, df): in how many documents of a base a word occurs now."""
    return _read(spark, f"{store}/delta", DELTA).groupBy("kb_id", "keyword").agg(F.sum("df").alias("df")).where("df > 0")


def fold(spark: SparkSession, store: str, to: str) -> None:
    """The store with one version of each document and one batch of counts, at another path; the caller swaps the paths."""
    last = _read(spark, f"{store}/delta", DELTA).agg(F.max("batch")).first()[0]
    if last is None:
        return
    current(spark, store).write.mode("overwrite").parquet(f"{to}/delta/batch={last}")
    words = _read(spark, f"{store}/words", WORDS).groupBy("doc_id").agg(F.max_by(F.struct("kb_id", "words"), "batch").alias("row_")).select("doc_id", "row_.*")
    words.where("kb_id is not null").write.mode("overwrite").parquet(f"{to}/words/batch={last}")


def run_stream(changes: DataFrame, store: str, checkpoint: str) -> None:
    """Take up all changes that have arrived, batch by batch."""
    changes.writeStream.foreachBatch(lambda batch, number: update(batch, store, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
