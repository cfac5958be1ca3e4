"""Training that follows growth: a ledger of the rows at each base's last training decides which bases are trained anew.

Vectors arrive as a stream. A batch is added to the store, the bases it touches are counted, and those that have grown by `growth`
since their last training are trained in one job; their centroids, the ledger's rows and the events are written. Every batch
has directories of its own and reads only earlier ones, so a repeated one replaces itself. Counts are kept by batch, so no batch
counts old rows again; only a training reads a base's vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..jobs.scratch import exists
from ..operators import kmeans
from .events import of_trainings

VECTORS = "kb_id string, vec_id long, embedding array<float>, batch long"
COUNTS = "kb_id string, n long, batch long"
LEDGER = "kb_id string, n_rows long, batch long"
CENTROIDS = "kb_id string, cluster_id long, centroid array<double>, size long, batch long"
EVENTS = "event_id string, event_type string, kb_id string, payload string, batch long"


def read(spark: SparkSession, store: str, name: str, schema: str, below: int | None = None) -> DataFrame:
    rows = spark.read.schema(schema).parquet(f"{store}/{name}") if exists(spark, f"{store}/{name}") else spark.createDataFrame([], schema)
    return rows if below is None else rows.where(F.col("batch") < below)


def needs_training(now: Column, trained: Column, growth: float) -> Column:
    """Whether rows have grown by a share since the last training; without one, whether there are any."""
    return (now > 0) & (now >= F.coalesce(trained, F.lit(0)) * (1 + growth))


def take_up(batch: DataFrame, number: int, store: str, ks: DataFrame, growth: float = 0.2, rounds: int = 5) -> None:
    """Add a batch of vectors (kb_id, vec_id, embedding); train the bases that have grown enough. `ks` is (kb_id, k)."""
    spark = batch.sparkSession
    batch.select("kb_id", "vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where("kb_id is not null").write.mode("overwrite").parquet(f"{store}/vector/batch={number}")
    added = read(spark, store, "vector", VECTORS).where(F.col("batch") == number)
    added.groupBy("kb_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{store}/count/batch={number}")
    counts = read(spark, store, "count", COUNTS, number + 1)
    touched = counts.where(F.col("batch") == number).select("kb_id")
    now = counts.join(touched, "kb_id", "left_semi").groupBy("kb_id").agg(F.sum("n").alias("n_rows"))
    trained = read(spark, store, "ledger", LEDGER, number).groupBy("kb_id").agg(F.max_by("n_rows", "batch").alias("trained"))
    due = now.join(trained, "kb_id", "left").where(needs_training(F.col("n_rows"), F.col("trained"), growth)).join(ks.select("kb_id", "k"), "kb_id")
    due.select("kb_id", "n_rows").write.mode("overwrite").parquet(f"{store}/ledger/batch={number}")
    due = read(spark, store, "ledger", LEDGER).where(F.col("batch") == number).join(ks.select("kb_id", "k"), "kb_id")
    if due.isEmpty():
        return
    vectors = read(spark, store, "vector", VECTORS, number + 1).join(due.select("kb_id"), "kb_id", "left_semi")
    kmeans.train(vectors, due, rounds).write.mode("overwrite").parquet(f"{store}/centroid/batch={number}")
    made = read(spark, store, "centroid", CENTROIDS).where(F.col("batch") == number)
    of_trainings(made.drop("batch"), F.lit(number)).write.mode("overwrite").parquet(f"{store}/event/batch={number}")


def run(vectors: DataFrame, store: str, checkpoint: str, ks: DataFrame, growth: float = 0.2, rounds: int = 5) -> None:
    """Take up all that has arrived."""
    vectors.writeStream.foreachBatch(lambda batch, number: take_up(batch, number, store, ks, growth, rounds)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def centroids(spark: SparkSession, store: str) -> DataFrame:
    """(kb_id, cluster_id, centroid, size): each base's clusters of its last training."""
    rows = read(spark, store, "centroid", CENTROIDS)
    last = rows.groupBy("kb_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["kb_id", "batch"], "left_semi").drop("batch")
