"""Readers and the mapping of raw tables onto knowledge-base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import kb_part, short_id
from ..functions.text import chunker, mime_of, parse
from ..schemas import DOCUMENT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their knowledge base (the source) and its partition name."""
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("kb_id", F.col("source")).withColumn("kb_part", kb_part(F.col("source")))


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tag slots: tag1 language, tag2 quality, tag3 toxicity (null without a label)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("tag2"), F.col("toxic").cast("string").alias("tag3"))
    return documents(spark, sf_dir).withColumn("tag1", F.col("lang")).join(labels, "doc_id", "left")


def chunk_table(docs: DataFrame, strategy: str = "fixed", size: int = 200, overlap: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk of each document, with the columns to keep."""
    pieces = docs.select("kb_id", "kb_part", "doc_id", *keep, F.posexplode(chunker(strategy, size, overlap)(F.col("text"))).alias("chunk_ix", "content"))
    return pieces.withColumn("chunk_id", short_id(F.col("doc_id").cast("string"), F.col("chunk_ix").cast("string"))).withColumn("n_chars", F.length("content"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as documents: read as binary, parsed by their extension."""
    raw = spark.read.format("binaryFile").load(path)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").withColumn("mime", mime_of(F.col("filename")))
    return named.select("filename", "mime", parse(F.col("content"), F.col("mime")).alias("text"))


def inline(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Inline texts as documents; fields that a row leaves out are null."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in DOCUMENT.fields) for r in rows], DOCUMENT)
