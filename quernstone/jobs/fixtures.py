"""Ten known-answer queries: passages that occur verbatim in a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import documents, table


FEW = 10_000


def known_answers(spark: SparkSession, sf_dir: str, most: int = 10) -> DataFrame:
    """(query_id, text, holders): the first passages that documents hold, and the documents that hold them."""
    items = table(spark, sf_dir, "benchmark")
    if items.count() > FEW:
        raise ValueError(f"more than {FEW} passages: too many to compare each with every document")
    held = documents(spark, sf_dir).select("doc_id", F.col("text").alias("whole")).join(F.broadcast(items), F.col("whole").contains(F.col("text")))
    return held.groupBy(F.col("item_id").alias("query_id"), "text").agg(F.collect_set("doc_id").alias("holders")).orderBy("query_id").limit(most)
