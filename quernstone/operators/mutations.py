"""Changes of tables, as rewrites of the partitions they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..jobs.scratch import remove
from ..functions.keys import short_id
from ..schemas import SCHEMA_VERSION, TABLES
from .embedding import Embedder, embed_with


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], version: str, tie: str) -> DataFrame:
    """Old and new rows, of each key the one with the highest version, ties by the larger `tie`."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version), F.desc(tie)))
    return old.unionByName(new).withColumn("_nth", newest).where("_nth = 1").drop("_nth")


def delete(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return rows.join(keys, on, "left_anti")


def delete_documents(tables: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents: the documents themselves, their chunks, what hangs on these."""
    keys = keys.select("doc_id").distinct()
    return {name: delete(rows, keys, "doc_id") for name, rows in tables.items()}


def patch_chunks(chunks: DataFrame, where: Column, embedder: Embedder, **values: Column) -> DataFrame:
    """Chunks (content, embedding, ...) with changes where a condition holds; only those that change are embedded anew."""
    hit = F.coalesce(where, F.lit(False))
    changed = chunks.where(hit).withColumns(values)
    if "content" in values:
        changed = changed.withColumn("embedding", embed_with(embedder)("content"))
    return chunks.where(~hit).unionByName(changed)


def put_endpoints(old: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The endpoints after clients declared theirs (paired_client_id, source, external_id, model), and the map (id, external_id).

    What a client declares replaces all that it had. An id follows from the client, the source and the external id.
    """
    new = declared.withColumn("id", short_id(F.col("paired_client_id"), F.col("source"), F.col("external_id"))).select(*old.columns)
    return replace_set(old, new, "paired_client_id"), new.select("paired_client_id", "id", "external_id")


def put_webhooks(old: DataFrame, declared: DataFrame) -> DataFrame:
    """The webhooks after clients declared theirs (paired_client_id, url, events)."""
    new = declared.withColumn("id", short_id(F.col("paired_client_id"), F.col("url"))).select(*old.columns)
    return replace_set(old, new, "paired_client_id")


def patch(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows with some columns changed where a condition holds; where it is unknown they stay."""
    return rows.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def set_included(rows: DataFrame, keys: DataFrame, on: str, included: bool) -> DataFrame:
    marked = rows.join(keys.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return marked.withColumn("included", F.when(F.col("_hit"), F.lit(included)).otherwise(F.col("included"))).drop("_hit")


def replace_set(old: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """For each value of the scope that the new rows have, they replace all old ones."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new)


def overwrite_partitions(rows: DataFrame, path: str, by: str = "kb_part") -> None:
    """Write rows; only the partitions that they have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_partition(spark: SparkSession, path: str, by: str, value: str) -> bool:
    """Remove a partition's directory on whatever file system holds it; tells whether it was there."""
    return remove(spark, f"{path}/{by}={value}")


def migrate(spark: SparkSession, database: str) -> int:
    """Create the database and its tables where they are missing; a second run changes nothing. Returns the version."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema.toDDL()}) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.schema_version (version INT) USING parquet")
    current = spark.table(f"{database}.schema_version").agg(F.max("version")).first()[0]
    if current != SCHEMA_VERSION:
        spark.createDataFrame([(SCHEMA_VERSION,)], "version int").write.insertInto(f"{database}.schema_version")
    return SCHEMA_VERSION
