"""Reads of the catalogue: knowledge bases, documents, chunks, tags, endpoints, webhooks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import kb_part

SLOTS = tuple(f"tag{i}" for i in range(1, 8))


def kb_list(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kb_id").agg(
        F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.countDistinct("lang").alias("n_langs")
    )


def create_kbs(kbs: DataFrame, new: DataFrame, chunk_size: int = 200, chunk_overlap: int = 50, kmeans_k: int = 8) -> DataFrame:
    """The knowledge bases (kb_id, kb_part, chunk_size, chunk_overlap, kmeans_k) and the new ones, settings that are null by default.

    A new one whose id is taken is left out; of new ones with one id the first by its settings stays.
    """
    settings = [F.coalesce(F.col(c), F.lit(v)).cast("long").alias(c) for c, v in (("chunk_size", chunk_size), ("chunk_overlap", chunk_overlap), ("kmeans_k", kmeans_k))]
    made = new.join(kbs.select("kb_id"), "kb_id", "left_anti").select("kb_id", kb_part(F.col("kb_id")).alias("kb_part"), *settings)
    first = made.groupBy("kb_id", "kb_part").agg(F.min(F.struct("chunk_size", "chunk_overlap", "kmeans_k")).alias("s")).select("kb_id", "kb_part", "s.*")
    return kbs.unionByName(first)


def tag_definitions(tagged: DataFrame, names: dict[str, str]) -> DataFrame:
    """(kb_id, slot, name): the slots that a knowledge base's documents use, and what they are called."""
    used = F.explode(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.lit(s).alias("slot"), F.lit(n).alias("name"))) for s, n in names.items()]))
    return tagged.select("kb_id", used.alias("t")).where("t is not null").select("kb_id", "t.slot", "t.name").distinct()


def resolved(endpoints: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, external_id, model, found): mirrored endpoints with what the resolver lists for their external ids."""
    known = listed.select("external_id", "model", F.lit(True).alias("found"))
    mirrored = endpoints.where("source = 'mirrored'").select("id", "external_id")
    return mirrored.join(known, "external_id", "left").select("id", "external_id", "model", F.coalesce("found", F.lit(False)).alias("found"))


def page(rows: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing, by id."""
    return rows.orderBy(order).offset(offset).limit(limit)


def tag_usage(docs: DataFrame, slots: tuple[str, ...] = ("tag1", "tag2", "tag3")) -> DataFrame:
    """(slot, value, n_docs) of all tags that are set; one pass over the documents for all slots."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("value")) for s in slots]))
    return docs.select("doc_id", pairs.alias("t")).where("t.value is not null").groupBy("t.slot", "t.value").agg(F.countDistinct("doc_id").alias("n_docs"))


def next_available_slot(definitions: DataFrame) -> DataFrame:
    """(kb_id, next_slot): the first slot that a knowledge base doesn't use; null if all are taken."""
    every = F.array(*[F.lit(s) for s in SLOTS])
    return definitions.groupBy("kb_id").agg(F.array_min(F.array_except(every, F.collect_set("slot"))).alias("next_slot"))


def public_endpoints(endpoints: DataFrame) -> DataFrame:
    """Endpoints without their sealed keys."""
    return endpoints.drop("key_ciphertext")


def endpoint_roles(kbs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(kb_id, embedding_model, inference_model): both roles of each knowledge base, null where unbound."""
    models = endpoints.select(F.col("id"), F.col("model"))
    return (
        kbs.join(models.select(F.col("id").alias("embedding_endpoint_id"), F.col("model").alias("embedding_model")), "embedding_endpoint_id", "left")
        .join(models.select(F.col("id").alias("inference_endpoint_id"), F.col("model").alias("inference_model")), "inference_endpoint_id", "left")
        .select("kb_id", "embedding_model", "inference_model")
    )


def capabilities(spark) -> DataFrame:
    from ..schemas import SCHEMA_VERSION

    features = ["hybrid", "v1-tags", "clusters", "keywords", "webhooks", "sse"]
    return spark.range(1).select(F.lit(1).alias("protocol"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.array(*[F.lit(f) for f in features]).alias("features"))
