"""Schemas of the knowledge-base tables. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

SCHEMA_VERSION = 1


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_s, _l, _i, _d, _b, _t = StringType(), LongType(), IntegerType(), DoubleType(), BooleanType(), TimestampType()

DOCUMENT = _struct(
    doc_id=_l, kb_id=_s, filename=_s, mime=_s, text=_s, tags=MapType(_s, _s), metadata=MapType(_s, _s), status=_s, included=_b, version=_l
)
CHUNK = _struct(
    chunk_id=_s, kb_id=_s, kb_part=_s, doc_id=_l, chunk_ix=_i, content=_s, n_chars=_i, embedding=ArrayType(FloatType()), cluster_id=_i, included=_b
)
CLUSTER = _struct(kb_id=_s, cluster_id=_i, centroid=ArrayType(_d), size=_l)
KEYWORD = _struct(kb_id=_s, keyword=_s, df=_l)
TAG_DEFINITION = _struct(kb_id=_s, slot=_s, name=_s)
EMBED_BATCH = _struct(doc_id=_l, batch_ix=_i, done=_b)
PAIRED_CLIENT = _struct(id=_s, label=_s, platform=_s, cert_serial=_s, scopes=ArrayType(_s), kb_ids=ArrayType(_s), status=_s, last_seen_at=_t, revoked_at=_t, created_at=_t)
PAIRING_CODE = _struct(code=_s, paired_client_id=_s, label=_s, expires_at=_t, consumed_at=_t, attempts=_i, created_at=_t)
MODEL_ENDPOINT = _struct(
    id=_s, paired_client_id=_s, kind=_s, provider=_s, template=_s, model=_s, dimension=_i, base_url=_s, key_ciphertext=BinaryType(), source=_s, external_id=_s,
    label=_s, created_at=_t, updated_at=_t,
)
KNOWLEDGE_BASE = _struct(
    id=_s, paired_client_id=_s, owner_id=_s, name=_s, embedding_endpoint_id=_s, inference_endpoint_id=_s, chunk_size=_i, chunk_overlap=_i, kmeans_k=_i, created_at=_t
)
EMBEDDING_KEYWORD = _struct(kb_id=_s, chunk_id=_s, keyword=_s, tf=_l)
DOCUMENT_KEYWORD = _struct(kb_id=_s, doc_id=_l, keyword=_s, rank=_i, score=_d)
WEBHOOK = _struct(id=_s, paired_client_id=_s, url=_s, secret_ciphertext=BinaryType(), events=ArrayType(_s), created_at=_t)
WEBHOOK_DELIVERY = _struct(id=_s, webhook_id=_s, event_id=_s, status=_s, attempts=_i, last_error=_s, created_at=_t)
MATCH = _struct(query_id=_l, rank=_i, doc_id=_l, score=_d, vector_score=_d, keyword_score=_d, content=_s)

TABLES = {
    "knowledge_base": KNOWLEDGE_BASE,
    "embedding_keyword": EMBEDDING_KEYWORD,
    "document_keyword": DOCUMENT_KEYWORD,
    "document": DOCUMENT,
    "chunk": CHUNK,
    "cluster": CLUSTER,
    "keyword": KEYWORD,
    "tag_definition": TAG_DEFINITION,
    "embed_batch": EMBED_BATCH,
    "paired_client": PAIRED_CLIENT,
    "pairing_code": PAIRING_CODE,
    "model_endpoint": MODEL_ENDPOINT,
    "webhook": WEBHOOK,
    "webhook_delivery": WEBHOOK_DELIVERY,
}
