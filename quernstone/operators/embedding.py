"""Embedders: the interface, and character trigrams hashed into a fixed number of buckets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trigrams import bucket_counts


class Embedder(Protocol):
    """What a model endpoint offers: vectors of `dimension` for a batch of texts."""

    dimension: int

    def embed(self, texts: pd.Series) -> pd.Series: ...


def embed_with(embedder: Embedder):
    """A column function that sends Arrow batches of texts to an embedder."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return embedder.embed(texts)

    return run


class EndpointRegistry:
    """Which embedder a client's last declaration chose: local ones, or those mirrored from elsewhere."""

    def __init__(self) -> None:
        self._local: dict[str, Embedder] = {}
        self._declared: dict[str, dict[str, Embedder]] = {}

    def add_local(self, endpoint_id: str, embedder: Embedder) -> None:
        self._local[endpoint_id] = embedder

    def declare(self, client_id: str, source: str, endpoints: dict[str, Embedder] | None = None) -> None:
        if source not in ("local", "mirrored"):
            raise ValueError(f"unknown source {source!r}")
        if source == "local":
            self._declared.pop(client_id, None)
        else:
            self._declared[client_id] = dict(endpoints or {})

    def lookup(self, client_id: str, endpoint_id: str) -> Embedder:
        return self._declared.get(client_id, self._local)[endpoint_id]


def hash_ngram(rows: DataFrame, key: str, buckets: int, text: str = "text") -> DataFrame:
    """(key, bucket, n): how many trigrams of a text fall into a bucket; the sparse form of its vector. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                counts = bucket_counts([t or "" for t in part.column(1).to_pylist()], buckets)
                row, bucket = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(bucket), pa.array(counts[row, bucket].astype(np.int64))], names=[key, "bucket", "n"])

    return rows.select(key, F.lower(text).alias("low")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, bucket long, n long")
