"""Sharding by Karmarkar-Karp differencing: groups of equal texts are kept whole, bytes are balanced.

The groups are hashed into buckets of bounded size. In each bucket the two partial partitions with the
largest spread are combined again and again, the largest part of the one with the smallest of the other.
What is left of a bucket is one partial partition, a list of sums; these are combined in the same way,
level by level, never more than FAN of them in one task.

Nulls: a null text counts 1 byte and all null texts are one group; a null doc_id is a value like another.
Empty texts count 1 byte. A single group larger than the mean shard stays whole: the others even out the
rest. Repeated rows are rows, each with its slot. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_spread

PER_BUCKET, FAN, PER_CHUNK = 20_000, 2_048, 50_000


def differencing(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions (k sums each) into one: its k sums, and where each part of each went."""
    k = len(parts[0])
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        own = [sums[j] for j in order]
        heap.append((own[-1] - own[0], i, own, [(i, j) for j in order]))
    heapq.heapify(heap)
    made = len(parts)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = sorted(((a[j] + b[k - 1 - j], j) for j in range(k)), key=lambda p: (-p[0], p[1]))
        own = [s for s, _ in both]
        heapq.heappush(heap, (own[-1] - own[0], made, own, [((x[j], y[k - 1 - j]),) for _, j in both]))
        made += 1
    _, _, sums, trees = heap[0]
    went = [[0] * k for _ in parts]
    for shard, tree in enumerate(trees):
        stack = [tree]
        while stack:
            node = stack.pop()
            if len(node) == 1:
                stack += node[0]
            else:
                went[node[0]][node[1]] = shard
    return sums, went


def _in_bucket(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        _, went = differencing([[int(s)] + [0] * (k - 1) for s in pdf["size"]])
        return pdf.assign(part=[w[0] for w in went])[["key", "bucket", "size", "part"]]

    return run


def _merge(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", ignore_index=True)
        sums, went = differencing([list(map(int, s)) for s in pdf["sums"]])
        return pd.DataFrame({"bucket": pdf["bucket"], "parent": pdf["parent"], "went": went, "sums": [sums] * len(pdf)})

    return run


def place_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key, size) of indivisible groups to (key, shard)."""
    n = groups.count()
    buckets = max(1, -(-n // PER_BUCKET))
    local = cut(
        groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(_in_bucket(shards), "key string, bucket long, size long, part int"),
        "kk-local",
    )
    sums = local.groupBy("bucket").agg(*[F.sum(F.when(F.col("part") == j, F.col("size")).otherwise(0)).alias(f"s{j}") for j in range(shards)])
    level = sums.select("bucket", F.array(*[f"s{j}" for j in range(shards)]).alias("sums"))
    paths = local.select("bucket").distinct().select("bucket", F.col("bucket").alias("top"), F.array(*[F.lit(j) for j in range(shards)]).alias("path"))
    while True:
        parents = max(1, -(-buckets // FAN))
        merged = cut(
            level.withColumn("parent", F.pmod("bucket", F.lit(parents)))
            .groupBy("parent")
            .applyInPandas(_merge(shards), "bucket long, parent long, went array<int>, sums array<long>"),
            "kk-merged",
        )
        step = merged.select(F.col("bucket").alias("top"), "parent", "went")
        paths = paths.join(step, "top").select("bucket", F.col("parent").alias("top"), F.transform("path", lambda j: F.col("went")[j]).alias("path"))
        if parents == 1:
            break
        level = merged.groupBy(F.col("parent").alias("bucket")).agg(F.first("sums").alias("sums"))
        buckets = parents
    return local.join(paths, "bucket").select("key", F.col("path")[F.col("part")].alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("key"),
    )
    rows = cut(rows, "kk-rows")
    shard_of = place_groups(rows.groupBy("key").agg(F.sum("size").alias("size")), shards)
    chunks = max(1, -(-rows.count() // PER_CHUNK))
    placed = cut(
        join_spread(rows, shard_of, "key", ["doc_id", "size"]).select(
            "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(chunks * 4)).alias("chunk")
        ),
        "kk-placed",
    )
    counts = placed.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("chunk", "shard").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("nth", F.row_number().over(within))
        .join(offsets, ["shard", "chunk"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
