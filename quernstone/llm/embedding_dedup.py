"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

Equal vectors are one class. Each class is encoded once, and what is stored of it are the signs of its unit vector
after each of ROTATIONS random rotations, packed to bits, with the inner product of code and vector as the correction
factor of each, and its keys in several tables of random hyperplanes. Only these go to the tables, never vectors.

Candidates are classes that agree on all bits of a key in a table; the number of tables is set so that a pair exactly
at the threshold is missed with a chance of at most MISSED, and more similar pairs far less often. A bucket of more
than CHUNK classes is compared in pairs of chunks. A code over its factor, turned back, is an unbiased estimate of the
vector, and the inner product of two such estimates from different rotations is one of the cosine. The factors say how
far it may lie off for a pair at the threshold; pairs whose estimate and error bound reach the threshold need exact
computation, all others are done. A pair is looked at in the first table in which it meets, so never twice. What goes
on are the members of such pairs with a bit for each of their partners; these get their vectors, and the pairs are
computed exactly, in double precision.

Nulls: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing, not even
its copies; vectors of different lengths never link. A null vec_id is kept, but is never the smallest. Repeated
rows are separate vectors. Other columns, labels among them, are ignored. An empty table gives no rows. Vectors that
reach null ids only have a null component_id. Ids from 2**62 on are not supported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_spread

THRESHOLD, MISSED, CHUNK, CONFIDENCE, ROTATIONS, FEW_BUCKETS, MADE = 0.95, 0.01, 1_024, 3.0, 4, 100_000, 1 << 62
BLOCK = ["dim", "tab", "key", "one", "two"]


def plan(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a key and number of tables."""
    bits = min(30, max(6, int(math.log2(max(classes, 2))) - 3))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree))


@lru_cache(8)
def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, bits * tables))


@lru_cache(8)
def rotations(dim: int) -> np.ndarray:
    rng, out = np.random.default_rng(1_000 + dim), []
    for _ in range(ROTATIONS):
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.array(out)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and correction factors of unit vectors."""
    turned = np.einsum("ij,rjk->irk", x, rotations(x.shape[1]))
    factors = np.abs(turned).sum(2) / math.sqrt(x.shape[1])
    return np.packbits((turned > 0).reshape(len(x), -1), axis=1), factors.astype(np.float32)


def decode(codes: np.ndarray, factors: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimates of the vectors from every other rotation, from the rest, and how long the error of such an estimate is."""
    signs = np.unpackbits(codes, axis=1, count=ROTATIONS * dim).reshape(len(codes), ROTATIONS, dim)
    scaled = (signs * np.float32(2) - np.float32(1)) / (np.float32(math.sqrt(dim)) * factors[..., None])
    back = np.einsum("irk,rjk->rij", scaled, rotations(dim).astype(np.float32), optimize=True)
    error = np.sqrt(np.maximum(0, 1 / factors.astype(np.float64) ** 2 - 1).sum(1) * 2) / ROTATIONS
    return back[0::2].mean(0), back[1::2].mean(0), error


def may_link(left: tuple, right: tuple, threshold: float, dim: int) -> np.ndarray:
    """For each pair of decoded rows whether its estimate, with its error bound, reaches the threshold.

    For a pair at the threshold the part of one vector beside the other has length sqrt(1 - threshold**2), and an
    error points in a random direction beside its vector.
    """
    (a, b, e), (c, d, f) = left, right
    estimate = (a @ d.T + b @ c.T) / 2
    beside = 1 - threshold**2
    error = np.sqrt((beside * (e[:, None] ** 2 + f[None] ** 2) + e[:, None] ** 2 * f[None] ** 2) / max(1, dim - 1))
    return estimate + CONFIDENCE * error >= threshold


def _store(bits: int, tables: int):
    """A row for each class: its codes, factors and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                part = batch.slice(at, 1_000)
                vectors = [np.array(v, np.float64) for v in part.column(1).to_pylist()]
                sizes = np.array(list(map(len, vectors)))
                for dim in np.unique(sizes).tolist():
                    rows = np.nonzero(sizes == dim)[0]
                    x = np.stack([vectors[i] for i in rows])
                    x = x / np.abs(x).max(1)[:, None]  # lengths that overflow or vanish
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                    codes, factors = encode(x)
                    sides = x @ planes(dim, bits, tables) > 0
                    keys = sides.reshape(len(rows), tables, bits) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), dim, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()),
                            pa.array([f.tobytes() for f in factors], pa.binary()), pa.array([s.tobytes() for s in np.packbits(sides, axis=1)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())),
                        ],
                        names=["id", "dim", "code", "factors", "sides", "keys"],
                    )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each block of two or more, sorted by id; blocks come one after the other, and one is held at a time."""
    held: list[dict[str, np.ndarray]] = []

    def done() -> dict[str, np.ndarray]:
        rows = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        order = np.argsort(rows["id"], kind="stable")
        return {k: v[order] for k, v in rows.items()}

    for batch in batches:
        rows = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        new = np.ones(len(batch), bool)
        new[1:] = np.any([rows[m][1:] != rows[m][:-1] for m in BLOCK], 0)
        cuts = [*np.nonzero(new)[0].tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and (a or any(held[0][m][0] != rows[m][0] for m in BLOCK)):
                if len(held) > 1 or len(held[0]["id"]) > 1:
                    yield done()
                held.clear()
            if b - a > 1 or not a or b == len(batch):  # a block of one row that can't go on is none
                held.append({k: v[a:b] for k, v in rows.items()})
    if held:
        yield done()


def _stacked(blobs: np.ndarray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def _sides_of(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block's two chunks; twice the same if it has one."""
    one, two = rows["one"][0], rows["two"][0]
    left = np.nonzero(rows["chunk"] == one)[0]
    return left, left if one == two else np.nonzero(rows["chunk"] == two)[0]


def _undecided(threshold: float, bits: int):
    """Members of each block's pairs that codes can't decide, each with a bit for every such member of the block: its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            left, right = _sides_of(rows)
            if len(left) * len(right) < 2 and rows["one"][0] == rows["two"][0] or not len(right) or not len(left):
                continue
            dim, tab = int(rows["dim"][0]), int(rows["tab"][0])
            among = left[:, None] < right[None] if rows["one"][0] == rows["two"][0] else np.ones((len(left), len(right)), bool)
            sides = np.unpackbits(_stacked(rows["sides"], np.uint8), axis=1)[:, : tab * bits].reshape(len(rows["id"]), tab, bits)
            keys = sides @ (1 << np.arange(bits, dtype=np.int64))
            for t in range(tab):
                among &= keys[left, t][:, None] != keys[right, t][None]
            whole = decode(_stacked(rows["code"], np.uint8), _stacked(rows["factors"], np.float32), dim)
            among &= may_link([v[left] for v in whole], [v[right] for v in whole], threshold, dim)
            a, b = np.nonzero(among)
            if not len(a):
                continue
            some, where = np.unique(np.concatenate([left[a], right[b]]), return_inverse=True)
            pairs = np.zeros((len(some), len(some)), bool)
            pairs[where[: len(a)], where[len(a) :]] = True
            columns = [pa.array(rows[m][some]) for m in (*BLOCK, "id")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in np.packbits(pairs, axis=1)], pa.binary())], names=[*BLOCK, "id", "partners"])

    return run


def _exact(threshold: float):
    """(id, links, root) of each block's pairs, by their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            ids, copies = rows["id"], rows["copies"]
            x = np.array(rows["vector"].tolist(), np.float64)
            x = x / np.abs(x).max(1)[:, None]
            x = x / np.linalg.norm(x, axis=1)[:, None]
            a, b = np.nonzero(np.unpackbits(_stacked(rows["partners"], np.uint8), axis=1, count=len(ids)))
            good = np.zeros(len(a), bool)
            for at in range(0, len(a), 100_000):
                part = slice(at, at + 100_000)
                good[part] = np.einsum("ij,ij->i", x[a[part]], x[b[part]]) >= threshold
            a, b = a[good], b[good]
            links = (np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))).astype(np.int64)
            root = np.arange(len(ids))
            while len(a):
                new = root.copy()
                np.minimum.at(new, a, root[b])
                np.minimum.at(new, b, root[a])
                if (new == root).all():
                    break
                root = new
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids[some], links[some], ids[root[some]])], names=["id", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector."""
    values = F.col("embedding")
    sound = F.coalesce(
        (F.size(values) > 0)
        & ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(values, lambda v: v != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", F.when(sound, F.transform(values, lambda v: v.cast("double") + F.lit(0.0))).alias("embedding"))
    rows = rows.withColumn("code", F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json(F.struct("embedding")), 256)))
    rows = cut(rows.select("vec_id", "code", "embedding"), "vectors")
    # the smallest id stands for a class; a class of null ids alone gets a number of its own
    number = F.coalesce(F.min("vec_id").cast("long"), F.min(F.xxhash64("code").bitwiseAND(F.lit(MADE - 1)).bitwiseOR(F.lit(MADE))))
    classes = cut(rows.where("code is not null").groupBy("code").agg(number.alias("id"), F.first("embedding").alias("embedding"), F.count("*").alias("copies")), "classes")
    bits, tables = plan(classes.count(), threshold)
    codes = cut(classes.select("id", "embedding").mapInArrow(_store(bits, tables), "id long, dim int, code binary, factors binary, sides binary, keys array<long>"), "codes")
    bucket = ["dim", "tab", "key"]
    keyed = codes.select("dim", F.posexplode("keys").alias("tab", "key"), "id", "code", "factors", "sides")
    large = cut(keyed.groupBy(*bucket).agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1"), "large-buckets")
    if large.count() <= FEW_BUCKETS:
        dealt = keyed.join(F.broadcast(large), bucket, "left")
    else:
        dealt = join_spread(cut(keyed, "keyed"), large, bucket, ["id"], "left")
    chunks = F.coalesce("chunks", F.lit(1).cast("long"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    dealt = dealt.select(*bucket, F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "id", "code", "factors", "sides")
    undecided = dealt.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_undecided(threshold, bits), "dim int, tab int, key long, one long, two long, id long, partners binary")
    vectors_of = classes.select("id", "copies", F.col("embedding").cast(dict(vectors.dtypes)["embedding"]).alias("vector"))
    asked = cut(undecided, "undecided").join(vectors_of.hint("merge"), "id").select(*BLOCK, "id", "partners", "copies", "vector")
    found = cut(asked.repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(_exact(threshold), "id long, links long, root long"), "found")
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.select("code", "id", "copies")
        .join(links, "id", "left")
        .join(parts.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("code", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    sound_rows = join_spread(rows.where("code is not null"), named, "code", ["vec_id"], "left")
    component = F.when(F.col("component_id") < MADE, F.col("component_id"))
    out = sound_rows.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"))
    out = out.unionByName(rows.where("code is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
