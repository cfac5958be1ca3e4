"""A stored vector index: navigable small-world graphs, built once for each base and walked best-first.

The vectors of a base are dealt by a hash into segments of about `SEGMENT` rows, so the largest base is as many equal tasks as
it needs. A segment becomes one row of the index: its vectors, the ids that share a vector, and a graph over the vectors. The
index is a table with a directory for each base: a query of one base reads no other, dropping a base removes its directory,
and new vectors are appended as further segments.

A graph links each vector to near ones in different directions (one that lies nearer to a link than to the vector itself is left
out), back, and to a few drawn ones, which keep it connected. A query walks from the best of the segment's pivots along the
links, always on from the nearest vectors not yet looked at, until the `breadth` best ones are all looked at. All queries of a
block walk in step, as matrix operations. Only the k best of each query and segment are shuffled.

A walk may miss some. So its k-th best score is a bar, and an exact check follows: a segment's vectors lie in cells around its pivots,
and a query is compared with the cells that, by the angles to their pivot and their farthest vector, can hold one above the bar.

Vectors that are null, empty, all zero or hold null or non-finite entries are not indexed; vectors of several lengths lie in
segments of their own, and a query meets those of its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import DECIMALS, rank_matches
from .spread import join_spread

SEGMENT, SEGMENT_BYTES = 8_192, 32_000_000
NEAR, BACK, DRAWN, CANDIDATES, PIVOTS = 14, 10, 4, 40, 128
BREADTH, STEP, TOGETHER = 64, 4, 128
PACKED = 16_000_000  # bytes of queries that go to all tasks at a time; more take further passes over the index
FEW_BASES = 100_000
SCHEMA = "segment string, dim int, n_rows int, ids array<long>, copies array<int>, vectors binary, links binary, pivots binary, kb_part string"


def _units(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def graph(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (-1: none) and pivots over different unit vectors."""
    n, rng = len(x), np.random.default_rng(len(x))
    near = np.full((n, NEAR), -1, np.int32)
    close = np.full((n, NEAR), -2, np.float32)
    m = min(CANDIDATES, n - 1)
    for at in range(0, n if m else 0, 256):
        rows = np.arange(at, min(at + 256, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -3
        some = np.argpartition(sims, n - m, axis=1)[:, n - m :]
        own = np.take_along_axis(sims, some, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        some, own = np.take_along_axis(some, order, 1), np.take_along_axis(own, order, 1)
        among = np.matmul(x[some], x[some].transpose(0, 2, 1))
        taken, count = np.zeros(own.shape, bool), np.zeros(len(rows), int)
        for c in range(m):
            apart = ~((among[:, c] >= own[:, c : c + 1]) & taken).any(1)
            taken[:, c] = apart & (count < NEAR)
            count += taken[:, c]
        # the nearest of those left out fill what is free
        first = np.argsort(~taken, axis=1, kind="stable")[:, :NEAR]
        near[rows, : first.shape[1]] = np.take_along_axis(some, first, 1)
        close[rows, : first.shape[1]] = np.take_along_axis(own, first, 1)
    source, sink, sim = np.repeat(np.arange(n), NEAR), near.ravel(), close.ravel()
    source, sink, sim = source[sink >= 0], sink[sink >= 0], sim[sink >= 0]
    order = np.lexsort((-sim, sink))
    source, sink = source[order], sink[order]
    place = np.arange(len(sink)) - np.searchsorted(sink, sink)
    back = np.full((n, BACK), -1, np.int32)
    back[sink[place < BACK], place[place < BACK]] = source[place < BACK]
    drawn = rng.integers(0, n, (n, DRAWN), dtype=np.int32)
    return np.concatenate([near, back, drawn], 1), rng.permutation(n)[:PIVOTS].astype(np.int32)


def walk(x: np.ndarray, links: np.ndarray, pivots: np.ndarray, q: np.ndarray, breadth: int) -> np.ndarray:
    """For each query the nodes (-1: none) that a best-first walk ends with, `breadth` at most."""
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    seen[:, pivots] = True
    beam = np.broadcast_to(pivots, (len(q), len(pivots))).astype(np.int64)
    sims, open_ = q @ x[pivots].T, np.ones(beam.shape, bool)
    while True:
        if beam.shape[1] > breadth:
            best = np.argpartition(-sims, breadth - 1, axis=1)[:, :breadth]
            beam, sims, open_ = (np.take_along_axis(a, best, 1) for a in (beam, sims, open_))
        going = np.flatnonzero((open_ & (sims > -2)).any(1))
        if not len(going):
            return np.where(sims > -2, beam, -1)
        some = np.where(open_[going], sims[going], -3)
        step = min(STEP, some.shape[1])
        top = np.argpartition(-some, step - 1, axis=1)[:, :step]
        use = np.take_along_axis(some, top, 1) > -2
        open_[going[:, None], top] = False
        nodes = np.where(use, np.take_along_axis(beam[going], top, 1), -1)
        ahead = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(going), -1).astype(np.int64)
        ahead.sort(axis=1)
        ahead[:, 1:][ahead[:, 1:] == ahead[:, :-1]] = -1
        ahead[seen[going[:, None], ahead]] = -1
        seen[going[:, None], ahead] = True
        new = np.where(ahead >= 0, np.einsum("qmd,qd->qm", x[ahead], q[going]), -3).astype(np.float32)
        wide = ahead.shape[1]
        beam = np.concatenate([beam, np.full((len(q), wide), -1)], 1)
        sims = np.concatenate([sims, np.full((len(q), wide), -3, np.float32)], 1)
        open_ = np.concatenate([open_, np.zeros((len(q), wide), bool)], 1)
        beam[going, -wide:], sims[going, -wide:], open_[going, -wide:] = ahead, new, ahead >= 0


def cells(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each unit vector, and each pivot's angle to the farthest of its vectors (-1: it has none)."""
    own, angles = np.zeros(len(x), np.int64), np.full(len(pivots), -1.0)
    for at in range(0, len(x), 1024):
        sims = x[at : at + 1024] @ x[pivots].T
        own[at : at + 1024] = sims.argmax(1)
        np.maximum.at(angles, own[at : at + 1024], np.arccos(np.clip(sims.max(1), -1, 1)))
    return own, angles


def above(x: np.ndarray, q: np.ndarray, bars: np.ndarray, pivots: np.ndarray, own: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, score) of all unit vectors whose rounded cosine is at least the query's bar."""
    # the least angle that a vector of a cell can have to a query, and the angle of the bar; both with room for rounding
    least = np.arccos(np.clip(q @ x[pivots].T, -1, 1)) - angles
    near = (least <= np.arccos(np.clip(bars - 10.0**-DECIMALS, -1, 1))[:, None] + 1e-6) & (angles >= 0)
    found = []
    order = np.argsort(own, kind="stable")
    ends = np.searchsorted(own[order], np.arange(len(pivots) + 1))
    for group in np.unique(near, axis=0):  # queries that look into the same cells
        some, nodes = np.flatnonzero((near == group).all(1)), np.concatenate([order[ends[c] : ends[c + 1]] for c in np.flatnonzero(group)] or [order[:0]])
        for at in range(0, len(nodes), 8192):
            part = nodes[at : at + 8192]
            scores = np.round(q[some] @ x[part].T, DECIMALS)
            i, j = np.nonzero(scores >= bars[some][:, None])
            found.append((some[i], part[j], scores[i, j]))
    who, node, score = (np.concatenate(c) for c in zip(*found))
    return who, node, score


def _segment(table: pa.Table) -> pa.Table:
    """The rows of a segment (kb_part, segment, dim, vec_id, embedding) as one row of the index."""
    dim = table["dim"][0].as_py()
    x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    ids = table["vec_id"].to_numpy()
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    x, ids = x[good], ids[good]
    names = ["segment", "dim", "n_rows", "ids", "copies", "vectors", "links", "pivots", "kb_part"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.string()]
    if not len(x):
        return pa.table([pa.array([], t) for t in kinds], names=names)
    different, which = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    links, pivots = graph(_units(different.astype(float)))
    values = [table["segment"][0].as_py(), dim, len(ids), ids[order], np.bincount(which.ravel()).astype(np.int32), different.astype(x.dtype).tobytes(), links.tobytes(), pivots.tobytes(), table["kb_part"][0].as_py()]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=names)


def append(vectors: DataFrame, path: str) -> None:
    """Index further vectors (kb_part, vec_id, embedding); what was there is not read. Equal rows count once."""
    rows = vectors.where("kb_part is not null").select("kb_part", F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim")).where("dim > 0 and vec_id is not null").distinct()
    most = F.greatest(F.least(F.lit(SEGMENT), (SEGMENT_BYTES / (8 * F.col("dim"))).cast("int")), F.lit(1))
    sizes = rows.groupBy("kb_part", "dim").agg(F.count("*").alias("n")).select("kb_part", "dim", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(sizes), ["kb_part", "dim"]) if sizes.count() <= FEW_BASES else join_spread(rows, sizes, ["kb_part", "dim"], ["vec_id"])
    name = F.concat_ws("-", F.lit(uuid4().hex[:12]), "dim", F.pmod(F.xxhash64("vec_id", "embedding"), "parts"))
    kept = dealt.select("kb_part", name.alias("segment"), "dim", "vec_id", "embedding")
    kept.groupBy("kb_part", "segment").applyInArrow(_segment, SCHEMA).write.mode("append").partitionBy("kb_part").parquet(path)


def build(vectors: DataFrame, path: str) -> None:
    """Index vectors (kb_part, vec_id, embedding) at a path where nothing is yet."""
    append(vectors, path)


def stored(spark: SparkSession, path: str, kb_part: str | None = None) -> DataFrame:
    """The index; of one base only its directory is read."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if kb_part is None else rows.where(F.col("kb_part") == kb_part)


def contents(index: DataFrame) -> DataFrame:
    """(kb_part, vec_id): what is indexed."""
    return index.select("kb_part", F.explode("ids").alias("vec_id"))


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries (query_id, embedding) by length, in blocks of at most PACKED bytes."""
    asked = queries.where(F.size("embedding") > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))
    for r in asked.groupBy("dim").count().collect():  # one row for each length of vectors
        parts = -(-r["count"] * r["dim"] * 8 // PACKED)
        for part in range(parts):
            rows = asked.where((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).collect()
            q = np.array([x["embedding"] for x in rows], float).reshape(-1, r["dim"])
            good = np.isfinite(q).all(1) & (q != 0).any(1)
            yield np.array([x["query_id"] for x in rows], np.int64)[good], q[good]


def nearest(index: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, breadth: int = BREADTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest indexed vectors by cosine for each query (query_id, embedding), ties by the smaller id."""

    def near(own: np.ndarray, q: np.ndarray):
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)

        def found(row: dict) -> Iterator[pd.DataFrame]:
            if row["dim"] != q.shape[1] or not len(q):
                return
            size = len(row["copies"])
            kind = np.float64 if len(row["vectors"]) == 8 * size * row["dim"] else np.float32
            x = np.frombuffer(row["vectors"], kind).reshape(size, -1).astype(float)
            whole = x / np.linalg.norm(x, axis=1, keepdims=True)
            units, links, pivots = whole.astype(np.float32), np.frombuffer(row["links"], np.int32).reshape(size, -1), np.frombuffer(row["pivots"], np.int32)
            ids, copies = np.asarray(row["ids"]), np.asarray(row["copies"])
            starts = np.cumsum(copies) - copies
            own_cells, angles = cells(whole, pivots)
            for at in range(0, len(q), TOGETHER):
                some = unit[at : at + TOGETHER]
                nodes = walk(units, links, pivots, some.astype(np.float32), max(breadth, k))
                scores = np.where(nodes >= 0, np.round(np.einsum("qmd,qd->qm", whole[nodes], some), DECIMALS), -np.inf)
                ordered = -np.sort(-scores, axis=1)
                bars = ordered[:, k - 1] if ordered.shape[1] >= k else np.full(len(some), -np.inf)
                who, node, score = above(whole, some, bars, pivots, own_cells, angles)
                # ids of equal vectors ascend, so the first k of each are enough
                many = np.minimum(copies[node], k)
                first = np.repeat(starts[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                got = pd.DataFrame({"query_id": own[at + np.repeat(who, many)], "vec_id": ids[first], "score": np.repeat(score, many)})
                yield got.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    held = list(found(batch.slice(i, 1).to_pylist()[0]))
                    if held:
                        yield pa.RecordBatch.from_pandas(pd.concat(held), preserve_index=False)

        return run

    kind = "query_id long, vec_id long, score double"
    parts = [index.select("dim", "ids", "copies", "vectors", "links", "pivots").mapInArrow(near(own, q), kind) for own, q in _blocks(queries)]
    if not parts:
        parts = [index.sparkSession.createDataFrame([], kind)]
    all_ = parts[0]
    for part in parts[1:]:
        all_ = all_.unionByName(part)
    if min_score is not None:
        all_ = all_.where(F.col("score") >= min_score)
    return rank_matches(all_, k, item="vec_id").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")
