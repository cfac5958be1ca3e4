"""Clusters of all bases in one job: seeds by k-means||, Lloyd's rounds, silhouettes; every base with its own k.

k-means||: a first vector is drawn for each base; in each round every row is drawn with a chance of 2k times its share of the base's
squared distances to what was drawn so far. Draws are hashes of round, base and id, so a task that is repeated draws the same. The
drawn ones (about 2k a round) are weighed by how many rows are nearest to them, and k of them are picked: the heaviest, then
always the one with the largest weight times distance to those picked.

A row meets only the centres of its base. Centres that take at most `PACKED` bytes go to all tasks; more are joined: a base's
rows are dealt into parts of about `PART` rows, and its centres are repeated for each part, so a base with a third of all rows
is many equal tasks. Means are folded within each Arrow batch before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import DECIMALS
from .spread import cut

PACKED, PART = 16_000_000, 20_000
ASSIGNED = "kb_id string, vec_id long, cluster_id long, d2 double"
FOLDED = "kb_id string, cluster_id long, n long, squares double, sums array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows (kb_id, vec_id, embedding) with a base and a whole vector. The vectors of a base are of one length."""
    good = F.size("embedding") > 0
    good = good & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("kb_id is not null").where(good)


def _nearest(x: np.ndarray, ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (ties, after rounding: the smaller id) and the squared distance; ids ascend."""
    who, how = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, 4_000_000 // max(1, c.size))
    for at in range(0, len(x), step):
        d = ((x[at : at + step, None] - c[None]) ** 2).sum(2)
        best = np.round(d, DECIMALS).argmin(1)
        who[at : at + step], how[at : at + step] = ids[best], d[np.arange(len(d)), best]
    return who, how


Fold = Callable[[str, pa.Table, np.ndarray, np.ndarray], pa.Table]


def _with_centres(vectors: DataFrame, centres: DataFrame, fold: Fold, schema: str) -> DataFrame:
    """`fold` of each base's rows (kb, rows, the centres' ids, the centres), some rows at a time."""
    names = [c.split()[0] for c in schema.split(", ")]
    size = centres.agg(F.sum(8 * F.size("centroid").cast("long") + 64)).first()[0] or 0
    if size <= PACKED:
        held: dict[str, tuple] = {}
        for r in centres.orderBy("kb_id", "cluster_id").collect():  # at most PACKED bytes
            held.setdefault(r["kb_id"], ([], []))
            held[r["kb_id"]][0].append(r["cluster_id"])
            held[r["kb_id"]][1].append(r["centroid"])
        packed = {kb: (np.array(ids, np.int64), np.array(c, float)) for kb, (ids, c) in held.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                kinds = rows["kb_id"].combine_chunks().dictionary_encode()
                codes = kinds.indices.to_numpy()
                for code, kb in enumerate(kinds.dictionary.to_pylist()):
                    if kb in packed:
                        yield from fold(kb, rows.take(pa.array(np.flatnonzero(codes == code))), *packed[kb]).select(names).to_batches()

        return vectors.mapInArrow(run, schema)

    # parts of a base: its rows are counted, its centres are repeated
    parts = vectors.groupBy("kb_id").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts_"))
    repeated = centres.join(parts, "kb_id").withColumn("part_", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1))).drop("parts_")
    dealt = vectors.join(F.broadcast(parts) if parts.count() <= 100_000 else parts.hint("shuffle_hash"), "kb_id").withColumn("part_", F.pmod(F.xxhash64("vec_id"), "parts_")).drop("parts_")

    def group(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return pa.schema(_arrow(schema)).empty_table()
        own = own.sort_by("cluster_id")
        return fold(key[0].as_py(), rows, own["cluster_id"].to_numpy(), _matrix(own["centroid"])).select(names)

    return dealt.groupBy("kb_id", "part_").cogroup(repeated.groupBy("kb_id", "part_")).applyInArrow(group, schema)


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return [(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]


def assign(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(kb_id, vec_id, cluster_id, d2): the nearest centre (kb_id, cluster_id, centroid) of each row in its base."""

    def fold(kb: str, rows: pa.Table, ids: np.ndarray, c: np.ndarray) -> pa.Table:
        who, how = _nearest(_matrix(rows["embedding"]), ids, c)
        return pa.table({"kb_id": rows["kb_id"], "vec_id": rows["vec_id"], "cluster_id": who, "d2": how})

    return _with_centres(_usable(vectors), centres, fold, ASSIGNED)


def _folded(kb: str, x: np.ndarray, who: np.ndarray) -> pa.Table:
    """n, sum of squares and sums of the rows of each cluster."""
    ids, at = np.unique(who, return_inverse=True)
    member = np.zeros((len(ids), len(x)))
    member[at, np.arange(len(x))] = 1
    return pa.table({"kb_id": [kb] * len(ids), "cluster_id": ids, "n": np.bincount(at, minlength=len(ids)), "squares": member @ (x**2).sum(1), "sums": list(member @ x)}, schema=pa.schema(_arrow(FOLDED)))


def _added(folded: DataFrame) -> DataFrame:
    """(kb_id, cluster_id, n, squares, sums): parts of clusters added up."""
    parts = folded.select("kb_id", "cluster_id", "n", "squares", F.posexplode("sums").alias("pos", "x"))
    sums = parts.groupBy("kb_id", "cluster_id", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    listed = sums.groupBy("kb_id", "cluster_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s"), F.max("n").alias("n"), F.max("squares").alias("squares"))
    return listed.select("kb_id", "cluster_id", "n", "squares", F.col("s.x").alias("sums"))


def lloyd(vectors: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(kb_id, cluster_id, centroid, size) after rounds from seeds (kb_id, cluster_id, centroid); clusters without rows go."""

    def fold(kb: str, rows: pa.Table, ids: np.ndarray, c: np.ndarray) -> pa.Table:
        x = _matrix(rows["embedding"])
        return _folded(kb, x, _nearest(x, ids, c)[0])

    rows, centres = _usable(vectors), seeds
    for _ in range(rounds):
        added = _added(_with_centres(rows, centres, fold, FOLDED))
        centres = cut(added.select("kb_id", "cluster_id", F.transform("sums", lambda s: s / F.col("n")).alias("centroid"), F.col("n").alias("size")), "centres")
    return centres


def draw(turn: int, seed: int = 0):
    """A number from 0 to 1 for each row, the same whenever it is asked for."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), "kb_id", F.col("vec_id").cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def seeds(vectors: DataFrame, ks: DataFrame, rounds: int = 3, seed: int = 0) -> DataFrame:
    """(kb_id, cluster_id, centroid): at most k seeds of each base (kb_id, k), by k-means||; cluster_id is a seed's vec_id."""
    rows = _usable(vectors).join(ks.where("k > 0").select(F.col("kb_id").cast("string").alias("kb_id")), "kb_id", "left_semi")
    centre = [F.col("vec_id").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("centroid")]
    drawn = rows.groupBy("kb_id").agg(F.min_by(F.struct("vec_id", "embedding"), F.struct(draw(0, seed), "vec_id")).alias("row_")).select("kb_id", "row_.*")
    found = cut(drawn.select("kb_id", *centre), "drawn")
    wanted = ks.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("k").cast("double").alias("k"))
    for turn in range(1, rounds + 1):
        far = cut(assign(rows, found).select("kb_id", "vec_id", "d2"), "distances")
        whole = far.groupBy("kb_id").agg(F.sum("d2").alias("phi")).join(wanted, "kb_id").where("phi > 0")
        chance = 2 * F.col("k") * F.col("d2") / F.col("phi")
        more = far.join(F.broadcast(whole) if whole.count() <= 100_000 else whole, "kb_id").where((F.col("d2") > 0) & (draw(turn, seed) < chance)).select("kb_id", "vec_id")
        taken = rows.join(more.distinct(), ["kb_id", "vec_id"], "left_semi").dropDuplicates(["kb_id", "vec_id"])
        found = cut(found.unionByName(taken.select("kb_id", *centre)), "drawn")
    weights = assign(rows, found).groupBy("kb_id", "cluster_id").agg(F.count("*").alias("weight"))
    heavy = found.join(weights, ["kb_id", "cluster_id"]).join(wanted, "kb_id")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cluster_id").reset_index(drop=True)
        c, w = np.array(group["centroid"].to_list(), float), group["weight"].to_numpy()
        chosen = [int(w.argmax())]
        near = ((c - c[chosen[0]]) ** 2).sum(1)
        while len(chosen) < min(int(group["k"].iloc[0]), len(group)):
            gain = np.round(w * near, DECIMALS)
            gain[chosen] = -1
            best = int(gain.argmax())
            if gain[best] <= 0:
                break
            chosen.append(best)
            near = np.minimum(near, ((c - c[best]) ** 2).sum(1))
        return group.iloc[sorted(chosen)][["kb_id", "cluster_id", "centroid"]]

    return heavy.groupBy("kb_id").applyInPandas(pick, "kb_id string, cluster_id long, centroid array<double>")  # about 2k * rounds rows


def train(vectors: DataFrame, ks: DataFrame, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(kb_id, cluster_id, centroid, size) of all bases (kb_id, k), clusters numbered from 0 by their seed's id."""
    done = lloyd(vectors, cut(seeds(vectors, ks, seed=seed), "seeds"), rounds)
    ranked = done.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("cluster_id", "centroid", "size"))).alias("all"))  # k rows
    return ranked.select("kb_id", F.posexplode("all").alias("at", "c")).select("kb_id", F.col("at").cast("long").alias("cluster_id"), "c.centroid", "c.size")


def silhouette(assigned: DataFrame) -> DataFrame:
    """(kb_id, cluster_id, size, silhouette): the mean silhouette of each cluster's rows (kb_id, vec_id, embedding, cluster_id), by squared distances.

    The mean squared distance of a row to a cluster follows from the cluster's sum, sum of squares and size, so there are no
    pairs. A row alone in its cluster has 0, and so have all rows of a base with one cluster.
    """
    rows = assigned.select(F.col("kb_id").cast("string").alias("kb_id"), F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("cluster_id").cast("long").alias("cluster_id")).where("cluster_id is not null and kb_id is not null and size(embedding) > 0")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = table["kb_id"].combine_chunks().dictionary_encode()
            for code, kb in enumerate(codes.dictionary.to_pylist()):
                part = table.take(pa.array(np.flatnonzero(codes.indices.to_numpy() == code)))
                yield from _folded(kb, _matrix(part["embedding"]), part["cluster_id"].to_numpy()).to_batches()

    added = cut(_added(rows.mapInArrow(fold, FOLDED)), "sums")
    # a cluster as one vector: its sums, then n and the sum of squares
    centres = added.select("kb_id", "cluster_id", F.concat("sums", F.array(F.col("n").cast("double"), F.col("squares"))).alias("centroid"))

    def score(kb: str, part: pa.Table, ids: np.ndarray, c: np.ndarray) -> pa.Table:
        x, own = _matrix(part["embedding"]), part["cluster_id"].to_numpy()
        sums, n, squares = c[:, :-2], c[:, -2], c[:, -1]
        size = (x**2).sum(1)
        total = np.maximum(n * size[:, None] - 2 * x @ sums.T + squares, 0)
        at = np.searchsorted(ids, own)
        every = np.arange(len(x))
        a = total[every, at] / np.maximum(n[at] - 1, 1)
        others = total / n
        others[every, at] = np.inf
        b = others.min(1)
        wide = np.maximum(a, b)
        good = (n[at] > 1) & np.isfinite(b) & (wide > 0)
        s = np.where(good, (b - a) / np.where(good, wide, 1), 0.0)
        many, where = np.unique(own, return_inverse=True)
        return pa.table({"kb_id": [kb] * len(many), "cluster_id": many, "n": np.bincount(where), "s": np.bincount(where, s)})

    parts = _with_centres(rows, centres, score, "kb_id string, cluster_id long, n long, s double")
    return parts.groupBy("kb_id", "cluster_id").agg(F.sum("n").alias("size"), F.round(F.sum("s") / F.sum("n"), DECIMALS).alias("silhouette"))
