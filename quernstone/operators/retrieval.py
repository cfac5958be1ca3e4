"""Filters, nearest vectors, hybrid ranking.

A query's keywords are scored by BM25 and its text by the cosine of hashed trigrams. Queries are few and packed into blocks
of QUERIES, which go to all tasks; rows are read in Arrow batches, scored against a whole block by matrix products, and
a task keeps only the best of each query. So nothing of the rows is shuffled but those, however many rows there are.
Further blocks are further passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from ..functions.keys import kb_part
from ..functions.metadata import condition
from ..functions.text import tokens
from ..jobs.scratch import scratch
from .access import scoped
from .embedding import embed_with
from .spread import cut
from .trigrams import TrigramEmbedder, unit_vectors

DECIMALS, QUERIES, CELLS, K1, B, PACKED = 6, 256, 1_000_000, 1.2, 0.75, 16_000_000
ROWS = 2_000  # rows that are compared at once
HELD = 200_000  # matches that a task holds before it drops all but the best of each query


def compile_filter(spec: dict | None, columns: list[str], variants: tuple[str, ...] = ()) -> Column:
    """A filter such as {"and": [{"field": "lang", "op": "=", "value": "en"}, ...]} as a column.

    A field is a column, or a path below one of the variant columns, such as `metadata.size.chars`.
    """
    if not spec:
        return F.lit(True)
    if "and" in spec:
        return reduce(lambda a, b: a & b, [compile_filter(s, columns, variants) for s in spec["and"]], F.lit(True))
    if "or" in spec:
        return reduce(lambda a, b: a | b, [compile_filter(s, columns, variants) for s in spec["or"]], F.lit(False))
    if "not" in spec:
        return ~compile_filter(spec["not"], columns, variants)
    field, op, value = spec["field"], spec["op"], spec.get("value")
    root = next((v for v in variants if field.startswith((f"{v}.", f"{v}["))), None)
    if root is not None and field not in columns:
        return condition(F.col(root), field[len(root) :], op, value)
    if field not in columns:
        raise ValueError(f"unknown field {field!r}")
    column = F.col(field)
    made = {
        "=": lambda: column == value,
        "<>": lambda: column != value,
        "<": lambda: column < value,
        "<=": lambda: column <= value,
        ">": lambda: column > value,
        ">=": lambda: column >= value,
        "in": lambda: column.isin(list(value)),
        "contains": lambda: column.contains(value),
        "exists": lambda: column.isNotNull() if value is not False else column.isNull(),
    }
    if op not in made:
        raise ValueError(f"unknown operation {op!r}")
    return made[op]()


def tag_filter(tags: dict[str, str]) -> Column:
    """All given slots must hold the given values."""
    return reduce(lambda a, b: a & b, [F.col(slot) == value for slot, value in tags.items()], F.lit(True))


def rank_matches(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query; scores are rounded first, and ties go to the smaller id."""
    rounded = scored.withColumn(score, F.round(score, DECIMALS))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def _sized(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of each cluster gathered into blocks of about `size`."""
    n = rows.count()
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // size))))
    rows = rows.groupBy("cluster_id", block.alias(name)).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias(f"{name}_rows"))
    return rows.drop(name)


def _top(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, min_score: float | None, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows (in rows) of each query (in columns) by cosine; ties by the smaller id. No match: -inf."""
    size_x, size_q = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    order = np.argsort(ids)
    ids, x, size_x = ids[order], x[order], size_x[order]
    scores = np.round((x / np.maximum(size_x, 1e-300)[:, None]) @ (q / np.maximum(size_q, 1e-300)[:, None]).T, DECIMALS)
    match = (size_x > 0)[:, None] & (size_q > 0)[None]
    if open_ is not None:
        match &= open_[order]
    if min_score is not None:
        match &= scores >= min_score
    scores = np.where(match, scores, -np.inf)
    top = np.argsort(-scores, axis=0, kind="stable")[:k]
    return ids[top], np.take_along_axis(scores, top, 0)


def _nearest(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int, min_score: float | None) -> pd.DataFrame:
    """The k best rows of each query among these, by cosine; ties by the smaller id."""
    row, score = _top(ids, x, q, k, min_score)
    good = score > -np.inf
    return pd.DataFrame({"query_id": np.broadcast_to(own, row.shape)[good], "vec_id": row[good], "score": score[good]})


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, min_score: float | None = None, size: int = 2_000, packed: int = PACKED, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine for each query (query_id, embedding).

    Queries that pack into about `packed` bytes go to all tasks; a task keeps the k best of each, and nothing else is shuffled. More
    queries take more passes. With `allowed` (query_id, cluster_id) a query looks only at rows of these clusters, and rows
    have a cluster_id; more queries then meet the rows of their clusters in pairs of blocks of bounded size.
    """
    vectors, queries = vectors.where("embedding is not null"), queries.where("embedding is not null")
    kind = "query_id long, vec_id long, score double"
    width = queries.agg(F.sum(F.size("embedding").cast("long"))).first()[0] or 0
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if 8 * width <= packed:
        rows = asked.collect()
        own, q = np.array([r["query_id"] for r in rows]), np.array([r["embedding"] for r in rows])
        clusters: dict[int, list] = {}
        pruned = allowed is not None
        if pruned:
            at = {o: i for i, o in enumerate(own.tolist())}
            for r in allowed.collect():  # a few clusters for each query
                clusters.setdefault(at[r["query_id"]], []).append(r["cluster_id"])

        def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # a task holds the k best of each query so far, and nothing that grows with its rows
            best, who = np.full((k, len(own)), -np.inf), np.zeros((k, len(own)), np.int64)
            for part in parts:
                for a in range(0, len(part) if len(own) else 0, ROWS):
                    some = part.iloc[a : a + ROWS]
                    ids, x = some["vec_id"].to_numpy(), np.array(some["embedding"].to_list(), float)
                    step = max(1, CELLS // len(some))
                    for b in range(0, len(own), step):
                        now = slice(b, b + step)
                        open_ = None if not pruned else np.stack([some["cluster_id"].isin(clusters.get(i, [])).to_numpy() for i in range(*now.indices(len(own)))], 1)
                        row, score = _top(ids, x, q[now], k, min_score, open_)
                        row, score = np.concatenate([who[:, now], row]), np.concatenate([best[:, now], score])
                        order = np.lexsort((row, -score), axis=0)[:k]
                        who[:, now], best[:, now] = np.take_along_axis(row, order, 0), np.take_along_axis(score, order, 0)
            good = best > -np.inf
            yield pd.DataFrame({"query_id": np.broadcast_to(own, best.shape)[good], "vec_id": who[good], "score": best[good]})

        found = vectors.select("vec_id", "embedding", *(["cluster_id"] if pruned else [])).mapInPandas(near, kind)
        return rank_matches(found, k, item="vec_id").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")

    if allowed is None:
        # further queries are further passes over the rows; only the k best of each query leave a pass
        spark, path = vectors.sparkSession, scratch(vectors.sparkSession, "nearest")
        parts = min(-(-8 * width // max(1, packed)), queries.count())
        for part in range(parts):
            some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
            vector_topk(vectors, some, k, min_score, size, 1 << 62).write.mode("append").parquet(path)
        return spark.read.schema("query_id long, rank long, vec_id long, score double").parquet(path)

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rows, some in zip(part["d_rows"], part["q_rows"]):
                yield _nearest(np.array([r["id"] for r in rows]), np.stack([r["v"] for r in rows]), np.array([r["id"] for r in some]), np.stack([r["v"] for r in some]), k, min_score)

    asked = asked.join(allowed.select("query_id", "cluster_id"), "query_id")
    pairs = _sized(vectors, "vec_id", "embedding", size, "d").join(_sized(asked, "query_id", "embedding", size, "q"), "cluster_id")
    pairs = pairs.repartition(F.xxhash64(F.col("d_rows")[0]["id"], F.col("q_rows")[0]["id"]))  # pairs of blocks, not their cluster, are the units of work
    found = pairs.select("d_rows", "q_rows").mapInPandas(best, kind)
    return rank_matches(found, k, item="vec_id").select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@dataclass
class Block:
    """Queries packed for scoring: their terms, who asks for which, and their trigram vectors."""

    ids: np.ndarray
    terms: list[str]
    asks: np.ndarray  # terms x queries
    vectors: np.ndarray  # buckets x queries
    n_tokens: int
    allowed: dict | None = None  # the clusters that each query looks into, by its number
    idf: np.ndarray | None = None
    mean: float = 1.0
    best: np.ndarray | None = None


def query_blocks(queries: DataFrame, buckets: int, size: int = QUERIES) -> Iterator[Block]:
    """The queries (query_id, text), at most about `size` at a time."""
    many = max(1, -(-queries.count() // size))
    for i in range(many):
        own = queries if many == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(many)) == i)
        rows = own.select(F.col("query_id").cast("long").alias("query_id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), tokens(F.coalesce("text", F.lit(""))).alias("words")).orderBy("query_id").collect()
        if rows:
            terms = sorted({w for r in rows for w in r["words"]})
            at = {t: j for j, t in enumerate(terms)}
            asks = np.zeros((len(terms), len(rows)))
            for j, r in enumerate(rows):
                asks[[at[w] for w in set(r["words"])], j] = 1
            yield Block(np.array([r["query_id"] for r in rows]), terms, asks, unit_vectors([r["low"] for r in rows], buckets).T, sum(len(r["words"]) for r in rows))


def _asked_words(block: Block) -> Column:
    """The words of a row that a query of the block asks for."""
    words = tokens(F.col("text"))
    return F.filter(words, lambda w: w.isin(block.terms)) if block.terms else F.array().cast("array<string>")


def _weigh(seen: DataFrame, block: Block) -> None:
    """Document frequencies and the mean length, over all rows (len, hit); at most a row for each term reaches the driver."""
    length = F.struct(F.lit(None).cast("string").alias("term"), F.col("len"))
    counted = seen.select(F.explode(F.concat(F.array(length), F.transform(F.array_distinct("hit"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("len"))))).alias("x"))
    found = {r["term"]: r for r in counted.groupBy("x.term").agg(F.count("*").alias("df"), F.avg("x.len").alias("mean")).collect()}
    whole = found.pop(None, None)
    n = whole["df"] if whole else 0
    df = np.array([found[t]["df"] if t in found else 0 for t in block.terms], float)
    block.idf, block.mean = np.log(1 + (n - df + 0.5) / (df + 0.5)), (whole["mean"] or 1.0) if whole else 1.0


def _keyword_scores(block: Block, sizes: np.ndarray, hits: pa.ListArray) -> np.ndarray:
    """BM25 of each row for each query."""
    counts = np.diff(hits.offsets.to_numpy())
    at = pc.index_in(hits.flatten(), pa.array(block.terms, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
    n, t = len(sizes), len(block.terms)
    tf = np.bincount(np.repeat(np.arange(n), counts) * t + at, minlength=n * t).reshape(n, t)
    weight = np.where(tf > 0, block.idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[:, None] / block.mean)), 0)
    return weight @ block.asks


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """Parts whose score matrices stay small."""
    step = max(1, CELLS // max(1, width))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def _best_keyword_scores(seen: DataFrame, block: Block) -> np.ndarray:
    """The highest keyword score of each query over all rows (len, hit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(block.ids))
        for batch in batches:
            for part in _slices(batch, len(block.terms)):
                best = np.maximum(best, _keyword_scores(block, part.column(0).to_numpy(), pa.concat_arrays([part.column(1)])).max(0, initial=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(best)), pa.int32()), pa.array(best)], names=["at", "best"])

    out = np.zeros(len(block.ids))
    for r in seen.where(F.size("hit") > 0).mapInArrow(run, "at int, best double").groupBy("at").agg(F.max("best").alias("best")).collect():
        out[r["at"]] = r["best"]
    return out


def _best_matches(found: list[tuple], k: int) -> tuple:
    """Of matches (query, id, score, ...) as arrays, the k best of each query; ties go to the smaller id."""
    q, ids, score, *others = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
    keep = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]
    return tuple(c[keep] for c in (q, ids, score, *others))


def scored(rows: DataFrame, queries: DataFrame, ranks: dict[str, int], keyword_weight: float = 0.4, min_score: float = 0.0, buckets: int = 512, allowed: DataFrame | None = None, item: str = "doc_id") -> DataFrame:
    """(list, query_id, item, score, vector_score, keyword_score, rank): for each of `ranks` ("keyword", "vector", "hybrid") its best rows.

    Rows have (item, text), and a cluster_id if `allowed` (query_id, cluster_id) restricts queries to clusters. A row that
    shares neither a word nor a trigram's bucket with a query is no match. Scores are rounded; ties go to the smaller item.
    keyword_score is a share of the query's highest one in "hybrid".
    """
    rows = rows.where(F.col("text").isNotNull())
    kind, names, most_held = dict(rows.dtypes)[item], list(ranks), HELD

    def best(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[tuple]] = {name: [] for name in names}
            for batch in batches:
                for part in _slices(batch, max(len(block.terms), len(block.ids), buckets)):
                    ids = np.array(part.column(0).to_pylist(), object)
                    order = np.argsort(ids)
                    part, ids = part.take(pa.array(order)), ids[order]
                    word = _keyword_scores(block, part.column(2).to_numpy(), pa.concat_arrays([part.column(3)])) if block.idf is not None else np.zeros((len(ids), len(block.ids)))
                    near = unit_vectors(part.column(1).to_pylist(), buckets) @ block.vectors if "vector" in names or "hybrid" in names else np.zeros_like(word)
                    open_ = np.ones(near.shape, bool)
                    if block.allowed is not None:
                        own = part.column(4).to_numpy(zero_copy_only=False)
                        open_ = np.stack([np.isin(own, list(block.allowed.get(q, ()))) for q in range(len(block.ids))], 1)
                    for name in names:
                        if name == "hybrid":
                            share = word / np.where(block.best > 0, block.best, 1)
                            score = np.round((1 - keyword_weight) * near + keyword_weight * share, DECIMALS)
                            match = open_ & ((near > 0) | (word > 0)) & (score >= min_score)
                        else:
                            share, score = word, np.round(word if name == "keyword" else near, DECIMALS)
                            match = open_ & ((word if name == "keyword" else near) > 0)
                        top = np.argsort(np.where(match, -score, np.inf), axis=0, kind="stable")[: ranks[name]]
                        row, q = top.ravel(), np.tile(np.arange(len(block.ids)), len(top))
                        good = match[row, q]
                        row, q = row[good], q[good]
                        held[name].append((q, ids[row], score[row, q], np.round(near[row, q], DECIMALS), np.round(share[row, q], DECIMALS)))
                        if sum(len(f[0]) for f in held[name]) > most_held:
                            held[name] = [_best_matches(held[name], ranks[name])]
            for name, found in held.items():
                if found:
                    q, ids, *scores = _best_matches(found, ranks[name])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(q)), pa.array(block.ids[q], pa.int64()), pa.array(ids.tolist(), part.schema.field(0).type), *map(pa.array, scores)],
                        names=["list", "query_id", item, "score", "vector_score", "keyword_score"],
                    )

        return run

    schema = f"list string, query_id long, {item} {kind}, score double, vector_score double, keyword_score double"
    found = []
    for block in query_blocks(queries, buckets):
        if block.terms and ("keyword" in names or "hybrid" in names):
            seen = rows.select(F.size(tokens(F.col("text"))).alias("len"), _asked_words(block).alias("hit"))
            if "hybrid" in names:  # then it is read twice; the words that are asked for are few
                seen = cut(seen, "asked-words")
            _weigh(seen, block)
            block.best = _best_keyword_scores(seen, block) if "hybrid" in names else None
        if block.best is None:
            block.best = np.zeros(len(block.ids))
        if allowed is not None:
            at = {q: i for i, q in enumerate(block.ids.tolist())}
            block.allowed = {}
            for r in allowed.where(F.col("query_id").isin(list(at))).collect():  # a few clusters for each query of the block
                block.allowed.setdefault(at[r["query_id"]], set()).add(r["cluster_id"])
        columns = [item, F.lower("text").alias("low"), F.size(tokens(F.col("text"))).alias("len"), _asked_words(block).alias("hit"), *(["cluster_id"] if allowed is not None else [])]
        found.append(rows.select(*columns).mapInArrow(best(block), schema))
    if not found:
        return rows.sparkSession.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(Window.partitionBy("list", "query_id").orderBy(F.desc("score"), item))
    most = F.lit(0)
    for name, k in ranks.items():
        most = F.when(F.col("list") == name, k).otherwise(most)
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= most)


def keyword_matches(rows: DataFrame, queries: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """(query_id, rank, item, score): the k best by BM25."""
    found = scored(rows, queries, {"keyword": k}, item=item)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), item, "score")


def hybrid(rows: DataFrame, queries: DataFrame, k: int, keyword_weight: float = 0.4, min_score: float = 0.0, buckets: int = 512, item: str = "doc_id", allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, item, score, vector_score, keyword_score): (1 - w) * cosine + w * BM25 / best BM25.

    The two lists of candidates are joined in full; a missing score counts 0.
    """
    found = scored(rows, queries, {"hybrid": k}, keyword_weight, min_score, buckets, allowed, item)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), item, "score", "vector_score", "keyword_score")


def hybrid_rrf(rows: DataFrame, queries: DataFrame, k: int, depth: int = 50, c: int = 60, buckets: int = 512) -> DataFrame:
    """Reciprocal rank fusion of the `depth` best of each list: the sum of 1 / (c + rank)."""
    lists = scored(rows, queries, {"keyword": depth, "vector": depth}, buckets=buckets)
    votes = lists.select("query_id", "doc_id", (F.lit(1.0) / (c + F.col("rank"))).alias("vote"))
    fused = votes.groupBy("query_id", "doc_id").agg(F.sum("vote").alias("score"))
    return rank_matches(fused, k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def query(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 5,
    mode: str = "hybrid",
    where: dict | None = None,
    tags: dict[str, str] | None = None,
    include_content: bool = False,
    item: str = "doc_id",
    neighbour_clusters: int | None = None,
    centroids: DataFrame | None = None,
    buckets: int = 512,
    **options,
) -> DataFrame:
    """The matches of each query: filters are applied before anything is scored, content is joined only on request.

    Rows are documents or chunks, by their id column `item`. With neighbour_clusters, rows have a cluster_id, and only those
    in the cluster nearest to a query and in so many next ones are scored; centroids are (cluster_id, centroid) of trigram vectors.
    """
    kept = filtered(rows, mode, where, tags)
    if mode == "v1-tags":
        options |= {"keyword_weight": 0.0}
    allowed = None
    if neighbour_clusters is not None:
        from .clusters import nearest_clusters

        embedded = queries.select("query_id", embed_with(TrigramEmbedder(buckets))("text").alias("embedding"))
        allowed = nearest_clusters(embedded, centroids, neighbour_clusters).select("query_id", "cluster_id")
    found = hybrid(kept.select(item, "text", *(["cluster_id"] if allowed is not None else [])), queries, k, item=item, allowed=allowed, buckets=buckets, **options)
    if include_content:
        found = found.join(kept.select(item, F.col("text").alias("content")), item)
    return found


def _variants(rows: DataFrame) -> tuple[str, ...]:
    return tuple(f.name for f in rows.schema.fields if isinstance(f.dataType, VariantType))


def filtered(rows: DataFrame, mode: str = "hybrid", where: dict | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """The rows that a query looks at."""
    return rows.where(_kept(rows, mode, where, tags))


def _kept(rows: DataFrame, mode: str, where: dict | None, tags: dict[str, str] | None) -> Column:
    if mode not in ("hybrid", "v1-tags"):
        raise ValueError(f"unknown mode {mode!r}")
    included = F.col("included") if "included" in rows.columns else F.lit(True)
    kept = included & compile_filter(where, rows.columns, _variants(rows))
    return kept & tag_filter(tags or {}) if mode == "v1-tags" else kept


@dataclass
class Answer:
    """What a client gets: matches (query_id, rank, item, scores), one row of usage, and one row of diagnostics for each query."""

    matches: DataFrame
    usage: DataFrame
    diagnostics: DataFrame


def answer(chunks: DataFrame, clients: DataFrame, client_id: str, kb_id: str, queries: DataFrame, k: int = 5, where: dict | None = None, tags: dict[str, str] | None = None, mode: str = "hybrid", **options) -> Answer:
    """A client's query of one knowledge base's chunks (chunk_id, kb_id, kb_part, text and whatever filters name).

    Rows outside the client's scope are never seen; the base's partition is read alone.
    """
    base = chunks.where((F.col("kb_id") == kb_id) & (F.col("kb_part") == kb_part(F.lit(kb_id))))
    seen = scoped(base, clients, client_id)
    matches = query(seen, queries, k, mode, where, tags, item="chunk_id", **options)
    counted = seen.agg(F.count("*").alias("scanned"), F.count_if(_kept(seen, mode, where, tags)).alias("kept"))
    words = queries.agg(F.coalesce(F.sum(F.size(tokens(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("query_tokens"))
    found = matches.groupBy("query_id").agg(F.count("*").alias("matches"), F.max("score").alias("best_score"), F.min("score").alias("least_score"))
    return Answer(matches, counted.crossJoin(words), queries.select("query_id").join(found, "query_id", "left").fillna(0, ["matches"]))


def usage(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: rows scanned, rows returned."""
    return docs.agg(F.count("*").alias("scanned")).crossJoin(matches.agg(F.count("*").alias("returned")))
