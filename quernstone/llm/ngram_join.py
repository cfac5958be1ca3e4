"""N-gram Jaccard join by a token-group matrix: exact links between sets of word shingles, and components.

A text's words are runs of other characters than white space, A-Z lower-cased; its set holds the hashes of
all distinct five-word shingles, or of the whole sequence where there are fewer words. Two sets link when
100 * intersection >= 75 * union. Equal sets are handled once.

Tokens are put in a global order, rarest first, by counts of all documents in SLOTS slots. If two sets of n and
m tokens link, they share at least a = ceil(3 * (n + m) / 7) tokens, and of the first n - ceil(3 * n / 4) + 1
of one (the set whose first part ends earlier) all but n - a lie in the first part of the other. So:

1. Groups. Only first parts are shuffled, by TOKEN_BITS bits of the token (two tokens of a set that agree in these
   cost one of the count, which the bound makes up for). Each set meets the smallest set of each of its tokens (its
   pivots); sets that share enough tokens with a pivot make a group of similar sets, in chunks of at most CHUNK.
   A set asks its own group first: all pairs of a chunk are counted as a matrix product. Links give components.
2. The matrix. All sets that share a token with another are dealt into groups of like sets: those of a component or
   of the pivot they share most with, of about equal size, at most CHUNK or so. The matrix of tokens and groups holds
   each group's union of tokens that more than one component has. The tokens that a set shares with a union
   bound its overlap with each member; groups that meet the bound are opened, all others are skipped. The last
   links join components.

Every pair that could link is either counted or in one component already, so components are exact, up to
collisions of 48-bit hashes within a pair. No pairs of a group are written, only links of each chunk to its first member.

No key is hot. A token whose slot holds more tokens than a mean shuffle partition is salted: what its holders have in
common is found for each salt, then over the salts. Joins on a pivot, a set or a group are spread likewise where one
of them has too many rows, as copies of one text can be a third of all rows.

Nulls: a null or empty text has no shingles and is its own component; a null doc_id is never smallest.
Repeated rows get equal results. An empty table gives no rows. Very long texts are processed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, components, cut, free_name, join_spread, mix, slices, span_hashes

WORDS, SLOTS, CHUNK, TOKEN_BITS = 5, 1 << 18, 64, 44
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28  # of the table of wanted texts: 32 MB at most
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STEPS = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(WORDS)], np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    none = [np.zeros(0, np.uint64)]
    if not len(texts) or offsets[-1] == offsets[0]:
        return none * len(texts)
    units = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inner = ~SPACE[units]
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = inner[heads]
    starts = np.nonzero(begin)[0]
    if not len(starts):
        return none * len(texts)
    stop = inner.copy()
    stop[:-1] &= ~inner[1:]
    tails = heads[1:] - 1
    stop[tails] = inner[tails]
    words = span_hashes(units, starts, np.nonzero(stop)[0] + 1)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled += words[j : j + len(rolled)] * STEPS[j]
    rolled = mix(rolled)
    bounds = np.searchsorted(starts, offsets)
    out = []
    for a, b, there in zip(bounds[:-1].tolist(), bounds[1:].tolist(), texts.is_valid().to_pylist()):
        if not there or a == b:
            out += none
        elif b - a < WORDS:
            out.append(mix((words[a:b] * STEPS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            own = np.sort(rolled[a : b - WORDS + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
    return out


def set_id(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(mix(tokens).sum() ^ np.uint64(len(tokens))).view(np.int64)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, set_id, text_key) of each document; at the end the slot counts of the partition, in blocks."""
    counts, kind = np.zeros(SLOTS, np.int64), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for part in slices(batch, 1):
            sets = shingle_sets(part.column(1))
            every = np.concatenate(sets)
            counts += np.bincount((every >> np.uint64(46)).astype(np.int64), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), part.column(2), pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.list_(pa.int64()))],
                names=["doc_id", "n", "set_id", "text_key", "block", "counts"],
            )
    if kind is not None:
        blocks = counts.reshape(64, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(64, kind), *[pa.nulls(64, pa.int64())] * 3, pa.array(range(64), pa.int32()), pa.array(list(blocks), pa.list_(pa.int64()))],
            names=["doc_id", "n", "set_id", "text_key", "block", "counts"],
        )


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the count blocks that a task reads: at most 64 rows."""
    total = np.zeros((64, SLOTS // 64), np.int64)
    seen = False
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[block] += counts.values.to_numpy()
            seen = True
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(list(total), pa.list_(pa.int64()))], names=["block", "counts"])


def _slot_counts(rows: DataFrame) -> np.ndarray:
    """The counts of all partitions, added up in tasks and then by block; 64 rows reach the driver."""
    blocks = rows.where("block is not null").select("block", "counts").mapInArrow(_add_blocks, "block int, counts array<long>")
    summed = blocks.groupBy("block").applyInPandas(lambda p: pd.DataFrame({"block": [p["block"].iat[0]], "counts": [np.sum(p["counts"].to_list(), 0)]}), "block int, counts array<long>")
    out = np.zeros((64, SLOTS // 64), np.int64)
    for row in summed.collect():
        out[row["block"]] = row["counts"]
    return out.ravel()


def _first_parts(ranks: np.ndarray, most: int):
    """(token, salt, set_id, n) of the rarest tokens of each set; a task writes equal sets once.

    The salt is -1 but for tokens of slots with more than `most` tokens, which are dealt by their set.
    """
    salts = -(-ranks // most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in slices(batch, 0):
                tokens, salted, ids, sizes = [], [], [], []
                for own in shingle_sets(part.column(0)):
                    n = len(own)
                    if not n or (me := set_id(own)) in done:
                        continue
                    done.add(me)
                    first = n - (3 * n + 3) // 4 + 1
                    slot = (own >> np.uint64(46)).astype(np.int64)
                    chosen = np.argsort(ranks[slot], kind="stable")[:first]  # equal ranks by the hash itself
                    many = salts[slot[chosen]]
                    tokens.append(own[chosen])
                    salted.append(np.where(many > 1, (me >> 8) % np.maximum(many, 1), -1).astype(np.int32))
                    ids.append(me)
                    sizes.append(n)
                if tokens:
                    many = list(map(len, tokens))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((np.concatenate(tokens) >> np.uint64(64 - TOKEN_BITS)).view(np.int64)), pa.array(np.concatenate(salted)),
                            pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many)),
                        ],
                        names=["token", "salt", "set_id", "n"],
                    )

    return run


def _sets_of(bits: np.ndarray):
    """(set_id, tokens) of the texts whose key may be wanted; a task writes equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            slot = keys & np.uint64(64 * len(bits) - 1)
            batch = batch.filter(pa.array(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1) > 0))
            for part in slices(batch, 0):
                ids, sets = [], []
                for own in shingle_sets(part.column(0)):
                    if len(own) and (me := set_id(own)) not in done:
                        done.add(me)
                        ids.append(me)
                        sets.append((own >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["set_id", "tokens"])

    return run


def _wanted_bits(keys: DataFrame) -> np.ndarray:
    """A bit table with the bits of all keys set: about 16 bits for each key, MOST_BITS at most.

    A text whose key is none of these, but has a bit, only costs a shuffle.
    """
    keys = cut(keys.select("text_key"), "wanted")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * keys.count()).bit_length()))
    slots = keys.select(F.col("text_key").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    found = words.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def overlaps(sets: list[np.ndarray], columns: int = 1 << 15) -> np.ndarray:
    """Sizes of all intersections, as products of token-by-member matrices of bounded width."""
    union, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = np.zeros((len(sets), len(sets)))
    for first in range(0, len(union), columns):
        a, b = np.searchsorted(at, [first, first + columns])
        block = np.zeros((len(sets), min(columns, len(union) - first)), np.float32)
        block[owner[a:b], at[a:b] - first] = 1
        total += block @ block.T
    return np.rint(total).astype(np.int64)


def _whole(tokens: bytes) -> np.ndarray:
    """Tokens as they are sent, the upper 48 bits of each."""
    out = np.zeros((len(tokens) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(tokens, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _open(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a chunk: each member to the smallest one that it reaches inside the chunk."""
    pdf = pdf.drop_duplicates("set_id").sort_values("set_id", ignore_index=True)
    ids = pdf["set_id"].to_numpy()
    if len(ids) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sets = [_whole(t) for t in pdf["tokens"]]
    size = np.array(list(map(len, sets)))
    both = overlaps(sets)
    linked = 100 * both >= 75 * (size[:, None] + size[None] - both)
    root = np.arange(len(ids))
    while True:
        new = np.where(linked, root[None], len(ids)).min(1)
        new = np.minimum(new, root)
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ids))
    return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})


def _first(n: Column) -> Column:
    return n - F.floor((3 * n + 3) / 4) + 1


def _share(n: Column, m: Column) -> Column:
    return F.floor((3 * (n + m) + 6) / 7)


def least_shared(n: Column, low: Column, high: Column) -> Column:
    """The fewest tokens of its first part that a set of n shares with a linked set of low to high tokens.

    With m tokens in the other set these are at least 1 - ceil(3 n / 4) + ceil(3 (n + m) / 7), which grows with m, and
    1 - ceil(3 m / 4) + ceil(3 (n + m) / 7), which is at least (7 + 12 n - 9 m) / 28. One is taken off for tokens that agree in TOKEN_BITS.
    """
    low, high = F.greatest(low, F.floor((3 * n + 3) / 4)), F.least(high, F.floor(4 * n / 3))
    return F.greatest(F.lit(1), F.least(_first(n) - n + _share(n, low), F.ceil((7 + 12 * n - 9 * high) / 28)) - 1)


UNIT = ["u", "v", "w"]


def _links(members: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of linked sets that lie in one unit (u, v, w); members has a row for each unit and set_id.

    Every side of the joins grows with the input, so none is sent to all tasks, however small it is.
    """
    members = cut(members.distinct(), "members")
    wanted = keys.join(members.select("set_id").distinct().hint("merge"), "set_id")
    sets = texts.mapInArrow(_sets_of(_wanted_bits(wanted)), "set_id long, tokens binary").dropDuplicates(["set_id"])
    opened = join_spread(members, sets, "set_id", UNIT).groupBy(*UNIT).applyInPandas(_open, "a long, b long")
    return cut(opened.distinct(), "set-links")


def _shared_tokens(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose token more than one key has, with the token's smallest row (key, n) as `low`."""
    of_token = Window.partitionBy("token", "salt")
    known = rows.withColumn("low", F.min(F.struct(F.col(key).alias("key"), "n")).over(of_token)).withColumn("high", F.max(key).over(of_token))
    known = cut(known.where("salt >= 0 or low.key <> high").distinct(), name)
    salted = known.where("salt >= 0")
    if salted.isEmpty():
        return known.drop("high")
    heads = salted.groupBy("token", "salt").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    whole = heads.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low.key <> high")
    found = salted.drop("low", "high").join(heads.select("token", "salt").join(whole, "token"), ["token", "salt"])
    return known.where("salt < 0").unionByName(cut(found, name)).drop("high")


def salting(tokens: int, partitions: int) -> int:
    """How many tokens of one slot a task takes: a mean partition's."""
    return max(FEW, -(-tokens // partitions))


def join_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries (doc_id, n, set_id, text_key) of all documents, and (node, component) of linked sets."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = cut(texts.mapInArrow(_summaries, f"doc_id {kind}, n long, set_id long, text_key long, block int, counts array<long>"), "summaries")
    every = rows.where("block is null").select("doc_id", "n", "set_id", "text_key")
    ranks = _slot_counts(rows)
    keys = every.where("set_id is not null").groupBy("set_id").agg(F.min("text_key").alias("text_key"))
    plain = texts.where("text is not null").select("text", "text_key")

    most = salting(int(ranks.sum()), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = plain.select("text").mapInArrow(_first_parts(ranks, most), "token long, salt int, set_id long, n int")
    live = _shared_tokens(first, "set_id", "live").withColumn("pivot", F.col("low.key")).withColumn("pivot_n", F.col("low.n")).drop("low")

    met = live.where("set_id <> pivot").groupBy("set_id", "n", "pivot", "pivot_n").agg(F.count("*").alias("shared"))
    fits = (4 * F.least("n", "pivot_n") >= 3 * F.greatest("n", "pivot_n")) & (F.col("shared") >= least_shared(F.col("n"), F.col("pivot_n"), F.col("pivot_n")))
    pairs = cut(met.where(fits).select("set_id", "pivot"), "pairs")
    many = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = join_spread(pairs, many, "pivot", ["set_id"]).withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")))
    dealt = dealt.select(F.col("pivot").alias("u"), F.col("chunk").alias("v"), F.lit(0).cast("long").alias("w"), F.explode(F.array("set_id", "pivot")).alias("set_id"))
    star = _links(dealt, keys, plain)
    parts = cut(components(star), "parts")

    # groups: sets of one component or of one nearest pivot, of like size, in chunks
    nearest = met.groupBy("set_id").agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("nearest"))
    placed = parts.select(F.col("node").alias("set_id"), "component")
    every_set = live.select("set_id", "n").distinct().hint("merge").join(nearest, "set_id", "left").hint("merge").join(placed, "set_id", "left")
    every_set = cut(
        every_set.select(
            "set_id",
            "n",
            F.coalesce("component", "set_id").alias("component"),
            F.coalesce("component", "nearest", "set_id").alias("home"),
            F.floor(F.log(F.col("n")) / math.log(4 / 3)).alias("band"),
        ),
        "live-sets",
    )
    crowd = every_set.groupBy("home", "band").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    grouped = join_spread(every_set, crowd, ["home", "band"], ["set_id"]).withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")))
    grouped = cut(grouped.select("set_id", "n", "component", F.struct("home", "band", "chunk").alias("g")), "groups")

    known = live.select("token", "salt", "set_id", "n").join(grouped.select("set_id", "component", "g").hint("merge"), "set_id")
    apart = _shared_tokens(known, "component", "apart").drop("low")
    matrix = apart.groupBy("token", F.col("g").alias("to")).agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("holders"), F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("salt").alias("salt")
    )
    salts = apart.where("salt >= 0").select("token", "salt").distinct()
    matrix = matrix.where("salt < 0").unionByName(matrix.where("salt >= 0").drop("salt").join(salts, "token"))
    # each pair of groups once, by the order of their names; a set is no match of itself, nor are those of its component
    others = (F.col("g") < F.col("to")) | (F.col("g") == F.col("to")) & (F.col("holders") > 1)
    beyond = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
    bound = apart.hint("merge").join(matrix, ["token", "salt"]).where(others & beyond)
    # whoever links with the set has one of the tokens they share, so its size lies between those of these tokens' holders
    bound = bound.groupBy("set_id", "n", "to").agg(F.count("*").alias("shared"), F.min("n_low").alias("n_low"), F.max("n_high").alias("n_high"))
    enough = (4 * F.least("n", "n_high") >= 3 * F.greatest("n", "n_low")) & (F.col("shared") >= least_shared(F.col("n"), F.col("n_low"), F.col("n_high")))
    opened = cut(bound.where(enough).select("set_id", "to"), "opened")
    asking = opened.groupBy("to").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    askers = join_spread(opened, asking, "to", ["set_id"]).select("to", F.pmod(F.xxhash64("set_id"), F.col("chunks")).alias("part"), "set_id")
    held = askers.select("to", "part").distinct().hint("merge").join(grouped.select(F.col("g").alias("to"), "set_id"), "to").select("to", "part", "set_id")
    unit = [F.xxhash64("to").alias("u"), F.col("to.home").alias("v"), F.col("part").alias("w"), "set_id"]
    askers, held = askers.select(*unit), held.select(*unit)
    cross = _links(askers.unionByName(held), keys, plain)
    return every, components(star.unionByName(cross))


def _linked(docs: DataFrame) -> DataFrame:
    every, parts = join_sets(docs)
    least = every.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = least.join(parts.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = cut(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = cut(join_spread(named, smallest, "component", ["set_id"]).select("set_id", "component_id"), "of-set")
    some = join_spread(every.where("set_id is not null"), of_set, "set_id", ["doc_id", "text_key"], "left")
    none = every.where("set_id is null").withColumn("component_id", F.lit(None).cast(dict(some.dtypes)["component_id"]))  # no key for a join
    return some.unionByName(none).select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    return _linked(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all columns.

    Documents without shingles or without an id stay. Of rows with equal id and text one stays.
    """
    name = free_name(docs, "text_key")
    links = cut(_linked(docs).withColumnRenamed("text_key", name), "linked")
    key = ["doc_id", name]
    copies = links.where("component_id <> doc_id").select(*key).distinct()
    kept = docs.withColumn(name, F.xxhash64("text")).join(copies, key, "left_anti")
    repeated = links.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key)
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns)
