"""Lexical retrieval packing: documents fill windows of WINDOW tokens together with their nearest neighbours.

Each document is turned into token ids once. Documents of one signature, a hash of their rarest-hashed three ids in
a row, lie together, so copies and texts alike do, and each task cuts its documents into shards of about SHARD_TOKENS
ids. A shard has an inverted index of token ids with BM25 weights, whose document frequencies and mean length come
from the whole corpus (they are bounded by the vocabulary). The first unused document of a shard is a seed; the index
returns its unused neighbours by all of the seed's ids, best first, and these fill the seed's window. What doesn't fit
of the last one begins the next window, with that document as the seed; a seed whose neighbours run out is followed
by the next unused document in its window. So only the last window of a task has padding. Neighbours are sought in
the seed's shard alone: README has the recall against an index of all documents.

Documents are dealt to tasks by signature. Signatures with more ids than a quarter of a mean task are dealt in parts.

Nulls: a null text is an empty one, of the end id alone; a null doc_id is kept. Ties of scores go to the
document that comes first in its shard. Repeated rows are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix
from .tokens import encoder

WINDOW, END, VOCABULARY, SHARD_TOKENS, TASK_TOKENS = 2_048, 1, 50_257, 1_500_000, 12_000_000
K1, B, COMMON, BATCH_CHARS = 1.2, 0.75, 5, 400_000
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    texts, at = batch.column(1), 0
    while at < len(batch):
        part, size = [], 0
        while at + len(part) < len(batch) and (not part or size < BATCH_CHARS):
            part.append(texts[at + len(part)].as_py() or "")
            size += len(part[-1])
        yield at, part
        at += len(part)


def signature(ids: np.ndarray) -> int:
    """The smallest hash of three ids in a row: alike for alike texts."""
    if len(ids) < 3:
        return int(ids.sum())
    wide = ids.astype(np.uint64)
    return int(mix(wide[:-2] << np.uint64(32) | wide[1:-1] << np.uint64(16) | wide[2:]).min() >> np.uint64(1))


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in _texts(batch):
                ids = [np.append(x, np.uint16(END)) for x in encoder(path).encode(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(range(serial, serial + len(texts)), pa.int64()), pa.array(list(map(len, ids)), pa.int64()),
                        pa.array(list(map(signature, ids)), pa.int64()), pa.array([pack(x.tobytes()) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "serial", "n", "signature", "ids"],
                )
                serial += len(texts)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, number of documents) for each id of a partition."""
    unpack, counts = zstandard.ZstdDecompressor().decompress, np.zeros(VOCABULARY, np.int64)
    seen = np.zeros(VOCABULARY, bool)
    for batch in batches:
        for blob in batch.column(0):
            seen[:] = False
            seen[np.frombuffer(unpack(blob.as_py()), np.uint16)] = True
            counts += seen
    there = np.nonzero(counts)[0]
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there], pa.int64())], names=["id", "df"])


class Shard:
    """A BM25 index over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        sizes = np.array([len(d) for d in docs])
        keys = np.repeat(np.arange(len(docs), dtype=np.int64) << 16, sizes) | np.concatenate(docs)
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = keys >> 16, keys & 0xFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        self.own = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.term = term
        self.n = len(docs)
        self.used = np.zeros(self.n, bool)
        # ids that many documents have are rows of a matrix, all others lists of documents
        common = np.nonzero(np.bincount(term, minlength=VOCABULARY) * COMMON > self.n)[0]
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.matrix = np.zeros((len(common), self.n), np.float32)
        self.matrix[self.row[term[dense]], doc[dense]] = weight[dense]
        doc, term, weight = doc[~dense], term[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.next = 0

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents by their score for all of the seed's ids, best first."""
        terms = self.term[self.own[seed] : self.own[seed + 1]]
        rows = self.row[terms]
        asked = np.zeros(len(self.matrix), np.float32)
        asked[rows[rows >= 0]] = 1
        scores = (asked @ self.matrix).astype(np.float64)
        terms = terms[rows < 0]
        begin, many = self.first[terms], self.first[terms + 1] - self.first[terms]
        posts = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
        scores += np.bincount(self.doc[posts], self.weight[posts], self.n)
        scores = np.where(self.used, 0, np.round(scores, 4))  # equal documents score alike
        left, many = int((scores > 0).sum()), 16
        done = 0
        while done < left:  # the best of them first; seldom are more wanted
            many = min(many * 4, left)
            least = np.partition(scores, self.n - many)[self.n - many]
            best = np.nonzero(scores >= max(least, np.nextafter(0, 1)))[0]
            best = best[np.lexsort((best, -scores[best]))]
            yield from best[done:].tolist()
            done = len(best)

    def unused(self) -> int | None:
        while self.next < self.n and self.used[self.next]:
            self.next += 1
        return self.next if self.next < self.n else None

    def order(self) -> Iterator[tuple[int, bool]]:
        """Documents as they are packed: a seed, neighbours while the window has room, and so on.

        After each document the caller says whether its window is full; the document is the next seed then.
        """
        seed = self.unused()
        while seed is not None:
            if not self.used[seed]:
                self.used[seed] = True
                yield seed
            for doc in self.neighbours(seed):
                self.used[doc] = True
                if (yield doc):
                    seed = doc
                    break
            else:
                seed = self.unused()


def _pack(idf: np.ndarray, mean: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sequence, room = TaskContext.get().partitionId() << 32, WINDOW

        def shard(ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sequence, room
            rows: list[list] = [[] for _ in range(7)]
            walk = Shard(docs, idf, mean).order()
            at = next(walk, None)
            while at is not None:
                tokens, start, full = docs[at], 0, False
                wide = tokens.astype("<u4")
                while start < len(tokens):
                    take = min(room, len(tokens) - start)
                    for column, value in zip(rows, (ids[at], start, take, zlib.crc32(wide[start : start + take]), len(tokens), sequence, WINDOW - room)):
                        column.append(value)
                    start += take
                    room -= take
                    if not room:
                        sequence, room, full = sequence + 1, WINDOW, True
                try:
                    at = walk.send(full)
                except StopIteration:
                    at = None
            return pa.RecordBatch.from_arrays([pa.array(rows[0], kind), *[pa.array(r, pa.int64()) for r in rows[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        ids, docs, held = [], [], 0
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                docs.append(np.frombuffer(unpack(blob.as_py()), np.uint16))
                held += len(docs[-1])
                if held >= SHARD_TOKENS:
                    yield shard(ids, docs)
                    ids, docs, held = [], [], 0
        if docs:
            yield shard(ids, docs)

    return run


def pack(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of all documents and where they lie: a row for each piece."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    name = kinds["doc_id"].simpleString()
    tokens = cut(docs.select("doc_id", "text").mapInArrow(_tokenize(path), f"doc_id {name}, serial long, n long, signature long, ids binary"), "tokens")
    count, total = tokens.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(1 << 16)
    for row in tokens.select("ids").mapInArrow(_frequencies, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():  # at most VOCABULARY rows
        df[row["id"]] = row["df"]
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    tasks = max(1, -(-(total or 0) // TASK_TOKENS))
    kind = pa.int64() if name == "bigint" else pa.int32() if name == "int" else pa.string()
    # copies of one text can be a third of all rows; there are fewer such signatures than four for each task or partition
    most = max(32 * WINDOW, (total or 0) // (4 * max(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    large = tokens.groupBy("signature").agg(F.sum("n").alias("all")).where(F.col("all") > most)
    parted = tokens.join(F.broadcast(large), "signature", "left").withColumn("part", F.pmod(F.xxhash64("serial"), F.coalesce(F.ceil(F.col("all") / most), F.lit(1))))
    spread = parted.repartition(tasks, "signature", "part").sortWithinPartitions("signature", "part", "doc_id", "serial")
    return spread.select("doc_id", "ids").mapInArrow(_pack(idf, (total or 1) / max(1, count), kind), SCHEMA.format(name))
