"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every document is cut into passages of PASSAGE code points (a short rest joins the one before it), and every
passage is encoded from its characters: shares of character classes, hashed character pairs, lengths of
words and lines, and how often words follow themselves. A hidden layer embeds each passage, a gated
attention weighs the passages of a document, and the weighted representation is scored by a logistic output.
All weights are learned together from the labels of whole documents.

Labels are learned from a bounded sample, the TRAIN_DOCS labelled rows whose hashed ids come first, as long as all of
their passages fit into TRAIN_PASSAGES; rows are taken whole or not at all. Rows whose crc32(doc_id) mod 4 is 2 are
never among them. doc_id, lang, source and labels are no inputs of a score.

Nulls: a null text is scored as an empty one, a single passage without characters; a null doc_id is not
held out and never trained on. Several labels of one id: the lowest counts. Several texts of one id: the one with the
lowest hash is learned from. Without labels of both classes
every score is the share of label 1 among those there are (1 without any). Repeated rows get equal scores.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, free_name, slices, span_hashes

PASSAGE, TRAIN_DOCS, TRAIN_PASSAGES, PAIRS = 800, 6_000, 100_000, 64
SIGNS = "!#$%&*|.,;:?'\"()[]{}<>/\\=+-_@~^"


def _classes() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 letters beyond ASCII, then the signs."""
    of = np.zeros(0x110000, np.uint8)
    of[0xAA:0xE000] = 6
    for first, last, kind in ((97, 123, 1), (65, 91, 2), (48, 58, 3), (32, 33, 4), (9, 14, 4), (10, 11, 5)):
        of[first:last] = kind
    for i, c in enumerate(SIGNS):
        of[ord(c)] = 7 + i
    return of


CLASS = _classes()
N_CLASSES = 7 + len(SIGNS)
N_FEATURES = N_CLASSES + 7 + PAIRS


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, the start of each passage, and for each text the number of its passages."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, (sizes + PASSAGE // 2) // PASSAGE)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, begins[owner] + nth * PASSAGE, counts


def encode(codes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """A row of features for each passage; passages follow each other without gaps."""
    n = len(starts)
    ends = np.append(starts[1:], end)
    size = (ends - starts).astype(np.float64)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(codes):
        return out
    owner = np.repeat(np.arange(n), ends - starts)
    kinds = CLASS[codes]
    shares = np.bincount(owner * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(shares / np.maximum(size, 1)[:, None])
    low = np.where(kinds == 2, codes + 32, codes).astype(np.uint32)
    pairs = ((low[:-1] * np.uint32(0x9E3779B1) + low[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(26)).astype(np.int64)
    inside = owner[:-1] == owner[1:]
    grams = np.bincount(owner[:-1][inside] * PAIRS + pairs[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, N_CLASSES + 7 :] = np.sqrt(grams / np.maximum(size, 1)[:, None])
    space = (kinds == 4) | (kinds == 5)
    begin = ~space
    heads = starts[ends > starts]  # words end where a passage does
    begin[1:] &= space[:-1]
    begin[heads] = ~space[heads]
    at = np.nonzero(begin)[0]
    if len(at):
        stop = ~space
        stop[:-1] &= space[1:]
        stop[heads[1:] - 1] = ~space[heads[1:] - 1]
        to = np.nonzero(stop)[0] + 1
        hashes = span_hashes(codes, at, to)
        mine = owner[at]
        words = np.bincount(mine, minlength=n)
        again = np.zeros(len(at), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (mine[1:] == mine[:-1])
        key = np.sort(np.unique(mine.astype(np.uint64) << np.uint64(40) ^ hashes >> np.uint64(24)) >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(np.minimum(key, n - 1), minlength=n)
        length = np.bincount(mine, weights=to - at, minlength=n)
        square = np.bincount(mine, weights=(to - at) ** 2.0, minlength=n)
        some = np.maximum(words, 1)
        out[:, N_CLASSES] = np.bincount(mine, weights=again, minlength=n) / some
        out[:, N_CLASSES + 1] = distinct / some
        out[:, N_CLASSES + 2] = length / some / 8
        out[:, N_CLASSES + 3] = np.sqrt(np.maximum(0, square / some - (length / some) ** 2)) / 8
        out[:, N_CLASSES + 4] = np.log1p(words) / 5
    out[:, N_CLASSES + 5] = np.log1p(size) / 7
    out[:, N_CLASSES + 6] = np.log1p(size / (1 + shares[:, 5])) / 7
    return out


class Attention:
    """Passage encoder, gated attention and document score, with gradients worked out by hand."""

    HIDDEN, GATE = 32, 16

    def __init__(self, seed: int = 3, attend: bool = True) -> None:
        self.attend = attend  # if not, all passages of a document weigh the same
        rng = np.random.default_rng(seed)
        norm = lambda a, b: rng.normal(0, np.sqrt(1 / a), (a, b))
        self.w = {"enc": norm(N_FEATURES, self.HIDDEN), "enc_b": np.zeros(self.HIDDEN), "v": norm(self.HIDDEN, self.GATE), "u": norm(self.HIDDEN, self.GATE), "a": norm(self.GATE, 1), "out": norm(self.HIDDEN, 1), "out_b": np.zeros(1)}
        self.mean, self.spread, self.prior = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.w
        first = np.cumsum(counts) - counts
        bag = np.repeat(np.arange(len(counts)), counts)
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = ((t * s) @ w["a"])[:, 0] * self.attend
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return (z @ w["out"] + w["out_b"])[:, 0], (x, first, bag, h, t, s, a, z)

    def backward(self, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        x, first, bag, h, t, s, a, z = kept
        w = self.w
        g = {"out": z.T @ slope[:, None], "out_b": slope.sum(keepdims=True)}
        to_z = (slope[:, None] @ w["out"].T)[bag]
        to_a = (to_z * h).sum(1)
        to_e = a * (to_a - np.add.reduceat(a * to_a, first)[bag]) * self.attend
        g["a"] = (t * s).T @ to_e[:, None]
        to_gate = to_e[:, None] @ w["a"].T
        to_t, to_s = to_gate * s * (1 - t * t), to_gate * t * s * (1 - s)
        g |= {"v": h.T @ to_t, "u": h.T @ to_s}
        to_h = (a[:, None] * to_z + to_t @ w["v"].T + to_s @ w["u"].T) * (1 - h * h)
        return g | {"enc": x.T @ to_h, "enc_b": to_h.sum(0)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 14, seed: int = 5) -> Attention:
        everything = np.concatenate(bags).astype(np.float64)
        self.mean, self.spread = everything.mean(0), np.maximum(everything.std(0), 0.02)
        bags = [(b - self.mean) / self.spread for b in bags]
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
                counts = np.array([len(bags[i]) for i in part])
                logit, kept = self.forward(np.concatenate([bags[i] for i in part]), counts)
                slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) / len(part)
                step += 1
                rate = 3e-3 * (1 - epoch / epochs)
                for k, g in self.backward(kept, slope).items():
                    g = g + 1e-4 * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.w[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        codes, starts, counts = passages(texts)
        x = (encode(codes, starts, len(codes)) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.forward(x, counts)[0], -30, 30)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            rows = []
            for text in part.column(1).to_pylist():
                codes, starts, _ = passages([text or ""])
                rows.append(encode(codes, starts, len(codes)).tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary()), part.column(2)], names=["doc_id", "bag", "label"])


def train(docs: DataFrame, labels: DataFrame) -> Attention:
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    marks = marks.where(~held_out()).withColumn("key", F.xxhash64("doc_id", F.lit("quality")))
    chosen = cut(marks.orderBy("key", "doc_id").limit(TRAIN_DOCS), "labelled")
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    sizes = own.join(F.broadcast(chosen), "doc_id").groupBy("key", "doc_id", "label").agg(F.min(F.struct("text_key", "size")).alias("t"))  # at most TRAIN_DOCS rows
    left, taken = TRAIN_PASSAGES, []
    for r in sorted(sizes.collect(), key=lambda r: (r["key"], r["doc_id"])):
        many = max(1, (r["t"]["size"] + PASSAGE // 2) // PASSAGE)
        if many <= left:
            left -= many
            taken.append((r["doc_id"], r["t"]["text_key"], r["label"]))
    model = Attention()
    if len({y for _, _, y in taken}) < 2:
        model.prior = float(np.mean([y for _, _, y in taken])) if taken else 1.0
        return model
    wanted = docs.sparkSession.createDataFrame(taken, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, label int")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).join(F.broadcast(wanted), ["doc_id", "text_key"])
    rows = texts.select("doc_id", "text", "label").mapInArrow(_bags, f"doc_id {dict(docs.dtypes)['doc_id']}, bag binary, label int").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (bytes(r["bag"]), r["label"]))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    return model.fit(bags, np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, model: Attention, column: str = "score") -> DataFrame:
    """The given rows with a score column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, scores = batch.column(batch.schema.names.index("text")), 0, []
            while at < len(batch):  # parts of bounded size: long texts go alone
                part = [texts[at].as_py() or ""]
                size = len(part[0])
                while at + len(part) < len(batch) and len(part) < 512 and size < 400_000:
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                scores.append(model.score(part))
                at += len(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores or [np.zeros(0)]), pa.float64())], names=[*batch.schema.names, column])

    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    name = free_name(docs, "quality_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= least).drop(name)
