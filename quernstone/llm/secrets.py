"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings come from three patterns and always stay. Every further candidate, an unbroken run of LEAST or
more token characters that isn't made of plain words, is scored with its surrounding context by a small
convolutional network written in numpy; a run of more than BODY characters is scored in windows that overlap by
half, and the highest score counts. The network is trained on labelled findings of a bounded sample of documents
(TRAIN_DOCS, at most TRAIN_SPANS windows of each of the five kinds). Positive are the values that the base patterns find, each with its
keyword, with its keyword taken out of the context, and so again with its characters redrawn from the other
ALPHABETS of keys, as secrets of other makers look; and values made as keys are built, of random runs with or without a
short name or numbers in front. Negative are candidates of a known harmless form: addresses, numbers, dates, words joined with
short numbers, such names made of words of the text, and identifiers as catalogues, journals, sites and build tools give them.
Made values stand between words of the sampled texts. Candidates that are neither are not trained on. A held-out third
calibrates the scores (Platt scaling) and sets the threshold: the highest one, so the lowest false-positive rate,
that finds at least RECALL of the held-out positives; the rates reached are kept with the network.

Nulls: a null text is an empty one; a null doc_id is kept (it is never trained on). Empty texts have no
spans and the digest of an empty string. Repeated rows are separate. Where the sample holds no finding of
one class, no model is made and only base findings are returned. An empty table gives no rows.
Offsets are code points, ends exclusive; equal starts are ordered by kind: assign, access, hex, network.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as runs are maximal, the same as all runs without the short ones
KINDS = ("assign", "access", "hex", "network")

LEAST, BEFORE, BODY, AFTER = 12, 32, 48, 16
WIDTH = BEFORE + BODY + AFTER
TRAIN_DOCS, TRAIN_SPANS, RECALL = 3_000, 2_500, 0.99
HARMLESS_FOUND, SECRET, NAME, MADE_KEY, MADE_ID = 0, 1, 2, 3, 4
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_=.@-]{{{LEAST},}}")
WORD = r"(?:[A-Z]?[a-z]+|[A-Z]+)"
WORDS = re.compile(rf"[+/_=.@-]*{WORD}(?:[+/_=.@-]+{WORD})*[+/_=.@-]*")
HARMLESS = re.compile(
    r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.?"  # addresses
    r"|[0-9+/_=.-]+"  # numbers and dates
    rf"|(?:{WORD}[0-9]{{0,4}}|[0-9]{{1,4}})(?:[+/_=.-]+(?:{WORD}[0-9]{{0,4}}|[0-9]{{1,4}}))*[+/_=.-]*"  # names with numbers
)
ALPHABETS = ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base findings, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters, other than plain words, that no base finding touches."""
    starts, ends = [s for s, _, _ in taken], np.maximum.accumulate([0, *[e for _, _, e in taken]]).tolist()
    return [
        (m.start(), m.end())
        for m in CANDIDATE.finditer(text)
        if ends[bisect_left(starts, m.end())] <= m.start() and not WORDS.fullmatch(m[0])
    ]


# Classes of characters for the network: 0 padding, lower and upper letters, digits, each sign, the rest.
CLASSES = np.full(0x110000, 63, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    CLASSES[ord(_c)] = 1 + _i
    CLASSES[ord(_c.upper())] = 27
CLASSES[48:58] = 28
for _i, _c in enumerate(" \n\t.,:;=+/_-\"'@!?#$%&*()[]{}<>|"):
    CLASSES[ord(_c)] = 29 + _i


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of a candidate: itself, or overlapping parts of BODY characters that cover it."""
    if end - start <= BODY:
        return [(start, end)]
    return [(at, at + BODY) for at in [*range(start, end - BODY, BODY // 2), end - BODY]]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Class ids of each span of at most BODY characters, between its left and its right context."""
    kinds = CLASSES[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    start, end = np.array(spans, np.int64).reshape(-1, 2).T[..., None]
    lane = np.arange(WIDTH)
    at = np.where(lane < BEFORE + BODY, start + lane - BEFORE, end + lane - BEFORE - BODY)
    there = (at >= 0) & (at < len(kinds)) & ((lane < BEFORE) | (at < end) | (lane >= BEFORE + BODY))
    return np.where(there, kinds[np.clip(at, 0, max(0, len(kinds) - 1))], 0).astype(np.uint8) if len(kinds) else np.zeros((len(spans), WIDTH), np.uint8)


class Network:
    """Embedding, one convolution, maxima over left context, body and right context, the body's mean and length, a hidden layer, a logistic output.

    A position counts if a character stands there; padding takes no part in any maximum or mean.
    """

    SIZE, KERNEL, FILTERS, HIDDEN = 12, 5, 24, 16
    PARTS = (slice(0, BEFORE), slice(BEFORE, BEFORE + BODY), slice(BEFORE + BODY, WIDTH))

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        norm = lambda *shape: rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)
        self.w = {
            "embed": rng.normal(0, 0.5, (64, self.SIZE)).astype(np.float32),
            "conv": norm(self.KERNEL * self.SIZE, self.FILTERS),
            "conv_b": np.zeros(self.FILTERS, np.float32),
            "hidden": norm(self.FILTERS * 4 + 1, self.HIDDEN),
            "hidden_b": np.zeros(self.HIDDEN, np.float32),
            "out": norm(self.HIDDEN, 1),
            "out_b": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0
        self.recall = self.false_positives = float("nan")

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        w, n = self.w, len(ids)
        there = (ids > 0)[..., None]
        padded = np.pad(w["embed"][ids] * there, ((0, 0), (0, self.KERNEL - 1), (0, 0)))
        patches = np.lib.stride_tricks.sliding_window_view(padded, self.KERNEL, axis=1).transpose(0, 1, 3, 2)
        patches = np.ascontiguousarray(patches).reshape(n * WIDTH, -1)
        act = np.maximum((patches @ w["conv"] + w["conv_b"]).reshape(n, WIDTH, -1), 0) * there
        body = act[:, self.PARTS[1]]
        filled = np.maximum(1, there[:, self.PARTS[1]].sum(1)).astype(np.float32)
        best = [part.start + act[:, part].argmax(1) for part in self.PARTS]
        pooled = np.concatenate([body.sum(1) / filled, *[act[:, part].max(1) for part in self.PARTS], 4 * filled / BODY], 1)
        hidden = np.maximum(pooled @ w["hidden"] + w["hidden_b"], 0)
        logit = (hidden @ w["out"] + w["out_b"])[:, 0]
        return logit, (ids, patches, act, pooled, hidden, filled, best)

    def backward(self, kept: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        ids, patches, act, pooled, hidden, filled, best = kept
        w, n, f = self.w, len(ids), self.FILTERS
        g = {"out": hidden.T @ slope[:, None], "out_b": slope.sum(keepdims=True)}
        to_hidden = (slope[:, None] @ w["out"].T) * (hidden > 0)
        g |= {"hidden": pooled.T @ to_hidden, "hidden_b": to_hidden.sum(0)}
        to_pooled = to_hidden @ w["hidden"].T
        to_act = np.zeros_like(act)
        rows, cols = np.arange(n)[:, None], np.arange(f)[None]
        to_act[:, self.PARTS[1]] += (to_pooled[:, :f] / filled)[:, None]
        for i, at in enumerate(best, 1):
            to_act[rows, at, cols] += to_pooled[:, i * f : (i + 1) * f]
        to_act = (to_act * (act > 0)).reshape(-1, f)  # padded positions have no activation
        g |= {"conv": patches.T @ to_act, "conv_b": to_act.sum(0)}
        to_patch = (to_act @ w["conv"].T).reshape(n, WIDTH, self.KERNEL, self.SIZE)
        to_padded = np.zeros((n, WIDTH + self.KERNEL - 1, self.SIZE), to_patch.dtype)
        for k in range(self.KERNEL):
            to_padded[:, k : k + WIDTH] += to_patch[:, :, k]
        flat, inside = ids.ravel(), to_padded[:, :WIDTH].reshape(-1, self.SIZE)
        g["embed"] = np.stack([np.bincount(flat, inside[:, j], 64) for j in range(self.SIZE)], 1) * (np.arange(64) > 0)[:, None]
        return g

    def fit(self, ids: np.ndarray, labels: np.ndarray, epochs: int = 8, least_steps: int = 400, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(ids))
        held, train = order[: len(ids) // 3], order[len(ids) // 3 :]
        weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, epochs = 0, max(epochs, -(-least_steps // max(1, len(train) // 64)))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                logit, kept = self.forward(ids[part])
                slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) * weight[part] / len(part)
                step += 1
                for k, g in self.backward(kept, slope.astype(np.float32)).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] -= (4e-3 * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.calibrate(ids[held], labels[held])
        return self

    def calibrate(self, ids: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling by Newton steps; the threshold is the highest that keeps RECALL of the positives."""
        logit = self.forward(ids)[0].astype(np.float64)
        a, b = 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-9)
            gradient = np.array([((p - labels) * logit).sum() + 1e-2 * (a - 1), (p - labels).sum()])
            hessian = np.array([[(v * logit**2).sum() + 1e-2, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-6]])
            a, b = np.array([a, b]) - np.linalg.solve(hessian, gradient)
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        scores = self.score(ids)
        positive = np.sort(scores[labels == 1])
        if len(positive):
            self.threshold = float(positive[int((1 - RECALL) * len(positive))])
            self.recall = float((positive >= self.threshold).mean())
            self.false_positives = float((scores[labels == 0] >= self.threshold).mean()) if (labels == 0).any() else 0.0

    def score(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.forward(ids)[0].astype(np.float64) + self.shift, -30, 30)))


def redrawn(value: str) -> list[str]:
    """The value with its characters drawn anew from each alphabet, signs in their places; always the same for a value."""
    rng = np.random.default_rng(zlib.crc32(value.encode()))
    return ["".join(d if c.isalnum() else c for c, d in zip(value, rng.choice(list(a), len(value)))) for a in ALPHABETS]


def names(text: str) -> list[tuple[str, list[tuple[int, int]], int]]:
    """Harmless names out of a text's own words: paths, hosts, identifiers, files with numbers, times."""
    words, out = re.findall(r"[A-Za-z]{2,12}", text), []
    for at in range(0, len(words) - 5, 48):
        own = words[at : at + 5]
        draw = zlib.crc32("".join(own).encode())
        sign, number = "/._-"[draw % 4], str(draw >> 8)[: 1 + draw // 4 % 8]
        joined = (
            f"{own[1]}{sign}{own[2]}{number}{sign}{own[3]}",
            f"{own[1]}{sign}{number}{sign}{own[2]}.{own[3][:4]}",
            f"{own[1].lower()}{own[2].title()}{own[3].title()}{number[:3]}",
            f"{own[1].upper()}_{number}_{draw >> 12}.{own[3][:4]}",
            f"{1900 + draw % 200}-{1 + draw % 12:02}-{1 + draw % 28:02}T{draw % 24:02}-{draw % 60:02}Z",
        )[draw // 64 % 5]
        if len(joined) >= LEAST and not WORDS.fullmatch(joined):
            left = own[0] + " "
            out.append((f"{left}{joined} {own[4]}", [(len(left) + a, len(left) + b) for a, b in pieces(0, len(joined))], NAME))
    return out


def drawn(rng: np.random.Generator, alphabet: str, size: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), size).tolist())


def key_like(rng: np.random.Generator) -> str:
    """A value as keys are built: perhaps a short name in front, then one to three runs of characters drawn from an alphabet."""
    alphabet = (LETTERS + DIGITS, LETTERS + DIGITS, LETTERS + DIGITS + "+/", LETTERS + DIGITS + "-_", LETTERS.lower()[:26] + DIGITS, LETTERS.upper()[:26] + DIGITS)[rng.integers(6)]
    parts = [drawn(rng, alphabet, int(rng.integers(20, 27) if rng.random() < 0.4 else rng.integers(27, 56)))]
    if rng.random() < 0.35:  # numbers before it
        parts = [drawn(rng, DIGITS, int(rng.integers(6, 14))) for _ in range(rng.integers(1, 3))] + parts
    sign = "_-."[rng.integers(3)]
    if rng.random() < 0.55:
        name = [drawn(rng, LETTERS[:26], int(rng.integers(2, 6))) for _ in range(rng.integers(1, 3))]
        parts = [*(name if rng.random() < 0.8 else [n.upper() for n in name]), *parts]
    return sign.join(parts) + ("=" * int(rng.integers(1, 3)) if rng.random() < 0.1 else "")


def id_like(rng: np.random.Generator, words: list[str]) -> str:
    """A harmless value that isn't made of words: identifiers as catalogues, journals, sites and build tools give them."""
    n = lambda a, b: drawn(rng, DIGITS, int(rng.integers(a, b)))
    word = lambda: words[rng.integers(len(words))].lower()
    low, up = LETTERS[:26] + DIGITS, LETTERS[26:] + DIGITS
    hexes = lambda k: drawn(rng, "0123456789abcdef", k)
    kind = int(rng.integers(15))
    if kind < 2:
        made = "-".join(hexes(k) for k in (8, 4, 4, 4, 12))
        return made.upper() if kind else made
    if kind > 11:  # a short random id, alone or as a field of an address
        front = ("", "v=", "id=", "p=", word()[:4] + "/", "watch/v=")[rng.integers(6)]
        return front + drawn(rng, LETTERS + DIGITS + "-_", int(rng.integers(max(6, LEAST - len(front)), 14)))
    return (
        f"{'vip'[rng.integers(3)]}={drawn(rng, LETTERS + DIGITS + '-_', 11)}",
        f"10.{n(4, 6)}/{word()[:4]}.{n(4, 5)}.{n(3, 8)}",
        f"10.{n(4, 6)}/{drawn(rng, low, int(rng.integers(4, 9)))}-{n(2, 6)}",
        "-".join([drawn(rng, LETTERS[26:], int(rng.integers(2, 4))), n(3, 7), drawn(rng, up, int(rng.integers(2, 6)))]),
        f"{drawn(rng, LETTERS[26:], 2)}{n(4, 9)}-{drawn(rng, up, int(rng.integers(2, 5)))}/{n(1, 4)}",
        f"{word()}.{hexes(int(rng.integers(7, 11)))}.{word()[:3]}",
        f"/{word()}/{word()}/{drawn(rng, low, int(rng.integers(5, 11)))}.{word()[:3]}",
        f"{word()}-{word()}-{hexes(int(rng.integers(5, 10)))}-{drawn(rng, low, 5)}",
        f"{n(4, 5)}-{n(2, 3)}-{n(2, 3)}T{n(2, 3)}.{n(2, 3)}.{n(2, 3)}.{n(3, 7)}Z",
        f"/{word()}.{word()[:3]}/{word()}/{drawn(rng, LETTERS + DIGITS, int(rng.integers(6, 12)))}",
    )[kind - 2]


def made_windows(text: str) -> list[tuple[bytes, int]]:
    """Windows of values made for the text, between its words: some as keys are built, some as harmless identifiers are."""
    words, out = re.findall(r"[^\W\d_]{2,12}", text), []
    for at in range(0, len(words) - 8, 160):
        rng = np.random.default_rng(zlib.crc32(" ".join(words[at : at + 8]).encode()))
        for label in (MADE_KEY, MADE_ID, MADE_ID):
            value = key_like(rng) if label == MADE_KEY else id_like(rng, [w for w in words[at : at + 8] if w.isascii()] or ["x"])
            if len(value) < LEAST or HEX.search(value) or ASSIGN.search(value) or not CANDIDATE.fullmatch(value):
                continue
            cut_off = int(rng.integers(0, 5))  # words on the left
            left = " ".join(words[at : at + cut_off]) + (" ", "\n", "=", ": ", ' "', "(")[rng.integers(6)] if cut_off else ""
            right = (" ", "\n", '"', ", ", ") ", ".")[rng.integers(6)] + " ".join(words[at + 4 : at + 8]) if rng.random() < 0.9 else ""
            for row in windows(left + value + right, [(len(left) + a, len(left) + b) for a, b in pieces(0, len(value))]):
                out.append((row.tobytes(), label))
    return out


def labelled_windows(text: str) -> list[tuple[bytes, int]]:
    """(window, class) of each labelled span of a text."""
    taken, out = base_spans(text), []
    shown: list[tuple[str, list[tuple[int, int]], int]] = [(text, [p for c in candidates(text, taken) if HARMLESS.fullmatch(text, *c) for p in pieces(*c)], HARMLESS_FOUND)]
    shown += names(text)
    for start, kind, end in taken:
        at, to = ASSIGN.match(text, start).span(2) if kind == 0 else (start, end)
        if to - at < LEAST:
            continue
        left, value, right = text[max(0, start - BEFORE) : start], text[at:to], text[to : to + AFTER]
        shown.append((text[max(0, at - BEFORE) : to + AFTER], [(min(at, BEFORE) + a, min(at, BEFORE) + b) for a, b in pieces(0, to - at)], SECRET))
        for own in (value, *redrawn(value)):  # without the keyword
            shown.append((left + own + right, [(len(left) + a, len(left) + b) for a, b in pieces(0, len(own))], SECRET))
    for part, spans, label in shown:
        if spans:
            out += [(row.tobytes(), label) for row in windows(part, spans)]
    return out + made_windows(text)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(1):
            found = labelled_windows(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([y for _, y in found], pa.int32())], names=["window", "label"])


def train(docs: DataFrame) -> Network | None:
    """The network, from the spans of the TRAIN_DOCS documents whose hashed ids come first."""
    key = F.xxhash64("doc_id", F.lit("secrets"))
    last = [r[0] for r in docs.where("doc_id is not null").select(key.alias("k")).distinct().orderBy("k").limit(TRAIN_DOCS).agg(F.max("k")).collect()][0]
    if last is None:
        return None
    sample = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (key <= last)).select("doc_id", "text")
    spans = cut(sample.mapInArrow(_labelled, "window binary, label int").distinct(), "findings")
    rows = []
    for label in (SECRET, HARMLESS_FOUND, NAME, MADE_KEY, MADE_ID):
        rows += spans.where(F.col("label") == label).orderBy(F.xxhash64("window"), "window").limit(TRAIN_SPANS).collect()
    labels = np.array([r["label"] in (SECRET, MADE_KEY) for r in rows], np.float32)
    if not 0 < labels.sum() < len(labels):
        return None
    return Network().fit(np.array([np.frombuffer(r["window"], np.uint8) for r in rows]), labels)


def find_spans(texts: list[str], network: Network | None) -> list[list[tuple[int, int, int]]]:
    """All (start, kind, end) of each text; the candidates' windows are scored in parts of bounded size."""
    found = [base_spans(t) for t in texts]
    if network is None:
        return found
    owners, spans, many, ids = [], [], [], []
    for row, text in enumerate(texts):
        if own := candidates(text, found[row]):
            parts = [pieces(*c) for c in own]
            owners += [row] * len(own)
            spans += own
            many += map(len, parts)
            ids.append(windows(text, [p for x in parts for p in x]))
    if ids:
        ids = np.concatenate(ids)
        scores = np.concatenate([network.score(ids[at : at + 2_048]) for at in range(0, len(ids), 2_048)])
        best = np.maximum.reduceat(scores, np.cumsum(many) - many)
        for i in np.nonzero(best >= network.threshold)[0]:
            found[owners[i]].append((spans[i][0], 3, spans[i][1]))
    return [sorted(x) for x in found]


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """A row for each document: its counts by kind, the digest of the base spans, and all spans."""
    network = network or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = find_spans([t or "" for t in part.column(1).to_pylist()], network)
                written = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in x] for x in found]
                base = [",".join(w for w, (_, k, _) in zip(ws, x) if k < 3) for ws, x in zip(written, found)]
                counts = [pa.array([sum(k == kind for _, k, _ in x) for x in found], pa.int64()) for kind in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts[:3], pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array([",".join(w) for w in written], pa.string()), counts[3]],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long")


def redact(docs: DataFrame, network: Network | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span replaced by a mark (overlapping spans by one), n_chars set anew."""
    network = network or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in slices(batch, names.index("text")):
                texts = part.column(names.index("text")).to_pylist()
                out = []
                for text, spans in zip(texts, find_spans([t or "" for t in texts], network)):
                    if spans:
                        pieces_of, at = [], 0
                        for start, _, end in spans:
                            if start >= at:
                                pieces_of += [text[at:start], mark]
                            at = max(at, end)
                        text = "".join([*pieces_of, text[at:]])
                    out.append(text)
                columns = dict(zip(names, part.columns)) | {"text": pa.array(out, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.col("n_chars").cast("long"))
    return docs.mapInArrow(run, docs.schema)
