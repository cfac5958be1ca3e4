"""Hashed character trigrams on arrays: counts of many texts at once, and an embedder made of them."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd

ALPHABET = 200  # so many different characters have a table for all of their trigrams


CHARS, CELLS = 500_000, 1_000_000  # characters and counts that are worked on at once

LETTERS = 128  # the first so many different characters that a process meets have a table of all hashes that is kept
_letters = np.zeros(1 << 16, np.int64)  # the number of each, from 1 on
_seen = np.zeros(LETTERS**3, np.int64)  # a trigram's hash plus 1, or 0 if it has none yet


@lru_cache(1 << 16)
def _hashed(gram: str) -> int:
    return int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)


def _bucket(gram: str, buckets: int) -> int:
    return _hashed(gram) % buckets


def _known(codes: np.ndarray, own: np.ndarray) -> np.ndarray | None:
    """The hash of the trigram that starts at each character that `own` marks; None if more different characters were met than have a table."""
    if codes.max() >= len(_letters):
        return None
    at = _letters[codes]
    if not at.all():
        new, first = np.unique(codes[at == 0]), int(_letters.max()) + 1
        if first + len(new) - 1 > LETTERS:
            return None
        _letters[new] = np.arange(first, first + len(new))
        at = _letters[codes]
    at -= 1
    grams = ((at[:-2] * LETTERS + at[1:-1]) * LETTERS + at[2:])[own]
    found = _seen[grams]
    missing = np.flatnonzero(found == 0)
    if len(missing):
        unknown, first = np.unique(grams[missing], return_index=True)
        starts = np.flatnonzero(own)[missing[first]]
        _seen[unknown] = [_hashed(chr(a) + chr(b) + chr(c)) + 1 for a, b, c in zip(codes[starts].tolist(), codes[starts + 1].tolist(), codes[starts + 2].tolist())]
        found = _seen[grams]
    return found - 1


def _add(out: np.ndarray, owners: list[int], counts: np.ndarray) -> None:
    if len(set(owners)) == len(owners):
        out[owners] += counts
    else:  # several parts of a text
        np.add.at(out, owners, counts)


def bucket_counts(lowered: list[str], buckets: int) -> np.ndarray:
    """How many trigrams of each lower-cased text fall into each bucket. Texts are taken by about CHARS characters, longer ones in parts."""
    out = np.zeros((len(lowered), buckets))
    held: list[str] = []
    owners: list[int] = []
    size, most = 0, max(1, CELLS // buckets)
    for i, text in enumerate(lowered):
        for at in range(0, len(text) - 2, CHARS):
            held.append(text[at : at + CHARS + 2])
            owners.append(i)
            size += len(held[-1])
            if size >= CHARS or len(held) >= most:
                _add(out, owners, _counts(held, buckets))
                held, owners, size = [], [], 0
    if held:
        _add(out, owners, _counts(held, buckets))
    return out


def _counts(lowered: list[str], buckets: int) -> np.ndarray:
    """The same for some texts at once; each different trigram is hashed once, the usual ones once in a process."""
    out = np.zeros((len(lowered), buckets))
    sizes = np.array([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return out
    owner = np.repeat(np.arange(len(lowered)), sizes)
    own = owner[:-2] == owner[2:]
    owner = owner[:-2][own]
    hashes = _known(codes, own)
    if hashes is not None:
        return np.bincount(owner * buckets + hashes % buckets, minlength=out.size).reshape(out.shape).astype(float)
    chars = np.nonzero(np.bincount(codes))[0]
    of = np.zeros(int(chars[-1]) + 1, np.int64)
    of[chars] = np.arange(len(chars))
    letters, n = of[codes], len(chars)
    grams = ((letters[:-2] * n + letters[1:-1]) * n + letters[2:])[own]
    if n <= ALPHABET:
        there = np.nonzero(np.bincount(grams, minlength=n**3))[0]
        at = np.zeros(n**3, np.int32)
        at[there] = np.arange(len(there))
        at = at[grams]
    else:
        there, at = np.unique(grams, return_inverse=True)
    parts = [chars[there // (n * n)], chars[there // n % n], chars[there % n]]
    hashed = np.fromiter((_bucket(chr(a) + chr(b) + chr(c), buckets) for a, b, c in zip(*(p.tolist() for p in parts))), np.int64, len(there))
    return np.bincount(owner * buckets + hashed[at], minlength=out.size).reshape(out.shape).astype(float)


def unit_vectors(lowered: list[str], buckets: int) -> np.ndarray:
    """Counts divided by their length; texts without trigrams have a zero vector."""
    counts = bucket_counts(lowered, buckets)
    return counts / np.maximum(np.sqrt((counts**2).sum(1)), 1e-300)[:, None]


class TrigramEmbedder:
    """An embedder without a model: unit vectors of hashed trigrams."""

    def __init__(self, dimension: int = 512) -> None:
        self.dimension = dimension

    def embed(self, texts: pd.Series) -> pd.Series:
        found = unit_vectors([(t or "").lower() for t in texts], self.dimension)
        rows = np.empty(len(found), object)
        rows[:] = list(found.astype(np.float32))
        return pd.Series(rows, index=texts.index, dtype=object)
