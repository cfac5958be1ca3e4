"""Byte-level BPE ids for many texts at once.

Texts are split into pieces by the vocabulary's own pattern, worked out on whole arrays of code points; each
distinct piece is encoded by the tokenizers library once and its ids are kept for the next texts. The ids
are those that the library gives for the text, the strings of the vocabulary's added tokens included: such a
string is one piece, and what stands before and after it is split like a text of its own.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# Unicode's White_Space, and the endings that the pattern splits off after an apostrophe.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SLOTS, MOST = 1 << 21, 1_200_000


@lru_cache(1)
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            first = ord(m[0][0])
            kinds[first : ord(m[0][-1]) + 1] = np.where(kinds[first : ord(m[0][-1]) + 1] == OTHER, kind, kinds[first : ord(m[0][-1]) + 1])
    kinds[WHITE] = SPACE
    return kinds


def split(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that follow each other; firsts has where non-empty texts begin."""
    kinds = _kinds()[codes]
    new = np.zeros(len(codes) + 3, bool)
    new[0] = True
    new[1 : len(codes)] = kinds[1:] != kinds[:-1]
    new[firsts] = True
    own = np.zeros(len(codes) + 3, bool)
    own[firsts] = True
    # white space before something else gives its last character away: to what follows if it is a blank
    after = np.nonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~own[1 : len(codes)])[0] + 1
    new[after - 1] = True
    new[after] = codes[after - 1] != 32
    # an apostrophe that begins a piece takes an ending with it
    quotes = np.nonzero(codes == 39)[0]
    quotes = quotes[new[quotes] & ~own[quotes + 1]]
    if len(quotes):
        long = np.concatenate([codes, np.zeros(3, codes.dtype)])
        for ending in ENDINGS:
            fits = np.ones(len(quotes), bool)
            for j, c in enumerate(ending):
                fits &= (long[quotes + 1 + j] == ord(c)) & ~own[quotes + 1 + j]
            at = quotes[fits]
            new[at + 1] = False
            rest = at + 1 + len(ending)
            inside = rest < len(codes)
            rest = rest[inside]
            new[rest] |= kinds[rest] == LETTER
    return np.nonzero(new[: len(codes)])[0]


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(self.tokenizer.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError(f"{path}: added tokens that depend on what stands beside them")
        self.added = regex.compile("|".join(regex.escape(t.content) for t in added)) if added else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.uint16)
        self.store = np.zeros(1 << 20, np.uint16)
        self.used = self.entries = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the empty one where it belongs."""
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        open_ = np.nonzero((self.keys[slots] != hashes) & (self.keys[slots] != 0))[0]
        while len(open_):
            slots[open_] = (slots[open_] + 1) & (SLOTS - 1)
            kept = self.keys[slots[open_]]
            open_ = open_[(kept != hashes[open_]) & (kept != 0)]
        return slots

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint16, sizes.sum())
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used : self.used + len(flat)] = flat
        begins = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.entries += len(ids)
        left = np.arange(len(ids))
        while len(left):  # of those that want one empty slot, the first gets it
            slots, first = np.unique(self._slots(hashes[left]), return_index=True)
            got = left[first]
            self.keys[slots], self.at[slots], self.size[slots] = hashes[got], begins[got], sizes[got]
            left = np.delete(left, first)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 16-bit numbers. A call must stay below MOST different pieces."""
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint16) for _ in texts]
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        firsts = (ends - sizes)[sizes > 0]
        if self.added and self.added.search(whole):
            found = np.array([(m.start() + at, m.end() + at) for t, at in zip(texts, (ends - sizes).tolist()) for m in self.added.finditer(t)], np.int64).reshape(-1, 2)
            own = np.unique(np.concatenate([firsts, found.ravel()]))
            starts = split(codes, own[own < len(codes)])
            before = np.searchsorted(found[:, 0], starts) - 1  # the added token that begins before a start, which it may not lie in
            starts = starts[(before < 0) | (starts >= np.append(found[:, 1], 0)[before])]
        else:
            starts = split(codes, firsts)
        stops = np.append(starts[1:], len(codes))
        hashes = np.maximum(span_hashes(codes, starts, stops), np.uint64(1))
        slots = self._slots(hashes)
        missing = np.nonzero(self.keys[slots] == 0)[0]
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            if self.entries + len(new) > MOST:
                self.clear()
                new, where = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            first = missing[where]
            self._learn(new, [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist())])
            slots = self._slots(hashes)
        many = self.size[slots].astype(np.int64)
        to = np.cumsum(many)
        flat = self.store[np.repeat(self.at[slots] - (to - many), many) + np.arange(to[-1])]
        cuts = np.searchsorted(starts, ends[:-1])
        return np.split(flat, np.concatenate([[0], to])[cuts])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
