"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lower-cased and runs of white space become one space. An item of m characters
may be found with k = floor(BUDGET * m) edits (fewer for short items, so that the filter still says something).
An occurrence then shares at least m + 1 - Q * (k + 1) q-grams with the item, all on diagonals that differ by
at most k. Shared q-grams of one text are counted in overlapping diagonal bands that are as wide as the item's own k
asks for; bands that reach the bound are regions, and a banded alignment of each region, within its text, gives the
exact edit distance at every end that is within the budget. Where a q-gram repeats at even steps in a text or an item, as in a
rule of dashes, the steps are one entry that counts for all bands it crosses, and entries are added up in parts of PAIRS, so
repeated characters take no more memory than others. Items shorter than a q-gram are looked up exactly.

Every document is read as a whole. The items are sent to all tasks in parts of about ITEM_CHARS
characters, a part a pass; the driver holds one part at a time. Nulls: null texts and null items contain nothing, and neither do empty items; a null
doc_id is kept. `drop_contaminated` leaves items of fewer than `shortest` characters out, as most documents hold a letter or
a short word. Very long texts are read whole; other columns don't matter, whatever their names. Equal items are separate. For each
end the fewest edits count, then the latest start; of overlapping occurrences of one item the one with the fewest
edits stays, then the leftmost. Empty tables give no rows. Repeated rows are separate.
Offsets are code points of the given text, the end exclusive.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds

Q, BUDGET, ITEM_CHARS, WINDOW, BATCH_CHARS, TABLE_BITS, ALIGNED, CELLS = 10, 0.08, 8_000_000, 400_000, 400_000, 22, 512, 4_000_000
PAIRS, STRIDE, KINDS = 1_000_000, 64, 16  # entries that are added up at a time; the largest even step between equal q-grams
GAP = 0x110000  # stands between texts


@lru_cache(1)
def _maps() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(GAP + 1, dtype=np.uint32)
    white = np.zeros(GAP + 1, bool)
    for i in range(GAP):
        c = chr(i)
        if not 0xD800 <= i < 0xE000 and len(low := c.lower()) == 1:
            lower[i] = ord(low)
        white[i] = c.isspace()
    return lower, white


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the normal forms, each text followed by a gap; where each came from; where texts begin."""
    lower, white = _maps()
    codes = np.frombuffer("".join(f"{t}\x00" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    codes[begins[1:] - 1] = GAP
    blank = white[codes]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[0] = True
    origin = np.nonzero(keep)[0]
    return np.where(blank, 32, lower[codes])[origin].astype(np.uint32), origin, begins


def grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position."""
    n = len(codes) - q + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(q if n > 0 else 0):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : n + j]
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def edits(m: int) -> int:
    return max(-1, min(int(BUDGET * m), (m - 1) // Q - 1))


def progressions(group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending positions of each group as runs of even steps: the index of each run's first position, its step and its length."""
    n = len(at)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    step = np.ones(n, np.int64)
    step[:-1] = at[1:] - at[:-1]
    alone = np.ones(n, bool)  # nothing of its group follows near by
    alone[:-1] = (group[1:] != group[:-1]) | (step[:-1] > STRIDE) | (step[:-1] <= 0)
    new = np.ones(n, bool)
    new[1:] = alone[1:] | alone[:-1] | (step[1:] != step[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return first, np.where(alone[first], 1, step[first]), np.diff(np.append(first, n))


class Index:
    """The q-grams of the items, with a bit table in front."""

    def __init__(self, items: list[tuple[object, str]]) -> None:
        self.ids, self.codes = [], []
        for item, text in items:
            codes = normal([text.strip()])[0][:-1]
            if len(codes):
                self.ids.append(item)
                self.codes.append(codes)
        self.k = np.array([max(0, edits(len(c))) for c in self.codes], np.int64)
        self.least = np.array([max(1, len(c) + 1 - Q * (k + 1)) for c, k in zip(self.codes, self.k)], np.int64)
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.kinds = np.array([np.bincount(c % KINDS, minlength=KINDS) for c in self.codes]).reshape(-1, KINDS)
        hashes = [grams(c) for c in self.codes]
        every = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        offset = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
        order = np.lexsort((offset, item, every))
        every, item, offset = every[order], item[order], offset[order]
        group = np.cumsum(np.concatenate([[0], (every[1:] != every[:-1]) | (item[1:] != item[:-1])])) if len(every) else item
        first, self.step, self.times = progressions(group, offset)
        self.item, self.offset = item[first], offset[first]
        self.keys, self.first, self.many = np.unique(every[first], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self._slot(self.keys)] = True
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: hashes, ascending, and items
        for m in sorted({int(n) for n in self.sizes if n < Q}):
            mine = np.flatnonzero(self.sizes == m)
            h = np.array([grams(self.codes[i], m)[0] for i in mine], np.uint64)
            order = np.argsort(h, kind="stable")
            self.short[m] = h[order], mine[order]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def shared(self, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, text, position, step, times) of the q-grams that the codes share with an item: the same q-gram at even steps is one."""
        positions, keys = [], []
        for at in range(0, max(1, len(codes) - Q + 1), WINDOW):
            h = grams(codes[at : at + WINDOW + Q - 1])
            where = np.nonzero(self.table[self._slot(h)])[0]
            found = np.minimum(np.searchsorted(self.keys, h[where]), len(self.keys) - 1)
            real = self.keys[found] == h[where]
            positions.append(where[real] + at)
            keys.append(found[real])
        position, key = np.concatenate(positions), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        position, key = position[order], key[order]
        text = np.searchsorted(begins, position, "right") - 1
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else key
        first, step, times = progressions(group, position)
        return key[first], text[first], position[first], step, times

    def regions(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows (text, item, first diagonal of a band) where the bound is met, those of longer items first.

        Two bands in turn are as wide as the item's own budget needs, and only q-grams of one text are counted together. An
        entry counts in a band for the item's offsets that can meet one of its positions there.
        """
        if not len(self.keys):
            return np.zeros((0, 3), np.int64)
        key, text, position, step, times = self.shared(codes, begins)
        if not len(key):
            return np.zeros((0, 3), np.int64)
        many = self.many[key]
        ahead = int(self.sizes.max()) + 2  # diagonals begin here below 0
        span = len(codes) + 2 * ahead
        found = []
        for half in (0, 1):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def reduced() -> tuple[np.ndarray, np.ndarray]:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

            ends = np.cumsum(many)
            begin = 0
            while begin < len(key):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                n = many[begin:stop]
                post = np.repeat(self.first[key[begin:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                a, s, t = (np.repeat(x[begin:stop], n) for x in (position, step, times))
                item, b, u, m = self.item[post], self.offset[post], self.step[post], self.times[post]
                wide = 2 * (self.k[item] + 1)
                shift = half * (self.k[item] + 1)
                last = a + s * (t - 1)  # the entry's last position
                low, high = (a - b - u * (m - 1) + shift) // wide, (last - b + shift) // wide
                pair = np.repeat(text[begin:stop], n) * len(self.ids) + item
                crossed = high - low + 1
                to = np.cumsum(crossed)
                at = 0
                while at < len(a):
                    upto = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + PAIRS, "right")))
                    c = crossed[at:upto]
                    each = np.repeat(np.arange(at, upto), c)
                    band = low[each] + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                    bottom = band * wide[each] - shift[each]
                    # offsets b + u j that lie on one of the band's diagonals with a position from a to last
                    j0 = np.maximum(-((b[each] - a[each] + bottom + wide[each] - 1) // u[each]), 0)
                    j1 = np.minimum((last[each] - bottom - b[each]) // u[each], m[each] - 1)
                    some = j1 >= j0
                    held.append((pair[each][some] * span + band[some] + ahead, (j1 - j0 + 1)[some]))
                    size += len(held[-1][0])
                    at = upto
                    if size > 2 * PAIRS:
                        held = [reduced()]
                        size = len(held[0][0])
                begin = stop
            keys, counts = reduced()
            of_text, of_item = np.divmod(keys // span, len(self.ids))
            width = self.k[of_item] + 1
            good = counts >= self.least[of_item]
            found.append(np.stack([of_text, of_item, (keys % span - ahead) * 2 * width - half * width], 1)[good])
        rows = np.unique(np.concatenate(found), axis=0)
        return rows[np.argsort(-self.sizes[rows[:, 1]], kind="stable")]

    def possible(self, codes: np.ndarray, begins: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """The regions whose text holds enough of the item's characters; what is missing takes an edit each. Characters are counted by KINDS."""
        texts, items, first = regions.T
        low = np.maximum(first - self.k[items], begins[texts])
        high = np.minimum(first + 3 * self.k[items] + 3 + self.sizes[items], begins[texts + 1])
        high = np.maximum(high, low)
        kind, missing = codes % KINDS, np.zeros(len(regions), np.int64)
        for c in range(KINDS):
            before = np.concatenate([[0], np.cumsum(kind == c, dtype=np.int32)])
            missing += np.maximum(self.kinds[items, c] - (before[high] - before[low]), 0)
        return regions[missing <= self.k[items]]

    def exact(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows as `align` gives them for the items shorter than a q-gram."""
        rows = [np.zeros((0, 5), np.int64)]
        for m, (hashes, items) in self.short.items():
            h = grams(codes, m)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            where = np.flatnonzero(high > low)
            n = (high - low)[where]
            start, item = np.repeat(where, n), items[np.repeat(low[where] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            same = np.ones(len(start), bool)
            for j in range(m):
                same &= codes[start + j] == np.array([self.codes[i][j] for i in range(len(self.codes)) if len(self.codes[i]) == m], np.uint32)[np.searchsorted(np.sort(items), item)]
            start, item = start[same], item[same]
            rows.append(np.stack([np.searchsorted(begins, start, "right") - 1, item, start + m, np.zeros_like(start), -start], 1))
        return np.concatenate(rows)

    def align(self, codes: np.ndarray, begins: np.ndarray, regions: np.ndarray) -> np.ndarray:
        """Rows (text, item, end, edits, -start) of all occurrences within the budget on the regions' diagonals.

        For each end the fewest edits count, then the latest start. Nothing outside the region's text or its
        diagonals is aligned. All regions run side by side, those of longer items first, so that those still
        running are a prefix. A cell holds edits * unit and, below that, how far the start lies from the last lane.
        """
        texts, items, first = regions.T
        sizes, k = self.sizes[items], self.k[items]
        low, widths, longest = first - k, 4 * k + 3, int(sizes[0])
        width = int(widths.max())
        unit = 1 << width.bit_length()
        far = (longest + width + 2) * unit
        kind = np.int32 if far + (width + 2) * unit < 1 << 31 else np.int64
        at = low[:, None] + np.arange(width + longest)
        inside = (at >= begins[texts, None]) & (at < begins[texts + 1, None] - 1)
        text = np.where(inside, codes[np.clip(at, 0, len(codes) - 1)], GAP)
        own = np.full((len(items), longest), GAP + 1, np.uint32)
        for i, item in enumerate(items):
            own[i, : sizes[i]] = self.codes[item]
        lanes = np.arange(width)
        inserted = (lanes * unit).astype(kind)
        least = np.where(lanes < widths[:, None], 0, far).astype(kind)
        row = np.maximum((width - 1 - lanes).astype(kind), least)
        live = np.searchsorted(-sizes, -np.arange(longest), "left")
        for i in range(longest):
            n = live[i]
            new = np.multiply(text[:n, i : i + width] != own[:n, i, None], unit, dtype=kind)
            new += row[:n]
            np.minimum(new[:, :-1], row[:n, 1:] + kind(unit), out=new[:, :-1])
            new -= inserted
            np.minimum.accumulate(new, 1, out=new)
            new += inserted
            np.maximum(new, least[:n], out=row[:n])
        edits = row // unit
        region, lane = np.nonzero(edits <= k[:, None])
        start = low[region] + width - 1 - row[region, lane] % unit
        end = low[region] + lane + sizes[region]
        rows = np.stack([texts[region], items[region], end, edits[region, lane], -start], 1).astype(np.int64)
        return rows[(start >= begins[rows[:, 0]]) & (end < begins[rows[:, 0] + 1])]


def occurrences(texts: list[str], index: Index) -> list[list[tuple[int, int, int, int]]]:
    """(item, start, end, edits) in each text."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not index.ids or not texts:
        return out
    codes, origin, raw_begins = normal(texts)
    begins = np.searchsorted(origin, raw_begins)
    regions, found, at = index.regions(codes, begins), [index.exact(codes, begins)], 0
    if len(regions):
        regions = index.possible(codes, begins, regions)
    while at < len(regions):
        item = regions[at, 1]
        many = max(1, min(ALIGNED, CELLS // int(index.sizes[item] + 4 * index.k[item] + 3)))
        found.append(index.align(codes, begins, regions[at : at + many]))
        at += many
    rows = np.unique(np.concatenate(found), axis=0)
    best = np.ones(len(rows), bool)
    best[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    rows = rows[best]
    kept: list[int] = []
    last = None
    for text, item, end, cost, start in rows[np.lexsort((rows[:, 2], -rows[:, 4], rows[:, 3], rows[:, 1], rows[:, 0]))].tolist():
        if (text, item) != last:
            kept, last = [], (text, item)
        edge = bisect_right(kept, -start)  # starts and ends in turn
        if edge % 2 or edge < len(kept) and kept[edge] < end:
            continue
        kept[edge:edge] = [-start, end]
        base = int(raw_begins[text])
        out[text].append((item, int(origin[-start]) - base, int(origin[end - 1]) + 1 - base, cost))
    return out


def item_parts(benchmark: DataFrame) -> Iterator[tuple[int, Index]]:
    """The number of parts still to come and an index over a part of the items, of about ITEM_CHARS characters, one after the other."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // ITEM_CHARS) + 1
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        yield parts - 1 - i, Index(sorted(((r["item_id"], r["text"]) for r in items.where(slot == i).collect()), key=lambda r: (str(r[0]), r[1])))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    texts, at = batch.column(batch.schema.names.index("text")), 0
    while at < len(batch):
        part, size = [], 0
        while at + len(part) < len(batch) and (not part or size < BATCH_CHARS):
            part.append(texts[at + len(part)].as_py() or "")
            size += len(part[-1])
        yield batch.slice(at, len(part)), part
        at += len(part)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_at, end_at and edits of each occurrence."""

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _parts(batch):
                    ids = part.column(0).to_pylist()
                    rows = [(ids[i], index.ids[item], s, e, c) for i, hits in enumerate(occurrences(texts, index)) for item, s, e, c in hits]
                    columns = list(zip(*rows)) or [[]] * 5
                    kinds = [part.schema.field(0).type, item_type, pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "start_at", "end_at", "edits"])

        return run

    kinds = dict(docs.dtypes) | dict(benchmark.dtypes)
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kinds["item_id"], pa.string())
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start_at long, end_at long, edits long"
    found, passes = None, Rounds("found")
    for left, index in item_parts(benchmark):
        now = docs.select("doc_id", "text").mapInArrow(finder(index), schema)
        found = now if found is None else found.unionByName(now)
        if left:  # so that this part's index is done with
            found = passes.cut(found)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shortest: int = Q) -> DataFrame:
    """The documents in which no item of at least `shortest` characters occurs, with their columns."""
    benchmark = benchmark.where(F.length(F.trim("text")) >= shortest)

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, texts in _parts(batch):
                    yield part.filter(pa.array([not hits for hits in occurrences(texts, index)], pa.bool_()))

        return run

    passes = Rounds("clean")
    for left, index in item_parts(benchmark):
        docs = docs.mapInArrow(keep(index), docs.schema)
        if left:
            docs = passes.cut(docs)
    return docs
