"""What the operators share: components, slices of batches, text as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spread import FEW, Rounds, cut, heavy_keys, join_salted, join_spread  # noqa: F401  (operators take them from here)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(a, b) links to (node, component), component being the smallest node reachable.

    Alternating large-star and small-star steps: each node's larger neighbours, then its smaller ones, are
    linked to the smallest neighbour. Minima are aggregated before they are shuffled, and a node with very many
    neighbours is dealt into parts, so it is no hot key; the number of links never grows. Nodes without links
    aren't in the result.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        if large:
            both = both.unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = join_spread(both, least, "u", ["v"])
        if large:
            out = out.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        else:
            out = out.select(F.explode(F.array("u", "v")).alias("hi"), F.col("m").alias("lo"))
        return out.where("hi <> lo").distinct()

    sign, tables = None, Rounds("links")
    for _ in range(rounds):
        links = tables.cut(star(tables.cut(star(links, True)), False))
        now = links.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long")), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def slices(batch: pa.RecordBatch, column: int, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with at most about `size` bytes of text in a column, long texts alone; Spark bounds the batch itself by bytes."""
    sizes = np.cumsum(np.nan_to_num(np.array(pc.binary_length(batch.column(column)).to_pylist(), float)) + 64)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)))
        yield batch.slice(at, to - at)
        at = to


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), _BASE)]))
    return _POWERS[:n]


_INVERSES = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        one = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _INVERSES = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 16), one)]))
    return _INVERSES[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each span of the units (bytes or code points), equal for equal spans anywhere.

    A sum of (unit + 1) * base**position is taken over each span and divided by base**start.
    """
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers(len(units)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverses(len(units) + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
