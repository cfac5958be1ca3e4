"""Columns for parsing, chunking and tokenizing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def runs(ordered: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """(first, many) for each run of elements with an equal key in a sorted array: where it begins, from 1, and how long it is.

    Arrays are wrapped and named, as an expression within a lambda is worked out anew for each element.
    """
    every = F.when(F.size(ordered) > 0, F.sequence(F.lit(1), F.size(ordered))).otherwise(F.array().cast("array<int>"))
    heads = F.filter(every, lambda i: (i == 1) | (key(F.element_at(ordered, i)) != key(F.element_at(ordered, F.greatest(i - 1, F.lit(1))))))
    ends = F.array(F.struct(heads.alias("h"), F.size(ordered).alias("n")))
    return F.transform(ends, lambda e: F.transform(e["h"], lambda i, j: F.struct(i.alias("first"), (F.coalesce(F.try_element_at(e["h"], j + 2), e["n"] + 1) - i).alias("many"))))[0]


def counted(values: Column) -> Column:
    """(value, n) for each different value of an array, without leaving the row."""
    return F.transform(F.array(F.sort_array(values)), lambda v: F.transform(runs(v), lambda r: F.struct(F.element_at(v, r["first"]).alias("value"), r["many"].cast("long").alias("n"))))[0]


def html_to_text(html: Column) -> Column:
    """Without scripts, styles and tags, white space collapsed. A plain parser for ingest."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def parse(content: Column, mime: Column) -> Column:
    """Text of a file by its kind; kinds without a parser give null."""
    text = content.cast("string")
    return (
        F.when(mime.isin("text/plain", "text/markdown", "text/csv", "application/json"), text)
        .when(mime == "text/html", html_to_text(text))
        .otherwise(F.lit(None).cast("string"))
    )


def mime_of(filename: Column) -> Column:
    """The parser is chosen by the file name's extension."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "json": "application/json", "html": "text/html", "htm": "text/html"}
    chosen = F.lit("application/octet-stream")
    for name, mime in kinds.items():
        chosen = F.when(ext == name, mime).otherwise(chosen)
    return chosen


def chunks_fixed(text: Column, size: int, overlap: int) -> Column:
    """An array of pieces of `size` characters that share `overlap` with the piece before.

    One pass over the text: at every step of size - overlap characters a look-ahead takes the piece. A rest that
    the piece before holds already is none.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)(?=(\\A.{{0,{size}}}|.{{{overlap + 1},{size}}})).{{1,{size - overlap}}}"), F.lit(1))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(pieces)


def chunks_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks_sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0))


def split_recursive(text: str, size: int, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does; separators stay at the left."""
    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(separators[0])
    parts = [p + separators[0] for p in parts[:-1]] + [parts[-1]]
    out, held = [], ""
    for part in parts:
        if len(held) + len(part) <= size:
            held += part
            continue
        if held:
            out.append(held)
        held = ""
        if len(part) <= size:
            held = part
        else:
            out += split_recursive(part, size, separators[1:])
    return [*out, held] if held else out


def chunks_recursive(size: int):
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursive(t or "", size))

    return run


CHUNKERS = {
    "fixed": lambda text, size, overlap: chunks_fixed(text, size, overlap),
    "line": lambda text, size, overlap: chunks_lines(text),
    "sentence": lambda text, size, overlap: chunks_sentences(text),
    "recursive": lambda text, size, overlap: chunks_recursive(size)(text),
}


def chunker(strategy: str, size: int = 200, overlap: int = 50):
    """A function from text to an array of chunks."""
    if strategy not in CHUNKERS:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return lambda text: CHUNKERS[strategy](text, size, overlap)
