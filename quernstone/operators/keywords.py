"""Keyword dictionary and TF-IDF extraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import counted, tokens
from ..sources.tables import chunk_table
from .spread import FEW, cut, join_salted

FREQUENT, LONGEST = 20_000, 64  # words whose df all tasks know, and how many characters they may have
WORDS = 200_000  # words that a task works on at once, or one document's


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf): term counts of each row, without a shuffle."""
    return docs.select(key, F.explode(counted(tokens(F.col(text)))).alias("p")).select(key, F.col("p.value").alias("term"), F.col("p.n").alias("tf"))


def dictionary(docs: DataFrame) -> DataFrame:
    """(kb_id, keyword, df): in how many documents of a knowledge base a word occurs."""
    words = docs.select("kb_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("keyword"))
    return words.groupBy("kb_id", "keyword").agg(F.count("*").alias("df"))


def _by_words(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts with at most so many words, or one document."""
    ends = np.cumsum(pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def _candidates(docs: DataFrame, known: list[tuple[str, int]], rest: int, n: int, most: int) -> DataFrame:
    """(doc_id, term, tf, df): what may be among a document's `most` best words; df is null where it isn't known yet.

    Words that aren't known have a df from 1 to `rest`, so a score between two bounds. A word goes if its upper bound is
    below the lower bounds of `most` others.
    """
    words, dfs = [w for w, _ in known], np.array([d for _, d in known] + [0], np.int64)  # the last is for words that aren't known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(words, pa.string())
        for batch in (part for whole in batches for part in _by_words(whole, WORDS)):
            lists = batch["words"]
            flat = lists.flatten().dictionary_encode()
            terms = flat.dictionary
            places = pc.index_in(terms, value_set).fill_null(len(words)).to_numpy().astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            pair, tf = np.unique(row * max(len(terms), 1) + flat.indices.to_numpy(), return_counts=True)
            row, code = np.divmod(pair, max(len(terms), 1))
            df = dfs[places[code]]
            low = tf * np.log(n / np.where(df > 0, df, rest))
            high = tf * np.log(n / np.maximum(df, 1))
            order = np.lexsort((-low, row))
            starts = np.searchsorted(row, np.arange(len(batch) + 1))
            last = np.minimum(starts[:-1] + most, starts[1:]) - 1  # the place of each row's `most`th lower bound
            bar = np.where(starts[1:] > starts[:-1], low[order][np.maximum(last, 0)] if len(low) else 0.0, 0.0)
            keep = high >= bar[row] - 1e-5  # scores are rounded to 6 digits
            found = df[keep]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(row[keep])), terms.take(pa.array(code[keep])), pa.array(tf[keep].astype(np.int64)), pa.array(found, mask=found == 0)], names=["doc_id", "term", "tf", "df"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    return rows.mapInArrow(run, f"doc_id {kind}, term string, tf long, df long")


def tfidf(docs: DataFrame, most: int) -> DataFrame:
    """The `most` words of each document with the highest tf * ln(N / df), ties by the word.

    All tasks know the df of the FREQUENT words that most documents have, so only the others that can still be among a document's best
    are shuffled to meet theirs. These are rare, but for words of over LONGEST characters: if more documents have one than a mean partition
    holds words, it is dealt into parts.
    """
    spark = docs.sparkSession
    every = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    df = cut(every.groupBy("term").agg(F.count("*").alias("df")), "df")
    long = F.length("term") > LONGEST
    known = [(r["term"], r["df"]) for r in df.where(~long).orderBy(F.desc("df"), "term").limit(FREQUENT).collect()]
    n, sums = docs.count(), df.agg(F.sum("df").alias("total"), F.max(F.when(long, F.col("df"))).alias("longest")).first()
    rest = max(known[-1][1] if len(known) == FREQUENT else 1, sums["longest"] or 1)
    part = max(FEW, -(-(sums["total"] or 0) // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    heavy = None
    if (sums["longest"] or 0) > part:
        heavy = df.where(long & (F.col("df") > part)).select("term", F.ceil(F.col("df") / part).cast("int").alias("salts"))
    found = cut(_candidates(docs, known, rest, n, most), "candidates")
    rare = join_salted(found.where("df is null").drop("df"), df, ["term"], ["doc_id"], "inner", heavy)
    scored = found.where("df is not null").unionByName(rare).withColumn("score", F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", F.col("term").alias("keyword"), "tf", "score")


def of_chunks(docs: DataFrame, found: DataFrame, strategy: str) -> DataFrame:
    """(doc_id, chunk, keyword, tf): which of its document's keywords (doc_id, keyword) occur in a chunk, and how often.

    A document meets its few keywords before it is cut, so no other words are counted or shuffled.
    """
    own = found.groupBy("doc_id").agg(F.collect_set("keyword").alias("own"))
    known = docs.select("doc_id", "kb_id", "kb_part", "text").join(own, "doc_id")
    pieces = chunk_table(known, strategy, keep=("own",)).select("doc_id", F.concat_ws(":", "doc_id", "chunk_ix").alias("chunk"), "own", "content")
    kept = counted(F.filter(tokens(F.col("content")), lambda w: F.array_contains("own", w)))
    return pieces.select("doc_id", "chunk", F.explode(kept).alias("p")).select("doc_id", "chunk", F.col("p.value").alias("keyword"), F.col("p.n").alias("tf"))
