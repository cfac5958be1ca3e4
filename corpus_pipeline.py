"""Raw documents to packed training sequences: five stages, each written and reread before the next.

Null and empty texts, null and repeated ids, very long texts and columns of any name pass through every stage; what a stage does with
them its operator's module states: a text without words is scored like others, is near to nothing, holds no item and no secret,
and is one piece of its end mark. Ties are settled by the operators (the smallest id of a group stays). Empty tables give no rows,
and without labels or findings to learn from all documents stay. All columns are kept until the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import cut
from quernstone.llm.decontaminate import drop_contaminated
from quernstone.llm.ngram_join import keep_one
from quernstone.llm.packing import pack
from quernstone.llm.quality import keep_good
from quernstone.llm.queries import vocabulary
from quernstone.llm.secrets import redact
from quernstone.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets stays."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of token sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

ORACLE_SQL = None  # models, alignment and tokenization are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
