"""Command line over a folder of tables (raw) or a lake of chunks with a partition for each knowledge base.

    query <folder> "<text>" | kb ls <folder> | run <folder> <query>
    kb create|rm <lake> <id> | ingest <lake> <id> <files> | status <lake>
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import kb_part
from ..operators import catalog, mutations, retrieval
from ..operators.embedding import embed_with
from ..operators.trigrams import TrigramEmbedder
from ..sources.tables import chunk_table, documents, files
from .queries import QUERIES
from .ship import ship

KB = "kb_id string, kb_part string, chunk_size long, chunk_overlap long, kmeans_k long"
CHUNK = "kb_id string, doc_id long, filename string, chunk_ix int, chunk_id string, content string, n_chars int, embedding array<float>, kb_part string"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernstone")
    commands = top.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("query", help="ask all documents of a folder")
    ask.add_argument("folder")
    ask.add_argument("text")
    ask.add_argument("--top-k", type=int, default=5)
    ask.add_argument("--keyword-weight", type=float, default=0.4)
    kb = commands.add_parser("kb", help="knowledge bases: of a folder (ls), or in a lake")
    kb.add_argument("action", choices=["ls", "create", "rm"])
    kb.add_argument("folder")
    kb.add_argument("id", nargs="?")
    put = commands.add_parser("ingest", help="files into a lake's knowledge base")
    put.add_argument("folder")
    put.add_argument("id")
    put.add_argument("files")
    state = commands.add_parser("status", help="what a lake holds")
    state.add_argument("folder")
    run = commands.add_parser("run", help="a registered query")
    run.add_argument("folder")
    run.add_argument("name", choices=sorted(QUERIES))
    return top


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, empty if it isn't there yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def create(spark: SparkSession, lake: str, kb_id: str) -> bool:
    """Tells whether the id was free. A base is a partition of its own, so creating one touches no other."""
    bases = _table(spark, f"{lake}/kb", KB).where(F.col("kb_part") == kb_part(F.lit(kb_id)))
    if not bases.isEmpty():
        return False
    new = spark.createDataFrame([(kb_id, None, None, None)], "kb_id string, chunk_size long, chunk_overlap long, kmeans_k long")
    mutations.overwrite_partitions(catalog.create_kbs(bases, new), f"{lake}/kb")
    return True


def remove(spark: SparkSession, lake: str, kb_id: str) -> bool:
    part = spark.range(1).select(kb_part(F.lit(kb_id))).first()[0]
    mutations.drop_partition(spark, f"{lake}/chunk", "kb_part", part)
    return mutations.drop_partition(spark, f"{lake}/kb", "kb_part", part)


def ingest(spark: SparkSession, lake: str, kb_id: str, path: str) -> None:
    """Files of a name replace the ones before; the base's partition alone is rewritten."""
    base = _table(spark, f"{lake}/kb", KB).where((F.col("kb_part") == kb_part(F.lit(kb_id))) & (F.col("kb_id") == kb_id)).first()
    if base is None:
        raise ValueError(f"no knowledge base {kb_id!r}")
    docs = files(spark, path).where("text is not null").withColumn("doc_id", F.xxhash64("filename")).withColumn("kb_id", F.lit(kb_id)).withColumn("kb_part", kb_part(F.col("kb_id")))
    chunks = chunk_table(docs, "fixed", base["chunk_size"], base["chunk_overlap"]).join(docs.select("doc_id", "filename"), "doc_id")
    chunks = chunks.withColumn("embedding", embed_with(TrigramEmbedder())("content")).select(*[c.split()[0] for c in CHUNK.split(", ")])
    old = _table(spark, f"{lake}/chunk", CHUNK).where(F.col("kb_part") == kb_part(F.lit(kb_id)))
    kept = mutations.replace_set(old, chunks, "filename")
    staged = f"{lake}/.staged-{kb_id}"
    kept.write.mode("overwrite").parquet(staged)  # what is overwritten can't be read at the same time
    mutations.overwrite_partitions(spark.read.schema(CHUNK).parquet(staged), f"{lake}/chunk")


def status(spark: SparkSession, lake: str) -> DataFrame:
    counted = _table(spark, f"{lake}/chunk", CHUNK).groupBy("kb_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.count("embedding").alias("n_embedded"))
    return _table(spark, f"{lake}/kb", KB).select("kb_id").join(counted, "kb_id", "left").fillna(0)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if args.command == "kb" and args.action == "ls":
        catalog.kb_list(documents(spark, args.folder)).orderBy("kb_id").show(100, False)
    elif args.command == "kb":
        if not args.id:
            parser().error(f"kb {args.action} needs an id")
        done = (create if args.action == "create" else remove)(spark, args.folder, args.id)
        print(f"{args.action} {args.id}: {'done' if done else 'taken' if args.action == 'create' else 'not there'}")
    elif args.command == "ingest":
        ingest(spark, args.folder, args.id, args.files)
    elif args.command == "status":
        status(spark, args.folder).orderBy("kb_id").show(100, False)
    elif args.command == "run":
        QUERIES[args.name](spark, args.folder).show(50, 80)
    else:
        asked = spark.createDataFrame([(0, args.text)], "query_id long, text string")
        found = retrieval.query(documents(spark, args.folder), asked, args.top_k, keyword_weight=args.keyword_weight, include_content=True)
        found.orderBy("rank").show(args.top_k, 80)


if __name__ == "__main__":
    main()
