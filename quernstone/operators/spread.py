"""Written tables between stages, and joins whose heavy keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.scratch import remove, scratch


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: later jobs start here, also after an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Cuts the lineage of an iteration: each round's table is written, and the one before the last is removed."""

    def __init__(self, name: str) -> None:
        self.name, self.paths = name, []

    def cut(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        self.paths.append(scratch(spark, self.name))
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 2:
            remove(spark, self.paths.pop(0))
        return spark.read.schema(df.schema).parquet(self.paths[-1])


FEW = 20_000  # rows of one key that a task takes in any case


def heavy_keys(rows: DataFrame, key: list[str], few: int = FEW) -> DataFrame | None:
    """(key, salts) of the keys that have more rows than `few` and than a mean shuffle partition; None if there is none.

    There are fewer of them than shuffle partitions, so they may be sent to all tasks.
    """
    total, parts = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(few, -(-total // parts))
    if total <= most:
        return None
    counts = rows.groupBy(*key).agg(F.count("*").alias("salts")).where(F.col("salts") > most)
    if counts.isEmpty():
        return None
    return cut(counts.withColumn("salts", F.ceil(F.col("salts") / most).cast("int")), "heavy-keys")


def join_spread(left: DataFrame, right: DataFrame, key: str | list[str], by: list[str], how: str = "inner", few: int = FEW) -> DataFrame:
    """Join many rows of a key with the one row that the right side has for it.

    Keys that are too heavy for a task are dealt into parts by a hash of the left side's columns `by`, and the
    right side's row is repeated for each part. The left side should be written, as it is read twice.
    """
    key = [key] if isinstance(key, str) else key
    heavy = heavy_keys(left, key, few)
    return join_salted(left, right, key, by, how, heavy)


def join_salted(left: DataFrame, right: DataFrame, key: list[str], by: list[str], how: str, heavy: DataFrame | None) -> DataFrame:
    """The same with heavy keys that are known."""
    if heavy is None:
        return left.join(right.hint("merge"), key, how)
    heavy = F.broadcast(heavy)  # fewer rows than shuffle partitions
    many = F.coalesce("salts", F.lit(1))
    dealt = left.join(heavy, key, "left").withColumn("salt_", F.pmod(F.xxhash64(*by), many).cast("int")).drop("salts")
    repeated = right.join(heavy, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    return dealt.join(repeated.hint("merge"), [*key, "salt_"], how).drop("salt_")
