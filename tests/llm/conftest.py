import pytest
from pyspark.sql import functions as F


@pytest.fixture
def odd(spark):
    """Documents with every unusual case, and columns whose names the operators use themselves."""

    def make(texts=(), **more):
        rows = [(i, t) for i, t in enumerate(texts)]
        rows += [(900, None), (901, ""), (902, " \n\t "), (903, "lone"), (903, "lone"), (None, "text without an id"), (904, "ß ﬁ 😀 \x00 ퟿ end")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        extra = ["n", "key", "size", "score", "label", "token", "set_id", "found", "ids", "chunk", "shard", "signature", "text_key", "quality_score", "component", "copies", "rule", "kind"]
        return df.select("*", F.lit("xx").alias("lang"), F.lit("src").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(c) for c in extra])

    return make
