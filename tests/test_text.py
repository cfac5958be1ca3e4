import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import keys, text


def column(spark, values, maker):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[0] for r in df.select(maker(F.col("text")).alias("x"), "i").orderBy("i").select("x").collect()]


EDGE = ["", "a", "ab", "äßéñ", "One two. Three!", "x" * 451, "a\n\nb", None]


def test_tokens(spark):
    assert column(spark, ["One, TWO-3 ä", "", None], text.tokens) == [["one", "two", "3", "ä"], [], None]


def fixed(t, size, overlap):
    return [t[i : i + size] for i in range(0, max(len(t) - overlap - 1, 0) + 1, size - overlap)]


@pytest.mark.parametrize("size,overlap", [(200, 50), (5, 0), (3, 2), (1, 0)])
def test_chunks_fixed(spark, size, overlap):
    values = [*EDGE[:-1], "emoji 😀😀 and more text here"]
    assert column(spark, values, lambda c: text.chunks_fixed(c, size, overlap)) == [fixed(v, size, overlap) for v in values]


def test_chunks_lines_and_sentences(spark):
    assert column(spark, ["a\nb\n", ""], text.chunks_lines) == [["a", "b", ""], [""]]
    assert column(spark, ["One. Two! Three", ""], text.chunks_sentences) == [["One.", " Two!", " Three"], []]


@given(st.text(alphabet="ab. \n", max_size=80), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_recursive_keeps_everything(value, size):
    pieces = text.split_recursive(value, size)
    assert "".join(pieces) == value
    assert all(0 < len(p) <= size for p in pieces)


def test_trigrams():
    import numpy as np
    import pandas as pd

    from quernstone.operators.trigrams import TrigramEmbedder, bucket_counts

    wide = "".join(chr(0x4E00 + i) for i in range(300))  # more characters than a table takes
    texts = ["abcab", "", "ab", "déjà déjà", "😀😀😀😀", wide, "x" * 5]
    for own in (texts, texts[:4]):
        want = np.zeros((len(own), 7))
        for i, t in enumerate(own):
            for j in range(len(t) - 2):
                want[i, int(hashlib.md5(t[j : j + 3].encode()).hexdigest()[:8], 16) % 7] += 1
        assert (bucket_counts(own, 7) == want).all()
    vectors = TrigramEmbedder(16).embed(pd.Series(["Some text", None], index=[3, 9]))
    assert list(vectors.index) == [3, 9] and abs((vectors[3] ** 2).sum() - 1) < 1e-6 and not vectors[9].any()


def test_trigrams_are_hashed_once_in_a_process(monkeypatch):
    from quernstone.operators import trigrams

    first = trigrams.bucket_counts(["some words and others", "more"], 16)
    monkeypatch.setattr(trigrams, "_hashed", None)
    assert (trigrams.bucket_counts(["more", "some words and others"], 16) == first[::-1]).all()


def test_trigrams_of_more_letters_than_have_a_table(monkeypatch):
    import numpy as np

    from quernstone.operators import trigrams

    monkeypatch.setattr(trigrams, "LETTERS", 6)
    monkeypatch.setattr(trigrams, "_letters", np.zeros(1 << 16, np.int64))
    monkeypatch.setattr(trigrams, "_seen", np.zeros(6**3, np.int64))
    for own in ("abc", "abcdef", "fedcba", "abcdefg", "😀abc", "gabc", "abc\ud800", "cabfed"):
        want = np.zeros((1, 9))
        for j in range(len(own) - 2):
            want[0, int(hashlib.md5(own[j : j + 3].encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % 9] += 1
        assert (trigrams.bucket_counts([own], 9) == want).all(), own
    assert trigrams._letters.max() == 6 and (trigrams._seen > 0).sum() > 8


def test_chunker_arguments():
    with pytest.raises(ValueError):
        text.chunker("nothing")
    with pytest.raises(ValueError):
        text.chunker("fixed", 10, 10)


def test_parse_by_extension(spark, tmp_path):
    from quernstone.sources.tables import files

    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.HTML").write_text("<p>Hello <b>you</b></p><script>x</script>")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    found = {r["filename"]: r["text"] for r in files(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": "plain", "b.HTML": "Hello you", "c.bin": None}


def test_keys(spark):
    df = spark.createDataFrame([("src0", "payload")], "kb string, p string")
    row = df.select(keys.kb_part(F.col("kb")).alias("part"), keys.sign("s")(F.col("p")).alias("sig"), keys.unseal(keys.seal(F.col("p"), F.lit("0" * 32)), F.lit("0" * 32)).alias("back")).first()
    assert row["part"] == hashlib.sha256(b"src0").hexdigest()[:12]
    assert row["sig"] == "sha256=" + hmac.new(b"s", b"payload", hashlib.sha256).hexdigest()
    assert row["back"] == "payload"


def test_counted_in_the_row(spark):
    from quernstone.functions.text import counted

    rows = spark.createDataFrame([(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"]), (4, None)], "id long, words array<string>")
    found = {r["id"]: r["n"] and [tuple(x) for x in r["n"]] for r in rows.select("id", counted(F.col("words")).alias("n")).collect()}
    assert found[1] == [("a", 1), ("b", 3), ("c", 1)] and not found[2] and found[3] == [("x", 1)] and not found[4]
    assert "Exchange" not in rows.select(counted(F.col("words")))._jdf.queryExecution().executedPlan().toString()
