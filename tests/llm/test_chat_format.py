import hashlib
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm.chat_format import MAPPINGS, Mapping, as_records, canonical_turns, digest, escaped, fingerprint, format_conversations, formatted, parsed, record_schema, unescaped

PIECES = ["<", "[", "\\", "/", "s>", "INST]", "</s>", "[/INST]", "<s>", "[INST]", "<\\/s>", "<\\\\s>", "a", "é😀", "\n", " ", "\x00"]


def test_escapes_can_be_taken_back(spark):
    rng = random.Random(1)
    texts = [""] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).select("t", "e", unescaped(F.col("e")).alias("back"))
    for r in df.collect():
        assert r["back"] == r["t"]
        assert not any(mark in r["e"] for mark in ("<s>", "</s>", "[INST]", "[/INST]"))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), max_size=6))
def test_turns_are_read_back(turns):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(1, "x", [{"role": r, "text": t} for r, t in turns])], "id int, layout string, turns array<struct<role:string,text:string>>")
    row = formatted(df, "id").select("formatted", "segments", parsed(F.col("formatted")).alias("back")).first()
    assert [tuple(t) for t in row["back"]] == turns
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]


RECORDS = [
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "gpt", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
    ("messages", {"messages": [{"role": "user"}, {"role": "assistant", "content": ""}], "extra": {"x": [1]}}, [("user", ""), ("assistant", "")]),
    ("from_value", {"conversations": [{"from": "human", "value": "q"}, {"from": "bot", "value": "a", "weight": 1}]}, [("user", "q"), ("assistant", "a")]),
    ("prompt_completion", {"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ("prompt_completion", {"completion": "c", "prompt": "p", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ("prompt_response", {"prompt": "p", "response": "c"}, [("user", "p"), ("assistant", "c")]),
    ("instruction", {"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ("instruction", {"instruction": "i", "input": "n", "output": "o", "system": "s"}, [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "o")]),
    ("question_answer", {"question": "q", "answer": "a", "context": "c"}, [("system", "c"), ("user", "q"), ("assistant", "a")]),
    ("rows", {"turns": [{"turn": 2, "role": "assistant", "text": "a"}, {"turn": 1, "role": "user", "text": "q"}]}, [("user", "q"), ("assistant", "a")]),
    (None, {"prompt": "p"}, []),
    (None, {"prompt": "p", "completion": "c", "messages": [{"role": "user", "content": "q"}]}, []),
    (None, {"messages": []}, []),
    (None, {}, []),
]


def test_layouts(spark):
    rows = [(i, json.dumps(record)) for i, (_, record, _) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "id int, raw string").withColumn("r", F.from_json("raw", record_schema())).select("id", "r.*")
    found = {r["id"]: r for r in canonical_turns(df, "id").collect()}
    for i, (layout, _, turns) in enumerate(RECORDS):
        assert found[i]["layout"] == layout
        assert [tuple(t) for t in found[i]["turns"]] == turns
    prints = {r["layout"]: r["p"] for r in df.withColumn("p", fingerprint(df)).join(canonical_turns(df, "id"), "id").where("layout is not null").collect()}
    assert len(set(prints.values())) == len(prints) == len(MAPPINGS)
    out = {r["id"]: r for r in digest(formatted(canonical_turns(df, "id"), "id"), "id").collect()}
    assert out[0]["n_turns"] == 2 and out[10]["layout"] is None and len(out) == len(RECORDS)


def test_a_mapping_of_ones_own(spark):
    mine = (Mapping("dialogue", items="dialogue", role="who", text="says", by="at", names=(("Q", "user"), ("A", "assistant"))),)
    df = spark.sql("SELECT 1 AS id, array(struct(2 AS at, 'A' AS who, 'a' AS says), struct(1 AS at, 'Q' AS who, 'q' AS says)) AS dialogue, 'x' AS prompt")
    assert [tuple(t) for t in canonical_turns(df, "id", mine).first()["turns"]] == [("user", "q"), ("assistant", "a")]


def told(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_odd_rows(spark):
    long = "x</s>" * 200_000
    rows = [
        (1, 2, "assistant", None), (1, 1, "user", "[INST]"), (1, None, "system", "first"), (2, 0, None, ""), (2, 0, "assistant", "b"), (2, 0, "assistant", "b"),
        (None, 1, "user", "no id"), (3, 0, "assistant", long), (3, 1, "assistant", "é😀"), (4, None, "user", "only null"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 AS layout", "2 AS turns", "3 AS messages", "4 AS prompt", "5 AS segments", "6 AS formatted", "7 AS print_")
    found = {r["conv_id"]: r for r in format_conversations(df).collect()}
    turns = {1: [("system", "first"), ("user", "[INST]"), ("assistant", "")], 2: [("", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "no id")], 3: [("assistant", long), ("assistant", "é😀")], 4: [("user", "only null")]}
    assert set(found) == set(turns)
    for conv, wanted in turns.items():
        r, learned = found[conv], "".join(t for role, t in wanted if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(wanted), told(wanted), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert found[3]["formatted_chars"] > len(long) + 200_000
    assert format_conversations(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark, sf_dir):
    df = format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan
    assert as_records(spark.read.parquet(f"{sf_dir}/conversations.parquet")).columns == ["conv_id", "turns"]
