from quernstone.operators import spread


def test_heavy_keys_join_like_others(spark):
    rows = [(1, i) for i in range(300)] + [(k, k) for k in range(2, 60)] + [(99, 0), (None, 5)]
    left = spread.cut(spark.createDataFrame(rows, "k long, v long"), "left")
    right = spark.createDataFrame([(k, f"n{k}") for k in range(0, 60)], "k long, name string")
    heavy = {r["k"]: r["salts"] for r in spread.heavy_keys(left, ["k"], few=10).collect()}
    assert heavy == {1: 4}  # a mean partition of four holds 90 rows
    assert spread.heavy_keys(left, ["k"], few=1_000) is None
    for how in ("inner", "left"):
        found = spread.join_spread(left, right, "k", ["v"], how, few=10)
        assert found.columns == ["k", "v", "name"]
        assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_rounds_keep_only_what_is_read(spark):
    from pathlib import Path

    tables, df = spread.Rounds("round"), spark.range(3)
    for _ in range(5):
        df = tables.cut(df.selectExpr("id + 1 AS id"))
    assert [r[0] for r in df.orderBy("id").collect()] == [5, 6, 7]
    assert len(tables.paths) == 2 and all(Path(p.removeprefix("file:")).exists() for p in tables.paths)
