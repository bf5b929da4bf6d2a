import random

from pyspark.sql import functions as F

from lakeloom.operators.ordered import predecessor, running_total


def test_running_total(spark):
    rng = random.Random(5)
    rows = [(g, rng.randint(-(2**63), 2**63 - 1), i, rng.randint(0, 9)) for i in range(300) for g in [rng.choice(["a", "a", None])]]
    rows += [("t", 7, 1000 + i, 1) for i in range(5)]  # ties of the order
    df = spark.createDataFrame(rows, "g string, h bigint, id int, w int")
    got = {r["id"]: r["_before"] for r in running_total(df, ["g"], "h", "w", tie=("id",), n=7).collect()}
    for g in ("a", None, "t"):
        total = 0
        for _, h, i, w in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[i] == total
            total += w


def test_predecessor_over_blocks(spark):
    rows = [(g, o, f"{g}{o}") for g in ("x", None) for o in (0, 1, 5, 63, 64, 200, 1000, 1001)]
    got = {(r["g"], r["o"]): (r["_prev_order"], r["_prev"]) for r in predecessor(spark.createDataFrame(rows, "g string, o int, v string"), "g", "o", "v", block=8).collect()}
    for g in ("x", None):
        mine = sorted(r for r in rows if r[0] == g)
        assert got[g, 0] == (None, None)
        assert all(got[g, b[1]] == (a[1], a[2]) for a, b in zip(mine, mine[1:]))


def test_empty(spark):
    assert running_total(spark.createDataFrame([], "g string, h bigint, w int"), ["g"], "h", "w").count() == 0
    assert predecessor(spark.createDataFrame([], "g string, o int, v string"), "g", "o", "v").count() == 0


def test_join_of_rows_with_hot_groups(spark):
    from lakeloom.operators.ordered import join_groups

    rows = [("hot" if i % 2 else None if i % 3 else f"g{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id int")
    groups = df.groupBy("g").count().withColumnRenamed("count", "n").withColumn("tag", F.concat(F.lit("t"), F.coalesce("g", F.lit("-"))))
    want = sorted((g or "", i, f"t{g or '-'}") for g, i in rows if g != "g0")
    for hot in (10, 1_000):
        got = join_groups(df, groups.filter("g is null or g <> 'g0'"), ["g"], "n", "id", hot_rows=hot, salts=5)
        assert got.columns == ["g", "id", "tag"] and sorted((r["g"] or "", r["id"], r["tag"]) for r in got.collect()) == want
