import random

from pyspark.sql import functions as F

from textloom.operators.ranking import global_rank


def test_places_over_the_whole_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, rng.randrange(50)]), "x") for i in range(500)] * 2
    df = spark.createDataFrame(rows, "id long, n long, part0_ string").repartition(7)
    for parts in (1, 3, 16):
        got = sorted((r["rank"], r["n"], r["id"]) for r in global_rank(df, [F.col("n").desc_nulls_last(), F.col("id").asc()], parts=parts).collect())
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        assert got == [(k + 1, r[1], r[0]) for k, r in enumerate(want)]


def test_empty_table_and_replaced_column(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b")], "rank int, k string")
    assert global_rank(df.limit(0), ["k"]).collect() == []
    assert sorted(map(tuple, global_rank(df, ["k"]).collect())) == [("a", 1), ("b", 2)]
