"""Exact set-similarity join by prefix filtering (AllPairs, Bayardo et al., 2007), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize


def similarity_join(sets: DataFrame, least: float, set_col: str = "features", id_col: str = "id") -> DataFrame:
    """(id_a, id_b, both, n_a, n_b), id_a < id_b, of the pairs with both / (n_a + n_b - both) >= `least`.

    `sets` has a unique `id_col` and a list of distinct strings. Two sets that are similar enough share an element of
    both prefixes when elements are ordered by rising frequency, so only prefixes are joined, and pairs of too different
    sizes are left out there. Equal sets are joined as one class and told apart afterwards. Empty or null sets are similar
    to nothing.
    """
    s = sets.select(F.col(id_col).alias("id"), F.sort_array(set_col).alias("f")).where(F.size("f") > 0)
    s = materialize(s.withColumn("n", F.size("f")).withColumn("cls", F.xxhash64("f", "n")), "sets")
    classes = materialize(s.groupBy("cls", "n").agg(F.first("f").alias("f")), "classes")
    parts = classes.select("cls", "n", F.explode("f").alias("e"))
    df = parts.groupBy("e").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls").orderBy("df", "e"))
    keep = F.col("n") - F.ceil(F.lit(least - 1e-9) * F.col("n")) + 1
    posts = materialize(parts.join(df, "e").withColumn("r", rank).where((F.col("r") <= keep) & (F.col("df") > 1)).select("cls", "n", "e"), "prefixes")
    a, b = (posts.select("e", F.col("cls").alias(f"cls_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = a.join(b, "e").where((F.col("cls_a") < F.col("cls_b")) & (F.least("n_a", "n_b") >= F.lit(least - 1e-9) * F.greatest("n_a", "n_b")))
    near = near.select("cls_a", "cls_b", "n_a", "n_b").distinct()
    fa, fb = (classes.select(F.col("cls").alias(f"cls_{x}"), F.col("f").alias(f"f_{x}")) for x in "ab")
    near = near.join(fa, "cls_a").join(fb, "cls_b").withColumn("both", F.size(F.array_intersect("f_a", "f_b")))
    near = near.where(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")) >= least).select("cls_a", "cls_b", "n_a", "n_b", "both")
    same = classes.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("both"))
    ids_a, ids_b = (s.select(F.col("cls").alias(f"cls_{x}"), F.col("id").alias(f"x_{x}")) for x in "ab")
    pairs = near.join(ids_a, "cls_a").join(ids_b, "cls_b").unionByName(same.join(ids_a, "cls_a").join(ids_b, "cls_b").where("x_a < x_b"))
    turn = F.col("x_a") > F.col("x_b")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("x_a", "x_b").alias("id_a"), pick("x_b", "x_a").alias("id_b"), "both", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))
