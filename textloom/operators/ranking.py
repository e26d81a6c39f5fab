"""Places of rows in an order over the whole table, without a window that one task must sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize


def global_rank(df: DataFrame, order: list[Column | str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """`df` and each row's place from 1 on (long, as column `name`) in `order`.

    Rows are dealt to ranges of the order and sorted within each; a range begins where the ones before it end, by their
    counts. Only those counts, one for each range, go through the driver. Rows equal in `order` get places of their own in
    any sequence, nulls come where `order` puts them, an empty table stays empty. A column called `name` is replaced. The
    rows are written once, so places don't change when tasks are repeated.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.drop(name)
    taken = {c.lower() for c in df.columns} | {name.lower()}
    part, at, before = (next(c for i in range(len(taken) + 1) if (c := f"{x}{i}_") not in taken) for x in ("part", "at", "before"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = materialize(dealt, "ranked")
    counts, starts = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}, []  # at most `parts` rows
    for p in range(max(counts, default=-1) + 1):
        starts.append((p, starts[-1][1] + counts.get(p - 1, 0) if starts else 0))
    offsets = spark.createDataFrame(starts, f"{part} int, {before} long")
    out = dealt.join(F.broadcast(offsets), part)
    return out.select(*df.columns, (F.col(before) + F.col(at) + 1).alias(name))
