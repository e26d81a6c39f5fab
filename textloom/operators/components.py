"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared_store import materialize


#: Edges that a task reduces at a time, and edges of a forest that it passes on before it starts another.
TOGETHER, KEPT = 1_000_000, 4_000_000


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node of its component in the graph of the edges a[i], b[i]."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, nearer := label[label]):
            label = nearer
    return label


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the same components as `edges` (u, v, no nulls): every task passes on a forest of its own edges.

    A task holds TOGETHER edges and a forest of KEPT, so dense graphs shrink to some edges a node and task.
    """

    def reduced(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(len(p) for p in parts)
        coded = pa.chunked_array([p.column(c) for c in (0, 1) for p in parts]).combine_chunks().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        label = labels(at[:n], at[n:], len(coded.dictionary))
        node = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(node)), coded.dictionary.take(pa.array(label[node]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, new = [], 0
        for batch in batches:
            parts.append(batch)
            new += len(batch)
            if new >= TOGETHER:
                parts, new = [reduced(parts)], 0
                if len(parts[0]) >= KEPT:
                    yield parts.pop()
        if parts:
            yield reduced(parts)

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component): the smallest node that each node of an edge can reach.

    Null ends, loops and repeated edges are ignored; an empty edge table gives an empty result. A round costs two
    shuffled joins of the edge list, no group is ever collected, and the edges are written to the shared folder after
    each round, so a lost executor costs one round at most. Tasks reduce their edges to forests before the first round. The number of rounds grows with the logarithm of the
    graph's size. Columns of `edges` other than `src` and `dst` are not read.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = spanning_forest(e)
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node move to its smallest neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("lo"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("lo").alias("v")).distinct()
        # Small star: a node and its neighbours below it move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("lo"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("v", "lo"), F.struct(F.col("u").alias("v"), "lo"))).alias("x"))
        e = materialize(moved.select(F.col("x.v").alias("u"), F.col("x.lo").alias("v")).where("u <> v").distinct(), "edges")
        # A state is done when nothing moves: same edges as before.
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
