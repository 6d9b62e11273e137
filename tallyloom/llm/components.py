"""Connected components by alternating star contraction, with every round written to the shared folder.

Each round replaces a node's edges by edges to the least node among its neighbours (large star: greater
neighbours; small star: lesser ones) until every edge points to the least node of its component.  A round
sends each edge a constant number of times; the least neighbours are partial aggregates, and the joins
that hand them back have written tables on both sides, so that a hub's edges can be split over tasks.

A graph of few edges (:data:`FEW`, some megabytes) is done in one task instead: it has the same result without the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import remove, shared_dir, tidy, written

#: Edges of two 64-bit nodes that one task may hold.
FEW = 1 << 18


def least_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes is connected with by the edges (u, v), by joining least nodes and shortening paths."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _at_once(batches):
    """(node, root) of all edges."""
    pairs = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
    if not pairs:
        return
    nodes, code = np.unique(np.concatenate([x for pair in zip(*pairs, strict=True) for x in pair]), return_inverse=True)
    root = least_roots(len(nodes), code[: len(code) // 2], code[len(code) // 2 :])
    other = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], names=["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (u, v) but the roots; root is the component's least node.

    Nodes are 64-bit numbers.  Up to ``few`` edges are done at once.  Loops, repeated edges and nulls are dropped.  Without edges the result is empty.
    """
    spark = edges.sparkSession
    scratch, n = shared_dir(spark), 0

    def keep(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        return written(df, f"{scratch}/{n}")

    def handed(pairs: DataFrame, least) -> DataFrame:
        """``pairs`` (u, v) with m, the least of u's neighbours or as ``least`` says."""
        mins = keep(pairs.groupBy("u").agg(least.alias("m")))
        return pairs.join(mins, "u")

    def stars(df: DataFrame) -> DataFrame:
        both = keep(df.select("u", "v").union(df.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = handed(both, F.least(F.min("v"), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.filter("u <> v").distinct())  # u > v
        small = handed(large, F.min("v"))
        return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = mark(now)
    if 0 < state[0] <= few:
        return written(now.coalesce(1).mapInArrow(tidy(_at_once), "node long, root long"), f"{scratch}/roots")
    for _ in range(max_rounds):
        if not state[0]:
            break
        old, now = state, keep(stars(now))
        state = mark(now)
        for k in range(1, n):
            remove(spark, f"{scratch}/{k}")
        if state == old:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    if state[0]:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
