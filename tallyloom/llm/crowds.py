"""Links within crowds: candidate keys that very many different texts share.

A crowd's pairs are neither listed nor compared in one task.  Its texts are dealt into blocks of bounded number and
bytes; a task gets one pair of blocks and counts what each two texts of different components have in common by
a matrix product over the shingles that occur in both.  Only a spanning forest of the links leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, tidy, written

#: Texts and bytes in a block, shingles in a step of the matrix product.
BLOCK_TEXTS, BLOCK_BYTES, STEP = 512, 4 << 20, 8192


def unions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) join what earlier ones have not."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            keep[k] = True
            parent[x] = y
    return keep


def common_counts(flat: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many members sets of ``left`` and ``right`` share, as a matrix; ``flat`` has the sets one after the other."""
    place = np.full(len(bounds) - 1, -1, np.int64)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, code = np.unique(flat, return_inverse=True)
    in_left, in_right = (np.zeros(int(code.max(initial=-1)) + 1, bool) for _ in (0, 1))
    for rows, mark in ((left, in_left), (right, in_right)):
        own = np.zeros(len(bounds) - 1, bool)
        own[rows] = True
        mark[code[own[of]]] = True
    shared = np.cumsum(in_left & in_right) - 1
    use = (in_left & in_right)[code]
    of, column = of[use], shared[code[use]]
    out = np.zeros((len(left), len(right)))
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, STEP):
        a, b = np.searchsorted(column, (low, low + STEP))
        sides = []
        for rows in (left, right):
            place[:] = -1
            place[rows] = np.arange(len(rows))
            row = place[of[a:b]]
            dense = np.zeros((len(rows), STEP), np.float32)
            dense[row[row >= 0], column[a:b][row >= 0] - low] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _compare(sets_of: Callable, hundredths: int):
    """(u, v) from rows (key, i, j, block, h, root, text) sorted by key, i and j: links across roots, up to connectedness."""

    def links(rows: list) -> pa.RecordBatch | None:
        i, j = rows[0][1:3]
        flat, bounds = sets_of([r[6] for r in rows])
        size, block = np.diff(bounds), np.array([r[3] for r in rows])
        h, roots = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return None
        both = common_counts(flat, bounds, left, right)
        near = 100 * both >= hundredths * (size[left][:, None] + size[right][None, :] - both)
        near &= roots[left][:, None] != roots[right][None, :]
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        keep = unions(roots[a], roots[b])
        return pa.RecordBatch.from_arrays([pa.array(h[a[keep]]), pa.array(h[b[keep]])], names=["u", "v"])

    def compare(batches):
        rows: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    if (out := links(rows)) is not None:
                        yield out
                    rows = []
                rows.append(row)
        if rows and (out := links(rows)) is not None:
            yield out

    return compare


def crowd_links(crowds: DataFrame, roots: DataFrame, texts: DataFrame, sets_of: Callable, hundredths: int, scratch: str) -> DataFrame | None:
    """Links (u, v) that crowds (key, h) still lack between texts (h, text) of different ``roots`` (node, root; a text without one is
    its own); None if every crowd has one root.

    ``sets_of`` makes (members of the sets one after the other, bounds) of a list of texts; two are linked whose sets have a
    Jaccard similarity of at least ``hundredths`` / 100.
    """
    sized = crowds.join(texts.select("h", F.octet_length("text").alias("bytes")), "h")
    known = sized.join(roots, F.col("h") == F.col("node"), "left").select("key", "h", F.coalesce("root", "h").alias("root"), "bytes")
    known = written(known, f"{scratch}/known")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    keys = known.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), blocks.alias("blocks"))
    keys = written(keys.filter("x <> y").select("key", "blocks"), f"{scratch}/blocks")
    if keys.isEmpty():
        return None
    dealt = known.join(checked_broadcast(keys), "key").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "h", "root").join(texts, "h")
    met = met.select("key", "i", "j", "block", "h", "root", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(met.mapInArrow(tidy(_compare(sets_of, hundredths)), "u long, v long"), f"{scratch}/crowd_links")
