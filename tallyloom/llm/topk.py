"""Operator 3: exact top-k by distributed histogram selection.

Vectors are packed into blocks; every block of queries meets every slab of candidates and scores are whole
numbers from one matrix product.  No score leaves its task.  Round by round, each task counts its scores
of a query in bins of the interval that still holds the query's k-th best, from the best down to the bin that
brings its own count to what is sought (no lower one can hold the k-th value); the counts are added up over all slabs, and the bin with the
k-th value becomes the next interval, until it is one score wide.  A last pass gives the candidates above that
score, and of those equal to it each task's smallest ids; what is left per query is ranked.

Scores that 64 bits may not hold are counted by their leading bits; of those equal in them, each task gives its best by
the whole number, and what is left is ranked by the whole number.

The product is repeated in each round rather than kept: at 64 dimensions it costs less than writing its results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_dir, tidy, written

#: Rows of a block of queries and of a slab of candidates, bins per round, slabs that share a key when they meet blocks.
QUERY_ROWS, SLAB_ROWS, BINS, BUCKET_SLABS = 512, 16384, 4096, 8
#: Scores below this in size are held in 64 bits.
WHOLE = 1 << 62


def scaled(vector: str, scale: float) -> F.Column:
    """scale * x per component; null where the vector has no component, or one that is null or (once scaled) not finite."""
    x = F.col(f"`{vector}`")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double") * scale) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(x, lambda v: v.cast("double") * scale))


def _blocks(df: DataFrame, rows: int, name: str, kind: str) -> DataFrame:
    """Rows (id, dim, v) packed: one row per up to ``rows`` vectors of one length, ids and floors of components as binaries."""

    def pack(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dim, ids, flat):
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=["block", "dim", "ids", "mat"])

        for batch in batches:
            ids, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                flat = np.floor(batch.column(2).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)).astype(kind)
                parts = held.setdefault(dim, [])
                parts.append((ids[own], flat))
                if sum(len(i) for i, _ in parts) >= rows:
                    i, f = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                    while len(i) >= rows:
                        yield out(dim, i[:rows], f[: rows * dim])
                        i, f = i[rows:], f[rows * dim :]
                    held[dim] = [(i, f)]
        for dim, parts in held.items():
            i, f = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            if len(i):
                yield out(dim, i, f)

    return df.mapInArrow(tidy(pack), f"{name} long, dim int, ids binary, mat binary")


def _scores(q_mat: bytes, c_mat: bytes, dim: int, kind: str) -> np.ndarray:
    """Inner products of all queries of a block with all candidates of a slab, exact: 64-bit, or Python's whole numbers."""
    q, c = (np.frombuffer(x, kind).reshape(-1, dim) for x in (q_mat, c_mat))
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim
    if bound < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < WHOLE:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([int(v) for v in x.reshape(-1).tolist()], object).reshape(x.shape)
    return whole(q) @ whole(c).T


def exact_topk(vectors: DataFrame, k: int, query, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, bins: int = BINS) -> DataFrame:
    """query_id, rank, id, score: each query's ``k`` best others by integer inner product, ties to the smaller id.

    ``query`` is the condition that makes a row a query.  Vectors without components, null, or with a null or
    non-finite component (also once scaled) take no part; vectors of different lengths don't meet.  A null id takes no part.  A
    query isn't its own candidate, and rows that repeat its id aren't either; of other repeated ids each row
    counts, and each row that is a query is answered.  A query with fewer than ``k`` candidates gets all; without queries the result is empty.

    Scores are exact for components of any size; one that a 64-bit column can't hold is ranked by its true value and
    given as the column's largest or smallest number.  Ids are whole numbers; others are refused with a TypeError.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    if id_type.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must hold whole numbers of up to 64 bits, not {id_type.simpleString()}")
    scratch = shared_dir(spark)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(vector_col, scale).alias("v"), F.coalesce(query, F.lit(False)).alias("q")).filter("v is not null and id is not null")
    rows = rows.select("id", F.size("v").alias("dim"), "v", "q")
    n_asked, largest, widest = rows.agg(F.count(F.when(F.col("q"), 1)), F.max(F.array_max(F.transform("v", F.abs))), F.max("dim")).first()
    largest = math.ceil(largest or 0) + 1  # floors are at most one further from zero
    kind = "<i4" if largest < 1 << 31 else "<f8"
    slabs = written(_blocks(rows.select("id", "dim", "v"), SLAB_ROWS, "slab", kind), f"{scratch}/slabs")
    asked = rows.filter("q").select("id", "dim", "v")
    blocks = written(_blocks(asked.repartition(max(1, n_asked // (4 * QUERY_ROWS)), "id"), QUERY_ROWS, "block", kind), f"{scratch}/queries")

    # Every block with every slab of its length: a block goes once to each bucket of slabs, a slab to its own.
    buckets = max(1, slabs.count() // BUCKET_SLABS)
    held = slabs.select("dim", F.pmod(F.xxhash64("slab"), F.lit(buckets)).alias("bucket"), F.col("ids").alias("c_ids"), F.col("mat").alias("c_mat"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("bucket")

    def met(states: DataFrame) -> DataFrame:
        own = blocks.join(_by_block(states), "block").select("block", "dim", F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), "low", "want", each)
        return own.join(held, ["dim", "bucket"]).select("block", "dim", "q_ids", "q_mat", "low", "want", "c_ids", "c_mat")

    reach = largest * largest * int(widest or 0)
    shift = max(0, reach.bit_length() - 61)  # leading bits that 64-bit counts go by
    reach = (reach >> shift) + 1
    span = 2 * reach + 1
    width = max(1, -(-span // bins))
    states = written(_first_states(blocks, k), f"{scratch}/state").withColumn("low", F.lit(-reach).cast("long"))
    n = 0
    while True:
        n += 1
        counts = met(states).mapInArrow(tidy(_counter(width, span, shift, kind)), "block long, at long, bin long, n long")
        counts = counts.groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        states = written(_narrowed(states, counts, width), f"{scratch}/state{n}")
        if width == 1:
            break
        span, width = width, max(1, -(-width // bins))
    best = met(states).mapInArrow(tidy(_chooser(shift, kind)), "block long, at long, query long, id long, score long, whole binary")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.desc("whole"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").cast(id_type).alias("query_id"), "rank", F.col("id").cast(id_type).alias(id_col), "score")


def _coarse(scores: np.ndarray, shift: int) -> np.ndarray:
    """Leading bits as 64-bit numbers, in the scores' order."""
    return scores >> min(shift, 63) if scores.dtype != object else np.array([int(x) >> shift for x in scores.tolist()], np.int64)


def _first_states(blocks: DataFrame, k: int) -> DataFrame:
    """(block, at, query, want) for each row of each block: ``want`` of the best are still to be found below ``top``."""

    def spread(batches):
        for batch in batches:
            for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids), pa.array(np.full(len(ids), k))], names=["block", "at", "query", "want"])

    return blocks.select("block", "ids").mapInArrow(tidy(spread), "block long, at long, query long, want long")


def _by_block(states: DataFrame) -> DataFrame:
    """The lower ends and what is wanted, of each block in its order; a block has at most QUERY_ROWS."""
    each = F.sort_array(F.collect_list(F.struct("at", "low", "want")))
    return states.groupBy("block").agg(each.alias("s")).select("block", F.transform("s", lambda x: x["low"]).alias("low"), F.transform("s", lambda x: x["want"]).alias("want"))


def _counter(width: int, span: int, shift: int, kind: str):
    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
                scores = _scores(row["q_mat"], row["c_mat"], row["dim"], kind)
                out = []
                for i, (q, low, want) in enumerate(zip(q_ids.tolist(), row["low"], row["want"], strict=True)):
                    if low is None:
                        continue
                    s = _coarse(scores[i], shift)
                    bin_ = (s[(s >= low) & (s - low < span) & (c_ids != q)] - low) // width
                    if len(bin_) > want:
                        bin_ = bin_[bin_ >= np.partition(bin_, len(bin_) - want)[len(bin_) - want]]
                    found, n = np.unique(bin_, return_counts=True)
                    out.append((np.full(len(found), row["block"]), np.full(len(found), i), found, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["block", "at", "bin", "n"])

    return count


def _narrowed(states: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Each query's bin of its ``want``-th best as the next interval; low is null where fewer scores exist."""
    down = Window.partitionBy("block", "at").orderBy(F.desc("bin"))
    sums = counts.withColumn("upto", F.sum("n").over(down)).join(states.select("block", "at", "want"), ["block", "at"]).filter("upto >= want")
    hit = sums.groupBy("block", "at").agg(F.max_by(F.struct("bin", (F.col("want") - (F.col("upto") - F.col("n"))).alias("left")), "bin").alias("h"))
    return states.join(hit, ["block", "at"], "left").select("block", "at", "query", F.col("h.left").alias("want"), (F.col("low") + F.col("h.bin") * width).alias("low"))


def _chooser(shift: int, kind: str):
    most = (1 << 63) - 1

    def sortable(x: int) -> bytes:
        """Whole numbers of any size as bytes in their order: sign and length, then the digits; of small ones nothing."""
        if -most <= x < most:
            return b""
        n = (abs(x).bit_length() + 7) // 8
        return (1 << 15 | n).to_bytes(2, "big") + x.to_bytes(n, "big") if x > 0 else ((1 << 15) - n).to_bytes(2, "big") + (x + (1 << 8 * n)).to_bytes(n, "big")

    def choose(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
                scores = _scores(row["q_mat"], row["c_mat"], row["dim"], kind)
                out, wholes = [], []
                for i, (q, low, want) in enumerate(zip(q_ids.tolist(), row["low"], row["want"], strict=True)):
                    s, other = scores[i], c_ids != q
                    rough = _coarse(s, shift)
                    take = np.flatnonzero(other if low is None else other & (rough > low))
                    if low is not None:
                        ties = np.flatnonzero(other & (rough == low))
                        if len(ties) > want and shift:
                            ties = np.array(sorted(ties.tolist(), key=lambda j: (-int(s[j]), c_ids[j]))[:want])
                        elif len(ties) > want:
                            ties = ties[np.argpartition(c_ids[ties], want - 1)[:want]]
                        take = np.concatenate([take, ties])
                    exact = s[take]
                    if s.dtype == object:
                        wholes += [sortable(x) for x in exact.tolist()]
                        exact = np.array([max(-most - 1, min(most, x)) for x in exact.tolist()], np.int64)
                    else:
                        wholes += [b""] * len(take)
                    out.append((np.full(len(take), row["block"]), np.full(len(take), i), np.full(len(take), q), c_ids[take], exact))
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(wholes, pa.binary())], names=["block", "at", "query", "id", "score", "whole"])

    return choose
