"""Operator 4: packing by cutting-stock column generation.

Documents are cut into pieces of the full length and up to three more, whose lengths are chosen so that only
some 150 lengths occur and none is above half a sequence.  Pieces are counted by length;
a linear program over patterns (how many pieces of each class one sequence takes) is solved by column
generation, where a knapsack dynamic program prices new patterns by the dual values.  Patterns are
rounded down, what is left is filled sequence by sequence, the largest piece first and then the
subset of the others that fits best, and the pieces of a class, ranked over all partitions,
take the patterns' places in order.

Only the histogram (a count per class) and the patterns come to the driver; both are bounded by the number
of classes, however many documents there are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import checked_broadcast, shared_dir, tidy, written
from tallyloom.llm.tokens import PartTokenizer, with_end

CAPACITY = 2048
#: Remainders are cut so that few lengths occur: multiples of STEP, and any length up to EXACT.
STEP, EXACT = 64, 128


def length_classes(capacity: int) -> np.ndarray:
    """The lengths that pieces have, ascending."""
    return np.unique([*range(1, min(EXACT, capacity) + 1), *range(STEP, capacity // 2 + 1, STEP), max(1, capacity // 2), capacity])


def cut_lengths(total: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The document and the length of each piece of documents of ``total`` ids, in order.

    Pieces of full length; of the remainder, half a sequence where it has that, the largest multiple of
    ``STEP`` in the rest, and what is left; a rest of up to ``EXACT`` ids stays whole.
    """
    n, half = np.arange(len(total)), max(1, capacity // 2)
    rest = total % capacity
    halves = rest // half
    rest = rest - halves * half
    tail = np.where(rest > EXACT, rest % STEP, 0)
    counts = ((total // capacity, capacity), (halves, half), ((rest > tail) * 1, rest - tail), ((tail > 0) * 1, tail))
    doc = np.concatenate([np.repeat(n, c) for c, _ in counts])
    length = np.concatenate([np.repeat(np.broadcast_to(size, n.shape), c) for c, size in counts])
    order = np.argsort(doc, kind="stable")
    return doc[order], length[order].astype(np.int64)


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: each size any number of times, within the capacity.  ``sizes`` ascends."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            gain = best[c - sizes[:k]] + values[:k]
            i = gain.argmax()
            if gain[i] > best[c] + 1e-15:
                best[c], choice[c] = gain[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return best[capacity], pattern


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A matrix product in numpy's own loops: a threaded BLAS may stall in a process that has forked."""
    return np.einsum("ij,j...->i...", a, b)


def _fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The largest piece that is left and the others that fill its sequence most; sums are bits of an integer."""
    pattern = np.zeros(len(sizes), np.int64)
    top = int(np.flatnonzero(left)[-1])
    pattern[top], room = 1, capacity - int(sizes[top])
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for i in range(top, -1, -1):
        count, size, unit = min(int(left[i]) - (i == top), room // int(sizes[i])), int(sizes[i]), 1
        while count > 0:  # in powers of two, so that few shifts give any number up to the count
            take = min(unit, count)
            steps.append((i, take, sums))
            sums |= sums << take * size & mask
            count, unit = count - take, 2 * unit
        if sums >> room:
            break
    total = sums.bit_length() - 1
    for i, take, before in reversed(steps):
        if not before >> total & 1:
            pattern[i] += take
            total -= take * int(sizes[i])
    return pattern


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-3, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, together exactly ``demand`` pieces of each size.

    The linear program ends when no pattern prices above 1 + ``gap``: its value is then within that share of
    the least.  After ``rounds`` columns the basis at hand is used; any basis gives a valid packing.
    """
    use = np.flatnonzero(demand)
    s, d = sizes[use], demand[use].astype(float)
    found: list[tuple[np.ndarray, int]] = []

    def keep(pattern: np.ndarray, times: int) -> None:
        full = np.zeros(len(sizes), np.int64)
        full[use] = pattern
        found.append((full, int(times)))

    left = demand[use].astype(np.int64)
    if len(use):
        basis = np.diag(capacity // s).astype(float)
        inverse, x = np.diag(1.0 / (capacity // s)), d / (capacity // s)
        for n in range(rounds):
            value, column = _knapsack(s, np.maximum(inverse.sum(0), 0), capacity)
            if value <= 1 + gap:
                break
            move = _product(inverse, column)
            ratio = np.full(len(x), np.inf)
            np.divide(x, move, out=ratio, where=move > 1e-9)
            out = ratio.argmin()
            if not np.isfinite(ratio[out]):
                break
            basis[:, out] = column
            step = ratio[out]
            x = x - step * move
            x[out] = step
            pivot = inverse[out] / move[out]
            inverse -= np.outer(move, pivot)
            inverse[out] = pivot
            if n % 100 == 99:
                # One Newton step takes the rounding errors out of the inverse.
                inverse = 2 * inverse - _product(inverse, _product(basis, inverse))
                x = _product(inverse, d)
            np.maximum(x, 0, out=x)
        for j in np.argsort(-x, kind="stable"):
            column = basis[:, j].astype(np.int64)
            times = min(int(np.floor(x[j] + 1e-7)), int((left[column > 0] // column[column > 0]).min()))
            if times > 0:
                keep(column, times)
                left -= times * column
    while left.any():
        pattern = _fullest(s, left, capacity)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        keep(pattern, times)
        left -= times * pattern
    return found


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, words: bool = False, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``with_ids`` adds the ids.

    A document is its text's ids and ``end_id``; a null text has ``end_id`` alone.  Pieces of one document
    cover it from 0 without gaps, pieces of one sequence fill it from 0 without gaps.  Rows with equal or
    null ids are documents of their own.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = shared_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = length_classes(capacity)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        from pyspark import TaskContext

        part, seen, tokenizer = TaskContext.get().partitionId(), np.zeros(len(sizes), np.int64), None
        for batch in batches:
            tokenizer = tokenizer or PartTokenizer(tokenizer_path, words)
            at = 0
            for ids, ends in tokenizer.encode(batch.column(1)):
                ids, ends = with_end(ids, ends, end_id)
                total = np.diff(ends, prepend=0)
                doc, length = cut_lengths(total, capacity)
                start = np.cumsum(length) - length - (ends - total)[doc]
                first = ends[doc] - total[doc] + start
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                of = np.searchsorted(sizes, length)
                order = np.argsort(of, kind="stable")
                counts = np.bincount(of, minlength=len(sizes))
                rank = np.empty(len(of), np.int64)
                rank[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + seen[of[order]]
                seen += counts
                columns = [batch.column(0).slice(at, len(total)).take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(np.full(len(of), part), pa.int32()), pa.array(of.astype(np.int32)), pa.array(rank)]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "class", "rank"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                at += len(total)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", ids array<long>" if with_ids else ""
    pieces = written(rows.mapInArrow(tidy(cut), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, rank long{more}"), f"{scratch}/pieces")
    counts = written(pieces.groupBy("part", "class").agg(F.count("*").alias("n")), f"{scratch}/counts")
    demand = np.zeros(len(sizes), np.int64)
    for c, n in counts.groupBy("class").agg(F.sum("n")).collect():  # a row per class
        demand[c] = n
    places = _places(cutting_patterns(sizes, demand, capacity), len(sizes))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(checked_broadcast(written(bases, f"{scratch}/bases")), ["part", "class"])

    def assign(batches):
        for batch in batches:
            of, rank = (batch.column(c).to_numpy() for c in ("class", "place"))
            sequence, slot = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
            for c in np.unique(of):
                own = of == c
                low, times, first = places[c]
                i = np.searchsorted(low, rank[own], "right") - 1
                over = rank[own] - low[i]
                sequence[own], slot[own] = first[i] + over % times[i], over // times[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(slot)], names=[*keep, "sequence_id", "slot"])

    keep = ["id", "start", "length", "ids_crc32", "doc_tokens", "class", *(["ids"] if with_ids else [])]
    placed = ranked.select(*keep, (F.col("base") + F.col("rank")).alias("place"))
    placed = placed.mapInArrow(tidy(assign), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int{more}, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def _places(patterns: list[tuple[np.ndarray, int]], n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each class: the first rank, the number of sequences and the first sequence of each pattern that has it."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    taken, first = np.zeros(n, np.int64), 0
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern):
            out[c].append((int(taken[c]), times, first))
            taken[c] += pattern[c] * times
        first += times
    return [tuple(np.array(x, np.int64).reshape(-1, 3).T) for x in out]


def sequences(pieces: DataFrame, pad_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The padded sequences of ``pack(with_ids=True)``: sequence_id, used, ids.

    A sequence is padded to ``capacity`` unless its length is a power of two; its pieces are few enough for one row.
    """
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("all"))
    ids = F.flatten(F.transform("all", lambda x: x["ids"]))
    power = F.expr("(used & (used - 1)) = 0")
    pad = F.array_repeat(F.lit(pad_id).cast("long"), F.when(power, F.lit(0)).otherwise(F.lit(capacity) - F.col("used")).cast("int"))
    return rows.select("sequence_id", "used", F.concat(ids, pad).alias("ids"))
