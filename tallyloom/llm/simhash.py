"""Operator 6: near-duplicates by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 22, 21 and 21 bits, each read as a word of the perfect binary
Golay code of length 23.  Let near(x) be the codewords within 4 bits of x: the one it decodes to, at most 3
away, and for words 3 away five more.  If x and y differ by one bit, what y decodes to is in near(x).

Fingerprints at 3 or fewer differing bits have, by the pigeonhole principle, either a segment without errors
and another with at most one, or one error in each.  Keys for the first case are the equal segment's bits and a
near codeword of another; for the second, the three codewords, of which one side takes near ones in the
first two segments and the other side in the third.  All keys have 33 to 36 bits of fingerprint.

Fingerprints that share a key are compared in the task that gets the key.  Of each key's links only a
spanning forest leaves the task, so a group of n copies costs n rows, not n squared.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_dir, tidy, written
from tallyloom.llm.components import components
from tallyloom.llm.textbytes import text_slices, word_bounds

DISTANCE, SHINGLE = 3, 3
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: Runs of equal keys up to this length are compared all with all at once.
SHORT_RUN = 32


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and up to six error patterns by syndrome (the first is the least)."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << bit - 11
        return x

    low, high = (np.array([syndrome(x << shift) for x in range(1 << bits)], np.uint32) for shift, bits in ((0, 12), (12, 11)))
    errors: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            e = sum(1 << p for p in places)
            of = int(low[e & 0xFFF] ^ high[e >> 12])
            if weight < 4 or bin(errors[of][0]).count("1") == 3:
                errors[of].append(e)
    return low, high, np.array([x + x[:1] * (6 - len(x)) for x in errors], np.uint32)


def near_codewords(x: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of each 23-bit word, as 6 columns; the first is the nearest, and fills up."""
    low, high, errors = _golay()
    x = x.astype(np.uint32)
    return ((x[:, None] ^ errors[low[x & 0xFFF] ^ high[x >> 12]]) >> 11).astype(np.uint64)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key): two fingerprints at 3 or fewer differing bits share a key."""
    raw = [fps >> np.uint64(shift) & np.uint64((1 << bits) - 1) for shift, bits in SEGMENTS]
    near = [near_codewords(x) for x in raw]
    u = np.uint64
    columns = []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                columns.append((u(kind) << u(60)) | (raw[i][:, None] << u(12)) | near[j])
                kind += 1
    a, b, c = near
    columns.append((u(6) << u(60)) | (a[:, :1] << u(24)) | (b[:, :1] << u(12)) | c)
    columns.append((u(6) << u(60)) | ((a[:, :, None] << u(24)) | (b[:, None, :] << u(12)) | c[:, :1, None]).reshape(len(fps), -1))
    keys = np.concatenate(columns, axis=1)
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


def shingles(column: pa.Array, shingle: int = SHINGLE):
    """(hash of each shingle, its document, shingles of each document) of slices of texts: words in lower case (A to Z),
    shingles with repeats, XXH64 with seed 42; a shorter text that isn't blank is one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    for data, offsets in text_slices(column, 2 << 20):
        starts, ends = word_bounds(data, offsets)
        # The words of all documents, with one space after each.
        lengths = ends - starts + 1
        after = np.cumsum(lengths)
        text = np.full(after[-1] if len(after) else 0, 0x20, np.uint8)
        at = np.arange(len(text)) + np.repeat(starts - (after - lengths), lengths)
        real = np.ones(len(text), bool)
        real[after - 1] = False
        text[real] = lower[data[at[real]]]
        bounds = np.searchsorted(starts, offsets)
        words = np.diff(bounds)
        n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        doc = np.repeat(np.arange(len(words)), n)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + bounds[doc]
        last = first + np.minimum(words[doc], shingle) - 1
        raw = text.tobytes()
        begin, end = (after - lengths)[first].tolist(), (after - 1)[last].tolist()
        yield np.fromiter((digest(raw[a:b], 42) for a, b in zip(begin, end, strict=True)), np.uint64, len(doc)), doc, n


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: majority per bit of its shingles' hashes."""
    out = []
    for hashes, doc, n in shingles(column, shingle):
        counts = np.zeros((len(n), 64), np.int64)
        for k in range(0, len(doc), 1 << 17):
            bits = np.unpackbits(hashes[k : k + (1 << 17)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            of = doc[k : k + (1 << 17)]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
            counts[of[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").reshape(-1).view("<u8"))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _bit_counts(hashes: np.ndarray, n: np.ndarray, factor: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of sets of ``n`` hashes, how often each bit of the hashes, mixed by each factor, is 1: (sets, factors, 64)."""
    u = np.uint64
    # Up to 15 hashes are added in lanes of 4 bits, up to 17 such sums in lanes of 8, the rest in 32 bits.
    pieces, cuts = [], [n]
    for most in (15, 17):
        parts = -(-cuts[-1] // most)
        of = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        pieces.append((np.cumsum(cuts[-1]) - cuts[-1])[of] + nth * most)
        cuts.append(parts)
    small = np.zeros((4, len(pieces[0]), len(factor)), u)
    bounds = np.append(pieces[0], len(hashes))
    for a in range(0, len(pieces[0]), 128):
        b = min(a + 128, len(pieces[0]))
        x = hashes[bounds[a] : bounds[b], None] * factor
        x ^= x >> u(32)
        x *= second
        x ^= x >> u(29)
        x[:, 0] = hashes[bounds[a] : bounds[b]]
        for j in range(4):
            np.add.reduceat((x >> u(j)) & u(0x1111111111111111), bounds[a:b] - bounds[a], axis=0, out=small[j, a:b])
    lanes = u(0x0F0F0F0F0F0F0F0F)
    wide = [np.add.reduceat((small[j % 4] >> u(j - j % 4)) & lanes, pieces[1], axis=0) for j in range(8)]
    counts = np.stack([x.astype("<u8", copy=False).view(np.uint8).reshape(len(x), len(factor), 8) for x in wide], axis=3)
    first = np.cumsum(cuts[2]) - cuts[2]
    return np.add.reduceat(counts, first, axis=0, dtype=np.int64).reshape(len(n), len(factor), 64)


def wide_fingerprints(hashes: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` times 64 bits of sets of ``n`` hashes each, one set after the other, none empty.

    The first word is the majority of the hashes' own bits, as in :func:`fingerprints`; the others are that of the hashes mixed anew.
    """
    rng = np.random.default_rng(64)
    factor, second = rng.integers(0, 1 << 63, (2, 256), np.uint64)[:, :words] * np.uint64(2) + np.uint64(1)
    out, ends = [np.zeros((0, words), np.uint64)], np.cumsum(n)
    at = 0
    while at < len(n):
        begin, to = int(ends[at] - n[at]), max(at + 1, min(at + 512, int(np.searchsorted(ends, ends[at] - n[at] + (1 << 17), "right"))))
        if to > at + 1:
            counts = _bit_counts(hashes[begin : ends[to - 1]], n[at:to], factor, second)
        else:  # a large set by parts
            parts = [hashes[k : min(k + (1 << 17), int(ends[at]))] for k in range(begin, int(ends[at]), 1 << 17)]
            counts = sum(_bit_counts(x, np.array([len(x)]), factor, second) for x in parts)
        out.append(np.packbits(2 * counts > n[at:to, None, None], axis=2, bitorder="little").view("<u8").reshape(to - at, words))
        at = to
    return np.concatenate(out)


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints; holds a few times their number.

    Those not yet reached are compared with those last reached, so a group of copies takes few steps.
    """
    rest, child, parent = fps, [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:64], front[64:]
            close = np.bitwise_count(block[:, None] ^ rest[None, :]) <= DISTANCE if len(rest) < 1 << 20 else np.array([np.bitwise_count(x ^ rest) <= DISTANCE for x in block])
            hit = close.any(axis=0)
            if hit.any():
                child.append(rest[hit])
                parent.append(block[close[:, hit].argmax(axis=0)])
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    if not child:
        return fps[:0], fps[:0]
    return np.concatenate(child), np.concatenate(parent)


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; ``keys`` is sorted and whole runs are given."""
    change = np.concatenate([[True], keys[1:] != keys[:-1], [True]])
    bounds = np.flatnonzero(change)
    length = np.diff(bounds)
    left, right = [], []
    long = length > SHORT_RUN
    small = np.repeat(~long & (length > 1), length)
    run = np.repeat(np.arange(len(length)), length)[small]
    own = fps[small]
    for step in range(1, int(length[~long].max(initial=1))):
        near = (run[step:] == run[:-step]) & (np.bitwise_count(own[step:] ^ own[:-step]) <= DISTANCE)
        left.append(own[step:][near])
        right.append(own[:-step][near])
    for k in np.flatnonzero(long):
        child, parent = _forest(np.unique(fps[bounds[k] : bounds[k + 1]]))
        left.append(child)
        right.append(parent)
    a, b = np.concatenate([keys[:0].astype(np.uint64), *left]), np.concatenate([keys[:0].astype(np.uint64), *right])
    return np.maximum(a, b), np.minimum(a, b)


def _spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links that join what earlier ones have not."""
    pairs = np.unique(np.stack([u, v], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    keep = []
    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        keep.append(a != b)
        parent[a] = b
    pairs = pairs[np.array(keep, bool)] if keep else pairs[:0]
    return pairs[:, 0], pairs[:, 1]


def near_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` at 3 or fewer differing bits, up to connectedness."""

    def emit(batches):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 4096):
                of, keys = fuzzy_keys(x[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(x[at : at + 4096][of].view(np.int64))], names=["key", "fp"])

    def link(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            u, v = _spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            to = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last run may go on
            if to:
                found.append(_links(k[:to], f[:to]))
                size += len(found[-1][0])
            held_k, held_f = k[to:], f[to:]
            if size > 1 << 20:
                yield flush()
                found, size = [], 0
        if len(held_k):
            found.append(_links(held_k, held_f))
        if found:
            yield flush()

    keyed = fps.select("fp").mapInArrow(tidy(emit), "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(link), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (least id reachable over links of 3 or fewer bits) for each row.

    A null, empty or blank text has fingerprint zero and is linked like any other.  Rows with equal
    fingerprints are one node.  A null id is never the least unless a component has no other: then
    component_id is null.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = shared_dir(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), shingle).view(np.int64))], names=["id", "fp"])

    fps = written(rows.mapInArrow(tidy(hashed), f"id {docs.schema[id_col].dataType.simpleString()}, fp long"), f"{scratch}/fps")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), f"{scratch}/nodes")
    links = written(near_links(nodes), f"{scratch}/links")
    roots = components(links)
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = written(joined, f"{scratch}/roots")
    least = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), f"{scratch}/least")
    named = written(joined.join(least, "root").select("fp", "component_id"), f"{scratch}/named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
