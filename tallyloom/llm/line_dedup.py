"""Operator 9: fuzzy line deduplication by MinHash.

Lines are compared by their sets of character shingles after lower-casing A to Z and collapsing white space.  A line's
signature is one hash per shingle, the least kept in each of a fixed number of bins (one-permutation
MinHash; empty bins take the next one's value); bands of bins are keys.  Lines that share a key are
candidates, which are verified by the exact Jaccard similarity of their shingle sets.  Verified pairs go to the
distributed union-find, and of each component the first line (by document, then place) stays.

Keys travel in packed columns, one row per pair of tasks, so that a line costs no row per band.  Equal lines
have one key set between them in a task, whatever their number.  Of a key that many different lines share, neighbours
in an order of the key's own are compared first; of lines not connected by then, blocks meet blocks (see ``crowds``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import by_part, parts_of, shared_dir, tidy, whole_row, written
from tallyloom.llm.components import components
from tallyloom.llm.crowds import crowd_links
from tallyloom.llm.textbytes import LOWER_BYTES, SPACE_BYTES, text_slices, word_bounds

#: Bytes in a character shingle (a machine word), bands and bins per band, least similarity.
SHINGLE, BANDS, ROWS, SIMILARITY = 8, 12, 5, 0.8
#: Bits of the mask that keeps most lines without candidates out of the exchange of texts; its size is fixed.
MASK_BITS = 1 << 24
#: Up to so many different lines under one key, all pairs are candidates.
SMALL_GROUP = 24
#: Bytes of the table of lines per part that is compared at once, places in a task's list of lines sent.
PART_BYTES, SENT = 32 << 20, 1 << 18
#: Bits of a line's map of shingles, a power of two.
MAP_BITS = 4096
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    return x * _M2 ^ (x >> np.uint64(32))


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(8-byte shingle as a mixed number, line) at each place; a shorter line that isn't empty is one shingle."""
    room = np.concatenate([data, np.zeros(SHINGLE, np.uint8)])
    windows = np.ndarray((len(data),), "<u8", buffer=room.data, strides=(1,))
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - SHINGLE + 1, 0)
    line = np.repeat(np.arange(len(lengths)), counts)
    whole = np.repeat(offsets[1:], lengths) - np.arange(offsets[0], offsets[-1]) >= SHINGLE
    x = windows[whole]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    if len(short):
        bits = (8 * lengths[short]).astype(np.uint64)
        x = np.concatenate([x, windows[offsets[:-1][short]] & ((np.uint64(1) << bits) - np.uint64(1))])
        line = np.concatenate([line, short])
    return _mixed(x), line


def band_keys(data: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key per line (none empty) and band: lines by bands."""
    hashes, line = _shingles(data, offsets)
    n, bins = len(offsets) - 1, bands * rows
    least = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    bin_ = (hashes >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)
    np.minimum.at(least, line * bins + bin_.view(np.int64), hashes & np.uint64((1 << 40) - 1))
    least = least.reshape(n, bins)
    # An empty bin takes the value of the next that isn't, round the circle, marked by the distance.
    empty = least == np.iinfo(np.uint64).max
    place = np.where(empty, 2 * bins, np.arange(bins))
    twice = np.concatenate([place, place + bins], axis=1)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :bins]
    values = np.take_along_axis(least, following % bins, axis=1) + ((following - np.arange(bins)).astype(np.uint64) << np.uint64(40))
    key = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        key = _mixed(key ^ values[:, r::rows])
    return _mixed(key + np.arange(bands, dtype=np.uint64))


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends, document, place) of the normalised lines that aren't blank, of a slice of documents."""
    starts, stops = word_bounds(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return b"", none, none, none, none
    doc = np.searchsorted(offsets, starts, "right") - 1
    apart = stops < offsets[doc + 1]  # white space follows, unless the document ends
    keep = ~SPACE_BYTES[data]
    keep[stops[apart]] = True
    lower = LOWER_BYTES[data]
    lower[stops[apart]] = 0x20
    after = np.cumsum(stops - starts + apart)
    breaks = np.flatnonzero(data == 0x0A)
    before = np.searchsorted(breaks, starts)
    number = before + doc
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    last = np.append(first[1:], len(starts)) - 1
    begins = (after - (stops - starts + apart))[first]
    return lower[keep].tobytes(), begins, (after - apart)[last], doc[first], before[first] - np.searchsorted(breaks, offsets[:-1])[doc[first]]


def _chunk(batches):
    """A row per slice of documents: their ids and hashes, their lines' documents, places and hashes, and each different line's text and keys."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for batch in batches:
        at = 0
        for data, offsets in text_slices(batch.column(1)):
            docs = len(offsets) - 1
            whole = data.tobytes()
            t = np.array([digest(whole[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            raw, begins, ends, doc, place = split_lines(data, offsets)
            h = np.fromiter((digest(raw[a:b], 42) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.uint64, len(begins))
            different, first = np.unique(h, return_index=True)
            texts = b"".join([raw[a:b] for a, b in zip(begins[first].tolist(), ends[first].tolist(), strict=True)])
            bounds = np.concatenate([[0], np.cumsum(ends[first] - begins[first])])
            keys = [band_keys(np.frombuffer(texts, np.uint8)[bounds[k] : bounds[min(k + 4096, len(first))]], bounds[k : k + 4097] - bounds[k]) for k in range(0, len(first), 4096)]
            one = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), batch.column(0).slice(at, docs))
            yield pa.RecordBatch.from_arrays([ids, one(t, "<u8"), one(doc, "<i4"), one(place, "<i4"), one(h, "<u8"), one(different, "<u8"), one(np.concatenate(keys) if keys else np.zeros(0), "<u8"), pa.array([texts], pa.binary()), one(bounds, "<i4")], names=["ids", "t", "doc", "place", "h", "different", "keys", "texts", "bounds"])
            at += docs


def _rows(batches):
    """(id, t, pos, h) of each line of the chunks."""
    for batch in batches:
        for i in range(batch.num_rows):
            t, doc, place, h = (np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in ((1, "<i8"), (2, "<i4"), (3, "<i4"), (4, "<i8")))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(doc)), pa.array(t[doc]), pa.array(place), pa.array(h)], names=["id", "t", "pos", "h"])


def _emit(parts: int):
    def emit(batches):
        """Keys of the chunks' different lines, packed by the task that will compare them."""
        sent = np.zeros(SENT, np.int64)  # hashes of lines sent before, one per place, so that few are sent twice
        for batch in batches:
            for i in range(batch.num_rows):
                own, keys = np.frombuffer(batch.column(0)[i].as_py(), np.int64), np.frombuffer(batch.column(1)[i].as_py(), np.uint64)
                place = own & (SENT - 1)
                fresh = sent[place] != own
                own, keys = own[fresh], keys.reshape(-1, BANDS)[fresh].reshape(-1)
                sent[place[fresh]] = own
                ids = np.repeat(own, BANDS)
                to = (keys >> np.uint64(33)).astype(np.int64) % parts
                order = np.argsort(to, kind="stable")
                bounds = np.searchsorted(to[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(bounds))
                pack = lambda x: pa.array([x[order[bounds[p] : bounds[p + 1]]].tobytes() for p in some], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(some), pack(keys), pack(ids)], names=["part", "keys", "ids"])

    return emit


def _mask(batches):
    """A bit per wanted line hash, of a fixed number of bits."""
    bits = np.zeros(MASK_BITS // 8, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(MASK_BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).view(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _or(batches):
    bits = np.zeros(MASK_BITS // 8, np.uint8)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            bits |= np.frombuffer(x, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def _pick(bits: np.ndarray):
    def pick(batches):
        """(h, line) of the different lines of chunks whose bit is set: all that are wanted and a few more."""
        for batch in batches:
            for i in range(batch.num_rows):
                own, bounds = np.frombuffer(batch.column(0)[i].as_py(), np.int64), np.frombuffer(batch.column(2)[i].as_py(), np.int32)
                lines = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds), batch.column(1)[i].as_buffer()])
                at = own.view(np.uint64) % np.uint64(MASK_BITS)
                some = pa.array(np.flatnonzero(bits[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1))
                yield pa.RecordBatch.from_arrays([pa.array(own).take(some), lines.take(some)], names=["h", "line"])

    return pick


def _meet(batches):
    """Pairs of lines under small keys and of neighbours under others; (key, line) with b null under the others."""
    for packed in by_part(batches):
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k, _ in packed])
        ids = np.concatenate([np.frombuffer(i, np.int64) for _, i in packed])
        packed.clear()
        order = np.lexsort((_mixed(ids.view(np.uint64) ^ keys), keys))
        keys, ids = keys[order], ids[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
        keys, ids = keys[fresh], ids[fresh]
        bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        length = np.diff(bounds)
        more = np.repeat(length > 1, length)
        run, own, large = np.repeat(np.arange(len(length)), length)[more], ids[more], np.repeat(length > SMALL_GROUP, length)[more]
        found = [(own[:-s][same], own[s:][same]) for s in range(1, SMALL_GROUP) if len(own) > s for same in [(run[s:] == run[:-s]) & (~large[s:] | (s == 1))]]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])
        large = np.repeat(length > SMALL_GROUP, length)
        if large.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[large].view(np.int64)), pa.array(ids[large]), pa.nulls(int(large.sum()), pa.int64())], names=["key", "a", "b"])


def _salts(n: int) -> np.ndarray:
    """A number per line that tells its shingles from other lines' when mixed in."""
    return _mixed(np.arange(1, n + 1, dtype=np.uint64))


def _sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, bounds, members): each line's different shingles one after the other, where each line's begin and
    the last's end, and all of them with their lines' salts, sorted."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    x, line = _shingles(np.frombuffer(b"".join(lines), np.uint8), offsets)
    salted = x ^ _salts(len(lines))[line]
    order = np.argsort(salted)
    members = salted[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = members[1:] != members[:-1]
    keep = np.sort(order[fresh])
    x, line = x[keep], line[keep]
    if len(line) and (line[1:] < line[:-1]).any():  # short lines come last
        order = np.argsort(line, kind="stable")
        x, line = x[order], line[order]
    return x, np.searchsorted(line, np.arange(len(lines) + 1)), members[fresh]


def _possible(x: np.ndarray, line: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs may be similar enough: never false for one that is.

    A line's shingles set bits of a map.  As many as one's map has beyond the other's, at least, are not shared; a line has
    at least as many different shingles as its map has bits, at most as many as places.
    """
    maps = np.zeros((n, MAP_BITS), bool)
    maps[line, (x >> np.uint64(20)).view(np.int64) & (MAP_BITS - 1)] = True
    maps = np.packbits(maps, axis=1).view(np.uint64)
    places, bits = np.bincount(line, minlength=n), np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 1024):
        p, q = a[k : k + 1024], b[k : k + 1024]
        both = np.bitwise_count(maps[p] & maps[q]).sum(axis=1, dtype=np.int64)
        only_p, only_q = bits[p] - both, bits[q] - both
        out[k : k + 1024] = (places[p] - only_p >= least * (bits[q] + only_p)) & (places[q] - only_q >= least * (bits[p] + only_q))
    return out


def similar_pairs(lines: list[bytes], a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For each pair of places in ``lines``, whether the Jaccard similarity of their shingle sets is at least that."""
    out = np.zeros(len(a), bool)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    x, line = _shingles(np.frombuffer(b"".join(lines), np.uint8), offsets)
    fits = np.flatnonzero(_possible(x, line, len(lines), a, b, least))
    used, place = np.unique(np.concatenate([a[fits], b[fits]]), return_inverse=True)
    a, b = place[: len(fits)], place[len(fits) :]
    sets, bounds, members = _sets([lines[i] for i in used.tolist()])
    size, salt = np.diff(bounds), _salts(len(used))
    for k in range(0, len(fits), 2048):
        p, q = a[k : k + 2048], b[k : k + 2048]
        n = size[p]
        pair = np.repeat(np.arange(len(p)), n)
        x = sets[np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + bounds[p][pair]] ^ salt[q][pair]
        order = np.argsort(x)  # sorted searches stay in the cache
        x = x[order]
        found = members[np.minimum(np.searchsorted(members, x), len(members) - 1)] == x
        both = np.bincount(pair[order[found]], minlength=len(p))
        out[fits[k : k + 2048]] = both >= least * (n + size[q] - both)
    return out


def _verify(batches):
    """(u, v) of the pairs (a, b, line_a, line_b) that are similar enough."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            ids = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            _, first, place = np.unique(ids, return_index=True, return_inverse=True)
            lines = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first)).to_pylist()
            keep = similar_pairs(lines, place[: batch.num_rows], place[batch.num_rows :])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, t, pos, keep_id, keep_pos, kept) for each line that isn't blank: kept or a near copy of an earlier line.

    pos counts a document's lines from 0, t tells documents of one id apart.  Blank lines have no row: they are
    no copies of each other.  Lines that differ in case or white space only are copies.  Null texts have no
    lines; a null id comes before others.  Rows that repeat id and text are one document, all of whose rows
    share the decision.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = shared_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blobs = ("t", "doc", "place", "h", "different", "keys", "texts", "bounds")
    chunks = written(source.mapInArrow(tidy(_chunk), f"ids array<{kind}>, " + ", ".join(f"{b} binary" for b in blobs)), f"{scratch}/chunks", blobs=True)
    n = parts or parts_of(spark, f"{scratch}/chunks", PART_BYTES)
    packed = chunks.select("different", "keys").mapInArrow(tidy(_emit(n)), "part long, keys binary, ids binary")
    met = written(packed.repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_meet), "key long, a long, b long"), f"{scratch}/met")
    pairs = written(met.filter("key is null").select("a", "b").distinct(), f"{scratch}/pairs")
    crowds = met.filter("key is not null").select("key", F.col("a").alias("h"))

    wanted = written(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).union(crowds.select("h")).distinct(), f"{scratch}/wanted")
    bits = np.zeros(MASK_BITS // 8, np.uint8)
    for (x,) in wanted.mapInArrow(tidy(_mask), "bits binary").repartition(8).mapInArrow(tidy(_or), "bits binary").collect():  # 8 masks
        bits |= np.frombuffer(x, np.uint8)
    picked = chunks.select("different", "texts", "bounds").mapInArrow(tidy(_pick(bits)), "h long, line binary")
    texts = written(picked.join(wanted, "h", "left_semi").dropDuplicates(["h"]), f"{scratch}/texts")
    with_a = pairs.join(texts.withColumnsRenamed({"h": "a", "line": "la"}), "a")
    with_b = with_a.join(texts.withColumnsRenamed({"h": "b", "line": "lb"}), "b").select("a", "b", "la", "lb").sortWithinPartitions("a")
    roots = components(written(with_b.mapInArrow(tidy(_verify), "u long, v long"), f"{scratch}/links"))
    if not crowds.isEmpty():
        more = crowd_links(crowds, roots, texts.withColumnRenamed("line", "text"), lambda lines: _sets(lines)[:2], round(100 * SIMILARITY), scratch)
        if more is not None and not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    lines = chunks.select("ids", "t", "doc", "place", "h").mapInArrow(tidy(_rows), f"id {kind}, t long, pos int, h long")
    rows = lines.join(roots, F.col("h") == F.col("node"), "left")
    rows = written(rows.select("id", "t", "pos", F.coalesce("root", "h").alias("g")), f"{scratch}/rows")
    first = written(rows.groupBy("g").agg(F.min(F.struct("id", "t", "pos")).alias("first")), f"{scratch}/first")
    out = rows.join(first, "g")
    return out.select(F.col("id").alias(id_col), "t", "pos", F.col("first.id").alias("keep_id"), F.col("first.pos").alias("keep_pos"), F.struct("id", "t", "pos").eqNullSafe(F.col("first")).alias("kept"))


def drop_lines(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``groups`` doesn't keep; documents that lose nothing keep their text as it is.

    A document of which no line that isn't blank is left goes, unless it had none.
    """
    gone = groups.groupBy(F.col(id_col).alias("id"), "t").agg(F.sort_array(F.collect_list(F.when(~F.col("kept"), F.col("pos")))).alias("drop"), F.count("*").alias("n"))
    gone = gone.filter(F.size("drop") > 0).withColumnsRenamed({"id": "gone_id", "t": "gone_t"})
    own = docs.select(whole_row(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("t"))
    joined = own.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("t") == F.col("gone_t")), "left").filter("drop is null or size(drop) < n")

    @F.pandas_udf("string")
    def without(text: pd.Series, drop: pd.Series) -> pd.Series:
        def cut(x, d):
            if d is None:
                return x
            d = set(d)
            return "\n".join(line for i, line in enumerate(x.split("\n")) if i not in d)

        return text.combine(drop, cut)

    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("drop")))
    return joined.select("row", text.alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
