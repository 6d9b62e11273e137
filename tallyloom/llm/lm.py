"""Operator 7: language-model scores of whole documents, by a gated recurrent network learnt from the corpus.

Texts become streams of word codes, a chunk of documents per row.  The count of every word over the whole
training part comes from a packed exchange: a chunk sends its distinct words and their counts to the task
that owns each word and gets their totals back.  The most frequent words, their classes and bands of rarer words are the
network's symbols.  Training goes over all training documents once, in rounds that double: the chunks of
a round each start from the same weights and train alone, and the mean of their weights, summed in
a tree, starts the next.  Scoring carries the state through a document's windows from first to last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import by_part, parts_of, remove, shared_dir, tidy, written
from tallyloom.llm.gru import Model, Shape, initial
from tallyloom.llm.textbytes import text_slices, word_bounds, words_array

#: Frequent words that are symbols of their own, bytes of text in a chunk, bytes of chunks per part in which words are counted.
TOP, CHUNK_BYTES, PART_BYTES = 1024, 16 << 20, 32 << 20
LOG10 = 1 / np.log(10)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _gathered(batches):
    """Batches joined to about a chunk's bytes of text (the third column), so that a long document shares its chunk with many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(2))).as_py() or 0
        if size >= CHUNK_BYTES:
            yield [pa.concat_arrays([x.column(i) for x in held]) for i in range(3)]
            held, size = [], 0
    if held:
        yield [pa.concat_arrays([x.column(i) for x in held]) for i in range(3)]


def _encode(batches):
    """A row per chunk: ids, held, tokens and codes of its documents, distinct words, their counts in training documents."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for ids_all, held_all, texts in _gathered(batches):
        at = 0
        held_all = held_all.to_numpy(zero_copy_only=False)
        for data, offsets in text_slices(texts, 2 * CHUNK_BYTES):  # one slice, but for very long documents
            docs = len(offsets) - 1
            starts, ends = word_bounds(data, offsets)
            coded = words_array(_LOWER[data], starts, ends).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            lengths = np.diff(np.searchsorted(starts, offsets)).astype(np.int32)
            held = held_all[at : at + docs]
            counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(coded.dictionary)).astype(np.int64)
            words = coded.dictionary
            bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
            raw = words.buffers()[2].to_pybytes() if len(words) and words.buffers()[2] is not None else b""
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            ids = pa.ListArray.from_arrays(pa.array([0, docs], pa.int32()), ids_all.slice(at, docs))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), ids, one(held), one(lengths), one(codes), pa.array([raw[bounds[0] : bounds[-1]] if len(words) else b""], pa.binary()), one(bounds - bounds[0] if len(words) else np.zeros(1, np.int32)), one(counts)], names=["chunk", "ids", "held", "lengths", "codes", "words", "bounds", "counts"])
            n, at = n + 1, at + docs


def _words(raw: bytes, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds.astype(np.int32))), pa.py_buffer(raw)])


def _part_of(words: pa.Array, parts: int) -> np.ndarray:
    """Which part owns each word, by its CRC: the same everywhere."""
    import zlib

    return np.fromiter((zlib.crc32(w) % parts for w in words.to_pylist()), np.int64, len(words))


def _send(parts: int):
    def send(batches):
        for batch in batches:
            for chunk, raw, bounds, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, counts = _words(raw, np.frombuffer(bounds, np.int32)), np.frombuffer(counts, np.int64)
                to = _part_of(words, parts)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                own = [words.take(pa.array(order[cuts[p] : cuts[p + 1]])) for p in some]
                data = [x.buffers()[2].to_pybytes() if x.buffers()[2] is not None else b"" for x in own]
                edge = [np.frombuffer(x.buffers()[1], np.int32)[: len(x) + 1] for x in own]
                pack = lambda rows: pa.array([x.tobytes() for x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), chunk)), pa.array(data, pa.binary()), pack(edge), pack([order[cuts[p] : cuts[p + 1]].astype(np.int32) for p in some]), pack([counts[order[cuts[p] : cuts[p + 1]]] for p in some])], names=["part", "chunk", "words", "bounds", "places", "counts"])

    return send


def _count(top: int):
    def count(batches):
        """Totals for each chunk's words (kind 0), and the frequent words (1) and counts of counts (2) of this part."""
        for rows in by_part(batches):
            words = pa.concat_arrays([_words(r[1], np.frombuffer(r[2], np.int32)) for r in rows]).dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            counts = np.concatenate([np.frombuffer(r[4], np.int64) for r in rows])
            total = np.zeros(len(words.dictionary), np.int64)
            np.add.at(total, codes, counts)
            at, reply = 0, []
            for r in rows:
                n = len(r[3]) // 4
                reply.append(total[codes[at : at + n]].tobytes())
                at += n
            out = [(0, r[0], r[3], c) for r, c in zip(rows, reply, strict=True)]
            most = np.argsort(-total, kind="stable")[:top]
            out += [(1, int(total[i]), words.dictionary[int(i)].as_py(), b"") for i in most if total[i]]
            values, times = np.unique(total[total > 0], return_counts=True)
            out.append((2, 0, values.astype(np.int64).tobytes(), times.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.binary())], names=["kind", "n", "a", "b"])

    return count


def _sum_bands(batches):
    """Distinct words, tokens and words by band of counts of counts, summed in the task."""
    sums = np.zeros((3, 64), np.int64)
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values, times = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            band = band_of(values)
            np.add.at(sums[0], band, times)
            np.add.at(sums[1], band, times * values)
            sums[2, :1] += times[values == 2].sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), *map(pa.array, sums)], names=["band", "words", "tokens", "twice"])


def band_of(counts: np.ndarray) -> np.ndarray:
    """0 for counts up to 1, else the whole part of the binary logarithm."""
    return np.frexp(np.maximum(counts, 1).astype(float))[1] - 1


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, seed: int = 7) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``held_out`` is the condition of the rows that nothing is learnt from.  Tokens are words in lower case (A to
    Z) and one end per document.  base_score is the sum of the tokens' log10((c + 1) / (N + V + 1)); score that
    of the network's log10 probabilities.  Both count all words without a training token as one more word; the network gives
    it the share of its band that words seen once and twice suggest.

    Null, empty and blank texts have the end alone.  Repeated ids are rows of their own.  Without training
    rows all counts are 0, the base probability is 1, and the network is that of its first weights.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = shared_dir(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = written(rows.mapInArrow(tidy(_encode), f"chunk long, ids array<{kind}>, held binary, lengths binary, codes binary, words binary, bounds binary, counts binary"), f"{scratch}/chunks", blobs=True)
    n_train, n_chunks = (rows.agg(F.sum((~F.col("held")).cast("long"))).first()[0] or 0), chunks.count()
    parts = parts_of(spark, f"{scratch}/chunks", PART_BYTES)
    sent = chunks.select("chunk", "words", "bounds", "counts").mapInArrow(tidy(_send(parts)), "part long, chunk long, words binary, bounds binary, places binary, counts binary")
    counted = written(sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(tidy(_count(top)), "kind int, n long, a binary, b binary"), f"{scratch}/counted")

    frequent = [(bytes(r[1]), r[0]) for r in counted.filter("kind = 1").select("n", "a").orderBy(F.desc("n"), "a").limit(top).collect()]
    bands = counted.filter("kind = 2").select("a", "b").mapInArrow(tidy(_sum_bands), "band long, words long, tokens long, twice long")
    words_in, tokens_in, twice = np.zeros(64, np.int64), np.zeros(64, np.int64), 0
    for band, w, t, two in bands.groupBy("band").agg(F.sum("words"), F.sum("tokens"), F.sum("twice")).collect():  # 64 rows
        words_in[band], tokens_in[band], twice = w, t, twice + two
    n_tokens = int(tokens_in.sum()) + n_train
    n_types = int(words_in.sum()) + (n_train > 0)
    for _, c in frequent:
        words_in[band_of(np.array([c]))[0]] -= 1
        tokens_in[band_of(np.array([c]))[0]] -= c
    used = int(np.flatnonzero(words_in).max(initial=0)) + 1
    shape = Shape(len(frequent), used)
    place = {w: i for i, (w, _) in enumerate(frequent)}
    once = max(1, int(words_in[0]))
    unseen = once / (once + 2 * twice + 1)  # of the band of words seen once or never
    share = np.log10(np.maximum(tokens_in, 1))
    end_count = n_train
    denominator = np.log10(n_tokens + n_types + 1) if n_tokens else 0.0

    def prepare(batches):
        for batch in batches:
            for chunk, ids, held, lengths, codes, raw, bounds, replies in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 8)), strict=True):
                held, lengths, codes = np.frombuffer(held.as_py(), bool), np.frombuffer(lengths.as_py(), np.int32), np.frombuffer(codes.as_py(), np.int32)
                words = _words(raw.as_py(), np.frombuffer(bounds.as_py(), np.int32))
                c = np.zeros(len(words), np.int64)
                for reply in replies.as_py() or []:
                    c[np.frombuffer(reply["a"], np.int32)] = np.frombuffer(reply["b"], np.int64)
                band = np.minimum(band_of(c), used - 1)
                symbol = np.fromiter((place.get(w, -1) for w in words.to_pylist()), np.int64, len(words))
                rare = symbol < 0
                # A rare word's part of its band; of the lowest band, words seen once share what is not for the unseen.
                tail = np.where(rare, np.log10(np.maximum(c, 1)) - share[band], 0.0)
                low = rare & (c <= 1)
                tail[low] = np.where(c[low] == 1, np.log10((1 - unseen) / once), np.log10(unseen))
                symbol = np.where(rare, shape.top + 1 + band, symbol)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                sums = lambda x: np.bincount(doc, x[codes], len(lengths))  # noqa: E731, B023
                base = sums(np.log10(c + 1.0)) + np.log10(end_count + 1.0) - (lengths + 1) * denominator
                known = sums((c > 0).astype(float)).astype(np.int64) + (end_count > 0)
                stream = np.insert(symbol[codes], np.cumsum(lengths), shape.top).astype(np.int16)
                one = lambda x: pa.array([x.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), ids.values), one(held), one(lengths + 1), one(stream), one(base), one(known), one(sums(tail))], names=["chunk", "ids", "held", "lengths", "stream", "base", "known", "tail"])

    replies = counted.filter("kind = 0").groupBy(F.col("n").alias("chunk")).agg(F.collect_list(F.struct("a", "b")).alias("replies"))
    joined = chunks.join(replies, "chunk", "left").select("chunk", "ids", "held", "lengths", "codes", "words", "bounds", "replies")
    ready = written(joined.mapInArrow(tidy(prepare), f"chunk long, ids array<{kind}>, held binary, lengths binary, stream binary, base binary, known binary, tail binary"), f"{scratch}/ready", blobs=True)
    for done in ("chunks", "counted"):
        remove(spark, f"{scratch}/{done}")

    counts = np.array([*(c for _, c in frequent), n_train, *tokens_in[:used]], float)
    weights = _trained(ready.select("chunk", "held", "lengths", "stream"), initial(shape, counts, seed), shape, n_chunks, f"{scratch}/train")

    def score(batches):
        model = Model(weights, shape)
        for batch in batches:
            for i in range(batch.num_rows):
                held, lengths, stream, base, known, tail = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((2, bool), (3, np.int32), (4, np.int16), (5, float), (6, np.int64), (7, float)))
                logs = model.score(stream.astype(np.int64), lengths) * LOG10 + tail
                columns = [batch.column(1)[i].values, held, lengths.astype(np.int64), known, np.full(len(held), n_tokens, np.int64), base, logs]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(tidy(score), f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _trained(chunks: DataFrame, weights: np.ndarray, shape: Shape, n: int, scratch: str) -> np.ndarray:
    """Weights after one pass over the training documents of all chunks, in rounds of 1, 2, 4, ... chunks.

    A chunk's place in the rounds is a hash of its number, so every chunk is in one round.
    """
    spark = chunks.sparkSession
    rounds = max(1, int(n).bit_length())
    # The last round takes half of all hashes, the one before a quarter, and so on down to the first.
    u = F.pmod(F.xxhash64("chunk"), F.lit(1 << 30))
    of = F.least(F.greatest(F.floor(F.log2((u + 1) / float(1 << 30))) + F.lit(rounds), F.lit(0)), F.lit(rounds - 1)).cast("int")
    staged = chunks.withColumn("round", of)
    for r in range(rounds):

        def learn(batches, start=weights):
            total, tokens = np.zeros(len(start)), 0
            for batch in batches:
                for i in range(batch.num_rows):
                    held, lengths, stream = (np.frombuffer(batch.column(k)[i].as_py(), t) for k, t in ((0, bool), (1, np.int32), (2, np.int16)))
                    own = ~held
                    if not own.any():
                        continue
                    model = Model(start, shape)
                    model.train(stream[np.repeat(own, lengths)].astype(np.int64), lengths[own])
                    size = int(lengths[own].sum())
                    total, tokens = total + size * model.flat.astype(float), tokens + size
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["w", "n"])

        one = staged.filter(F.col("round") == r).select("held", "lengths", "stream")
        sums = written(one.mapInArrow(tidy(learn), "w binary, n long"), f"{scratch}/{r}")
        level, k = sums.count(), 0
        while level > 32:  # a tree of sums, so that the driver gets a few
            k += 1
            sums = written(sums.repartition(-(-level // 32)).mapInArrow(tidy(_add), "w binary, n long"), f"{scratch}/{r}-{k}")
            level = -(-level // 32)
        total, tokens = np.zeros(len(weights)), 0
        for w, t in sums.collect():
            total, tokens = total + np.frombuffer(w, float), tokens + t
        if tokens:
            weights = (total / tokens).astype(np.float32)
        for j in range(k + 1):
            remove(spark, f"{scratch}/{r}" + (f"-{j}" if j else ""))
    return weights


def _add(batches):
    total, tokens = None, 0
    for batch in batches:
        for w, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total = np.frombuffer(w, float) + (0 if total is None else total)
            tokens += t
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["w", "n"])
