"""Operator 2: token ids in Arrow stream files of fixed-size-list batches.

A shard is two Arrow IPC stream files: ``.seq`` has batches of equal numbers of rows, each row a sequence of
``seq_len`` ids and a mask of which are real; ``.idx`` has a row per document: id, first id and number of ids
in the shard.  Batches aren't compressed and, but for the last, equally long, so that sequence ``i`` is found
by arithmetic and read through a memory map without a copy (:class:`SequenceFile`).  Ids are unsigned 16-bit
where the vocabulary allows it, else 32-bit.

Shards are written by tasks over ranges of the document id, each under a name of its attempt; the table of
shards, which Spark commits, names those that count.  Files of lost attempts are never read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import tidy, written
from tallyloom.llm.tokens import PartTokenizer, with_end

SEQ_LEN, BATCH_ROWS = 2048, 64


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _schema(seq_len: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class _Shard:
    """Writes one shard; holds at most one batch."""

    def __init__(self, folder: str, name: str, id_type: pa.DataType, wide: bool, seq_len: int, rows: int):
        self.uri = f"{folder}/{name}"
        fs, path = _open(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.kind, self.seq_len, self.full = (pa.uint32() if wide else pa.uint16()), seq_len, seq_len * rows
        self.schema, self.index_schema = _schema(seq_len, self.kind), pa.schema([("id", id_type), ("start", pa.int64()), ("n", pa.int64())])
        self.sinks = fs.open_output_stream(path + ".seq"), fs.open_output_stream(path + ".idx")
        self.seq, self.index = pa.ipc.new_stream(self.sinks[0], self.schema), pa.ipc.new_stream(self.sinks[1], self.index_schema)
        self.held, self.n_held, self.docs, self.ids, self.sequences = [], 0, 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        begins = np.concatenate([[0], ends[:-1]])
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(begins + self.ids), pa.array(ends - begins)], schema=self.index_schema))
        self.docs, self.ids = self.docs + len(doc_ids), self.ids + len(ids)
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.n_held += len(ids)
        if self.n_held >= self.full:
            flat = np.concatenate(self.held)
            to = len(flat) // self.full * self.full
            for at in range(0, to, self.full):
                self._batch(flat[at : at + self.full])
            self.held, self.n_held = [flat[to:].copy()], len(flat) - to

    def _batch(self, flat: np.ndarray) -> None:
        rows = -(-len(flat) // self.seq_len)
        ids = np.zeros(rows * self.seq_len, flat.dtype)
        ids[: len(flat)] = flat
        real = np.arange(len(ids)) < len(flat)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, real)]
        self.seq.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += rows

    def close(self) -> None:
        if self.n_held:
            self._batch(np.concatenate(self.held))
        for x in (self.seq, self.index, *self.sinks):
            x.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, words: bool = True, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``docs`` under ``folder`` in ascending id order and return the table of shards.

    ``words`` says that the tokenizer drops white space and lower-cases.  Columns of the result: shard, uri,
    docs, ids, sequences, base (ids in the shards before).  A document is its text's ids and ``end_id``;
    a null text has ``end_id`` alone, a null id comes first, rows of equal ids follow each other in an order
    that depends on their texts alone.  A shard's last sequence is filled up under its mask.  An empty
    table gives no shards.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, tokenizer = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tokenizer is None:
                tokenizer = PartTokenizer(tokenizer_path, words)
                name = f"shard-{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}"
                shard = _Shard(folder, name, batch.column(0).type, max(end_id + 1, len(tokenizer.edge)) > 1 << 16, seq_len, batch_rows)
            at = 0
            for ids, ends in tokenizer.encode(batch.column(1)):
                shard.add(batch.column(0).slice(at, len(ends)), *with_end(ids, ends, end_id))
                at += len(ends)
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "uri": [shard.uri], "docs": pa.array([shard.docs], pa.int64()), "ids": pa.array([shard.ids], pa.int64()), "sequences": pa.array([shard.sequences], pa.int64())})

    shards = written(rows.mapInArrow(tidy(write), "shard long, uri string, docs long, ids long, sequences long"), f"{folder}/shards")
    # One row per shard: a task wrote each, so one more task can order them.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(shards: DataFrame, id_type: str, id_col: str = "doc_id") -> DataFrame:
    """From the files of ``shards``: id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids) of each document.

    A task reads a shard batch by batch; a document may span any number of batches.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _digests(row["uri"], row["base"])

    n = max(1, shards.count())
    return shards.select("shard", "uri", "base").repartition(n, "shard").mapInArrow(tidy(read), f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long")


def _digests(uri: str, base: int):
    fs, path = _open(uri)
    with fs.open_input_stream(path + ".seq") as seq_file, fs.open_input_stream(path + ".idx") as index_file:
        batches = (b.column("ids").flatten().to_numpy()[b.column("mask").flatten().to_numpy(zero_copy_only=False)] for b in pa.ipc.open_stream(seq_file))
        ids, at = np.zeros(0, np.uint16), 0
        for index in pa.ipc.open_stream(index_file):
            crcs = []
            for n in index.column("n").to_pylist():
                crc = 0
                while n:
                    if at == len(ids):
                        ids, at = next(batches).astype("<u4"), 0
                    part = ids[at : at + n]
                    crc, n, at = zlib.crc32(part.tobytes(), crc), n - len(part), at + len(part)
                crcs.append(crc)
            start = pa.array(index.column("start").to_numpy() + base)
            yield pa.RecordBatch.from_arrays([index.column("id"), start, index.column("n"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


class SequenceFile:
    """Random access to a shard's sequences, without copies where the file is local."""

    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.source = pa.memory_map(path + ".seq") if fs.type_name == "local" else fs.open_input_file(path + ".seq")
        self.schema = pa.ipc.read_schema(self.source)
        self.head = self.source.tell()
        first = pa.ipc.read_message(self.source)
        self.rows, self.step = pa.ipc.read_record_batch(first, self.schema).num_rows, self.source.tell() - self.head

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``; the ids are a view of the file."""
        self.source.seek(self.head + i // self.rows * self.step)
        batch = pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)
        row = batch.slice(i % self.rows, 1)
        return row.column("ids").flatten().to_numpy(), row.column("mask").flatten().to_numpy(zero_copy_only=False)
