"""Helpers shared by the operators: scratch tables in the cluster's shared folder, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch, in place of Spark's 10,000: rows are whole texts, and a task holds several batches at once.
BATCH_ROWS_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

#: Parquet settings for rows of megabytes.
BLOB_OPTIONS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "compression": "zstd"}

#: A table of at most so many short rows may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder, as a URI, that the driver and all executors see, removed when the application ends.

    Every operator on texts asks for one first, so this is also where batches are made smaller.  The folder lies in
    ``spark.checkpoint.dir``.  Only a local master may do without that setting (tests):
    it gets a temporary folder.
    """
    if spark.conf.get(BATCH_ROWS_CONF) == "10000":  # the session's own choice stays
        spark.conf.set(BATCH_ROWS_CONF, str(BATCH_ROWS))
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{os.path.abspath(base)}" if _is_local_fs(spark, base) else base
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def _is_local_fs(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no later plan reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, path: str, blobs: bool = False) -> DataFrame:
    """Write a table and read it again: cuts the lineage in storage that outlives any executor.

    ``blobs`` says that a row has megabytes: pages and row groups are then measured at each row, not after a
    hundred, so that a writer or reader holds a few rows.
    """
    writer = df.write.mode("overwrite")
    for name, value in BLOB_OPTIONS.items() if blobs else ():
        writer = writer.option(name, value)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession, path: str, part_bytes: int) -> int:
    """How many parts of about ``part_bytes`` a written table makes: at least as many as shuffles have partitions."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jpath).getLength()
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def checked_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of short rows for broadcasting if it has at most ``limit`` rows; else leave the join to shuffle."""
    rows = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= limit else df


def whole_row(df: DataFrame) -> F.Column:
    """All columns as one struct ``row``, so that a join's own columns meet none of theirs; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def tidy(function):
    """A function over Arrow batches after which a worker gives freed memory back: idle workers stay for later stages."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def by_part(batches):
    """Rows without their first column, part by part, of batches sorted by it: a part at a time is held."""
    part, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != part and rows:
                yield rows
                rows = []
            part = row[0]
            rows.append(row[1:])
    if rows:
        yield rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
