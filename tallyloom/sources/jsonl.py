"""JSON-lines sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.errors import DatasetError
from tallyloom.functions.text import trim
from tallyloom.operators.validation import parse_samples
from tallyloom.sources.scratch import scratch_dir, written


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) is not None and bool(len(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)))


def numbered_lines(reader, path: str) -> DataFrame:
    """(path, line, value): text files' lines with their numbers from 1, blank ones counted but left out.

    A task counts the lines of its piece of a file; what the pieces before hold is added, a row per piece.
    """
    raw = reader.text(path)
    piece = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at")]
    sizes = raw.select(*piece).groupBy("path", "piece").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("path", "piece", (before - F.col("first") + 1).alias("shift"))
    lines = raw.select("value", *piece).join(shifts, ["path", "piece"])
    return lines.select("path", (F.col("at") + F.col("shift")).alias("line"), "value").filter(trim(F.col("value")) != "")


def read_variant(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, line, v, error) of all lines that aren't blank: v the object as VARIANT, or why it isn't one.

    Types stay those of the JSON, and a missing field differs from a null one.
    """
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true") if recursive else spark.read
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    error = F.when(v.isNull(), "invalid JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not an object")
    return numbered_lines(reader, path).withColumn("v", F.when(error.isNull(), v)).withColumn("error", error).drop("value")


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """``read_variant`` that fails on the first bad line, naming file and line."""
    rows = read_variant(spark, path)
    where = F.concat_ws(":", "path", F.col("line").cast("string"), "error")
    return rows.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(where).cast("boolean"))).drop("error")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Question samples of a strict scan; the first that isn't valid fails the query, naming file and line."""
    parsed = parse_samples(read_strict(spark, path))
    where = F.concat_ws(":", "path", F.col("line").cast("string"), "error")
    return parsed.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(where).cast("boolean"))).drop("error")


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; a missing path is an empty table and bad lines are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_fail_fast(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows; a bad line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_quarantine(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(typed rows, bad lines)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select("value", parsed.alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    return rows.filter(~bad).select("r.*").drop("_corrupt_record"), rows.filter(bad).select(F.col("value").alias("_corrupt_record"))


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Audit rows, each with a reward; an empty file or a row without one is an error."""
    rows = read_fail_fast(spark, path, schema)
    if rows.limit(1).count() == 0:
        raise DatasetError(f"{path} has no rows")
    return rows.filter(F.assert_true(F.col("reward").isNotNull(), "a row has no reward").isNull())


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; ``errorifexists`` never overwrites, ``append`` adds."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_decided(df: DataFrame, accepted: str, rejected: str, decision: str = "decision", keep: str = "keep") -> None:
    """Rows kept and rows turned away, to two different new paths; a null decision turns away.

    The rows are computed once and written in between.
    """
    if accepted == rejected:
        raise DatasetError("accepted and rejected rows need different paths")
    kept = F.coalesce(F.col(decision) == keep, F.lit(False))
    once = written(df, f"{scratch_dir(df.sparkSession)}/decided")
    write(once.filter(kept), accepted, "errorifexists")
    write(once.filter(~kept), rejected, "errorifexists")


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    """A folder per split."""
    df.write.mode("overwrite").partitionBy(column).json(path)
