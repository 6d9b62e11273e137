"""A snapshot of records with their vectors and a manifest that binds the two together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.errors import RecordError
from tallyloom.operators.validation import parse_records

MANIFEST = "schema_version string, embedding_model string, embedding_dim int, normalized boolean, record_count long, records_digest string"


def digest(df: DataFrame, columns: list[str]) -> str:
    """A digest of a table's rows in any order: two sums of row hashes, as hex."""
    both = [F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    a, b = df.agg(*both).first()
    return f"{int(a or 0):x}-{int(b or 0):x}"


def unit_vector(v: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def write_snapshot(records: DataFrame, path: str, vector: str = "embedding", model: str = "", normalize: bool = True, id_col: str = "fact_id") -> None:
    """Records with their vectors in the same rows, sorted by id in files, and the manifest beside them."""
    df = records.withColumn(vector, unit_vector(F.col(vector))) if normalize else records
    df.sortWithinPartitions(id_col).write.mode("overwrite").parquet(f"{path}/records")
    stored = records.sparkSession.read.parquet(f"{path}/records")
    dims = stored.agg(F.min(F.size(vector)), F.max(F.size(vector)), F.count("*")).first()
    if dims[0] != dims[1]:
        raise RecordError("vectors have different lengths")
    row = [("1.1", model, dims[0] or 0, normalize, dims[2], digest(stored, [c for c in stored.columns if c != vector]))]
    records.sparkSession.createDataFrame(row, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str, vector: str = "embedding", model: str | None = None, verify: bool = True) -> DataFrame:
    """The records, once the manifest agrees: one row, model, count, dimension, unit length, digest."""
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()
    if len(rows) != 1:
        raise RecordError("the manifest must have one row")
    m, df = rows[0], spark.read.parquet(f"{path}/records")
    if model is not None and m.embedding_model != model:
        raise RecordError(f"the snapshot was made with {m.embedding_model!r}")
    if verify:
        length = F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, low, high, off = df.agg(F.count("*"), F.min(F.size(vector)), F.max(F.size(vector)), F.max(F.when(length > 0, F.abs(length - 1)))).first()
        if n != m.record_count:
            raise RecordError(f"{n} records, {m.record_count} in the manifest")
        if n and (low != m.embedding_dim or high != m.embedding_dim):
            raise RecordError("a vector's length isn't the manifest's")
        if m.normalized and n and (off or 0) > 1e-3:
            raise RecordError("a vector isn't of unit length")
        if digest(df, [c for c in df.columns if c != vector]) != m.records_digest:
            raise RecordError("the records aren't those of the manifest")
    return df


def load_records(spark: SparkSession, path: str, vector: str = "embedding", model: str | None = None) -> DataFrame:
    """A snapshot's records in canonical form with their vectors; one that isn't valid fails the query."""
    df = read_snapshot(spark, path, vector, model)
    fields = [c for c in df.columns if c != vector]
    # Null fields are left out, so that a missing one and a null one are the same.
    as_object = F.try_parse_json(F.to_json(F.struct(*fields)))
    parsed = parse_records(df.select(vector, F.col("fact_id").alias("own_id"), as_object.alias("v")))
    where = F.concat_ws(": ", F.coalesce("own_id", F.lit("")), "error")
    return parsed.filter(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(where).cast("boolean"))).drop("error", "own_id")
