"""Deduplication of facts and labels under an explicit order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_in_order(*frames: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """All rows, with ``source_rank`` by the frames' order; missing columns are null.

    (``source_rank``, ``ordinal``) is the order that later steps break ties by.
    """
    out = None
    for rank, df in enumerate(frames):
        df = df if ordinal in df.columns else df.withColumn(ordinal, F.monotonically_increasing_id())
        df = df.withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _columns(df: DataFrame, keep: list[str] | None) -> Column:
    return F.struct(*(keep or df.columns))


def keep_longest(df: DataFrame, key: Column, text: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per key: the longest ``text``, of equal ones the first; ``position`` is that of the key's first row.

    A partial aggregate per key, so a key with many rows doesn't gather in one task.  Only the columns ``keep`` (all by
    default) go through it: with ids alone, no text is moved.
    """
    best = F.max_by(_columns(df, keep), F.struct(F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), *[(-F.col(c)).alias(c) for c in order]))
    out = df.groupBy(key.alias("__key")).agg(best.alias("r"), F.min(F.struct(*order)).alias("position"))
    return out.select("r.*", "position")


def _edge(df: DataFrame, keys: list[str | Column], order: list[str], keep: list[str] | None, by, least) -> DataFrame:
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"__k{i}") for i, k in enumerate(keys)]
    if keep and keep == order and len(keep) == 1:  # a number is aggregated by hash
        return df.groupBy(*named).agg(least(keep[0]).alias(keep[0])).select(keep[0])
    return df.groupBy(*named).agg(by(_columns(df, keep), F.struct(*order)).alias("r")).select("r.*")


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The first row of each key by ``order``, with the columns ``keep`` (all by default); null keys are keys."""
    return _edge(df, keys, order, keep, F.min_by, F.min)


def keep_last(df: DataFrame, keys: list[str | Column], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The last row of each key by ``order``, with the columns ``keep`` (all by default)."""
    return _edge(df, keys, order, keep, F.max_by, F.max)


def drop_conflicts(df: DataFrame, prompt: str | Column, targets: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per prompt whose copies all have the same targets, the first, with ``duplicates``; other prompts go."""
    return conflict_groups(df, prompt, targets, order, keep).filter("versions = 1").select("r.*", (F.col("n") - 1).alias("duplicates"))


def conflict_groups(df: DataFrame, prompt: str | Column, targets: str, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Per prompt: the first row ``r``, rows ``n``, different target lists ``versions``.

    Whether two lists differ needs no set of them: the least and the greatest are equal or not.
    """
    as_json = F.to_json(F.col(targets)) if df.schema[targets].dataType.typeName() in ("array", "struct", "map") else F.coalesce(F.col(targets).cast("string"), F.lit("\0"))
    versions = F.when(F.min(as_json).eqNullSafe(F.max(as_json)), 1).otherwise(2)
    key = (F.col(prompt) if isinstance(prompt, str) else prompt).alias("__p")
    return df.groupBy(key).agg(F.min_by(_columns(df, keep), F.struct(*order)).alias("r"), F.count("*").alias("n"), versions.alias("versions"))


def seen_before(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row with ``nth``, its place among the rows of its key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
