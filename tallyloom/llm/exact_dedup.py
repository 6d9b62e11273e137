"""Operator 1: exact deduplication by progressive refinement, in DataFrame functions only.

Texts are compared after replacing each run of ASCII white space by one space.  Rows go through three
ever narrower sieves: length, then a 64-bit hash of a prefix, then SHA-256 of the whole text.  A row is
looked at in a sieve only if another row shares all its earlier keys.

Keys are counted by partial aggregates and written, a row each.  Few keys are broadcast to the rows, which then don't
move; more are joined as a written table, so that adaptive execution may split the rows of a frequent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACE, checked_broadcast, shared_dir, written

#: Code points in the prefix that the second sieve hashes.
PREFIX_CHARS = 256
#: Keys of at most 60 bytes that may be broadcast.
KEY_ROWS = 200_000


def normalised(text: str | Column) -> Column:
    """Null as empty, runs of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(F.col(f"`{text}`") if isinstance(text, str) else text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept; with ``digest`` also text_sha256.

    keep_id is the smallest id of the rows with an equal text, group_size their number, kept whether the
    row carries that id.  Without ``digest`` the first scan reads lengths and prefixes and only rows whose
    length and prefix occur again are hashed in full; with it every row needs its hash, so one scan takes
    all three keys and the sieves run on the narrow table.

    Null and empty texts are equal.  Rows that repeat an id count one by one, and all that carry the kept
    id are kept.  A null id is never smaller than another; in a group of null ids only, keep_id is null and
    all are kept.  Other columns are ignored, whatever their names.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = shared_dir(spark)
    norm = normalised(text_col)
    sha = F.unhex(F.sha2(norm, 256))
    keys = [F.col(f"`{id_col}`").alias("id"), F.length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("p")]
    narrow = written(docs.select(*keys, *([sha.alias("sha")] if digest else [])), f"{scratch}/narrow")

    def again(df: DataFrame, *by: str) -> DataFrame:
        """Keys that occur more than once, as a written table: a row per key, however many rows a key has."""
        return checked_broadcast(written(df.groupBy(*by).agg(F.count("*").alias("c")).filter("c > 1").drop("c"), f"{scratch}/{'-'.join(by)}"), limit=KEY_ROWS)

    by_length = narrow.select("id", "n", "p").join(again(narrow, "n"), "n", "left_semi")
    by_prefix = again(by_length, "n", "p")
    hashed = narrow if digest else docs.select(*keys, sha.alias("sha"))
    survivors = hashed.join(by_prefix, ["n", "p"], "left_semi")
    groups = survivors.groupBy("sha").agg(F.min("id").alias("keep"), F.count("*").alias("size")).filter("size > 1")
    groups = checked_broadcast(written(groups, f"{scratch}/groups"), limit=KEY_ROWS)

    if digest:
        found = narrow.join(groups, "sha", "left")
        more = [F.lower(F.hex("sha")).alias("text_sha256")]
    else:
        # Rows that no sieve caught are alone; the others are joined by their full hash.
        alone = narrow.join(by_prefix, ["n", "p"], "left_anti").select("id", F.lit(None).cast(docs.schema[id_col].dataType).alias("keep"), F.lit(None).cast("long").alias("size"))
        found = survivors.join(groups, "sha", "left").select("id", "keep", "size").unionByName(alone)
        more = []
    grouped = F.col("size").isNotNull()
    keep = F.when(grouped, F.col("keep")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), *more)
