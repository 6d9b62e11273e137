"""Content hashes, stable splits and deduplication keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(text: Column, length: int = 16) -> Column:
    """The first hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def hash_percent(key: Column) -> Column:
    """0 to 99, evenly and for ever the same for a key: the first 32 bits of its SHA-256, modulo 100."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


def split_label(key: Column, train: int = 80, held: int = 10, names: tuple[str, str, str] = ("train", "val", "test")) -> Column:
    """The split that a key falls into: ``train`` per cent, ``held`` per cent, the rest."""
    bucket = hash_percent(key)
    return F.when(bucket < train, names[0]).when(bucket < train + held, names[1]).otherwise(names[2])


def fact_split(entity: Column, metric: Column, salt: str) -> Column:
    """Split of a fact: all facts of an entity and metric go together."""
    return split_label(F.concat_ws("|", F.coalesce(entity, F.lit("")), F.coalesce(metric, F.lit("")), F.lit(salt)))


def label_split(qid: Column, salt: str) -> Column:
    """Split of a labelled question; its salt goes before the id and its middle split is called validation."""
    return split_label(F.concat(F.lit(salt + ":"), qid), names=("train", "validation", "test"))


def dedup_key(entity: Column, metric: Column, date: Column, value_text: Column, unit: Column, fact: Column) -> Column:
    """JSON of the five identifying fields, missing ones empty; without entity or metric, a hash of the sentence."""
    fields = F.array(*[F.coalesce(c, F.lit("")) for c in (entity, metric, date, value_text, unit)])
    known = (F.length(entity) > 0) & (F.length(metric) > 0)
    return F.when(known, F.to_json(fields)).otherwise(short_hash(F.coalesce(fact, F.lit("")), 20))
