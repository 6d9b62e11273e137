"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Expressions that mean the same in both dialects.
DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
PRICE = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"


def short(x: str, n: int = 16) -> str:
    """SQL for the first digits of a text's SHA-256."""
    return f"substr(sha256({x}), 1, {n})"


def cases(key: str, *values: str) -> str:
    """SQL that picks a value by a number modulo their count."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: SQL for the tokens of a text, and for its numbers.
TOKENS = "regexp_extract_all({}, '[\\x{{4e00}}-\\x{{9fff}}]|[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{4e00}}-\\x{{9fff}}]+')"
NUMBERS = "list_transform(regexp_extract_all({}, '-?\\d+\\.?\\d*%?'), lambda v: TRY_CAST(rtrim(v, '%') AS DOUBLE))"
