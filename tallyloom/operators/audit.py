"""Aggregates over scored trajectories and over the fact base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import truthy
from tallyloom.sources.scratch import scratch_dir, written

PARTS = ("answer_correctness", "answer_cem", "format_compliance", "search_incentive", "retrieval_correctness", "total")


def audit_rows(df: DataFrame, preview: int = 500) -> DataFrame:
    """What is kept of a scored trajectory: the trace, the answer, and per search its query, sizes and a preview."""
    step = lambda s: F.struct(s["query"].alias("query"), F.length(s["retrieved_text"]).alias("retrieved_characters"), F.substring(s["retrieved_text"], 1, preview).alias("retrieved_preview"), F.size(s["retrieved_records"]).alias("retrieved_record_count"))
    return df.select("qid", "prompt", F.col("best.target").alias("selected_target"), F.col("targets").alias("accepted_targets"), F.col("raw_text").alias("assistant_trace"), "final_answer", "num_rounds", "is_repeated_query", F.transform("search_steps", step).alias("searches"), F.col("best.reward").alias("reward"))


def rate(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def reward_metrics(audit: DataFrame) -> DataFrame:
    """One row of means over a batch of audit rows; no row for an empty batch."""
    means = [F.avg(f"reward.{p}").alias(f"{p}_mean") for p in PARTS]
    out = audit.agg(F.count("*").alias("count"), *means, rate(truthy(F.col("final_answer"))).alias("answer_rate"), rate(F.size("searches") > 0).alias("search_rate"), rate(F.col("is_repeated_query")).alias("repeated_rate"), rate(F.col("reward.terminated_with_zero")).alias("zero_rate"), F.avg("num_rounds").alias("rounds_mean"))
    return out.filter(F.col("count") > 0)


def run_table(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(run, key, n, low, high, total) of all runs of a global order, computed in ranges that are then joined.

    Each range finds its runs; a range's last run and the next one's first are one if their keys are equal.  Only a
    row per range, not per run, is ordered in a single task.
    """
    ranged = df.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(value).alias("value")).repartitionByRange("at").sortWithinPartitions("at")
    tagged = written(ranged.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), f"{scratch_dir(df.sparkSession)}/ranges")
    w = Window.partitionBy("part").orderBy("at")
    new = (~F.col("key").eqNullSafe(F.lag("key").over(w)) | (F.row_number().over(w) == 1)).cast("long")
    local = tagged.withColumn("new", new).withColumn("local", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = local.groupBy("part", "local").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"))
    ends = runs.groupBy("part").agg(F.max("local").alias("runs"), F.min_by("key", "local").alias("first_key"), F.max_by("key", "local").alias("last_key"))
    over = Window.orderBy("part")
    glued = (F.lag("part").over(over).isNotNull() & F.col("first_key").eqNullSafe(F.lag("last_key").over(over))).cast("long")
    ends = ends.withColumn("glued", glued)
    shift = F.coalesce(F.sum("runs").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.sum("glued").over(over.rowsBetween(Window.unboundedPreceding, 0))
    numbered = runs.join(ends.select("part", shift.alias("shift")), "part").withColumn("run", F.col("local") + F.col("shift"))
    return numbered.groupBy("run").agg(F.first("key").alias("key"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"))


def health_summary(audit: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row over an audit file: trajectories, groups of consecutive qids, rates, reward mean and population deviation.

    A group has no variance where its least and greatest reward are equal.
    """
    flat = audit.select("*", F.col("reward.total").alias("__total"))
    whole = flat.agg(F.count("*").alias("trajectories"), rate(truthy(F.col("final_answer"))).alias("answer_rate"), rate((F.size("searches") > 0) & truthy(F.col("final_answer"))).alias("search_to_answer_rate"), rate(F.size("searches") > 0).alias("search_rate"), rate(F.col("is_repeated_query")).alias("repeated_query_rate"), rate(F.col("reward.terminated_with_zero")).alias("zero_termination_rate"), F.avg("__total").alias("reward_mean"), F.stddev_pop("__total").alias("reward_std"), F.avg("num_rounds").alias("average_rounds"))
    groups = run_table(flat, "qid", order, "__total").agg(F.count("*").alias("prompt_groups"), rate(F.col("low") == F.col("high")).alias("zero_reward_std_group_rate"))
    return require_rows(whole.crossJoin(groups))


def require_rows(df: DataFrame) -> DataFrame:
    """Fails on an empty audit file."""
    return df.filter(F.assert_true(F.col("trajectories") > 0, "the audit has no rows").isNull())


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_counts(df: DataFrame, key: str, k: int = 20, order: str | None = None) -> DataFrame:
    """The ``k`` most frequent keys; of equal ones those seen first, or else the smaller."""
    first = F.min(order) if order else F.min(key)
    return df.groupBy(key).agg(F.count("*").alias("n"), first.alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, and per field the whole per cent of rows where it is neither null nor empty."""
    filled = [F.floor(100 * F.sum(F.when(truthy(F.col(c).cast("string")), 1).otherwise(0)) / F.greatest(F.count("*"), F.lit(1))).alias(c) for c in fields]
    return df.agg(F.count("*").alias("n"), *filled)


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows per key and their per cent of all, to one decimal; the groups are counted once."""
    by = counts(df, key)
    total = F.sum("n").over(Window.partitionBy())
    return by.withColumn("share", F.round(100.0 * F.col("n") / total, 1))


def rejection_histogram(rejected: DataFrame) -> DataFrame:
    return counts(rejected, "reason")


def report_metrics(audit: DataFrame, sink: Callable[[dict[str, float]], None] | None = None) -> DataFrame:
    """The batch's metrics; they also go to ``sink`` if there is one and the batch isn't empty."""
    out = reward_metrics(audit)
    if sink is not None and (row := out.first()) is not None:
        sink({k: float(v) for k, v in row.asDict().items() if v is not None})
    return out


def markdown_report(df: DataFrame, title: str, splits: str = "segment") -> str:
    """A statistics report of a fact base; only aggregates come to the driver."""

    def section(name: str, rows: list, head: tuple[str, ...]) -> list[str]:
        return [f"## {name}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(x) for x in r) + " |" for r in rows), ""]

    n = df.count()
    out = [f"# {title}", "", f"- facts: {n:,}", f"- entities: {df.select('entity').distinct().count():,}", ""]
    for key in ("source_type", "value_type", splits):
        if key in df.columns:
            out += section(key, [(r[0], f"{r[1]:,}", f"{r[2]}%") for r in shares(df, key).orderBy(F.desc("n"), key).collect()], (key, "rows", "share"))
    out += section("entities", [(r[0], f"{r[1]:,}") for r in top_counts(df, "entity").collect()], ("entity", "rows"))
    fields = [c for c in ("source_url", "date", "published_at", "industry", "structured") if c in df.columns]
    out += section("completeness", [(c, f"{v}%") for c, v in zip(fields, completeness(df, fields).first()[1:], strict=True)], ("field", "filled"))
    return "\n".join(out)
