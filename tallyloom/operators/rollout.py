"""Replay of multi-turn rollouts from recorded turns: what the state machine would have done, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.traces import final_answer, has_repeat, parse_turn, queries_of, tag_contents

# How a rollout ends.
TERMINATIONS = ("answer", "repeated_query", "malformed_action", "max_rounds", "generation_error", "retrieval_error")


def replay_turns(turns: DataFrame, max_rounds: int = 25, key: str = "rollout_id", order: str = "turn", text: str = "text", observation: str | None = "observation") -> DataFrame:
    """One row per rollout of its turns: termination, completed, answer, rounds, steps, segments.

    A turn that isn't one think and one action ends the rollout as malformed, an answer as answered, a query that
    occurred before in any case as repeated; turns after the end, or after ``max_rounds``, don't count.  A rollout's
    turns are bounded by ``max_rounds``, so its lists are short.
    """
    w = Window.partitionBy(key).orderBy(order)
    parsed = turns.withColumn("p", parse_turn(F.col(text))).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= max_rounds)
    query = F.when(F.col("p.kind") == "search", F.lower("p.content"))
    again = query.isNotNull() & (F.row_number().over(Window.partitionBy(key, query).orderBy(order)) > 1)
    parsed = parsed.withColumn("again", again)
    ends = F.when(~F.col("p.valid"), "malformed_action").when(F.col("p.kind") == "answer", "answer").when(F.col("again"), "repeated_query")
    parsed = parsed.withColumn("ends", ends)
    before = F.sum(F.col("ends").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    live = parsed.withColumn("dead", F.coalesce(before, F.lit(0))).filter("dead = 0")
    seen = F.col(observation) if observation and observation in turns.columns else F.lit(None).cast("string")
    stepped = (F.col("p.kind") == "search") & F.col("ends").isNull()
    row = F.struct(F.col("nth"), F.col(text).alias("text"), F.col("p.content").alias("query"), seen.alias("observation"), stepped.alias("step"))
    one = live.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("turns"), F.max("ends").alias("ends"), F.max(F.when(F.col("ends") == "answer", F.col("p.content"))).alias("final_answer"), F.max("nth").alias("num_rounds"))
    steps = F.transform(F.filter("turns", lambda t: t["step"]), lambda t: F.struct(t["query"].alias("query"), t["observation"].alias("retrieved_text")))
    part = lambda owner, x: F.struct(F.lit(owner).alias("owner"), x.alias("text"))
    segments = F.flatten(F.transform("turns", lambda t: F.when(t["step"] & t["observation"].isNotNull(), F.array(part("assistant", t["text"]), part("environment", t["observation"]))).otherwise(F.array(part("assistant", t["text"])))))
    out = one.select(key, F.coalesce("ends", F.lit("max_rounds")).alias("termination"), "final_answer", "num_rounds", steps.alias("search_steps"), segments.alias("segments"))
    return out.withColumn("completed", F.col("termination") == "answer").withColumn("is_repeated_query", F.col("termination") == "repeated_query")


def environment_characters(segments: Column) -> Column:
    """How many characters of a trace the environment wrote."""
    return F.aggregate(F.filter(segments, lambda s: s["owner"] != "assistant"), F.lit(0), lambda n, s: n + F.length(s["text"]))


def trajectories(df: DataFrame, trace: str = "raw_text", results: str = "tool_results") -> DataFrame:
    """Trajectory columns from raw traces and the texts that their searches returned."""
    queries = queries_of(F.col(trace))
    # An array named in a lambda is computed again for each element, so results go beside the queries.
    found = F.slice(F.coalesce(F.col(results), F.array().cast("array<string>")), F.lit(1), F.greatest(F.size(queries), F.lit(0)))
    steps = F.zip_with(queries, found, lambda q, r: F.struct(q.alias("query"), F.coalesce(r, F.lit("")).alias("retrieved_text"), F.array().cast("array<struct<value_text:string,fact:string,unit:string>>").alias("retrieved_records")))
    return df.withColumn("search_steps", steps).withColumn("final_answer", final_answer(F.col(trace), "keep_blank")).withColumn("num_rounds", F.size(tag_contents(F.col(trace), "search"))).withColumn("tool_calls_in_single_round", F.lit(1)).withColumn("is_repeated_query", has_repeat(queries))


def with_metadata(completions: DataFrame, prompts: DataFrame, key: str = "prompt") -> DataFrame:
    """Completions with their prompt's metadata; one whose prompt is unknown is an error."""
    meta = prompts.dropDuplicates([key]).withColumn("__known", F.lit(True))
    joined = completions.join(meta, key, "left")
    return joined.filter(F.assert_true(F.col("__known").isNotNull(), "a completion has no prompt metadata").isNull()).drop("__known")
