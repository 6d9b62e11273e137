"""Two-hop questions from pairs of facts: candidates, templates, numbering, acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import trim, truthy
from tallyloom.functions.values import answer_targets
from tallyloom.operators.validation import eligible_fact
from tallyloom.sources.scratch import scratch_dir, written

REQUIRED = ("entity", "metric", "date", "value_text")


def pair_facts(facts: DataFrame, per_root: int | None = None, order: str = "fact_id", target_first: str = "date") -> DataFrame:
    """(root, target): eligible facts of one entity and metric with different dates and values.

    ``per_root`` keeps each root's first targets by date.  A group's roots then meet few of its facts, which hold every
    root's first targets (see :func:`first_targets`); without it the result itself has all pairs.
    """
    own = facts.filter(eligible_fact())
    names = own.columns
    targets = own if per_root is None else first_targets(own, per_root, order, target_first)
    left, right = own.select(F.struct(*names).alias("root")), targets.select(F.struct(*names).alias("target"))
    same = (F.col("root.entity") == F.col("target.entity")) & (F.col("root.metric") == F.col("target.metric"))
    differ = (F.col(f"root.{order}") != F.col(f"target.{order}")) & (F.col("root.date") != F.col("target.date")) & (trim(F.col("root.value_text")) != trim(F.col("target.value_text")))
    pairs = left.join(right, same & differ)
    if per_root is None:
        return pairs
    w = Window.partitionBy(F.col(f"root.{order}")).orderBy(F.col(f"target.{target_first}"), F.col(f"target.{order}"))
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_root)


def first_targets(own: DataFrame, k: int, order: str, target_first: str) -> DataFrame:
    """Facts among which every fact of their entity and metric has its first ``k`` targets.

    A root takes no target of its date or its value.  So a fact with k before it of its date and value is never needed; nor is
    one with k (k + 1) of those before it of its date, as their values are more than k, or of its value.  Of what is left a root
    passes over at most k (k + 1) for its date and as many for its value.  Each limit is also applied before its exchange.
    """
    columns, group = own.columns, ["entity", "metric"]
    out = own.withColumn("__value", trim(F.col("value_text")))
    for keys, n in (([*group, "date", "__value"], k), ([*group, "date"], k * (k + 1)), ([*group, "__value"], k * (k + 1)), (group, k + 2 * k * (k + 1))):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(target_first, order))
        out = out.withColumn("__nth", nth).filter(F.col("__nth") <= n)
    return out.select(*columns)


def target_counts(facts: DataFrame) -> DataFrame:
    """Eligible facts with ``targets``, the number of facts that :func:`pair_facts` pairs them with.

    All of the group, less those of the same date, less those of the same value, and again those of both, from sums.
    """
    own = facts.filter(eligible_fact()).withColumn("__value", trim(F.col("value_text")))
    keys = ["entity", "metric", "date", "__value"]
    cells = own.groupBy(*keys).agg(F.count("*").alias("__both"))
    sums = cells
    for name, by in (("__all", keys[:2]), ("__dates", keys[:3]), ("__values", [*keys[:2], keys[3]])):
        sums = sums.join(cells.groupBy(*by).agg(F.sum("__both").alias(name)), by)
    counted = sums.select(*keys, (F.col("__all") - F.col("__dates") - F.col("__values") + F.col("__both")).alias("targets"))
    return own.join(counted, keys).drop("__value")


def lookup_question(root: Column, target: Column) -> Column:
    """The question that names the root's date, metric and value and asks for the target's; null if it can't be asked."""
    fine = (root["entity"] == target["entity"]) & (root["metric"] == target["metric"]) & (root["date"] != target["date"]) & (trim(root["value_text"]) != trim(target["value_text"]))
    for r in (root, target):
        for c in REQUIRED:
            fine = fine & truthy(trim(r[c]))
    text = F.concat(F.lit("某家上市公司在"), root["date"], F.lit("披露的"), root["metric"], F.lit("为"), root["value_text"], F.lit("；请问该公司在"), target["date"], F.lit("的"), target["metric"], F.lit("具体是多少？"))
    return F.when(fine, text)


def template_error(root: Column, target: Column) -> Column:
    """A short code for why no question can be asked, null if one can."""
    blank = lambda r: F.exists(F.array(*[r[c] for c in REQUIRED]), lambda x: ~truthy(trim(x)))
    return (
        F.when(blank(root), "root_incomplete")
        .when(blank(target), "target_incomplete")
        .when((root["entity"] != target["entity"]) | (root["metric"] != target["metric"]), "other_entity_or_metric")
        .when(root["date"] == target["date"], "equal_dates")
        .when(trim(root["value_text"]) == trim(target["value_text"]), "equal_values")
    )


def render_candidates(candidates: Column) -> Column:
    """A numbered list of facts with their ids."""
    return F.array_join(F.transform(candidates, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". ["), r["fact_id"], F.lit("] "), r["fact"])), "\n")


def render_facts(involved: Column) -> Column:
    """struct(facts, final_fact): a line per fact of a chain, for an audit, and the last one; null without facts.

    Missing fields are empty.
    """
    cell = lambda r, c: F.coalesce(r[c], F.lit(""))
    line = lambda r: F.concat(F.lit("- ["), cell(r, "fact_id"), F.lit("] "), cell(r, "entity"), cell(r, "date"), F.lit("的"), cell(r, "metric"), F.lit("为"), cell(r, "value_text"))
    lines = F.transform(involved, line)
    return F.when(F.coalesce(F.size(involved), F.lit(0)) > 0, F.struct(F.array_join(lines, "\n").alias("facts"), F.try_element_at(lines, F.lit(-1)).alias("final_fact")))


def primary_target(targets: Column) -> Column:
    """The first accepted answer; null where there is none."""
    return F.try_element_at(targets, F.lit(1))


def training_row(qid: Column, prompt: Column, root: Column, involved: Column, actions: Column, source: str, question_policy: str | None = None) -> Column:
    """The public row: prompt, accepted answers of the last fact, source, qid, and what an audit needs."""
    last = F.element_at(involved, -1)
    brief = F.transform(involved, lambda r: F.struct(*[F.coalesce(r[c], F.lit("")).alias(c) for c in ("fact_id", "entity", "metric", "date", "value_text")]))
    truth = F.struct(answer_targets(last["value_text"], last["value_number"], last["unit"]).alias("target"), F.lit(True).alias("valid_inst"))
    meta = [root["entity"].alias("root_entity"), F.size(involved).alias("hop_count"), actions.alias("actions"), last["fact_id"].alias("target_fact_id"), F.lit("final_record_value").alias("target_policy")]
    meta += [F.lit(question_policy).alias("question_policy")] if question_policy else []
    return F.struct(trim(prompt).alias("prompt"), truth.alias("ground_truth"), F.lit(source).alias("source"), qid.alias("qid"), F.struct(*meta, brief.alias("involved_records")).alias("meta"))


def rejection(attempt: Column, reason: Column, detail: Column, root: Column) -> Column:
    """The row of an attempt that failed."""
    brief = F.struct(*[root[c].alias(c) for c in ("fact_id", "entity", "metric", "date")])
    return F.struct(attempt.alias("attempt"), reason.alias("reason"), detail.alias("detail"), brief.alias("root_record"))


def number_rows(df: DataFrame, order: list[str], column: str = "qid", form: str = "ft_%05d") -> DataFrame:
    """Rows numbered from 1 over a total order.

    Ranges of the order are written with their places and shifted by what stands before, so no task holds all rows.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    parts = written(parts, f"{scratch_dir(df.sparkSession)}/ranges")
    parts = parts.withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id") - F.shiftleft(F.col("__part"), 33))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return parts.join(before, "__part").withColumn(column, F.format_string(form, F.col("__before") + F.col("__at") + 1)).drop("__id", "__part", "__at", "__before")


def round_robin_roots(facts: DataFrame, attempts: int, seed: int = 0, entity: str = "entity", id_col: str = "fact_id") -> DataFrame:
    """(attempt, entity, root_id): attempt i takes entity i modulo their number in a seeded order, and its next fact.

    An entity's facts are in a seeded order of their own and come round again when all are used; only as many of
    them are ranked as there are rounds.
    """
    seeded = lambda c: F.sha2(F.concat(F.col(c).cast("string"), F.lit(f":{seed}")), 256)
    names = facts.groupBy(entity).agg(F.count("*").alias("facts"))
    names = names.withColumn("slot", F.row_number().over(Window.orderBy(seeded(entity), entity)) - 1)  # one row per entity
    n = max(1, names.count())
    tries = facts.sparkSession.range(attempts).select(F.col("id").alias("attempt"), (F.col("id") % n).alias("slot"), F.floor(F.col("id") / n).alias("round"))
    tries = tries.join(names, "slot").select("attempt", entity, (F.col("round") % F.col("facts") + 1).alias("place"))
    place = F.row_number().over(Window.partitionBy(entity).orderBy(seeded(id_col), id_col))
    ranked = facts.select(entity, F.col(id_col).alias("root_id"), place.alias("place")).filter(F.col("place") <= -(-attempts // n))
    return tries.join(ranked, [entity, "place"]).select("attempt", entity, "root_id")
