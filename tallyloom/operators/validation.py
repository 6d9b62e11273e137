"""Row validation with quarantine: rows are never lost, they get the reason why they were turned away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import affirmative, trim, truthy
from tallyloom.functions.values import finite

# Fields and kinds of a fact, rules on questions whose target is the last record's value.
FACT_FIELDS = ("fact_id", "fact", "entity", "source_type")
RECORD_FIELDS = ("fact_id", "fact", "source_doc", "source_type", "document_id", "published_at", "retrieved_at", "raw_content_hash", "entity", "metric", "value_text", "value_type")
VERDICT_CHARACTERS = 240
VALUE_TYPES = ("amount", "percentage", "ratio", "rank", "entity", "text")
DERIVED = (
    r"多少个?百分点",
    r"相差多少",
    r"两者.*(?:差值|之差)",
    r"(?:高出|低了|增加了|减少了|提升了|下降了|降低了)多少",
    r"(?:增长|提升|下降|变化).*(?:幅度|倍数)",
    r"变动幅度",
    r"累计变化",
    r"多少倍",
    r"(?:比例|占比).*(?:多少|约为)",
)
OTHER_ENTITY = (r"另一(?:家)?(?:公司|银行|企业|券商|机构)", r"其他(?:公司|银行|企业|券商|机构)")
EQUALITY = (
    r"(?:数值|指标|增速|比例).*?(?<!不)(?:相同|一致|相等)",
    r"恰好与.*?(?<!不)(?:相同|一致|相等)",
    r"(?<!不)(?:相同|一致|相等).*(?:数值|指标|增速|比例)",
)


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with theirs in ``reason``)."""
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def fact_issues() -> Column:
    """All that is wrong with a fact: missing fields, and amounts or percentages without a number."""
    missing = [F.when(~truthy(F.col(c)), f"missing_{c}") for c in FACT_FIELDS]
    number = F.when(F.col("value_type").isin("amount", "percentage") & F.col("value_number").isNull(), "missing_value_number")
    return F.array_compact(F.array(*missing, number))


def validate_facts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts without issues, the others with ``issues``)."""
    marked = df.withColumn("issues", fact_issues())
    return marked.filter(F.size("issues") == 0).drop("issues"), marked.filter(F.size("issues") > 0)


def issue_counts(rejected: DataFrame) -> DataFrame:
    """How often each issue occurs."""
    return rejected.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def _kind(v: str, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def _text(v: str, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "string")


def _first(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), why) for bad, why in rules])


def parse_records(df: DataFrame, v: str = "v") -> DataFrame:
    """Canonical knowledge records of a VARIANT column, with the first ``error`` of those that aren't valid.

    Types are those of the JSON: a number where a text should be is an error, not a text.  A missing entity type is
    company, a missing period is the date; a null one is missing, never the text of a null.
    """
    kind, text = (lambda p: _kind(v, p)), (lambda p: _text(v, p))
    numeric = lambda p: F.coalesce(kind(p).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"), F.lit(False))
    absent = lambda p: kind(p).isNull() | (kind(p) == "VOID")
    rules = [(F.coalesce(kind(c) != "STRING", F.lit(True)) | (trim(text(c)) == ""), f"blank_{c}") for c in RECORD_FIELDS]
    url, number = text("source_url"), F.when(numeric("value_number"), F.try_variant_get(v, "$.value_number", "double"))
    related = F.try_variant_get(v, "$.related_entities", "array<string>")
    rules += [
        (truthy(url) & ~url.rlike("^https?://"), "bad_source_url"),
        (~text("value_type").isin(*VALUE_TYPES), "unknown_value_type"),
        (~absent("value_number") & ~numeric("value_number"), "bad_value_number"),
        (text("value_type").isin("amount", "percentage") & absent("value_number"), "missing_value_number"),
        (kind("related_entities").isNotNull() & (~F.startswith(kind("related_entities"), F.lit("ARRAY")) | kind("related_entities").rlike("BIGINT|BOOLEAN|OBJECT|DOUBLE|DECIMAL|VARIANT") | F.exists(related, lambda x: F.coalesce(trim(x) == "", F.lit(True)))), "bad_related_entities"),
        (kind("structured").isNotNull() & (kind("structured") != "BOOLEAN"), "bad_structured"),
        *[(~absent(c) & (kind(c) != "STRING"), f"bad_{c}") for c in ("unit", "currency", "scale", "industry")],
    ]
    date = F.coalesce(text("period"), text("date"), F.lit(""))
    columns = [trim(text(c)).alias(c) for c in RECORD_FIELDS]
    columns += [trim(text(c)).alias(c) for c in ("unit", "currency", "scale", "industry")]
    columns += [trim(F.coalesce(url, F.lit(""))).alias("source_url"), F.coalesce(F.nullif(trim(F.coalesce(text("entity_type"), F.lit("company"))), F.lit("")), F.lit("company")).alias("entity_type"), trim(date).alias("period"), number.alias("value_number"), F.transform(F.coalesce(related, F.array().cast("array<string>")), trim).alias("related_entities"), F.coalesce(F.try_variant_get(v, "$.structured", "boolean"), F.lit(True)).alias("structured")]
    keep = [c for c in df.columns if c != v]
    return df.select(*keep, *columns, _first(*rules).alias("error"))


def parse_samples(df: DataFrame, v: str = "v") -> DataFrame:
    """Question samples (qid, prompt, targets, source, valid_inst) of a VARIANT column, with the first ``error``.

    A null source is a source, a missing one is an error.
    """
    kind, text = (lambda p: _kind(v, p)), (lambda p: _text(v, p))
    target = F.try_variant_get(v, "$.ground_truth.target", "array<string>")
    listed = F.coalesce(F.startswith(kind("ground_truth.target"), F.lit("ARRAY<STRING")), F.lit(False))
    valid = F.try_variant_get(v, "$.ground_truth.valid_inst", "boolean")
    rules = [(F.coalesce(kind(c) != "STRING", F.lit(True)) | (trim(text(c)) == ""), f"blank_{c}") for c in ("qid", "prompt")]
    rules += [
        (kind("source").isNull(), "missing_source"),
        (~listed | (F.size(target) == 0) | F.exists(target, lambda x: F.coalesce(trim(x) == "", F.lit(True))), "bad_target"),
        (kind("ground_truth.valid_inst").isNotNull() & (kind("ground_truth.valid_inst") != "BOOLEAN"), "bad_valid_inst"),
    ]
    keep = [c for c in df.columns if c != v]
    return df.select(*keep, trim(text("qid")).alias("qid"), trim(text("prompt")).alias("prompt"), F.transform(target, trim).alias("targets"), F.try_variant_get(v, "$.source", "variant").alias("source"), F.coalesce(valid, F.lit(True)).alias("valid_inst"), _first(*rules).alias("error"))


def dataset_gate(samples: DataFrame) -> DataFrame:
    """One row: rows, distinct qids and prompts, answerable and unanswerable ones, and whether the set may be used."""
    out = samples.agg(F.count("*").alias("n"), F.count_distinct("qid").alias("qids"), F.count_distinct("prompt").alias("prompts"), F.coalesce(F.sum(F.col("valid_inst").cast("long")), F.lit(0)).alias("answerable"))
    return out.withColumn("unanswerable", F.col("n") - F.col("answerable")).withColumn("ok", (F.col("n") > 0) & (F.col("n") == F.col("qids"))).withColumn("trainable", F.col("ok") & (F.col("n") == F.col("prompts")))


def require(df: DataFrame, ok: str, message: str) -> DataFrame:
    """The same rows; the query fails if ``ok`` is false in any."""
    return df.filter(F.assert_true(F.col(ok), message).isNull())


def config_errors(config: dict) -> list[str]:
    """What is wrong with a training configuration."""
    out = []
    if config.get("num_generations", 1) < 1 or config.get("batch_size", 0) % max(1, config.get("num_generations", 1)):
        out.append("batch_size must be a multiple of num_generations")
    if config.get("max_steps", 1) < 1:
        out.append("max_steps must be at least 1")
    if config.get("use_vllm") and config.get("max_steps", 1) != 1:
        out.append("generation by an engine takes max_steps 1")
    if config.get("trace_path") and config.get("trace_exists") and not config.get("append_trace"):
        out.append("the trace file exists; append_trace is needed")
    return out


def alignment_reason(prompt: Column, has_meta: Column, records: Column, target_fact_id: Column, derived=DERIVED, other_entity=OTHER_ENTITY, equality=EQUALITY) -> Column:
    """Why a question doesn't fit a target that is its last record's value; the first rule that applies, else null."""
    hit = lambda patterns: F.array_compact(F.array(*[F.when(prompt.rlike(p), F.lit(p)) for p in patterns]))
    some = lambda patterns: F.size(hit(patterns)) > 0
    entities = F.array_distinct(F.filter(F.transform(records, lambda r: trim(F.coalesce(r["entity"], F.lit("")))), lambda e: e != ""))
    values = F.array_distinct(F.transform(records, lambda r: F.coalesce(r["value_text"], F.lit(""))))
    return (
        F.when(~F.coalesce(has_meta, F.lit(False)), "missing_target_alignment_metadata")
        .when(F.coalesce(F.size(records), F.lit(0)) < 2, F.lit(None))
        .when(~truthy(target_fact_id), "legacy_target_alignment_unverifiable")
        .when(some(other_entity) & (F.size(entities) < 2), "multi_entity_claim_unsupported_by_involved_records")
        .when(some(equality) & (F.size(values) > 1), "equality_claim_conflicts_with_involved_values")
        .when(some(derived), "derived_question_with_scalar_final_record_target")
    )


def matched_patterns(text: Column, patterns) -> Column:
    """Those of the patterns that occur in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(p)) for p in patterns]))


def without_findings(df: DataFrame, findings: DataFrame, key: str = "qid") -> DataFrame:
    """Rows whose key, as a text, no finding has."""
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    found = findings.select(as_text(F.col(key)).alias("__found")).distinct()
    return df.join(found, as_text(F.col(key)) == F.col("__found"), "left_anti")


def audit_relations(df: DataFrame, reason: Column, verdict: Column, failure: Column | None = None) -> DataFrame:
    """``decision`` and ``finding`` (reason, detail, verdict; null for rows that are kept): rules first, then a model's verdict.

    A verdict is a model's reply; one that doesn't begin with yes rejects, and so does a missing one (``failure`` says why).
    """
    why = F.coalesce(failure, F.lit("no verdict")) if failure is not None else F.lit("no verdict")
    missing = verdict.isNull() if failure is None else verdict.isNull() | failure.isNotNull()
    text = F.lit(None).cast("string")
    finding = lambda r, detail, said: F.struct(r.alias("reason"), detail.alias("detail"), said.alias("verdict"))
    found = F.when(reason.isNotNull(), finding(reason, text, text)).when(missing, finding(F.lit("relation_grounding_unverified"), why, text)).when(~affirmative(verdict), finding(F.lit("relation_grounding_failed"), text, F.substring(verdict, 1, VERDICT_CHARACTERS)))
    return df.withColumn("finding", found).withColumn("decision", F.when(F.col("finding").isNull(), "keep").otherwise("reject"))


def eligible_fact() -> Column:
    """Facts that may enter a reasoning chain: identified, structured, dated, with a finite number."""
    named = truthy(F.col("fact_id")) & truthy(F.col("entity")) & truthy(F.col("metric")) & truthy(F.col("value_text"))
    return named & F.col("structured").eqNullSafe(F.lit(True)) & truthy(trim(F.col("date"))) & F.coalesce(finite(F.col("value_number")), F.lit(False))
