"""Queries on sources and sinks: tables written in a form and read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.errors import ConfigError, DatasetError
from tallyloom.operators import audit, facts, validation
from tallyloom.plans.registry import DAY, PRICE, cases, query, table
from tallyloom.sources import jsonl, protocols, snapshot
from tallyloom.sources.protocols import RunConfig
from tallyloom.sources.schemas import REWARD
from tallyloom.sources.scratch import scratch_dir

_CUSTOMER = "c_custkey long, c_name string, c_acctbal double"


def _lines(spark, sf, bad: str, path: str) -> str:
    """Customers as JSON lines in order, where ``bad`` (of the key) is null; else that text as it is."""
    c = table(spark, sf, "customer").select("c_custkey", F.coalesce(F.expr(bad), F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("value"))
    c.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(path)
    return path


@query("""
SELECT c_custkey, c_name, c_acctbal, 'BIGINT' AS kind FROM customer""")
def strict_scan(spark, sf):
    """Whole lines, blank ones between them."""
    path = _lines(spark, sf, "CASE WHEN c_custkey < 0 THEN '' END", f"{scratch_dir(spark)}/a")
    spark.createDataFrame([("  ",), ("",)], "value string").write.mode("append").text(path)
    v = jsonl.read_strict(spark, path)
    get = lambda c, kind: F.try_variant_get("v", f"$.{c}", kind).alias(c)
    return v.select(get("c_custkey", "long"), get("c_name", "string"), get("c_acctbal", "double"), F.schema_of_variant(F.try_variant_get("v", "$.c_custkey", "variant")).alias("kind"))


@query(f"""
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'not an object' END AS error, row_number() OVER (ORDER BY c_custkey) AS line FROM customer WHERE c_custkey % 7 <> 2""")
def numbered_scan(spark, sf):
    """Every line of one file with its number, bad ones with their errors; lines of white space are only counted."""
    c = table(spark, sf, "customer")
    value = F.expr("CASE c_custkey % 7 WHEN 0 THEN '{' || c_custkey WHEN 1 THEN '[' || c_custkey || ']' WHEN 2 THEN NULL ELSE '{\"k\": ' || c_custkey || '}' END")
    path = f"{scratch_dir(spark)}/a"
    c.select("c_custkey", value.alias("value")).filter("value is not null").coalesce(1).sortWithinPartitions("c_custkey").select("value").write.text(path)
    raw = jsonl.numbered_lines(spark.read, path).select("line", F.regexp_extract("value", r"(\d+)", 1).cast("long").alias("c_custkey"))
    return jsonl.read_variant(spark, path).join(raw, "line").select("c_custkey", "error", "line")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 > 1")
def lenient_scan(spark, sf):
    path = _lines(spark, sf, "CASE c_custkey % 10 WHEN 0 THEN '{\"c_custkey\": ' WHEN 1 THEN 'nonsense' END", f"{scratch_dir(spark)}/a")
    return jsonl.read_lenient(spark, path, _CUSTOMER).unionByName(jsonl.read_lenient(spark, f"{path}-missing", _CUSTOMER))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def fail_fast_scan(spark, sf):
    return jsonl.read_fail_fast(spark, _lines(spark, sf, "CAST(NULL AS STRING)", f"{scratch_dir(spark)}/a"), _CUSTOMER)


@query("""
SELECT 'good' AS kind, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT 'bad', count(*), NULL FROM customer WHERE c_custkey % 10 = 0""")
def quarantine_scan(spark, sf):
    good, bad = jsonl.read_quarantine(spark, _lines(spark, sf, "CASE WHEN c_custkey % 10 = 0 THEN '{\"c_custkey\": \"x\", }' END", f"{scratch_dir(spark)}/a"), _CUSTOMER)
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum("c_custkey").alias("total")).unionByName(bad.agg(F.lit("bad").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("long").alias("total")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'invalid JSON' END AS error FROM customer WHERE c_custkey % 9 > 0 UNION ALL SELECT NULL, 'invalid JSON' FROM customer WHERE c_custkey % 9 = 0")
def recursive_scan(spark, sf):
    base = scratch_dir(spark)
    c = table(spark, sf, "customer").select(F.coalesce(F.expr("CASE WHEN c_custkey % 9 = 0 THEN '{' END"), F.to_json(F.struct("c_custkey"))).alias("value"), F.expr("c_custkey % 3").alias("k"))
    for k in range(3):  # three folders deep and wide, and one file that isn't looked at
        _as_jsonl(spark, c.filter(F.col("k") == k).select("value"), f"{base}/{k}/deep" if k else base, f"part{k}.jsonl")
    _as_jsonl(spark, c.select("value"), base, "other.txt")
    return jsonl.read_variant(spark, base, recursive=True).select(F.try_variant_get("v", "$.c_custkey", "long").alias("c_custkey"), "error")


def _as_jsonl(spark, df, folder: str, name: str) -> None:
    """One text file of a wanted name."""
    temporary = f"{folder}/_{name}"
    df.coalesce(1).write.text(temporary)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(p.getPath() for p in fs.listStatus(hadoop.Path(temporary)) if p.getPath().getName().startswith("part-"))
    fs.rename(part, hadoop.Path(f"{folder}/{name}"))
    fs.delete(hadoop.Path(temporary), True)


@query("""
SELECT event_type AS qid, count(*) AS n, round(sum(value), 2) AS total, count(*) FILTER (user_id % 2 = 0) AS answered FROM events GROUP BY event_type""")
def audit_scan(spark, sf):
    e = table(spark, sf, "events")
    path = f"{scratch_dir(spark)}/a"
    names = ["answer_correctness", "answer_cem", "format_compliance", "search_incentive", "retrieval_correctness", "total"]
    reward = F.struct(*[F.col("value").alias(n) for n in names], F.lit(False).alias("terminated_with_zero"))
    rows = e.select(F.col("event_type").alias("qid"), F.when(F.col("user_id") % 2 == 0, "a").alias("final_answer"), reward.alias("reward"))
    half = F.crc32(F.col("qid").cast("binary")) % 2 == 0
    jsonl.write(rows.filter(half), path, "append")
    jsonl.write(rows.filter(~half), path, "append")
    back = jsonl.read_audit(spark, path, f"qid string, final_answer string, reward {REWARD}")
    return back.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("reward.total"), 2).alias("total"), F.count("final_answer").alias("answered"))


@query("""
SELECT n_nationkey, n_name, k AS copies, true AS refused FROM nation, (VALUES (1), (2)) t(k)""")
def sink_modes(spark, sf):
    """Overwritten, appended, and a new file that isn't overwritten."""
    n, base = table(spark, sf, "nation").select("n_nationkey", "n_name"), scratch_dir(spark)
    jsonl.write(n.limit(1), f"{base}/a")
    jsonl.write(n.withColumn("copies", F.lit(1)), f"{base}/a")
    jsonl.write(n.withColumn("copies", F.lit(2)), f"{base}/a", "append")
    refused = False
    try:
        jsonl.write(n, f"{base}/a", "errorifexists")
    except Exception as e:
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return jsonl.read_fail_fast(spark, f"{base}/a", "n_nationkey int, n_name string, copies int").withColumn("refused", F.lit(refused))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'rejected' END AS path, CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split, true AS refused FROM orders""")
def decided_sink(spark, sf):
    base = scratch_dir(spark)
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'reject' END AS decision", "CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'test' END AS split")
    jsonl.write_decided(o, f"{base}/accepted", f"{base}/rejected")
    refused = False
    try:
        jsonl.write_decided(o, f"{base}/x", f"{base}/x")
    except DatasetError:
        refused = True
    read = lambda p: jsonl.read_fail_fast(spark, f"{base}/{p}", "o_orderkey long, split string").withColumn("path", F.lit(p))
    jsonl.write_splits(read("accepted").unionByName(read("rejected")), f"{base}/splits")
    parts = [jsonl.read_fail_fast(spark, f"{base}/splits/split={s}", "o_orderkey long, path string").withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).withColumn("refused", F.lit(refused))


@query("""
SELECT vec_id::VARCHAR AS fact_id, 'e' || label AS entity, label::DOUBLE AS value_number, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 3) > 0 AS some, true AS unit_length, 64 AS dim, 'company' AS entity_type FROM embeddings""")
def snapshot_records(spark, sf):
    path = f"{scratch_dir(spark)}/s"
    e = table(spark, sf, "embeddings").selectExpr("CAST(vec_id AS STRING) AS fact_id", "'x' AS fact", "'d' AS source_doc", "'s' AS source_type", "'i' AS document_id", "'p' AS published_at", "'r' AS retrieved_at", "'h' AS raw_content_hash", "'e' || label AS entity", "'m' AS metric", "'v' AS value_text", "'amount' AS value_type", "CAST(label AS DOUBLE) AS value_number", "true AS structured", "embedding")
    snapshot.write_snapshot(e, path, model="m")
    back = snapshot.load_records(spark, path, model="m")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return back.select("fact_id", "entity", "value_number", (length > 0).alias("some"), (F.abs(length - 1) < 1e-3).alias("unit_length"), F.size("embedding").alias("dim"), "entity_type")


@query(f"""
SELECT CAST(o_orderkey AS STRING) AS document_id, 'c' || o_custkey || {DAY} || 'm为' || {cases("o_orderkey", f"{PRICE} || '亿'", "'12%'", f"{PRICE}")} || '。' AS fact, CASE WHEN o_orderkey % 5 = 0 THEN 'blank_published_at' END AS error, {cases("o_orderkey", "o_totalprice::DECIMAL(18,2)::DOUBLE", "12", "o_totalprice::DECIMAL(18,2)::DOUBLE")} AS value_number FROM orders""")
def built_records(spark, sf):
    """Facts as the engine builds them are records as it validates them, but for those without a publication date."""
    value = cases("o_orderkey", f"{PRICE} || '亿'", "'12%'", PRICE)
    o = table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS document_id", "'c' || o_custkey AS entity", "'m' AS metric", f"{value} AS raw_value", "'d' AS source_doc", "'' AS source_url", "'orders' AS source_type", f"{DAY} AS date", f"CASE WHEN o_orderkey % 5 > 0 THEN {DAY} ELSE '' END AS published_at")
    f = facts.build_facts(o)
    parsed = validation.parse_records(f.select(F.try_parse_json(F.to_json(F.struct("*"))).alias("v")))
    return parsed.select("document_id", "fact", "error", "value_number")


@query("""
SELECT 'answer_rate' AS name, round(avg((user_id % 3 > 0)::INT), 9) AS value FROM events UNION ALL SELECT 'total_mean', round(avg(value / 100), 9) FROM events UNION ALL SELECT 'count', count(*) FROM events""")
def metric_sink(spark, sf):
    """What a metrics callback gets; an empty batch sends nothing, and without a callback nothing is sent."""
    from tallyloom.plans.catalogue import _events_as_audit

    got: dict[str, float] = {}
    batch = _events_as_audit(spark, sf)
    audit.report_metrics(batch)
    audit.report_metrics(batch, got.update)
    audit.report_metrics(batch.limit(0), lambda _: got.clear())
    return spark.createDataFrame([(k, round(got[k], 9)) for k in ("answer_rate", "total_mean", "count")], "name string, value double")


@query("""
SELECT i, CASE WHEN i % 2 = 1 THEN 'batch_size must be a multiple of num_generations|' ELSE '' END || CASE WHEN i % 3 = 1 THEN 'max_steps must be at least 1|' ELSE '' END || CASE WHEN i % 3 <> 2 AND i % 5 = 0 THEN 'generation by an engine takes max_steps 1|' ELSE '' END AS errors, CASE i % 3 WHEN 0 THEN 'kb' WHEN 1 THEN 'tool_aware' ELSE 'refused' END AS adapter, 25 AS rounds FROM range(30) r(i)""")
def config_rules(spark, sf):
    """Run configurations and adapter names: what is checked before a run, on the driver."""
    adapters = {"kb": lambda: "kb", "tool_aware": lambda: "tool_aware"}
    rows = []
    for i in range(30):
        config = RunConfig(num_generations=4, batch_size=8 + i % 2, max_steps=(2, 0, 1)[i % 3], use_vllm=i % 5 == 0)
        try:
            adapter = protocols.choose(("kb", "tool_aware", "other")[i % 3], adapters)()
        except ConfigError:
            adapter = "refused"
        rows.append((i, "".join(f"{x}|" for x in validation.config_errors(vars(config))), adapter, config.max_rounds))
    return spark.createDataFrame(rows, "i long, errors string, adapter string, rounds int")


class Upper:
    """Stands for an outside text function: some calls fail."""

    def __call__(self, texts: list[str]) -> list[str]:
        if any("7" in x for x in texts):
            raise OSError("busy")
        return [x.upper() for x in texts]


@query("""
SELECT c_custkey, CASE WHEN contains(c_custkey::VARCHAR, '7') THEN NULL ELSE 'K' || c_custkey END AS answer, CASE WHEN contains(c_custkey::VARCHAR, '7') THEN 'OSError: busy' END AS answer_error FROM customer""")
def outside_function(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "'k' || c_custkey AS asked")
    return protocols.apply_text(c, "asked", "answer", Upper).drop("asked")
