"""All queries over the standard tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import keys, rewards, text, traces, values
from tallyloom.operators import audit, dedup, dimensions, facts, retrieval, synthesis, validation
from tallyloom.plans import fact_queries, registry, source_queries, trace_queries  # noqa: F401

_LABELS: dict[str, str] = {"split": "kb-v1", "labels": "labels-v1"}
_query, _t = registry.query, registry.table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as facts: a customer's amounts by priority and day."""
    o = _t(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").cast("string").alias("fact_id"), F.concat(F.lit("c"), "o_custkey").alias("entity"), F.col("o_orderpriority").alias("metric"), day.alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value_text"), F.col("o_totalprice").alias("value_number"), F.lit("").alias("unit"), F.lit(True).alias("structured"),
        F.concat(F.lit("c"), "o_custkey", F.lit(" "), day).alias("fact"), F.col("o_orderstatus").alias("source_type"), F.lit("amount").alias("value_type"), F.col("o_orderkey").alias("ordinal"),
    )


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation with the one after it, wrapped into a tagged trace."""
    c = _t(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = c.join(nxt, ["conv_id", "turn"])
    trace = F.concat(F.lit("<think>"), F.col("role"), F.lit("</think><search>"), F.col("text"), F.lit("</search><answer>"), F.col("reply"), F.lit("</answer>"))
    return pairs.select("conv_id", "turn", "text", "reply", trace.alias("trace"))


@_query("""
SELECT s AS segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share
FROM (SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS s
      FROM (SELECT (('0x' || substr(sha256(p_brand || '|' || p_type || '|kb-v1'), 1, 8))::UBIGINT % 100)::INT AS b FROM part))
GROUP BY s""")
def stable_split(spark, sf):
    p = _t(spark, sf, "part").withColumn("segment", keys.fact_split(F.col("p_brand"), F.col("p_type"), _LABELS["split"]))
    return audit.shares(p, "segment")


@_query("""
SELECT item_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT item_id, (('0x' || substr(sha256('labels-v1:' || item_id), 1, 8))::UBIGINT % 100)::INT AS b FROM benchmark)""")
def label_split(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", keys.label_split(F.col("item_id").cast("string"), _LABELS["labels"]).alias("split"))


@_query("""
SELECT arg_max(doc_id, struct_pack(n := length(text), d := -doc_id)) AS doc_id, min(doc_id) AS position, '["' || lang || '","' || source || '","","' || sha256(text) || '",""]' AS key FROM documents GROUP BY lang, source, sha256(text)""")
def semantic_dedup(spark, sf):
    d = _t(spark, sf, "documents").withColumn("key", keys.dedup_key(F.col("lang"), F.col("source"), F.lit(""), F.sha2("text", 256), F.lit(""), F.col("text")))
    return dedup.keep_longest(d, F.col("key"), "text", ["doc_id"], ["doc_id", "key"]).select("doc_id", F.col("position.doc_id").alias("position"), "key")


@_query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, text")
def exact_fact_dedup(spark, sf):
    return dedup.keep_first(_t(spark, sf, "documents"), ["source", F.sha2("text", 256)], ["doc_id"], ["doc_id"])


@_query("""
SELECT min(doc_id) AS doc_id, count(*) - 1 AS duplicates FROM documents LEFT JOIN labels USING (doc_id) GROUP BY text HAVING count(DISTINCT coalesce(quality, -1)) = 1""")
def conflict_filter(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left").withColumn("target", F.array(F.coalesce("quality", F.lit(-1))))
    return dedup.drop_conflicts(d, F.sha2("text", 256), "target", ["doc_id"], ["doc_id"]).select("doc_id", "duplicates")


_NULLED = """SELECT o_orderkey::VARCHAR AS fact_id, nullif(o_orderpriority, '5-LOW') AS fact, nullif(o_orderstatus, 'P') AS entity, 'orders' AS source_type,
 CASE o_orderkey % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'percentage' ELSE 'text' END AS value_type, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS value_number FROM orders"""


@_query(f"""
WITH f AS ({_NULLED}),
i AS (SELECT unnest(list_filter([CASE WHEN coalesce(fact, '') = '' THEN 'missing_fact' END, CASE WHEN coalesce(entity, '') = '' THEN 'missing_entity' END,
  CASE WHEN value_type IN ('amount', 'percentage') AND value_number IS NULL THEN 'missing_value_number' END], lambda x: x IS NOT NULL)) AS issue FROM f)
SELECT issue, count(*) AS n FROM i GROUP BY issue""")
def quarantine(spark, sf):
    o = _t(spark, sf, "orders")
    f = o.select(
        F.col("o_orderkey").cast("string").alias("fact_id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("fact"), F.nullif("o_orderstatus", F.lit("P")).alias("entity"), F.lit("orders").alias("source_type"),
        F.element_at(F.array(F.lit("amount"), F.lit("percentage"), F.lit("text")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("value_type"), F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("value_number"),
    )
    return validation.issue_counts(validation.validate_facts(f)[1])


def _raw_value() -> F.Column:
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return F.when(n == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%"))).when(n == 2, F.concat(price, F.lit("亿"))).when(n == 3, F.concat(F.lit(" "), price, F.lit("万元 "))).when(n == 4, "n/a").when(n == 5, F.concat(price, F.lit("万亿元"))).when(n == 6, F.concat(F.lit("约"), price)).otherwise(price)


@_query("""
SELECT l_orderkey, l_linenumber,
 (CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber IN (4, 6) THEN NULL ELSE l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS number,
 CASE l_linenumber WHEN 1 THEN '%' WHEN 2 THEN '亿' WHEN 3 THEN '万元' WHEN 4 THEN '' WHEN 5 THEN '万亿元' WHEN 6 THEN '约' || l_extendedprice::DECIMAL(18,2) ELSE 'raw' END AS unit,
 CASE WHEN l_linenumber IN (1, 4) THEN NULL ELSE 'CNY' END AS currency,
 CASE l_linenumber WHEN 2 THEN '亿' WHEN 3 THEN '万' WHEN 5 THEN '万亿' ELSE '' END AS scale,
 CASE WHEN l_linenumber = 1 THEN 'percentage' WHEN l_linenumber IN (2, 3, 5) THEN 'amount' ELSE 'text' END AS value_type
FROM lineitem""")
def parse_values(spark, sf):
    v = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", values.parse_value(_raw_value()).alias("v"))
    return v.select("l_orderkey", "l_linenumber", "v.number", "v.unit", "v.currency", "v.scale", values.value_type(F.col("v.unit")).alias("value_type"))


@_query("""
SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber = 1 THEN l_quantity WHEN l_linenumber IN (4, 6) THEN NULL ELSE l_extendedprice::DECIMAL(18,2) END)::DOUBLE AS number,
 CASE l_linenumber WHEN 1 THEN '%' WHEN 2 THEN '亿' WHEN 3 THEN '万元' WHEN 4 THEN 'n/a' WHEN 5 THEN '万亿元' WHEN 6 THEN '约' || l_extendedprice::DECIMAL(18,2) ELSE 'raw' END AS unit FROM lineitem""")
def parse_answer_values(spark, sf):
    v = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", values.parse_answer_value(_raw_value()).alias("v"))
    return v.select("l_orderkey", "l_linenumber", "v.number", "v.unit")


@_query("""
SELECT metric, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS date, count(*) AS n, round(sum(v), 2) AS total
FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, price, discount, tax INTO NAME metric VALUE v)
GROUP BY 1, 2""")
def unpivot_metrics(spark, sf):
    li = _t(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    names = {"l_quantity": "quantity", "l_extendedprice": "price", "l_discount": "discount", "l_tax": "tax"}
    long = facts.unpivot_metrics(li, ["l_orderkey", "l_linenumber", "day"], names)
    return long.groupBy("metric", values.quarter_label(F.col("day")).alias("date")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("raw_value").cast("double")), 2).alias("total"))


@_query("""
SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name, coalesce(r_name, 'unknown') AS r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def dim_enrich(spark, sf):
    dim = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return dimensions.lookup(_t(spark, sf, "customer"), dim, "c_nationkey", "n_nationkey", ["n_name", "r_name"], "unknown").select("c_custkey", "n_name", "r_name")


@_query("""
SELECT s_suppkey, arg_min(n_name, n_nationkey) AS matched FROM supplier JOIN nation ON contains('of NATION_' || s_nationkey || ' today', n_name) GROUP BY 1""")
def name_in_title(spark, sf):
    titles = _t(spark, sf, "supplier").withColumn("title", F.concat(F.lit("of NATION_"), "s_nationkey", F.lit(" today")))
    return dimensions.name_in_title(titles, "title", _t(spark, sf, "nation"), "n_name", "n_nationkey").select("s_suppkey", "matched")


@_query("""
SELECT a.o_orderkey::VARCHAR AS root_id, b.o_orderkey::VARCHAR AS target_id FROM orders a JOIN orders b USING (o_custkey, o_orderpriority)
WHERE a.o_orderkey <> b.o_orderkey AND a.o_orderdate::DATE <> b.o_orderdate::DATE AND a.o_totalprice::DECIMAL(18,2) <> b.o_totalprice::DECIMAL(18,2)""")
def two_hop_pairs(spark, sf):
    return synthesis.pair_facts(order_facts(spark, sf)).select(F.col("root.fact_id").alias("root_id"), F.col("target.fact_id").alias("target_id"))


@_query("""
SELECT root_id, '某家上市公司在' || d1 || '披露的' || m || '为' || v1 || '；请问该公司在' || d2 || '的' || m || '具体是多少？' AS prompt,
 CASE WHEN regexp_replace(regexp_replace(printf('%.6f', p2), '0+$', ''), '\\.$', '') = v2 THEN v2 ELSE v2 || '/' || regexp_replace(regexp_replace(printf('%.6f', p2), '0+$', ''), '\\.$', '') END AS targets
FROM (SELECT a.o_orderkey::VARCHAR AS root_id, a.o_orderpriority AS m, strftime(a.o_orderdate, '%Y-%m-%d') AS d1, strftime(b.o_orderdate, '%Y-%m-%d') AS d2,
 (a.o_totalprice::DECIMAL(18,2))::VARCHAR AS v1, (b.o_totalprice::DECIMAL(18,2))::VARCHAR AS v2, b.o_totalprice AS p2,
 row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey::VARCHAR) AS place
 FROM orders a JOIN orders b USING (o_custkey, o_orderpriority)
 WHERE a.o_orderkey <> b.o_orderkey AND a.o_orderdate::DATE <> b.o_orderdate::DATE AND a.o_totalprice::DECIMAL(18,2) <> b.o_totalprice::DECIMAL(18,2))
WHERE place = 1""")
def two_hop_questions(spark, sf):
    pairs = synthesis.pair_facts(order_facts(spark, sf), per_root=1)
    t = F.col("target")
    accepted = values.answer_targets(t["value_text"], t["value_number"], t["unit"])
    return pairs.select(F.col("root.fact_id").alias("root_id"), synthesis.lookup_question(F.col("root"), t).alias("prompt"), F.array_join(accepted, "/").alias("targets"))


@_query("""
WITH e AS (SELECT entity, c, row_number() OVER (ORDER BY sha256(entity || ':3'), entity) - 1 AS slot FROM (SELECT o_orderpriority AS entity, count(*) AS c FROM orders GROUP BY 1)),
f AS (SELECT o_orderpriority AS entity, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(o_orderkey || ':3'), o_orderkey) AS place FROM orders)
SELECT attempt, entity, o_orderkey AS root_id FROM range(1000) r(attempt) JOIN e ON attempt % (SELECT count(*) FROM e) = slot JOIN f USING (entity) WHERE place = (attempt // (SELECT count(*) FROM e)) % c + 1""")
def round_robin_roots(spark, sf):
    return synthesis.round_robin_roots(_t(spark, sf, "orders"), 1000, 3, "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "entity")


@_query("""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 AND q.vec_id % 3 > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 3""")
def vector_topk(spark, sf):
    e = _t(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 3 > 0, "q").otherwise(" ").alias("query"), F.col("embedding").alias("vector"))
    found = retrieval.search(q, e.select("vec_id", "embedding"), 3, id_col="vec_id")
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"


@_query(f"""
SELECT page_id, scheme, (row_number() OVER (PARTITION BY scheme ORDER BY (host = 'example.org' OR host LIKE '%.example.org') DESC, length(url), page_id))::INT AS rank
FROM (SELECT page_id, url, split_part(url, ':', 1) AS scheme, {_HOST} AS host FROM pages)""")
def domain_rank(spark, sf):
    p = _t(spark, sf, "pages").withColumn("scheme", F.substring_index("url", ":", 1))
    return retrieval.rank_hits(p, "scheme", "url", "page_id", ("example.org",)).select("page_id", "scheme", "rank")


@_query(f"""
SELECT page_id, {_HOST} AS host, (regexp_matches(url, '(?i)^https?://') AND {_HOST} NOT IN ('', 'localhost')) AS public FROM pages""")
def page_hosts(spark, sf):
    return _t(spark, sf, "pages").select("page_id", retrieval.host_of(F.col("url")).alias("host"), retrieval.is_public_url(F.col("url")).alias("public"))


_TOKENS, _NUMBERS = registry.TOKENS, registry.NUMBERS
_PAIRED = f"""
p AS (SELECT c.conv_id, c.turn, c.role, c.text, n.text AS reply FROM conversations c JOIN conversations n ON c.conv_id = n.conv_id AND n.turn = c.turn + 1),
k AS (SELECT *, {_TOKENS.format("reply")} AS a, {_TOKENS.format("text")} AS b, {_NUMBERS.format("reply")} AS x, {_NUMBERS.format("text")} AS y FROM p),
o AS (SELECT *, len(list_distinct(list_intersect(a, b))) AS common, len(a) AS n, len(b) AS m,
  list_min(list_filter(flatten(list_transform(list_filter(y, lambda g: g <> 0), lambda g: list_transform(x, lambda q: abs(q - g) / abs(g)))), lambda e: e <= 0.05)) AS err FROM k),
f AS (SELECT *, CASE WHEN n = 0 OR m = 0 THEN 0.0::DOUBLE ELSE greatest(CASE WHEN common = 0 THEN 0.0::DOUBLE ELSE 2 * (common::DOUBLE / n) * (common::DOUBLE / m) / (common::DOUBLE / n + common::DOUBLE / m) END,
  coalesce(1.0::DOUBLE - 0.2::DOUBLE * (err / 0.05::DOUBLE), 0.0::DOUBLE)) END AS f1 FROM o)"""


@_query(f"WITH {_PAIRED} SELECT conv_id, turn, round(f1, 9) AS f1 FROM f")
def answer_f1(spark, sf):
    return _exchanges(spark, sf).select("conv_id", "turn", F.round(rewards.answer_f1(F.col("reply"), F.col("text")), 9).alias("f1"))


_INVALID = "(" + " OR ".join(f"contains(lower(reply), '{w.replace(chr(39), chr(39) * 2)}')" for w in rewards.INVALID_ANSWERS) + ")"


@_query(f"""
WITH {_PAIRED},
r AS (SELECT *, CASE WHEN {_INVALID} THEN -0.5::DOUBLE ELSE 0.4::DOUBLE * f1 END AS corr,
  CASE WHEN len(list_filter(b, lambda t: NOT contains(reply, t))) = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS cem, 0.2::DOUBLE AS fmt,
  CASE WHEN trim(text) <> '' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS srch,
  CASE WHEN (m > 0 AND len(list_filter(b, lambda t: NOT contains(text, t))) = 0) OR len(list_filter(y, lambda g: g <> 0)) > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS ret,
  trim(reply, ' \t\n\r') = '' AS dead FROM f)
SELECT conv_id, turn, round(CASE WHEN dead THEN 0 ELSE corr END, 9) AS answer_correctness, round(CASE WHEN dead THEN 0 ELSE cem END, 9) AS answer_cem, round(CASE WHEN dead THEN 0 ELSE ret END, 9) AS retrieval_correctness,
 round(CASE WHEN dead THEN 0 ELSE least(greatest(corr + cem + fmt + srch + ret, 0), 1) END, 9) AS total, dead AS terminated_with_zero FROM r""")
def reward_breakdown(spark, sf):
    steps = F.array(F.struct(F.col("text").alias("query"), F.col("text").alias("retrieved_text"), F.array().cast("array<struct<value_text:string,fact:string,unit:string>>").alias("retrieved_records")))
    parts = {"trace": F.col("trace"), "answer": F.col("reply"), "steps": steps, "rounds": F.lit(1), "calls": F.lit(1), "repeated": F.lit(False), "valid": F.lit(True)}
    out = _exchanges(spark, sf).withColumn("r", rewards.breakdown(truth=F.col("text"), **parts))
    return out.select("conv_id", "turn", *[F.round(f"r.{c}", 9).alias(c) for c in ("answer_correctness", "answer_cem", "retrieval_correctness", "total")], "r.terminated_with_zero")


@_query("""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<think>a</think><search>' || text || '</search>' ELSE '<think>b</think> <answer>' || text || '</answer>' END AS x FROM conversations),
m AS (SELECT *, regexp_full_match(x, '(?s)\\s*<think>[^<]*</think>\\s*(?:<search>[^<]*</search>|<answer>[^<]*</answer>)\\s*') AS ok, trim(regexp_extract(x, '(?s)<search>([^<]*)</search>', 1), E' \\t\\n\\r') AS q, trim(regexp_extract(x, '(?s)<answer>([^<]*)</answer>', 1), E' \\t\\n\\r') AS a FROM t)
SELECT conv_id, turn, ok AND (q <> '' OR a <> '') AS valid, CASE WHEN ok AND q <> '' THEN 'search' WHEN ok AND a <> '' THEN 'answer' END AS kind, CASE WHEN ok AND (q <> '' OR a <> '') THEN length(q || a) END AS n FROM m""")
def turn_parse(spark, sf):
    c = _t(spark, sf, "conversations")
    x = F.when(F.col("role") == "user", F.concat(F.lit("<think>a</think><search>"), "text", F.lit("</search>"))).otherwise(F.concat(F.lit("<think>b</think> <answer>"), "text", F.lit("</answer>")))
    p = c.select("conv_id", "turn", traces.parse_turn(x).alias("p"))
    return p.select("conv_id", "turn", "p.valid", "p.kind", F.length("p.content").cast("long").alias("n"))


@_query("""
SELECT conv_id, count(*) FILTER (role = 'user') - count(DISTINCT CASE WHEN role = 'user' THEN lower(text) END) > 0 AS repeated, count(DISTINCT CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END)::INT AS searches FROM conversations GROUP BY conv_id""")
def seen_queries(spark, sf):
    q = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda s: s["text"])
    g = _t(spark, sf, "conversations").groupBy("conv_id").agg(q.alias("q"))
    return g.select("conv_id", traces.has_repeat(F.col("q"), fold=True).alias("repeated"), traces.distinct_searches(F.col("q")).alias("searches"))


def _events_as_audit(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events")
    value = (F.col("value") / 100).alias("total")
    part = [(F.col("value") / k).alias(c) for k, c in ((250, "answer_correctness"), (500, "answer_cem"), (1000, "format_compliance"), (2000, "search_incentive"), (4000, "retrieval_correctness"))]
    search = F.array().cast("array<struct<query:string>>")
    return e.select(F.col("event_type").alias("qid"), "event_id", F.struct(*part, value, (F.col("event_type") == "error").alias("terminated_with_zero")).alias("reward"), F.when(F.col("user_id") % 3 > 0, "yes").alias("final_answer"), F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.lit("q").alias("query")))).otherwise(search).alias("searches"), (F.col("event_type") == "click").alias("is_repeated_query"), (F.col("event_id") % 7).cast("int").alias("num_rounds"))


@_query("""
SELECT count(*) AS count, round(avg(value / 250), 9) AS answer_correctness_mean, round(avg(value / 100), 9) AS total_mean, round(avg((user_id % 3 > 0)::INT), 9) AS answer_rate, round(avg((user_id % 2 = 0)::INT), 9) AS search_rate,
 round(avg((event_type = 'click')::INT), 9) AS repeated_rate, round(avg((event_type = 'error')::INT), 9) AS zero_rate, round(avg(event_id % 7), 9) AS rounds_mean FROM events""")
def audit_metrics(spark, sf):
    m = audit.reward_metrics(_events_as_audit(spark, sf))
    return m.select("count", *[F.round(c, 9).alias(c) for c in ("answer_correctness_mean", "total_mean", "answer_rate", "search_rate", "repeated_rate", "zero_rate", "rounds_mean")])


@_query("""
WITH r AS (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM (SELECT *, (lag(event_type) OVER (ORDER BY event_id) IS DISTINCT FROM event_type)::INT AS new FROM events)),
g AS (SELECT run, min(value) = max(value) AS flat FROM r GROUP BY run)
SELECT (SELECT count(*) FROM events) AS trajectories, count(*) AS prompt_groups, round(avg(flat::INT), 9) AS zero_reward_std_group_rate, (SELECT round(avg(value / 100), 9) FROM events) AS reward_mean, (SELECT round(stddev_pop(value / 100), 9) FROM events) AS reward_std,
 (SELECT round(avg((user_id % 3 > 0 AND user_id % 2 = 0)::INT), 9) FROM events) AS search_to_answer_rate FROM g""")
def group_health(spark, sf):
    s = audit.health_summary(_events_as_audit(spark, sf), "event_id")
    return s.select("trajectories", "prompt_groups", *[F.round(c, 9).alias(c) for c in ("zero_reward_std_group_rate", "reward_mean", "reward_std", "search_to_answer_rate")])


@_query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing_target_alignment_metadata' WHEN l.quality = 0 AND d.doc_id % 5 = 0 THEN 'legacy_target_alignment_unverifiable'
 WHEN regexp_matches(text, 'the other|autre') AND true THEN 'multi_entity_claim_unsupported_by_involved_records' WHEN regexp_matches(text, 'same|même') THEN 'equality_claim_conflicts_with_involved_values'
 WHEN regexp_matches(text, 'how much|tion.*ing') THEN 'derived_question_with_scalar_final_record_target' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY reason""")
def alignment_rules(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    record = lambda e, v: F.struct(F.lit(e).alias("entity"), F.lit(v).alias("value_text"))
    records = F.array(record("a", "1"), record("a", "2"))
    target = F.when(~((F.col("quality") == 0) & (F.col("doc_id") % 5 == 0)), "x")
    reason = validation.alignment_reason(F.col("text"), F.col("quality").isNotNull(), records, target, ("how much|tion.*ing",), ("the other|autre",), ("same|même",))
    return audit.rejection_histogram(d.withColumn("reason", reason))


@_query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def without_findings(spark, sf):
    return validation.without_findings(_t(spark, sf, "documents"), _t(spark, sf, "labels").filter("toxic = 1"), "doc_id").select("doc_id")


@_query("""
SELECT source, n, min_id AS first_seen FROM (SELECT source, count(*) AS n, min(doc_id) AS min_id FROM documents GROUP BY source) ORDER BY n DESC, min_id LIMIT 20""")
def report_topn(spark, sf):
    return audit.top_counts(_t(spark, sf, "documents"), "source", 20, "doc_id")


@_query("""
SELECT count(*) AS n, floor(100.0 * sum((coalesce(quality::VARCHAR, '') <> '')::INT) / greatest(count(*), 1))::BIGINT AS quality, floor(100.0 * sum((text <> '')::INT) / greatest(count(*), 1))::BIGINT AS text FROM documents LEFT JOIN labels USING (doc_id)""")
def completeness(spark, sf):
    return audit.completeness(_t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left"), ["quality", "text"])


@_query("""
SELECT conv_id, sum(length(text))::BIGINT AS tokens, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS assistant FROM conversations GROUP BY conv_id""")
def env_mask(spark, sf):
    s = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("owner"), "text").alias("s")))), lambda x: x["s"])
    g = _t(spark, sf, "conversations").groupBy("conv_id").agg(s.alias("segments"))
    whole = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    g = g.select("conv_id", traces.segment_spans(F.col("segments")).alias("spans"), F.length(whole).alias("n"))
    each = F.transform("spans", lambda x: F.struct((x["end"] - x["start"]).alias("n"), x["mask"].alias("mask")))
    return g.select("conv_id", F.col("n").cast("long").alias("tokens"), F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x["n"] * x["mask"]).alias("assistant"))


@_query("""
SELECT o_orderkey, printf('ft_%05d', row_number() OVER (ORDER BY o_orderdate, o_orderkey)) AS qid FROM orders""")
def numbered(spark, sf):
    return synthesis.number_rows(_t(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "qid")


@_query("""
SELECT count(*) AS n, count(DISTINCT doc_id) AS qids, count(DISTINCT text) AS prompts, sum(quality)::BIGINT AS answerable, (count(*) - sum(quality))::BIGINT AS unanswerable, count(*) > 0 AND count(*) = count(DISTINCT doc_id) AS ok, count(*) = count(DISTINCT text) AND count(*) = count(DISTINCT doc_id) AS trainable FROM (SELECT doc_id, text, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id))""")
def dataset_gate(spark, sf):
    d = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    return validation.dataset_gate(d.select(F.col("doc_id").alias("qid"), F.sha2("text", 256).alias("prompt"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("valid_inst")))


@_query("""
WITH g AS (SELECT p_partkey, list_distinct([substr(p_name, i, 3) FOR i IN range(1, length(p_name) - 1)]) AS a, list_distinct([substr(lower(p_type), i, 3) FOR i IN range(1, length(p_type) - 1)]) AS b, length(p_name) >= 3 AND length(p_type) >= 3 AS ok FROM part)
SELECT p_partkey, round(CASE WHEN ok THEN len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) ELSE 0 END, 9) AS similarity FROM g""")
def trigram_similarity(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", F.round(text.trigram_similarity(F.col("p_name"), F.lower("p_type")), 9).alias("similarity"))


@_query("""
SELECT o_custkey, string_agg(i || '. [' || o_orderkey || '] c' || o_custkey || ' ' || strftime(o_orderdate, '%Y-%m-%d'), chr(10) ORDER BY i) AS candidates
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders QUALIFY i <= 5) GROUP BY o_custkey""")
def candidate_lists(spark, sf):
    o = order_facts(spark, sf).withColumn("c", F.substring("entity", 2, 20).cast("long"))
    nth = F.row_number().over(dedup.Window.partitionBy("c").orderBy("date", "ordinal"))
    few = o.withColumn("nth", nth).filter("nth <= 5").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("nth", "fact_id", "fact"))).alias("r"))
    return few.select(F.col("c").alias("o_custkey"), synthesis.render_candidates(F.col("r")).alias("candidates"))


@_query("""
WITH d AS (SELECT o_custkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice::DECIMAL(18,2) AS v, arg_min(o_orderkey, o_orderkey) AS id, arg_min(o_orderstatus, o_orderkey) AS source_type FROM orders GROUP BY o_custkey, o_orderpriority, day, v),
s AS (SELECT *, (('0x' || substr(sha256('c' || o_custkey || '|' || o_orderpriority || '|kb-v1'), 1, 8))::UBIGINT % 100)::INT AS b FROM d),
q AS (SELECT a.id, CASE WHEN a.b < 80 THEN 'train' WHEN a.b < 90 THEN 'val' ELSE 'test' END AS segment, a.source_type, count(*) AS targets FROM s a JOIN s b USING (o_custkey, o_orderpriority) WHERE a.id <> b.id AND a.day <> b.day AND a.v <> b.v GROUP BY ALL)
SELECT segment, source_type, count(*) AS roots, sum(targets)::BIGINT AS pairs, max(targets) AS most FROM q GROUP BY ALL""")
def kb_pipeline(spark, sf):
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """From facts to questions: union, dedup, validation, split, pairing, and a summary per split."""
    raw = order_facts(spark, sf)
    merged = dedup.union_in_order(raw, raw.filter("ordinal % 3 = 0").withColumn("source_type", F.lit("again")))
    key = keys.dedup_key(*[F.col(c) for c in ("entity", "metric", "date", "value_text", "unit", "fact")])
    unique = dedup.keep_longest(merged, key, "fact", ["source_rank", "ordinal"]).drop("position")
    valid, _ = validation.validate_facts(unique)
    split = valid.withColumn("segment", keys.fact_split(F.col("entity"), F.col("metric"), _LABELS["split"]))
    paired = synthesis.target_counts(split).filter("targets > 0")
    return paired.groupBy("segment", "source_type").agg(F.count("*").alias("roots"), F.sum("targets").alias("pairs"), F.max("targets").alias("most"))
