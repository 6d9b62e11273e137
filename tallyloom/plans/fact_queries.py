"""Queries on facts: sources, builders, rules on text, questions and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import keys, rewards, text
from tallyloom.operators import audit, dedup, dimensions, facts, retrieval, synthesis, validation
from tallyloom.plans.registry import DAY, PRICE, cases, query, short, table

NAMES = cases("o_custkey", "'贵州茅台'", "'招商银行'", "'万科企业'", "'某某'", "'比亚迪'")
INDUSTRIES = cases("o_custkey", "'白酒'", "'银行'", "'地产'", "'未知'", "'汽车'")
_DIGITS = "regexp_replace(regexp_replace(printf('%.6f', {}), '0+$', ''), '\\.$', '')"

# -- names, metrics and rules on text

_COMPANY = cases("p_partkey", "'2022年贵州茅台报告'", "'东方科技公告 ' || p_name", "'abc ' || p_type", "'某某公司'", "p_name || '海康威视'", "CAST(NULL AS STRING)")


@query(f"""
SELECT p_partkey, {cases("p_partkey", "'贵州茅台'", "'东方科技'", "NULL", "'某某公司'", "'海康威视'", "NULL")} AS entity,
 {cases("p_partkey", "'贵州茅台'", "'东方科技'", "NULL", "NULL", "'海康威视'", "NULL")} AS narrow FROM part""")
def entity_names(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", f"{_COMPANY} AS x")
    return p.select("p_partkey", text.entity(F.col("x")).alias("entity"), text.entity(F.col("x"), with_company=False).alias("narrow"))


_Q, _D = "CAST(CAST(l_quantity AS INT) AS STRING)", "CAST(CAST(l_discount AS DECIMAL(18,2)) AS STRING)"
_STATED = f"""CASE l_linenumber WHEN 1 THEN '公司毛利率为' || {_Q} || '%，高于同行' WHEN 2 THEN '每股收益达' || {_D} WHEN 3 THEN '净利润超过去年' WHEN 4 THEN '市盈率约 ' || {_Q} || ' 倍'
 WHEN 5 THEN '流动比率 ' || {_D} || '，增速 ' || {_Q} || '%' WHEN 6 THEN '没有指标 ' || {_Q} ELSE '营收约' || {_Q} || '亿元，同比增长' || {_D} || '%' END"""


@query(f"""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '毛利率' WHEN 2 THEN '每股收益' WHEN 3 THEN '净利润' WHEN 4 THEN '市盈率' WHEN 5 THEN '流动比率' WHEN 7 THEN '营收' END AS metric,
 CASE l_linenumber WHEN 1 THEN {_Q} || '%' WHEN 2 THEN {_D} WHEN 3 THEN '净利润' WHEN 4 THEN {_Q} WHEN 5 THEN {_Q} || '%' WHEN 7 THEN {_D} || '%' END AS value_text,
 CASE WHEN l_linenumber IN (1) THEN 'percentage' WHEN l_linenumber IN (2, 3, 7) THEN 'amount' WHEN l_linenumber IN (4, 5) THEN 'ratio' ELSE 'text' END AS value_type FROM lineitem""")
def metric_values(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_STATED} AS x").select("l_orderkey", "l_linenumber", text.metric(F.col("x")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")


_VALUED = f"""CASE l_linenumber WHEN 1 THEN '全年营业总收入达' || {_Q} || '亿元' WHEN 2 THEN '净利润' || {_Q} || '万元，毛利率' || {_D} || '%' WHEN 3 THEN '同比下降' || {_D} || '%'
 WHEN 4 THEN '市占率约' || {_Q} || '%' WHEN 5 THEN 'PE' || {_Q} || '倍' WHEN 6 THEN '营收增长' ELSE 'ROE' || {_D} || '%' END"""


@query(f"""
SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '营业总收入' WHEN 2 THEN '净利润' WHEN 3 THEN '同比增速' WHEN 4 THEN '市占率' WHEN 5 THEN '市盈率' WHEN 7 THEN '净资产收益率' END AS metric,
 CASE l_linenumber WHEN 1 THEN '营业总收入达' || {_Q} || '亿元' WHEN 2 THEN '净利润' || {_Q} || '万元' WHEN 3 THEN '同比下降' || {_D} || '%' WHEN 4 THEN '市占率约' || {_Q} || '%' WHEN 5 THEN 'PE' || {_Q} || '倍' WHEN 7 THEN 'ROE' || {_D} || '%' END AS value_text FROM lineitem""")
def valued_metrics(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_VALUED} AS x").select("l_orderkey", "l_linenumber", text.valued_metric(F.col("x")).alias("m")).select("l_orderkey", "l_linenumber", "m.*")


_CHOICE = cases("c_custkey", "' 2 '", "'３。'", "'0'", "'9'", "'2 or 3'", "'1.'")
_VERDICT = cases("c_custkey", "' 是的'", "'“ 是”'", "'不是'", "''", "CAST(NULL AS STRING)")
_WEB = cases("c_custkey", "' https://a.org/x '", "'http://b.com'", "'http:///x'", "'what is https://a.org'", "'HTTP://c.com'")
_LANG = cases("c_custkey", "'ZH'", "'cn'", "'en'", "CAST(NULL AS STRING)", "''", "'Chinese'")
_HINT = "c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || chr(10) || '### JSON' || chr(10) || chr(10) || '### more' ELSE ' ### kept' END"
_LATEX = "chr(92) || 'text{' || c_name || '} = ' || chr(92) || 'frac{a}{b}'"
_QUOTED = "' \"' || c_name || chr(9) || chr(10) || '  ' || c_mktsegment || '\" '"


@query(f"""
SELECT c_custkey, {cases("c_custkey", "1", "2", "NULL", "NULL", "NULL", "0")} AS choice, {cases("c_custkey", "true", "true", "false", "false", "NULL")} AS yes, {cases("c_custkey", "true", "true", "false", "false", "false")} AS address,
 {cases("c_custkey", "true", "true", "false", "true", "true", "true")} AS chinese, c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' ### kept' END AS question, c_name || ' = frac{{a{{b' AS formula, c_name || ' ' || c_mktsegment AS clean, {short("c_name")} AS hash FROM customer""")
def text_rules(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", f"{_CHOICE} AS choice", f"{_VERDICT} AS verdict", f"{_WEB} AS web", f"{_LANG} AS lang", f"{_HINT} AS hint", f"{_LATEX} AS latex", f"{_QUOTED} AS quoted")
    return c.select(
        "c_custkey", text.candidate_choice(F.col("choice"), F.lit(3)).alias("choice"), text.affirmative(F.col("verdict")).alias("yes"), retrieval.is_url_query(F.col("web")).alias("address"), dimensions.is_chinese(F.col("lang")).alias("chinese"),
        text.without_format_hint(F.col("hint")).alias("question"), text.without_latex(F.col("latex")).alias("formula"), text.squeeze(F.col("quoted")).alias("clean"), keys.short_hash(F.col("c_name")).alias("hash"),
    )


# -- sources


@query(f"""
WITH o AS (SELECT o_orderkey, CAST(o_custkey AS STRING) AS code, {NAMES} AS name, {INDUSTRIES} AS industry, {DAY} AS period, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS label, {PRICE} AS price, o_totalprice::DECIMAL(18,2)::DOUBLE AS p, o_custkey % 50 AS share FROM orders),
m AS (SELECT *, '净利润' AS metric, price || '亿' AS raw, p AS number, 'amount' AS kind, '亿' AS unit, 'CNY' AS currency, '亿' AS scale FROM o
 UNION ALL SELECT *, '销售毛利率', share || '%', share, 'percentage', '%', NULL, '' FROM o UNION ALL SELECT *, '流动比率', price, p, 'text', 'raw', 'CNY', '' FROM o WHERE o_orderkey % 3 <> 0)
SELECT o_orderkey, 'fina_' || {short("name || '|' || name || period || '财报摘要(同花顺)|' || metric || '|' || raw || '|' || label")} AS fact_id, name || label || metric || '为' || raw || '。' AS fact, industry, metric, raw AS value_text, number AS value_number, kind AS value_type, unit, currency, scale, label AS date,
 'ths_abstract_' || code || '_' || period AS document_id, 'https://data.10jqka.com.cn/financial/yjgg/opp/' || code || '/' AS source_url, '2025-01-01' AS retrieved_at FROM m""")
def abstract_facts(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS STRING) || '#' || o_orderkey AS code", f"{NAMES} AS name", f"{DAY} AS `报告期`", f"{PRICE} || '亿' AS `净利润`", "o_custkey % 50 || '%' AS `销售毛利率`", f"CASE o_orderkey % 3 WHEN 0 THEN 'False' ELSE {PRICE} END AS `流动比率`", "CAST(NULL AS STRING) AS `速动比率`")
    # The order travels in the code, and leaves it here.
    f = facts.abstract_facts(o, F.lit("2025-01-01"))
    plain = lambda c: F.regexp_replace(c, "#[0-9]+", "")
    key = F.regexp_extract("document_id", "#([0-9]+)", 1).cast("long").alias("o_orderkey")
    return f.select(key, "fact_id", "fact", "industry", "metric", "value_text", "value_number", "value_type", "unit", "currency", "scale", "date", plain("document_id").alias("document_id"), plain("source_url").alias("source_url"), "retrieved_at")


_TITLE = cases("o_orderkey", "'T' || o_orderkey", "'T' || o_custkey", "'nan'", "''")


@query(f"""
WITH o AS (SELECT *, CAST(o_custkey AS STRING) AS code, {NAMES} AS name, {DAY} AS d, {_TITLE} AS title, 'B' || o_orderkey % 7 AS broker, CASE WHEN o_orderstatus = 'F' THEN 'nan' ELSE '买入' || o_orderpriority END AS rating, {PRICE} AS eps FROM orders WHERE {_TITLE} NOT IN ('nan', '')),
r AS (SELECT 'rrpt_' || {short("name || '_' || d || '_' || rating")} AS fact_id, name || '在' || d || '获' || broker || '研报评级为「' || rating || '」，报告标题：《' || title || '》。' AS fact, '东财评级' AS metric, rating AS value_text, NULL::DOUBLE AS value_number, '' AS unit, {short("name || '_' || d || '_' || rating || '_' || broker")} AS h, * FROM o WHERE rating <> 'nan'
 UNION ALL SELECT 'rese_' || h, name || d || '2026预测每股收益为' || eps || '，来源：' || broker || '于' || d || '发布的研报。', '2026预测每股收益', eps, eps::DOUBLE, 'raw', h, * EXCLUDE (h) FROM (SELECT *, {short("name || '|研报《' || title || '》(' || broker || ')|2026预测每股收益|' || eps || '|' || d")} AS h FROM o WHERE o_orderkey % 3 > 0))
SELECT fact_id, fact, metric, value_text, value_number, unit, h AS raw_content_hash, '研报《' || title || '》(' || broker || ')' AS source_doc, 'em_rpt_' || code || '_' || d || '_' || {short("title")} AS document_id, d AS date FROM r""")
def report_facts(spark, sf):
    o = table(spark, sf, "orders").selectExpr("CAST(o_custkey AS STRING) AS code", f"{NAMES} AS name", "'B' || o_orderkey % 7 AS broker", f"{_TITLE} AS title", f"{DAY} AS date", "CASE WHEN o_orderstatus = 'F' THEN 'nan' ELSE '买入' || o_orderpriority END AS rating", f"CASE WHEN o_orderkey % 3 > 0 THEN {PRICE} END AS eps_2026", "'NaN' AS pe_2026")
    f = facts.report_facts(o, ["2026", "2027"])
    return f.select("fact_id", "fact", "metric", "value_text", "value_number", "unit", "raw_content_hash", "source_doc", "document_id", "date")


_TITLES = cases("o_orderkey", "'关于' || o_custkey", "'公告' || o_orderkey", "'nan'", "'C' || o_custkey % 50 || '号提示'")
_COLUMNS = ("o_orderkey AS ordinal", "CAST(o_custkey % 60 AS STRING) AS code", f"replace({DAY}, '-', '') AS day", "o_orderpriority AS kind", f"{_TITLES} AS title", f"{DAY} AS date", "'nan' AS url")
_NOTICES = f"SELECT {', '.join(_COLUMNS)} FROM orders"


def _notices(spark, sf):
    return table(spark, sf, "orders").selectExpr(*_COLUMNS)


_COMPANIES = "SELECT CAST(n_nationkey AS STRING) AS code, 'C' || n_nationkey || '号' AS name, n_nationkey AS place FROM nation"
_KINDS, _YEAR = ("1-URGENT", "5-LOW"), "1996"


def _companies(spark, sf):
    return table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS STRING) AS code", "'C' || n_nationkey || '号' AS name", "n_nationkey AS place")


@query(f"""
WITH n AS ({_NOTICES}), c AS ({_COMPANIES}), d AS (SELECT n.*, c.name FROM n JOIN c USING (code) WHERE title <> 'nan' AND kind IN {_KINDS} AND day IN (SELECT strftime(x, '%Y%m%d') FROM range(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY) r(x))),
f AS (SELECT *, row_number() OVER (PARTITION BY code, title ORDER BY day DESC, kind, ordinal) AS k FROM d)
SELECT 'anno_' || {short("code || '_' || title")} AS fact_id, name || '于' || date || '发布' || kind || '公告：《' || title || '》。' AS fact, '公告《' || title || '》(' || name || ')' AS source_doc, 'em_notice_' || code || '_' || date || '_' || {short("title")} AS document_id, {short("code || '_' || title || '_' || date")} AS raw_content_hash, '' AS source_url FROM f WHERE k = 1""")
def requested_announcements(spark, sf):
    from datetime import date, timedelta

    days = [(date(1996, 12, 30) - timedelta(days=i)).strftime("%Y%m%d") for i in range(365)]
    f = facts.requested_announcements(_notices(spark, sf), _companies(spark, sf), days, list(_KINDS))
    return f.select("fact_id", "fact", "source_doc", "document_id", "raw_content_hash", "source_url")


@query(f"""
WITH n AS ({_NOTICES}), c AS ({_COMPANIES}),
m AS (SELECT n.*, coalesce(c.name, (SELECT arg_min(name, place) FROM c x WHERE contains(n.title, x.name))) AS matched FROM n LEFT JOIN c USING (code) WHERE title <> 'nan' AND day BETWEEN '19961101' AND '19961230'),
f AS (SELECT m.* EXCLUDE (code), c.code, row_number() OVER (PARTITION BY c.code, title ORDER BY day DESC, ordinal) AS k FROM m JOIN c ON matched = c.name)
SELECT 'anno2_' || {short("code || '_' || title")} AS fact_id, matched || '于' || date || '发布公告：《' || title || '》。' AS fact, 'em_notice_' || code || '_' || date || '_' || {short("title")} AS document_id FROM f WHERE k = 1""")
def recent_announcements(spark, sf):
    f = facts.recent_announcements(_notices(spark, sf).drop("kind"), _companies(spark, sf), "1996-12-31", 60)
    return f.select("fact_id", "fact", "document_id")


@query("""
SELECT * FROM (SELECT strftime(x, '%Y%m%d') AS day FROM range(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 1 DAY) r(x))""")
def last_days(spark, sf):
    return dimensions.last_days(spark, "2024-03-01", 60)


_LANGUAGE = cases("doc_id", "'zh'", "CAST(NULL AS STRING)", "lang", "'CN'", "''")
_PASSAGES = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '  ' || text ELSE '贵州茅台营收约' || doc_id || '亿元，好于大家的预期水平。' END"


@query(f"""
WITH d AS (SELECT doc_id, {_LANGUAGE} AS lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS q, [{_PASSAGES}, 'short', text] AS docs FROM documents),
p AS (SELECT doc_id, q, unnest(range(0, 3)) AS j, unnest(docs) AS passage FROM d WHERE lower(coalesce(lang, '')) IN ('zh', 'chinese', 'cn', '')),
t AS (SELECT *, regexp_replace(passage, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS bare, regexp_extract(passage, '营收约[0-9]+亿元') AS value FROM p)
SELECT 'fcqa_sample_' || doc_id || '_doc_' || j AS document_id, 'fcqa_' || {short("substr(passage, 1, 500)")} AS fact_id, substr(bare, 1, 500) AS fact, 'FinanceComplexQA #' || doc_id || CASE WHEN coalesce(q, '') = '' THEN '' ELSE ' (Q: ' || substr(q, 1, 80) || ')' END AS source_doc,
 CASE WHEN value = '' THEN '未知' ELSE '贵州茅台' END AS entity, CASE WHEN value = '' THEN '' ELSE '营业总收入' END AS metric, CASE WHEN value = '' THEN substr(passage, 1, 200) ELSE value END AS value_text, value <> '' AS structured FROM t WHERE length(bare) >= 20""")
def passage_facts(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id AS place", f"{_LANGUAGE} AS lang", "CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS question", f"array({_PASSAGES}, 'short', text) AS docs")
    f = facts.passage_facts(d, "x/y")
    return f.select("document_id", "fact_id", "fact", "source_doc", "entity", "metric", "value_text", "structured")


_PAYLOAD = cases("c_custkey", "'\"' || c_name || '\"'", "'[\"a\", \"' || c_name || '\"]'", "'{\"k\": \"' || c_name || '\"}'", "'7'", "'null'")


@query(f"""SELECT c_custkey, {cases("c_custkey", "c_name", "'a|' || c_name", "c_name", "NULL", "NULL")} AS passages FROM customer WHERE c_custkey % 5 <> 3""")
def list_values(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 5 <> 3").select("c_custkey", facts.as_list(F.try_parse_json(F.expr(_PAYLOAD))).alias("x"))
    return c.select("c_custkey", F.array_join("x", "|").alias("passages"))


_ASKED = f"'请问' || {NAMES} || '在去年的毛利率为' || o_custkey % 90 || '%，是否高于行业平均水平？' || chr(10) || chr(10) || '### JSON'"
_KNOWN = "CASE o_orderkey % 3 WHEN 0 THEN chr(92) || 'text{毛利率} = (收入 - 成本) / 收入，编号 ' || o_orderkey ELSE '短' END"


@query(f"""
WITH o AS (SELECT CAST(o_orderkey AS STRING) AS id, o_orderpriority AS kind, {NAMES} AS name, {INDUSTRIES} AS industry, o_custkey % 90 AS share, o_orderkey % 4 AS k, o_orderkey % 3 AS known FROM orders),
q AS (SELECT *, CASE name WHEN '万科企业' THEN '万科' ELSE name END AS found, CASE WHEN k = 0 THEN '太短' ELSE '请问' || name || '在去年的毛利率为' || share || '%，是否高于行业平均水平？' END AS q, '毛利率 = (收入 - 成本) / 收入，编号 ' || id AS e FROM o)
SELECT 'fcqa_q_' || {short("id || '_q'")} AS fact_id, 'FinanceComplexQA金融问答上下文: ' || q AS fact, '毛利率' AS metric, share || '%' AS value_text, share::DOUBLE AS value_number, 'percentage' AS value_type, '%' AS unit, found AS entity, industry, 'FinanceComplexQA/' || kind || ' (id: ' || id || ')' AS source_doc, {short("id || q")} AS raw_content_hash, true AS structured FROM q WHERE k > 0
UNION ALL SELECT 'fcqa_k_' || {short("id || '_k'")}, '金融公式/领域知识: ' || e, '金融公式/知识点', e, NULL, 'text', '', found, industry, 'FinanceComplexQA/' || kind || ' (id: ' || id || ')', {short("id || e")}, false FROM q WHERE known = 0""")
def question_facts(spark, sf):
    o = table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS finqa_id", "o_orderpriority AS doc_type", f"CASE WHEN o_custkey % 5 IN (2, 3) THEN {NAMES} ELSE {NAMES} || '2022年' END AS company_with_period", f"CASE WHEN o_orderkey % 4 = 0 THEN '太短' ELSE {_ASKED} END AS question", f"{_KNOWN} AS external_knowledge")
    f = facts.question_facts(o)
    return f.select("fact_id", "fact", "metric", "value_text", "value_number", "value_type", "unit", "entity", "industry", "source_doc", "raw_content_hash", "structured")


@query(f"""
WITH l AS (SELECT 'fcqa_' || o_custkey AS qid, 'Q' || o_orderkey AS prompt, {PRICE} AS target, o_orderpriority AS kind, o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT qid, arg_max(prompt, k) AS prompt, arg_max(target, k) AS targets, arg_max(kind, k) AS task_type FROM l GROUP BY qid""")
def question_labels(spark, sf):
    o = table(spark, sf, "orders").selectExpr("CAST(o_custkey AS STRING) AS finqa_id", "'Q' || o_orderkey || chr(10) || chr(10) || '### x' AS question", f"CASE WHEN o_orderkey % 5 = 0 THEN array(chr(9) || ' ') ELSE array(chr(9) || {PRICE} || chr(10), ' ') END AS gold", "'d' AS doc_type", "o_orderpriority AS task_type", "o_orderkey AS ordinal")
    return facts.question_labels(o, ["ordinal"]).select("qid", "prompt", F.array_join("targets", "|").alias("targets"), "source.task_type")


# -- dimensions, unions, rules on rows


@query(f"""SELECT o_orderkey, {NAMES} AS entity, CASE WHEN o_orderkey % 3 = 0 THEN 'kept' ELSE {INDUSTRIES} END AS industry, o_orderkey % 3 > 0 AND NOT (o_orderkey % 3 = 1 AND {INDUSTRIES} = '未知') AS changed, {INDUSTRIES} AS renewed FROM orders""")
def enrich_industry(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{NAMES} AS entity", "CASE o_orderkey % 3 WHEN 0 THEN 'kept' WHEN 1 THEN '未知' END AS industry")
    new = dimensions.enrich_industry(o)
    return dimensions.enrich_industry(new.withColumnsRenamed({"industry": "filled", "changed": "first"}), overwrite=True).select("o_orderkey", "entity", F.col("filled").alias("industry"), F.col("first").alias("changed"), F.col("industry").alias("renewed"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def keep_codes(spark, sf):
    wanted = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("code"))
    return dimensions.keep_codes(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "code"), wanted, "code").select("c_custkey")


@query("""
WITH u AS (SELECT 0 AS source_rank, o_orderkey AS ordinal, o_custkey, o_orderstatus, NULL AS note FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT 1, o_orderkey, o_custkey, NULL, 'late' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 2, o_orderkey, o_custkey, o_orderstatus, NULL FROM orders)
SELECT ordinal, arg_min(source_rank, source_rank) AS source_rank, arg_min(coalesce(o_orderstatus, '-'), source_rank) AS status, arg_min(coalesce(note, '-'), source_rank) AS note, count(*) AS copies FROM u GROUP BY ordinal""")
def union_order(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ordinal"), "o_custkey", "o_orderstatus")
    late = o.filter("ordinal % 3 = 0").select("ordinal", "o_custkey", F.lit("late").alias("note"))
    u = dedup.union_in_order(o.filter("ordinal % 2 = 0"), late, o)
    first = dedup.keep_first(u.withColumn("copy", F.lit(1)), [F.col("ordinal")], ["source_rank", "ordinal"])
    return first.join(u.groupBy("ordinal").agg(F.count("*").alias("copies")), "ordinal").select("ordinal", "source_rank", F.coalesce("o_orderstatus", F.lit("-")).alias("status"), F.coalesce("note", F.lit("-")).alias("note"), "copies")


_RECORD = """CASE WHEN o_orderkey % 11 = 10 THEN '[1]' ELSE '{"fact_id": ' || CASE WHEN o_orderkey % 11 = 1 THEN '3' ELSE '" f' || o_orderkey || ' "' END || ', "fact": "x", "source_doc": "d", "source_type": "s", "document_id": "i", "published_at": "p", "retrieved_at": "r", "raw_content_hash": "h", "entity": "'
 || CASE WHEN o_orderkey % 11 = 2 THEN '  ' ELSE 'e' END || '", "metric": "m", "value_text": "v", "value_type": "' || CASE WHEN o_orderkey % 11 = 3 THEN 'odd' WHEN o_orderkey % 2 = 0 THEN 'amount' ELSE 'text' END || '"' || CASE WHEN o_orderkey % 11 = 4 THEN ', "source_url": "ftp://x"' ELSE ', "source_url": "https://a/b"' END
 || CASE WHEN o_orderkey % 11 = 5 THEN ', "value_number": "1"' WHEN o_orderkey % 11 = 6 THEN ', "value_number": null' ELSE ', "value_number": ' || o_custkey END || CASE WHEN o_orderkey % 11 = 7 THEN ', "related_entities": ["a", " "]' WHEN o_orderkey % 11 = 8 THEN ', "structured": 1' ELSE ', "related_entities": [" b ", "c"], "structured": false, "date": "2020"' END || CASE WHEN o_orderkey % 11 = 9 THEN ', "unit": 5}' ELSE ', "unit": null, "entity_type": null}' END END"""


@query("""
SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN 'blank_fact_id' WHEN 2 THEN 'blank_entity' WHEN 3 THEN 'unknown_value_type' WHEN 4 THEN 'bad_source_url' WHEN 5 THEN 'bad_value_number' WHEN 6 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'missing_value_number' END
 WHEN 7 THEN 'bad_related_entities' WHEN 8 THEN 'bad_structured' WHEN 9 THEN 'bad_unit' WHEN 10 THEN 'blank_fact_id' END AS error,
 CASE WHEN o_orderkey % 11 IN (0, 4, 5, 6, 7, 8, 9, 2, 3) THEN 'f' || o_orderkey END AS fact_id, CASE WHEN o_orderkey % 11 IN (5, 6, 10) THEN NULL ELSE o_custkey::DOUBLE END AS value_number, CASE WHEN o_orderkey % 11 IN (7, 8, 10) THEN '' ELSE '2020' END AS period,
 CASE WHEN o_orderkey % 11 IN (8, 10) THEN '' WHEN o_orderkey % 11 = 7 THEN 'a,' ELSE 'b,c' END AS related, o_orderkey % 11 IN (7, 8, 10) AS structured FROM orders WHERE o_orderkey % 11 <> 1""")
def record_rules(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderkey % 11 <> 1").select("o_orderkey", F.try_parse_json(F.expr(_RECORD)).alias("v"))
    return validation.parse_records(o).select("o_orderkey", "error", "fact_id", "value_number", "period", F.array_join("related_entities", ",").alias("related"), "structured")


_SAMPLE = """'{"qid": ' || CASE WHEN o_orderkey % 7 = 1 THEN '3' ELSE '" q' || o_orderkey || ' "' END || ', "prompt": "' || CASE WHEN o_orderkey % 7 = 2 THEN ' ' ELSE 'p' END || '"' || CASE WHEN o_orderkey % 7 = 3 THEN '' WHEN o_orderkey % 2 = 0 THEN ', "source": null' ELSE ', "source": {"a": 1}' END
 || ', "ground_truth": {"target": ' || CASE o_orderkey % 7 WHEN 4 THEN '[]' WHEN 5 THEN '"x"' ELSE '[" x ", "y"]' END || CASE WHEN o_orderkey % 7 = 6 THEN ', "valid_inst": 1' WHEN o_orderkey % 3 = 0 THEN ', "valid_inst": false' ELSE '' END || '}}'"""


@query("""
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'blank_qid' WHEN 2 THEN 'blank_prompt' WHEN 3 THEN 'missing_source' WHEN 4 THEN 'bad_target' WHEN 5 THEN 'bad_target' WHEN 6 THEN 'bad_valid_inst' END AS error,
 CASE o_orderkey % 7 WHEN 0 THEN 'q' || o_orderkey END AS qid, CASE o_orderkey % 7 WHEN 0 THEN 'x,y' END AS targets, CASE o_orderkey % 7 WHEN 0 THEN o_orderkey % 3 <> 0 END AS valid_inst FROM orders""")
def sample_rules(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.try_parse_json(F.expr(_SAMPLE)).alias("v"))
    fine = F.col("error").isNull()
    return validation.parse_samples(o).select("o_orderkey", "error", F.when(fine, F.col("qid")).alias("qid"), F.when(fine, F.array_join("targets", ",")).alias("targets"), F.when(fine, F.col("valid_inst")).alias("valid_inst"))


# -- questions and audits

_PAIR = """FROM (SELECT a.o_orderkey AS a_id, b.o_orderkey AS b_id, 'c' || a.o_custkey AS e, a.o_orderpriority AS m, strftime(a.o_orderdate, '%Y-%m-%d') AS d1, strftime(b.o_orderdate, '%Y-%m-%d') AS d2, (a.o_totalprice::DECIMAL(18,2))::VARCHAR AS v1, (b.o_totalprice::DECIMAL(18,2))::VARCHAR AS v2, b.o_totalprice AS p2,
 row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey::VARCHAR) AS place FROM orders a JOIN orders b USING (o_custkey, o_orderpriority)
 WHERE a.o_orderkey <> b.o_orderkey AND a.o_orderdate::DATE <> b.o_orderdate::DATE AND a.o_totalprice::DECIMAL(18,2) <> b.o_totalprice::DECIMAL(18,2)) WHERE place = 1"""
_TARGETS = f"CASE WHEN {_DIGITS.format('p2')} = v2 THEN v2 ELSE v2 || '/' || {_DIGITS.format('p2')} END"


def _first_pairs(spark, sf):
    from tallyloom.plans.catalogue import order_facts

    return synthesis.pair_facts(order_facts(spark, sf), per_root=1)


@query(f"""
SELECT 'ft_' || a_id AS qid, {_TARGETS} AS targets, v2 AS primary_target, e AS root_entity, 2 AS hop_count, 'SELECT,TEMPLATE,EXIT' AS actions, CAST(b_id AS STRING) AS target_fact_id, 'final_record_value' AS target_policy, 'same_entity_metric' AS question_policy,
 a_id || ':' || v1 || ',' || b_id || ':' || v2 AS involved, '- [' || a_id || '] ' || e || d1 || '的' || m || '为' || v1 || chr(10) || '- [' || b_id || '] ' || e || d2 || '的' || m || '为' || v2 AS facts, '- [' || b_id || '] ' || e || d2 || '的' || m || '为' || v2 AS final_fact {_PAIR}""")
def training_rows(spark, sf):
    p = _first_pairs(spark, sf)
    root, involved = F.col("root"), F.array("root", "target")
    row = synthesis.training_row(F.concat(F.lit("ft_"), root["fact_id"]), F.lit(" p "), root, involved, F.array(F.lit("SELECT"), F.lit("TEMPLATE"), F.lit("EXIT")), "kb", "same_entity_metric")
    r = p.select(row.alias("t"), synthesis.render_facts(involved).alias("chain"))
    each = F.transform("t.meta.involved_records", lambda x: F.concat(x["fact_id"], F.lit(":"), x["value_text"]))
    accepted = F.col("t.ground_truth.target")
    return r.select("t.qid", F.array_join(accepted, "/").alias("targets"), synthesis.primary_target(accepted).alias("primary_target"), "t.meta.root_entity", "t.meta.hop_count", F.array_join("t.meta.actions", ",").alias("actions"), "t.meta.target_fact_id", "t.meta.target_policy", "t.meta.question_policy", F.array_join(each, ",").alias("involved"), "chain.facts", "chain.final_fact")


_PROMPTS = cases("o_orderkey", "'另一家银行的数值是多少'", "'该数值恰好与去年相同'", "'两年数值不相同'", "'相比变化多少个百分点'", "'去年是多少'", "'是多少倍'", "'其他公司的占比约为'", "'两者在去年的差值'")
_SAID = cases("o_custkey", "'是'", "'“是”，一致'", "'不是，因为' || o_orderpriority", "CAST(NULL AS STRING)")


@query(f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey % 4 AS s, o_orderkey % 13 AS meta, o_orderkey % 5 AS few, o_orderstatus = 'F' AS same, o_orderpriority, o_orderkey % 17 = 0 AS failed FROM orders),
r AS (SELECT *, CASE WHEN meta = 0 THEN 'missing_target_alignment_metadata' WHEN few = 0 THEN NULL WHEN meta = 1 THEN 'legacy_target_alignment_unverifiable' WHEN k IN (0, 6) THEN 'multi_entity_claim_unsupported_by_involved_records'
 WHEN k = 1 AND NOT same THEN 'equality_claim_conflicts_with_involved_values' WHEN k IN (3, 5, 7) THEN 'derived_question_with_scalar_final_record_target' END AS rule FROM o)
SELECT o_orderkey, coalesce(rule, CASE WHEN failed OR s = 3 THEN 'relation_grounding_unverified' WHEN s = 2 THEN 'relation_grounding_failed' END) AS reason, CASE WHEN rule IS NULL AND failed THEN 'timeout' WHEN rule IS NULL AND s = 3 THEN 'no verdict' END AS detail,
 CASE WHEN rule IS NULL AND NOT failed AND s = 2 THEN '不是，因为' || o_orderpriority END AS verdict, CASE WHEN rule IS NULL AND NOT failed AND s < 2 THEN 'keep' ELSE 'reject' END AS decision FROM r""")
def relation_audit(spark, sf):
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PROMPTS} AS prompt", f"{_SAID} AS verdict", "o_orderkey % 13 > 0 AS has_meta", "CASE WHEN o_orderkey % 13 <> 1 THEN 'f' END AS target", "CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS failure", "o_orderstatus = 'F' AS same", "o_orderkey % 5 = 0 AS few")
    record = lambda v: F.struct(F.lit("甲银行").alias("entity"), v.alias("value_text"))
    two = F.array(record(F.lit("1")), record(F.when(F.col("same"), "1").otherwise("2")))
    records = F.when(F.col("few"), F.slice(two, 1, 1)).otherwise(two)
    out = validation.audit_relations(o, validation.alignment_reason(F.col("prompt"), F.col("has_meta"), records, F.col("target")), F.col("verdict"), F.col("failure"))
    return out.select("o_orderkey", "finding.reason", "finding.detail", "finding.verdict", "decision")


@query("""
SELECT o_custkey, string_agg('[fact ' || i || '] c' || o_custkey || ' ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'source: ' || o_orderpriority || chr(10) || 'url: u' || o_orderkey, chr(10) || chr(10) ORDER BY i) AS facts,
 string_agg('[source ' || i || '] title: ' || o_orderpriority || chr(10) || 'url: u' || o_orderkey || chr(10) || 'content: c' || o_custkey || ' ' || strftime(o_orderdate, '%Y-%m-%d'), chr(10) || chr(10) ORDER BY i) AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders QUALIFY i <= 4) GROUP BY o_custkey""")
def fact_texts(spark, sf):
    nth = F.row_number().over(dedup.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = table(spark, sf, "orders").withColumn("i", nth).filter("i <= 4").selectExpr("o_custkey", "i", f"'c' || o_custkey || ' ' || {DAY} AS fact", "o_orderpriority AS source_doc", "'u' || o_orderkey AS source_url")
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("i", "fact", "source_doc", "source_url", F.col("source_doc").alias("title"), F.col("source_url").alias("url"), F.col("fact").alias("text")))).alias("r"))
    return g.select("o_custkey", retrieval.format_facts(F.col("r")).alias("facts"), retrieval.format_evidence(F.col("r")).alias("evidence"))


@query(f"""
SELECT o_orderkey AS attempt, {cases("o_orderkey", "'select_failed'", "'difficulty'", "'answer_leak'")} AS reason, o_orderstatus AS detail, o_orderkey || '/c' || o_custkey || '/' || o_orderpriority || '/' || {DAY} AS root,
 {cases("o_orderkey", "'root_incomplete'", "'equal_dates'", "NULL", "'other_entity_or_metric'", "'equal_values'", "'target_incomplete'")} AS template FROM orders""")
def rejections(spark, sf):
    from tallyloom.plans.catalogue import order_facts

    o = order_facts(spark, sf).withColumn("reason", F.expr(cases("ordinal", "'select_failed'", "'difficulty'", "'answer_leak'")))
    k = F.col("ordinal") % 6
    blank = lambda n, c: F.when(k == n, F.lit(" ")).otherwise(F.col(c))
    root = F.struct(F.col("fact_id"), "entity", "metric", blank(0, "date").alias("date"), "value_text")
    other = F.struct(F.when(k == 3, "x").otherwise(F.col("entity")).alias("entity"), "metric", F.when(k == 1, F.col("date")).otherwise("2099-01-01").alias("date"), F.when(k == 5, F.lit(None)).when(k == 4, F.concat(F.lit(" "), "value_text")).otherwise("-1").alias("value_text"))
    r = o.select(synthesis.rejection(F.col("ordinal"), F.col("reason"), F.col("source_type"), F.struct("*")).alias("r"), synthesis.template_error(root, other).alias("template"))
    return r.select("r.attempt", "r.reason", "r.detail", F.concat_ws("/", "r.root_record.fact_id", "r.root_record.entity", "r.root_record.metric", "r.root_record.date").alias("root"), "template")


@query("""
SELECT o_orderkey, o_custkey % 4 = 1 OR o_custkey % 4 = 2 AS easy, o_orderkey % 3 = 0 AS leaks FROM orders""")
def question_gates(spark, sf):
    number = "CAST(100 + o_orderkey AS STRING)"
    guesses = cases("o_custkey", "array('zzz')", f"array('zzz', {number})", "array(CAST((100 + o_orderkey) * 1.04 AS STRING))", "array(CAST((100 + o_orderkey) * 1.06 AS STRING))")
    asked = f"CASE o_orderkey % 3 WHEN 0 THEN 'is it ' || substr({number}, 1, 1) || ' ' || substr({number}, 2) || '?' ELSE 'is it 7?' END"
    o = table(spark, sf, "orders").selectExpr("o_orderkey", f"{guesses} AS guesses", f"array({number}, '7') AS targets", f"{asked} AS question")
    return o.select("o_orderkey", rewards.too_easy(F.col("guesses"), F.col("targets")).alias("easy"), rewards.leaks_answer(F.col("question"), F.col("targets")).alias("leaks"))


@query("""
WITH r AS (SELECT event_id % 3 AS s, count(*) AS n FROM events GROUP BY 1), e AS (SELECT event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1 ORDER BY n DESC, f LIMIT 20), t AS (SELECT sum(n) AS n FROM r)
SELECT i, line FROM (
 SELECT 10 AS i, '- facts: ' || format('{:,}', (SELECT n FROM t)::BIGINT) AS line UNION ALL SELECT 11, '- entities: ' || (SELECT count(*) FROM e)
 UNION ALL SELECT 20, '| s' || s || ' | ' || format('{:,}', n) || ' | ' || round(100.0 * n / (SELECT n FROM t), 1)::DOUBLE || '% |' FROM r
 UNION ALL SELECT 30, '| ' || event_type || ' | ' || format('{:,}', n) || ' |' FROM e)""")
def report_lines(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_type AS entity", "'s' || event_id % 3 AS source_type")
    lines = audit.markdown_report(e, "report").split("\n")
    kinds = [(10 if x.startswith("- facts") else 11 if x.startswith("- entities") else 20 if x.startswith("| s") and "%" in x else 30, x) for x in lines if x.startswith("- ") or (x.startswith("| ") and any(c.isdigit() for c in x) and "filled" not in x)]
    return spark.createDataFrame(kinds, "i int, line string")
