"""Operators on small fixtures."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyloom.errors import RecordError
from tallyloom.functions import traces
from tallyloom.operators import audit, dedup, dimensions, facts, retrieval, rollout, synthesis, validation, web
from tallyloom.plans import catalogue
from tallyloom.sources import jsonl, protocols, schemas, snapshot

FACT = {"fact_id": "f1", "fact": "甲2025年营收为15.3%。", "source_doc": "d", "source_url": "", "source_type": "s", "document_id": "i", "published_at": "2025", "retrieved_at": "2025", "raw_content_hash": "h", "entity": "甲", "metric": "营收", "value_text": "15.3%", "value_type": "percentage", "value_number": 15.3, "unit": "%", "date": "2025-Q4"}


def variants(spark, rows):
    import json

    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "i int, j string").select("i", F.parse_json("j").alias("v"))


def test_keep_longest_and_first(spark):
    df = spark.createDataFrame([("k", "ab", 0), ("k", "abcd", 1), ("k", "wxyz", 2), ("l", "a", 3), (None, "n", 4)], "k string, t string, ordinal long")
    got = {(r.k, r.t, r.position.ordinal) for r in dedup.keep_longest(df, F.col("k"), "t", ["ordinal"]).collect()}
    assert got == {("k", "abcd", 0), ("l", "a", 3), (None, "n", 4)}
    assert {(r.k, r.t) for r in dedup.keep_first(df, ["k"], ["ordinal"]).collect()} == {("k", "ab"), ("l", "a"), (None, "n")}
    assert {(r.k, r.t) for r in dedup.keep_last(df, ["k"], ["ordinal"]).collect()} == {("k", "wxyz"), ("l", "a"), (None, "n")}


def test_conflicts(spark):
    df = spark.createDataFrame([("p", ["a"], 0), ("p", ["a"], 1), ("q", ["a"], 2), ("q", ["b"], 3)], "prompt string, target array<string>, ordinal long")
    got = dedup.drop_conflicts(df, "prompt", "target", ["ordinal"]).collect()
    assert [(r.prompt, r.ordinal, r.duplicates) for r in got] == [("p", 0, 1)]


def test_union_in_order(spark):
    a, b = spark.createDataFrame([(1, 0)], "x int, ordinal long"), spark.createDataFrame([(2, "z")], "x int, y string")
    got = dedup.union_in_order(a, b).orderBy("source_rank").select("x", "y", "source_rank").collect()
    assert [tuple(r) for r in got] == [(1, None, 0), (2, "z", 1)]


def test_fact_issues(spark):
    rows = [FACT, FACT | {"fact_id": ""}, FACT | {"entity": None, "value_number": None}, FACT | {"value_type": "text", "value_number": None}]
    df = spark.createDataFrame([Row(**{k: r.get(k) for k in FACT}) for r in rows], ", ".join(f"{k} {'double' if k == 'value_number' else 'string'}" for k in FACT))
    good, bad = validation.validate_facts(df)
    assert good.count() == 2
    assert {r.issue: r.n for r in validation.issue_counts(bad).collect()} == {"missing_fact_id": 1, "missing_entity": 1, "missing_value_number": 1}


RECORD_CASES = [
    ({}, None), ({"value_type": "entity", "value_number": None}, None), ({"value_number": None}, "missing_value_number"),
    ({"fact": 3}, "blank_fact"), ({"entity": "  "}, "blank_entity"), ({"source_url": "ftp://x"}, "bad_source_url"),
    ({"value_type": "odd"}, "unknown_value_type"), ({"value_number": "15"}, "bad_value_number"), ({"related_entities": ["a", " "]}, "bad_related_entities"),
    ({"related_entities": "a"}, "bad_related_entities"), ({"structured": 1}, "bad_structured"), ({"unit": 5}, "bad_unit"), ({"industry": None}, None),
]


def test_records(spark):
    got = validation.parse_records(variants(spark, [FACT | c for c, _ in RECORD_CASES])).orderBy("i").collect()
    assert [r.error for r in got] == [w for _, w in RECORD_CASES]
    assert got[0].value_number == 15.3 and got[0].unit == "%" and got[0].entity_type == "company" and got[0].period == "2025-Q4" and got[0].structured is True


def test_samples(spark):
    base = {"qid": " q ", "prompt": "p", "source": {"a": 1}, "ground_truth": {"target": [" x ", "y"]}}
    cases = [(base, None), (base | {"source": None}, None), ({k: v for k, v in base.items() if k != "source"}, "missing_source"), (base | {"qid": 3}, "blank_qid"), (base | {"ground_truth": {"target": "x"}}, "bad_target"), (base | {"ground_truth": {"target": []}}, "bad_target"), (base | {"ground_truth": {"target": ["x"], "valid_inst": "yes"}}, "bad_valid_inst")]
    got = validation.parse_samples(variants(spark, [c for c, _ in cases])).orderBy("i").collect()
    assert [r.error for r in got] == [w for _, w in cases]
    assert got[0].qid == "q" and got[0].targets == ["x", "y"] and got[0].valid_inst is True


ALIGNMENT = [
    ("另一家银行的数值与它相同吗", True, "f", "multi_entity_claim_unsupported_by_involved_records"), ("该数值恰好与去年相同", True, "f", "equality_claim_conflicts_with_involved_values"),
    ("两年数值不相同", True, "f", None), ("相比变化多少个百分点", True, "f", "derived_question_with_scalar_final_record_target"), ("去年是多少", True, "f", None),
    ("去年是多少", True, None, "legacy_target_alignment_unverifiable"), ("去年是多少", False, "f", "missing_target_alignment_metadata"),
]


def test_alignment(spark):
    df = spark.createDataFrame([(i, p, m, t) for i, (p, m, t, _) in enumerate(ALIGNMENT)], "i int, p string, m boolean, t string")
    records = F.array(*[F.struct(F.lit("甲银行").alias("entity"), F.lit(v).alias("value_text")) for v in ("-16.81%", "8.16%")])
    got = df.withColumn("r", validation.alignment_reason(F.col("p"), F.col("m"), records, F.col("t"))).orderBy("i").collect()
    assert [r.r for r in got] == [w for *_, w in ALIGNMENT]


def test_findings_and_verdicts(spark):
    df = spark.createDataFrame([("a", " 是"), ("b", "不是" * 200), (None, None)], "qid string, verdict string")
    assert [r.qid for r in validation.without_findings(df, spark.createDataFrame([("a",), ("None",)], "qid string")).collect()] == ["b"]
    got = validation.audit_relations(df, F.lit(None).cast("string"), F.col("verdict")).collect()
    assert [(r.decision, r.finding and tuple(r.finding)) for r in got] == [("keep", None), ("reject", ("relation_grounding_failed", None, "不是" * 120)), ("reject", ("relation_grounding_unverified", "no verdict", None))]
    late = validation.audit_relations(df, F.lit(None).cast("string"), F.col("verdict"), F.when(F.col("qid") == "a", "timeout")).collect()
    assert [(r.finding.reason, r.finding.detail) for r in late] == [("relation_grounding_unverified", "timeout"), ("relation_grounding_failed", None), ("relation_grounding_unverified", "no verdict")]


def test_gates(spark):
    df = spark.createDataFrame([("a", "p", True), ("b", "p", False)], "qid string, prompt string, valid_inst boolean")
    g = validation.dataset_gate(df).first()
    assert (g.n, g.answerable, g.unanswerable, g.ok, g.trainable) == (2, 1, 1, True, False)
    assert validation.dataset_gate(df.limit(0)).first().ok is False
    with pytest.raises(Exception, match="not trainable"):
        validation.require(validation.dataset_gate(df), "trainable", "not trainable").collect()
    assert validation.config_errors({"batch_size": 8, "num_generations": 4}) == []
    assert len(validation.config_errors({"batch_size": 7, "num_generations": 4, "max_steps": 2, "use_vllm": True, "trace_path": "x", "trace_exists": True})) == 3


def test_industry(spark):
    df = spark.createDataFrame([("贵州茅台", ""), ("万科企业", ""), ("某行", "Bank_Financial_Statements"), ("某", "x"), ("", ""), (None, None)], "e string, d string")
    got = [r[0] for r in df.select(dimensions.infer_industry(F.col("e"), F.col("d"))).collect()]
    assert got == ["白酒", "地产", "银行", "未知", "未知", "未知"]
    e = spark.createDataFrame([("贵州茅台", "x"), ("贵州茅台", None)], "entity string, industry string")
    assert [(r.industry, r.changed) for r in dimensions.enrich_industry(e).collect()] == [("x", False), ("白酒", True)]
    assert [r.industry for r in dimensions.enrich_industry(e, overwrite=True).collect()] == ["白酒", "白酒"]


def test_titles_and_codes(spark):
    names = dimensions.companies(spark).select("code", "name").withColumn("o", F.monotonically_increasing_id())
    df = spark.createDataFrame([("平安银行与贵州茅台", None), ("公告", "600519"), ("无", None)], "title string, code string")
    got = dimensions.name_in_title(df, "title", names, "name", "o", "code", "code").collect()
    assert [r.matched for r in got] == ["贵州茅台", "贵州茅台", None]
    many = dimensions.name_in_title(df, "title", names, "name", "o", "code", "code", limit=5).collect()
    assert {r.title: r.matched for r in many} == {r.title: r.matched for r in got}
    assert dimensions.keep_codes(names, spark.createDataFrame([("600519",), ("600519",)], "code string"), "code").count() == 1
    assert [r.day for r in dimensions.last_days(spark, "2025-03-02", 3).collect()] == ["20250227", "20250228", "20250301"]


def test_abstract_and_report_facts(spark):
    wide = spark.createDataFrame([("600519", "贵州茅台", "2025-06-30", "1.47亿", "NaN", None), ("1", "x", "", "1", "1", "1")], "code string, name string, `报告期` string, `净利润` string, `销售毛利率` string, `流动比率` string")
    got = facts.abstract_facts(wide).collect()
    assert [(r.metric, r.date, r.value_number, r.value_type, r.industry) for r in got] == [("净利润", "2025-Q2", 1.47, "amount", "白酒")]
    assert got[0].fact == "贵州茅台2025-Q2净利润为1.47亿。" and got[0].fact_id.startswith("fina_") and len(got[0].fact_id) == 21
    cols = "name string, broker string, title string, date string, rating string, eps_2025 double, pe_2025 double, code string"
    reports = spark.createDataFrame([("甲", "B1", "t", "2025-01-01", "买入", 1.5, None, "1"), ("甲", "B2", "t", "2025-01-01", "False", float("nan"), 9.0, "1"), ("甲", "B3", "nan", "2025-01-01", "买入", 1.0, 1.0, "1")], cols)
    r = {x.metric: x for x in facts.report_facts(reports, ["2025"], F.lit("2026-01-01")).collect()}
    assert set(r) == {"东财评级", "2025预测每股收益", "2025预测市盈率"} and all(x.retrieved_at == "2026-01-01" for x in r.values())
    assert r["东财评级"].fact == "甲在2025-01-01获B1研报评级为「买入」，报告标题：《t》。" and r["东财评级"].fact_id.startswith("rrpt_")
    assert r["2025预测每股收益"].fact == "甲2025-01-012025预测每股收益为1.5，来源：B1于2025-01-01发布的研报。" and r["2025预测每股收益"].source_doc == "研报《t》(B1)"


def test_question_sources(spark):
    rows = spark.createDataFrame([("贵州茅台2022", "1", "贵州茅台2022年的毛利率为91.5%，请问是否高于行业平均水平？\n\n###格式", r"\text{毛利率}=（收入-成本）/收入，这是常见的定义公式", ["91.5%", " "], "Corporate", "t", 0), ("甲", "1", "贵州茅台2022年的毛利率为91.5%，请问是否高于行业平均水平？", None, ["92%"], "Corporate", "t", 1), ("甲", "2", "短", None, [], "d", "t", 2)], "company_with_period string, finqa_id string, question string, external_knowledge string, gold array<string>, doc_type string, task_type string, o int")
    got = facts.question_facts(rows).collect()
    assert [(r.metric, r.value_number, r.structured) for r in got] == [("毛利率", 91.5, True), ("金融公式/知识点", None, False), ("毛利率", 91.5, True)]
    assert not any("92%" in r.fact for r in got)
    labels = facts.question_labels(rows, ["o"]).collect()
    assert [(r.qid, r.targets) for r in labels] == [("fcqa_1", ["92%"])]
    lists = variants(spark, ["one", ["a", "b"], {"k": "v"}, None]).orderBy("i").select(facts.as_list(F.col("v")).alias("x"))
    assert [r.x for r in lists.collect()] == [["one"], ["a", "b"], ["v"], None]


def test_announcements(spark):
    rows = spark.createDataFrame([("1", "甲", "t", "年报", "2025-01-01", "", 1), ("1", "甲", "t", "季报", "2025-01-02", "", 0), ("2", None, "nan", "x", "2025-01-02", "", 2)], "code string, name string, title string, kind string, date string, url string, o int")
    got = facts.announcement_facts(rows, ["o"]).collect()
    assert [(r.metric, r.date, r.fact, r.source_doc) for r in got] == [("公告", "2025-01-02", "甲于2025-01-02发布季报公告：《t》。", "公告《t》(甲)")]
    companies = spark.createDataFrame([("1", "甲乙", 0), ("2", "丙丁", 1)], "code string, name string, place int")
    rows = spark.createDataFrame([("9", "关于丙丁", "20250102", 0), ("1", "a", "20250101", 1), ("1", "a", "20250102", 2), ("9", "无", "20250102", 3), ("1", "旧", "20240101", 4)], "code string, title string, day string, ordinal int").withColumn("date", F.col("day")).withColumn("url", F.lit("u")).withColumn("kind", F.lit("k"))
    got = facts.recent_announcements(rows.drop("kind"), companies, "2025-01-03", 5).collect()
    assert {(r.entity, r.value_text, r.date, r.fact_id[:6]) for r in got} == {("丙丁", "关于丙丁", "20250102", "anno2_"), ("甲乙", "a", "20250102", "anno2_")}
    got = facts.requested_announcements(rows, companies, ["20250101", "20250102"], ["k"]).collect()
    assert [(r.entity, r.value_text, r.date) for r in got] == [("甲乙", "a", "20250101")]


def test_passages(spark):
    rows = spark.createDataFrame([(0, "q", "zh", ["短", "贵州茅台的营收约12亿元，高于大家一致的预期。" + "好" * 600]), (1, None, "en", ["x" * 40]), (2, "", None, None)], "place int, question string, lang string, docs array<string>")
    (r,) = facts.passage_facts(rows, "a/b").collect()
    assert (r.entity, r.metric, r.value_text, r.structured, r.document_id, r.source_doc) == ("贵州茅台", "营业总收入", "营收约12亿元", True, "fcqa_sample_0_doc_1", "FinanceComplexQA #0 (Q: q)")
    assert len(r.fact) == 500 and r.source_url.endswith("a/b") and r.retrieved_at


def test_search(spark):
    recs = spark.createDataFrame([(str(i), "甲", "m", str(i), "doc", [float(i % 3), 1.0]) for i in range(7)], "fact_id string, entity string, metric string, value_text string, source_doc string, embedding array<float>")
    q = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, " ", [1.0, 0.0])], "query_id int, query string, vector array<float>")
    got = retrieval.search(q, recs, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.fact_id, r.score) for r in got] == [(1, "2", 2.0), (1, "5", 2.0), (1, "1", 1.0)]
    assert retrieval.search(q, recs, 3, few_bytes=0, blocks=3).orderBy("query_id", "rank").select(*got[0].asDict()).collect() == got
    assert retrieval.search(q, recs, 0).count() == 0 and retrieval.search(q, recs, 99).count() == 7
    with pytest.raises(ValueError, match="at least 1"):
        retrieval.search(q, recs, 0, strict=True)
    with pytest.raises(Exception, match="blank"):
        retrieval.search(q, recs, 3, strict=True).collect()
    text = retrieval.retrieve(retrieval.search(q, recs, 2), ["entity", "metric", "value_text", "source_doc"]).first().text
    assert text.startswith("搜索结果（共 2 条）：\n\n1. [甲] m: 2 （来源: doc）\n2. ") and '<!-- metadata: {"records": [{' in text and "score" not in text
    nothing = spark.range(1).select(retrieval.format_results(F.lit("q"), F.array().cast("array<struct<entity:string,metric:string,value_text:string,source_doc:string>>")).alias("t")).first().t
    assert nothing == '[search] 未找到与 "q" 相关的结果。'


def test_search_in_passes_and_tiles(spark, monkeypatch):
    """Several batches, tiles and passes, repeated vectors, other lengths and NaN, against plain sums from left to right."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 24)).astype("float32")
    vectors[rng.random(900) < 0.4] = vectors[0]
    rows = [(f"{i:03d}", v.tolist()) for i, v in enumerate(vectors)] + [("x", [1.0]), ("y", None), ("z", [float("nan")] + [0.0] * 23)]
    asked = [(i, f"q{i}", vectors[i].tolist()) for i in range(0, 900, 30)]
    want = []
    for i, _, a in asked:
        total = np.zeros(900)
        for d in range(24):
            total += float(a[d]) * vectors[:, d].astype(float)
        best = sorted(range(900), key=lambda j: (-total[j], j))[:4]  # noqa: B023
        want += [(i, 1, "z", None), *((i, n + 2, f"{j:03d}", total[j]) for n, j in enumerate(best))]
    recs, q = spark.createDataFrame(rows, "fact_id string, embedding array<float>").repartition(3), spark.createDataFrame(asked, "query_id int, query string, vector array<float>")
    held, tile = [], retrieval._pass
    monkeypatch.setattr(retrieval, "_pass", lambda asked, *rest: held.append(asked.count()) or tile(asked, *rest))
    monkeypatch.setattr(retrieval, "TILE", 7)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        for few in (8 << 20, 2048):
            held.clear()
            got = sorted((r.query_id, r["rank"], r.fact_id, None if r.score != r.score else r.score) for r in retrieval.search(q, recs, 5, few_bytes=few, blocks=3).collect())
            assert got == want and sum(held) == 30 and (max(held) == 30 if few > 2048 else max(held) < 12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def test_question_facts_run_each_pattern_once(spark):
    cols = ("finqa_id", "doc_type", "company_with_period", "question", "external_knowledge")
    df = facts.question_facts(spark.range(3).select(*[F.concat(F.lit("x"), F.col("id").cast("string")).alias(c) for c in cols]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("同比(?:增长|增速") < 20, plan.count("同比(?:增长|增速")


def test_web_ranking(spark):
    hits = spark.createDataFrame([("q", "https://a.com/long/path", 0), ("q", "https://b.com", 1), ("q", "https://www.sse.com.cn/x", 2), ("q", "https://fake-sse.com.cn", 3)], "query string, url string, place int")
    got = [r.url for r in retrieval.rank_hits(hits, limit=3).orderBy("rank").collect()]
    assert got == ["https://www.sse.com.cn/x", "https://b.com", "https://a.com/long/path"]
    got = [r.url for r in retrieval.rank_hits(hits, limit=1, readable=~F.contains("url", F.lit("sse"))).collect()]
    assert got == ["https://b.com"]
    df = spark.createDataFrame([(u,) for u in ("https://a.com", "http://localhost/", "http://10.0.0.1/", "ftp://a", "http://printer.local", "http://172.20.1.1", "https://8.8.8.8", None)], "u string")
    assert [r[0] for r in df.select(retrieval.is_public_url(F.col("u"))).collect()] == [True, False, False, False, False, False, True, False]
    df = spark.createDataFrame([("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2Fx&rut=1",), ("https://b.com",)], "u string")
    assert [r[0] for r in df.select(retrieval.unwrap_redirect(F.col("u"))).collect()] == ["https://a.com/x", "https://b.com"]


def test_cache(spark):
    cache = spark.createDataFrame([("q1", "t1")], "q string, text string").select(retrieval.cache_key(F.col("q")).alias("key"), F.current_timestamp().alias("created_at"), "text", F.lit("{}").alias("metadata"))
    hits, misses = retrieval.replay(spark.createDataFrame([(" q1 ",), ("q2",)], "query string"), cache)
    assert [(r.query, r.text, r.cached) for r in hits.collect()] == [(" q1 ", "t1", True)] and [r.query for r in misses.collect()] == ["q2"]
    new = retrieval.cache_entries(misses.select("query", F.lit("t").alias("text"), F.lit("{}").alias("metadata")))
    assert new.columns == ["key", "created_at", "text", "metadata"]


def test_payloads(spark):
    df = spark.createDataFrame([('"a"',), ('{"text": "b", "n": 1}',), ('{"n": 1}',), ("{",)], "p string")
    got = [r[0] for r in df.select(retrieval.normalise_payload(F.col("p"))).collect()]
    assert [g and g.text for g in got] == ["a", "b", None, None] and got[1].metadata == '{"n":1}'


def test_visible_text_of_a_long_page(spark):
    df = spark.createDataFrame([("<p>" + "word " * 3000 + "end</p>",)], "html string")
    r = df.select(web.visible_text(F.col("html")).alias("whole"), web.visible_text(F.col("html"), 6000).alias("cut")).first()
    assert r.whole == "word " * 3000 + "end" and r.cut == r.whole[:6000]


def test_html():
    assert web.visible("<svg><svg>no</svg>no</svg><p>a &amp; <b>b</b></p><script>x</script>") == "a & b"
    assert web.visible("<style>x</style>") is None and web.visible(None) is None
    assert web.links('<a class="x result__a" href="/u">T <b>1</b></a><a href="/v">no</a>') == [{"title": "T 1", "url": "/u"}]


def test_open_references(spark):
    page = "<p>a&amp b &copy; &amp;amp &#39; &notit; &am &amp;copy; c&amp</p>"
    assert web.visible(page) == "a& b © &amp ' ¬it; &am &copy; c&"
    assert web.visible(page, open_references=False) == "a&amp b © &amp ' &notit; &am &copy; c&amp"


def test_pages_with_open_references(spark, tmp_path):
    """A page cut within a reference, as some of sf0.1 are, against the queries' SQL."""
    pages = [(i, f"http://a.org/{i}", f"<title>x and&amp</title><h1>x and&amp</h1><p>y &amp; z{i}</p>") for i in range(4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("visible_text", "page_reader"):
        got = sorted(tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(catalogue.oracle_sql()[name]).fetchall()) and "and&amp x and&amp" in got[1][1]


def test_event_stream(spark):
    body = 'data: {"choices":[{"delta":{"content":"年"}}]}\n\ndata: {"choices":[{"delta":{}}]}\ndata: {"choices":[{"delta":{"content":"报"}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"x"}}]}'
    df = spark.createDataFrame([(body,), ("",)], "b string")
    assert [r[0] for r in df.select(web.decode_event_stream(F.col("b"))).collect()] == ["年报", None]


def facts_df(spark, rows):
    cols = "fact_id string, entity string, metric string, date string, value_text string, value_number double, unit string, structured boolean, fact string"
    return spark.createDataFrame(rows, cols)


def test_pairs_and_questions(spark):
    df = facts_df(spark, [("1", "甲", "m", "2024", "1%", 1.0, "%", True, "x"), ("2", "甲", "m", "2025", "2%", 2.0, "%", True, "y"), ("3", "甲", "m", "2026", "2%", 2.0, "%", True, "z"), ("4", "甲", "m", "2027", "", 3.0, "%", True, "z"), ("5", "甲", "m", "2028", "5%", float("inf"), "%", True, "z"), ("6", "甲", "m", " ", "6%", 6.0, "%", True, "z"), ("7", "甲", "m", "2029", "7%", 7.0, "%", None, "z")])
    pairs = synthesis.pair_facts(df)
    assert {(r.root.fact_id, r.target.fact_id) for r in pairs.collect()} == {("1", "2"), ("1", "3"), ("2", "1"), ("3", "1")}
    q = synthesis.pair_facts(df, per_root=1).filter("root.fact_id = '1'").select(synthesis.lookup_question(F.col("root"), F.col("target")).alias("q"), synthesis.template_error(F.col("root"), F.col("target")).alias("e")).first()
    assert q.q == "某家上市公司在2024披露的m为1%；请问该公司在2025的m具体是多少？" and q.e is None and "甲" not in q.q and "2%" not in q.q
    row = pairs.filter("root.fact_id = '1' and target.fact_id = '2'").select(synthesis.training_row(F.lit("ft_1"), F.lit(" p "), F.col("root"), F.array("root", "target"), F.array(F.lit("SELECT")), "kb", "template").alias("t"), synthesis.render_facts(F.array("root", "target")).alias("f"), synthesis.render_candidates(F.array("target")).alias("c"), synthesis.rejection(F.lit(1), F.lit("r"), F.lit("d"), F.col("root")).alias("x")).first()
    assert row.t.ground_truth.target == ["2%"] and row.t.meta.hop_count == 2 and row.t.prompt == "p" and row.t.meta.target_fact_id == "2" and row.x.root_record.fact_id == "1"
    assert row.f.facts == "- [1] 甲2024的m为1%\n- [2] 甲2025的m为2%" and row.f.final_fact == "- [2] 甲2025的m为2%" and row.c == "1. [2] y"


def test_template_errors(spark):
    same = facts_df(spark, [("1", "甲", "m", "2024", "1%", 1.0, "%", True, "x")]).select(F.struct("*").alias("r"))
    assert "equal_dates" == same.select(synthesis.template_error(F.col("r"), F.col("r"))).first()[0]


def test_numbering_and_round_robin(spark):
    df = spark.range(25).select((24 - F.col("id")).alias("x"))
    got = synthesis.number_rows(df.repartition(5), ["x"]).orderBy("x").collect()
    assert [r.qid for r in got] == [f"ft_{i:05d}" for i in range(1, 26)]
    roots = synthesis.round_robin_roots(facts_df(spark, [(str(i), "甲乙丙"[i % 3], "m", "d", "1", 1.0, "", True, "f") for i in range(9)]), 6).collect()
    assert len(roots) == 6 and len({r.entity for r in roots if r.attempt < 3}) == 3


def test_sampling(spark):
    df = facts_df(spark, [(str(i), "甲乙"[i % 2], "m", "d", "1", 1.0, "", True, "f") for i in range(10)])
    assert retrieval.sample_facts(df, 99).count() == 10 and retrieval.sample_facts(df, 3, entity="甲").filter("entity = '甲'").count() == 3
    assert retrieval.sample_facts(df, 3, entity="丙").count() == 0 and retrieval.sample_facts(df, 4, 1).collect() == retrieval.sample_facts(df, 4, 1).collect()


def test_replay(spark):
    s, a = "<think>t</think><search>{}</search>", "<think>t</think><answer>{}</answer>"
    rows = [("ok", 0, s.format("q1"), "o1"), ("ok", 1, s.format("q2"), "o2"), ("ok", 2, a.format("x"), None), ("ok", 3, a.format("late"), None), ("rep", 0, s.format("annual report"), "o"), ("rep", 1, s.format("ANNUAL REPORT"), "o"), ("bad", 0, "<search>x", None), ("long", 0, s.format("1"), "o"), ("long", 1, s.format("2"), "o"), ("long", 2, s.format("3"), "o"), ("long", 3, s.format("4"), "o")]
    df = spark.createDataFrame(rows, "rollout_id string, turn int, text string, observation string")
    got = {r.rollout_id: r for r in rollout.replay_turns(df, 3).collect()}
    assert {k: (r.termination, r.num_rounds, len(r.search_steps)) for k, r in got.items()} == {"ok": ("answer", 3, 2), "rep": ("repeated_query", 2, 1), "bad": ("malformed_action", 1, 0), "long": ("max_rounds", 3, 3)}
    assert got["ok"].final_answer == "x" and got["ok"].completed and [p.owner[0] for p in got["ok"].segments] == list("aeaea")


def test_trajectories_and_metadata(spark):
    df = spark.createDataFrame([("<think>a</think><search>q</search><search>q</search><answer> x </answer>", ["r"])], "raw_text string, tool_results array<string>")
    t = rollout.trajectories(df).first()
    assert t.final_answer == "x" and t.is_repeated_query and t.num_rounds == 2 and [s.retrieved_text for s in t.search_steps] == ["r", ""]
    known = spark.createDataFrame([("p", 1)], "prompt string, m int")
    assert rollout.with_metadata(spark.createDataFrame([("p",)], "prompt string"), known).count() == 1
    with pytest.raises(Exception, match="metadata"):
        rollout.with_metadata(spark.createDataFrame([("z",)], "prompt string"), known).collect()


def audit_df(spark, qids, totals):
    reward = ", ".join(f"{p}:double" for p in audit.PARTS)
    cols = f"qid string, ordinal int, final_answer string, searches array<struct<query:string>>, is_repeated_query boolean, num_rounds int, reward struct<{reward},terminated_with_zero:boolean>"
    return spark.createDataFrame([(q, i, "a" if i % 2 else "", [("q",)], False, 2, (0.1, 0.1, 0.1, 0.1, 0.1, float(t), t == 0)) for i, (q, t) in enumerate(zip(qids, totals, strict=True))], cols)


def test_health(spark):
    s = audit.health_summary(audit_df(spark, "AABA", [0.1, 0.1, 0.5, 0.0]).repartition(3)).first()
    assert (s.trajectories, s.prompt_groups, s.zero_reward_std_group_rate) == (4, 3, 1.0) and s.reward_mean == pytest.approx(0.175) and s.answer_rate == 0.5
    flat = audit_df(spark, "AABA", [0, 0, 0, 0]).select("qid", "ordinal", F.lit(1).alias("v"))
    assert sorted((r.run, r.key, r.n) for r in audit.run_table(flat, "qid", "ordinal", "v").collect()) == [(1, "A", 2), (2, "B", 1), (3, "A", 1)]
    assert audit.reward_metrics(audit_df(spark, "", [])).count() == 0
    with pytest.raises(Exception, match="no rows"):
        audit.health_summary(audit_df(spark, "", [])).collect()


def test_report(spark):
    df = spark.createDataFrame([("甲", "s", "text", "train", "u", True), ("乙", "s", "text", "val", "", True)], "entity string, source_type string, value_type string, segment string, source_url string, structured boolean")
    text = audit.markdown_report(df, "Facts")
    assert "- facts: 2" in text and "| train | 1 | 50.0% |" in text and "| source_url | 50% |" in text


def test_audit_rows(spark):
    steps = F.array(F.struct(F.lit("q").alias("query"), F.lit("x" * 600).alias("retrieved_text"), F.array(F.lit(1)).alias("retrieved_records")))
    df = spark.range(1).select(F.lit("q").alias("qid"), F.lit("p").alias("prompt"), F.array(F.lit("t")).alias("targets"), F.lit("r").alias("raw_text"), F.lit("a").alias("final_answer"), F.lit(1).alias("num_rounds"), F.lit(False).alias("is_repeated_query"), steps.alias("search_steps"), F.struct(F.lit("t").alias("target"), F.struct(F.lit(1.0).alias("total")).alias("reward")).alias("best"))
    s = audit.audit_rows(df).first().searches[0]
    assert (s.retrieved_characters, len(s.retrieved_preview), s.retrieved_record_count) == (600, 500, 1)


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"qid": 3}\n\n[1]\n{bad\n{"qid": null}\n', encoding="utf-8")
    rows = jsonl.read_variant(spark, str(p)).orderBy("line").collect()
    assert [r.error for r in rows] == [None, "not an object", "invalid JSON", None]
    with pytest.raises(Exception, match="invalid JSON|not an object"):
        jsonl.read_strict(spark, str(p)).collect()
    assert jsonl.read_lenient(spark, str(tmp_path / "none.jsonl"), schemas.FACT).count() == 0
    good, bad = jsonl.read_quarantine(spark, str(p), schemas.FACT)
    assert bad.count() == 2 and good.count() == 2
    df = spark.createDataFrame([("a", "keep", "train"), ("b", "reject", "test")], "x string, decision string, split string")
    jsonl.write_decided(df, str(tmp_path / "k"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "k")).count() == 1
    with pytest.raises(Exception, match="(?i)exists"):
        jsonl.write_decided(df, str(tmp_path / "k"), str(tmp_path / "r2"))
    with pytest.raises(ValueError, match="different"):
        jsonl.write_decided(df, "x", "x")
    jsonl.write_splits(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").exists()
    assert jsonl.read_variant(spark, str(tmp_path), recursive=True).count() == 4


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", [3.0, 4.0]), ("b", "y", [0.0, 2.0])], "fact_id string, fact string, embedding array<float>")
    snapshot.write_snapshot(df, str(tmp_path / "s"), model="m")
    got = snapshot.read_snapshot(spark, str(tmp_path / "s"), model="m")
    assert got.count() == 2 and got.filter("fact_id = 'a'").first().embedding == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError, match="made with"):
        snapshot.read_snapshot(spark, str(tmp_path / "s"), model="other")
    spark.createDataFrame([("c", "z", [1.0, 0.0])], "fact_id string, fact string, embedding array<float>").write.mode("append").parquet(str(tmp_path / "s" / "records"))
    with pytest.raises(ValueError, match="manifest"):
        snapshot.read_snapshot(spark, str(tmp_path / "s"))


def test_protocols(spark):
    class Upper:
        def __call__(self, texts):
            if texts[0] == "bad":
                raise RuntimeError("no")
            return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",)], "t string")
    got = {r.t: (r.o, r.o_error) for r in protocols.apply_text(df, "t", "o", Upper).collect()}
    assert got == {"a": ("A", None), "bad": (None, "RuntimeError: no")}
    tries = []
    with pytest.raises(ZeroDivisionError):
        protocols.retry(lambda: tries.append(1) or 1 / 0, 3, 1.0, lambda s: tries.append(s))
    assert tries == [1, 1.0, 1, 2.0, 1]
    with pytest.raises(ValueError, match="unknown"):
        protocols.choose("x", {"kb": list})


def test_streaming(spark, tmp_path):
    from tallyloom.streaming import ingest

    jsonl.write(spark.createDataFrame([(FACT["fact_id"], FACT["fact"], "甲", "m", "1", "s"), ("g", "f", "甲", "m", "1", "s"), ("", "f", "甲", "m", "2", "s")], "fact_id string, fact string, entity string, metric string, value_text string, source_type string"), str(tmp_path / "in"))
    q = ingest.append_audits(ingest.fresh_facts(ingest.fact_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_chat(spark):
    p = spark.range(1).select(traces.chat_prompt(F.lit("u"), "s")).first()[0]
    assert p == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\n"


def test_first_targets_hold_all_roots_targets(spark):
    import random

    rng = random.Random(4)
    rows = [(f"{i:03}", "甲", "m", f"d{rng.randrange(6)}", f"{rng.randrange(4)}", 1.0, "", True, "f") for i in range(120)] + [(f"x{i}", "乙", "m", f"d{i}", "1", 1.0, "", True, "f") for i in range(20)]
    df = facts_df(spark, rows).repartition(4)
    for k in (1, 2, 3):
        got = {(r.root.fact_id, r.target.fact_id, r.place) for r in synthesis.pair_facts(df, per_root=k).collect()}
        want = set()
        for a in rows:
            fit = sorted((b[3], b[0]) for b in rows if b[1:3] == a[1:3] and b[3] != a[3] and b[4] != a[4])[:k]
            want |= {(a[0], t, i + 1) for i, (_, t) in enumerate(fit)}
        assert got == want
    counts = {r.fact_id: r.targets for r in synthesis.target_counts(df).collect()}
    assert counts == {a[0]: sum(b[1:3] == a[1:3] and b[3] != a[3] and b[4] != a[4] for b in rows) for a in rows}


def test_line_numbers(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n' + ("broken\n" if name != "b" else '{"x": 3}\n[1]\n'), encoding="utf-8")
    got = sorted((r.path[-7:], r.line, r.error) for r in jsonl.read_variant(spark, str(tmp_path)).collect())
    assert got == [("a.jsonl", 1, None), ("a.jsonl", 3, None), ("a.jsonl", 4, "invalid JSON"), ("b.jsonl", 1, None), ("b.jsonl", 3, None), ("b.jsonl", 4, None), ("b.jsonl", 5, "not an object"), ("c.jsonl", 1, None), ("c.jsonl", 3, None), ("c.jsonl", 4, "invalid JSON")]
    with pytest.raises(Exception, match=r"b.jsonl:5:not an object"):
        jsonl.read_strict(spark, str(tmp_path / "b.jsonl")).collect()
    long = tmp_path / "long.jsonl"
    long.write_text("".join(f'{{"qid": "q{i}", "prompt": "p", "source": null, "ground_truth": {{"target": ["a"]}}}}\n' for i in range(5000)) + '{"qid": ""}\n', encoding="utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # many pieces of one file
        rows = jsonl.read_variant(spark, str(long)).select("line", F.try_variant_get("v", "$.qid", "string").alias("q")).collect()
        assert len(rows) == 5001 and all(r.q == f"q{r.line - 1}" for r in rows if r.line <= 5000)
        with pytest.raises(Exception, match=r"long.jsonl:5001:blank_qid"):
            jsonl.read_samples(spark, str(long)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_page_reader(spark):
    rows = [("text/html", "<p>a <b>b</b></p>"), ("TEXT/PLAIN; charset=x", " a\n b "), ("image/png", "x"), (None, "x"), ("text/html", "<style>x</style>")]
    df = spark.createDataFrame(rows, "t string, b string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(web.page_text(F.col("t"), F.col("b"))).collect()]
    assert got == [("a b", None), ("a b", None), (None, "unsupported_content_type"), (None, "unsupported_content_type"), (None, "no_text")]


def test_records_of_a_snapshot(spark, tmp_path):
    good = {k: v for k, v in FACT.items()}
    names = [k for k in good if k != "value_number"]
    df = spark.createDataFrame([(*[str(good[k]) if k != "structured" else good[k] for k in names], 1.5, [3.0, 4.0])], ", ".join(f"{k} {'boolean' if k == 'structured' else 'string'}" for k in names) + ", value_number double, embedding array<float>")
    snapshot.write_snapshot(df, str(tmp_path / "a"), model="m")
    (r,) = snapshot.load_records(spark, str(tmp_path / "a"), model="m").collect()
    assert r.fact_id == "f1" and r.embedding == pytest.approx([0.6, 0.8]) and r.value_number == 1.5
    snapshot.write_snapshot(df.withColumn("entity", F.lit(" ")), str(tmp_path / "b"), model="m")
    with pytest.raises(Exception, match="f1: blank_entity"):
        snapshot.load_records(spark, str(tmp_path / "b"), model="m").collect()
    with pytest.raises(RecordError):
        snapshot.load_records(spark, str(tmp_path / "b"), model="other")
