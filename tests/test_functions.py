"""Column functions against restated fixtures and plain Python."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import keys, rewards, text, traces, values


def one(spark, column, **row):
    """The value of a column over one row of texts."""
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)) if row else spark.range(1)
    return df.select(column.alias("v")).first()[0]


def many(spark, make, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in df.withColumn("v", make(F.col("x"))).orderBy("i").select("v").collect()]


VALUES = [
    (None, (None, "", None, "")), ("N/A", (None, "", None, "")), ("12.5", (12.5, "raw", "CNY", "")), ("1.47亿", (1.47, "亿", "CNY", "亿")),
    ("46.84%", (46.84, "%", None, "")), ("x%", (None, "%", None, "")), ("0.43", (0.43, "raw", "CNY", "")), ("1.2万亿", (1.2, "万亿", "CNY", "万亿")),
    ("1,234万", (1234.0, "万", "CNY", "万")), ("abc", (None, "abc", "CNY", "")), ("　－１２．５％ ", (-12.5, "%", None, "")), ("", (None, "", None, "")), ("3万亿元", (3.0, "万亿元", "CNY", "万亿")),
]


def test_parse_value(spark):
    got = many(spark, values.parse_value, [v for v, _ in VALUES])
    assert [tuple(g) for g in got] == [w for _, w in VALUES]


def test_parse_value_legacy(spark):
    a, b = many(spark, lambda x: values.parse_value(x, legacy=True), ["1.2万亿", "1,234万"])
    assert tuple(a) == (1.2, "亿", "CNY", "亿") and tuple(b) == (1.0, "万", "CNY", "万")


def test_parse_answer_value(spark):
    got = many(spark, values.parse_answer_value, ["1,234万", "约5.5亿元", "1,000", "7%", "", "无"])
    assert [tuple(g) for g in got] == [(1234.0, "万", "CNY", "万"), (5.5, "亿元", "CNY", "亿"), (1000.0, "raw", "CNY", ""), (7.0, "%", None, ""), (None, "", None, ""), (None, "无", "CNY", "")]


def test_parse_number(spark):
    got = many(spark, values.parse_number, [12.5, None, math.nan], "double")
    assert [tuple(g) for g in got] == [(12.5, "raw", "CNY", ""), (None, "", None, ""), (None, "", None, "")]


def test_value_type_and_quarter(spark):
    assert many(spark, values.value_type, ["%", "亿", "raw", None]) == ["percentage", "amount", "text", "text"]
    assert many(spark, values.quarter_label, ["2025-06-30", "2025-12-31", "bad", "2025-13-01", None]) == ["2025-Q2", "2025-Q4", "bad", "2025-13-01", None]


def test_answer_targets(spark):
    df = spark.createDataFrame([(" 15.3% ", 15.3, "%"), ("2.83", 2.83, "raw"), ("x", None, ""), ("7", 7.0, "")], "t string, n double, u string")
    got = [r[0] for r in df.select(values.answer_targets(F.col("t"), F.col("n"), F.col("u"))).collect()]
    assert got == [["15.3%"], ["2.83", "2.83raw"], ["x"], ["7"]]


def test_splits_match_hashlib(spark):
    names = [f"实体{i}" for i in range(300)]
    got = many(spark, lambda x: keys.fact_split(x, F.lit("m"), "salt"), names)
    bucket = lambda k: int(hashlib.sha256(k.encode()).hexdigest()[:8], 16) % 100
    name = lambda b, mid: "train" if b < 80 else mid if b < 90 else "test"
    assert got == [name(bucket(f"{n}|m|salt"), "val") for n in names]
    assert many(spark, lambda x: keys.label_split(x, "s"), names) == [name(bucket(f"s:{n}"), "validation") for n in names]


def test_dedup_key(spark):
    df = spark.createDataFrame([("e", "m", None, "1", "%", "f"), ("", "m", "d", "1", "%", "f")], "e string, m string, d string, v string, u string, f string")
    a, b = (r[0] for r in df.select(keys.dedup_key(*[F.col(c) for c in "emdvuf"])).collect())
    assert a == '["e","m","","1","%"]' and b == hashlib.sha256(b"f").hexdigest()[:20]


def test_tokens_and_numbers(spark):
    assert many(spark, text.tokens, ["同比增长15.3%", "a　b\u0085c\x1cd", "", "😀 x"]) == [["同", "比", "增", "长", "15.3%"], ["a", "b", "c", "d"], [], ["😀", "x"]]
    assert many(spark, text.numbers, ["2025-06-30 约１５.3%"]) == [[2025.0, -6.0, -30.0, 15.3]]


def test_trim_squeeze(spark):
    assert many(spark, text.trim, ["　a b\t\x1c", "", None]) == ["a b", "", None]
    assert many(spark, text.squeeze, ['  "a \n b" ']) == ["a b"]


def test_choice_and_verdict(spark):
    assert many(spark, lambda x: text.candidate_choice(x, F.lit(3)), ["2", " 3。", "候选2", "4", "0", "99999999999"]) == [1, 2, None, None, None, None]
    assert many(spark, text.affirmative, ["是", "“是，成立”", "否", "不是"]) == [True, True, False, False]


def test_entities_and_metrics(spark):
    assert many(spark, text.entity, ["据万科A公告", "某某科技集团发布", "无", "上海公司"]) == ["万科", "某某科技集团", None, "上海公司"]
    assert one(spark, text.entity(F.lit("由华东公司发布")), x="") == "由华东公司"
    got = many(spark, text.metric, ["2024年毛利率为 46.8 %", "净利润达到12亿", "流动比率", "天气"])
    assert [tuple(g) for g in got] == [("毛利率", "46.8 %", "percentage"), ("净利润", "12", "amount"), ("流动比率", "流动比率", "ratio"), (None, None, "text")]
    assert tuple(many(spark, text.valued_metric, ["营收约12.5亿元"])[0]) == ("营业总收入", "营收约12.5亿元")


def test_cleanups(spark):
    assert many(spark, text.without_format_hint, ["a\n\n###b\n\n###c", "a"]) == ["a", "a"]
    assert many(spark, text.without_latex, [r"\text{x}\frac"]) == ["xfrac"]
    assert many(spark, lambda x: text.trigram_similarity(x, F.lit("abcd")), ["abcd", "ab", "bcde"]) == [1.0, 0.0, pytest.approx(1 / 3)]


TRACE = "<think>查</think><search>营收</search><think>得</think><answer>{}</answer>"
REWARD_CASES = [
    ("该公司2025年Q4营收同比增长15.3%", 1, True, (0.4, 0.2, 0.2, 0.05, 0.1, 0.95, False)),
    ("大概增长了15%", 0, False, (0.368627, 0, 0.2, 0, 0, 0.568627, False)),
    ("约15%", 1, True, (0.368627, 0, 0.2, 0.05, 0.1, 0.718627, False)),
    ("抱歉，信息不足，无法回答这个问题", 1, False, (-0.5, 0, 0.2, 0.05, 0, 0, False)),
]


@pytest.mark.parametrize(("answer", "searched", "found", "want"), REWARD_CASES)
def test_reward_scenarios(spark, answer, searched, found, want):
    step = F.struct(F.lit("营收").alias("query"), F.lit("同比增长15.3%" if found else "无关").alias("retrieved_text"), F.array().cast("array<struct<value_text:string,fact:string,unit:string>>").alias("retrieved_records"))
    steps = F.array(step) if searched else F.slice(F.array(step), 1, 0)
    out = one(spark, rewards.breakdown(F.lit(TRACE.format(answer)), F.lit(answer), F.lit("15.3%"), steps, F.lit(2), F.lit(1), F.lit(False), F.lit(True)), x="")
    assert tuple(out) == tuple(pytest.approx(w, abs=1e-6) if not isinstance(w, bool) else w for w in want)


@pytest.mark.parametrize(("trace", "answer", "repeated"), [("<think>a<answer>15.3%</answer>", "15.3%", False), (TRACE.format("15.3%"), "15.3%", True), (TRACE.format("x"), None, False)])
def test_terminated(spark, trace, answer, repeated):
    steps = F.array().cast("array<struct<query:string,retrieved_text:string,retrieved_records:array<struct<value_text:string,fact:string,unit:string>>>>")
    out = one(spark, rewards.breakdown(F.lit(trace), F.lit(answer).cast("string"), F.lit("15.3%"), steps, F.lit(1), F.lit(1), F.lit(repeated), F.lit(True)), x="")
    assert tuple(out) == (0, 0, 0, 0, 0, 0, True)


@pytest.mark.parametrize(("value", "unit", "hit"), [("15.3", "%", True), ("15.3亿元", "亿元", False)])
def test_record_units(spark, value, unit, hit):
    record = F.struct(F.lit(value).alias("value_text"), F.lit("").alias("fact"), F.lit(unit).alias("unit"))
    steps = F.array(F.struct(F.lit("q").alias("query"), F.lit("").alias("retrieved_text"), F.array(record).alias("retrieved_records")))
    assert one(spark, rewards.retrieval_hit(steps, F.lit("15.3%")), x="") is hit


def test_best_target(spark):
    steps = F.array().cast("array<struct<query:string,retrieved_text:string,retrieved_records:array<struct<value_text:string,fact:string,unit:string>>>>")
    trace = "<think>a</think><answer>新能源</answer>"
    best = rewards.best_breakdown(F.array(F.lit("New energy"), F.lit("新能源")), trace=F.lit(trace), answer=F.lit("新能源"), steps=steps, rounds=F.lit(0), calls=F.lit(0), repeated=F.lit(False), valid=F.lit(True))
    out = one(spark, best, x="")
    assert out.target == "新能源" and out.reward.total == pytest.approx(0.8)


def test_difficulty_and_leak(spark):
    assert one(spark, rewards.too_easy(F.array(F.lit("不知"), F.lit("15%")), F.array(F.lit("15.3%"))), x="") is True
    assert one(spark, rewards.leaks_answer(F.lit("值为 15. 3%吗"), F.array(F.lit("15.3%"))), x="") is True


def test_turns(spark):
    good, two, bare, blank = many(spark, traces.parse_turn, ["<think>t</think><search> q </search>", "<think>t</think><search>a</search><search>b</search>", "<answer>x</answer>", "<think> </think><answer>x</answer>"])
    assert tuple(good) == ("search", "q", "t", True)
    assert not two.valid and not bare.valid and not blank.valid and two.kind is None


def test_tags_as_by_patterns(spark):
    rng, parts = random.Random(5), ["<answer>", "</answer>", "<search>", "</search>", "<", "a", " b\n", "</answer", "answer>"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = df.select(traces.tag_contents(F.col("t"), "answer"), traces.tag_contents(F.col("t"), "search"), traces.final_answer(F.col("t"), "last_open")).collect()
    for t, (answers, searches, last) in zip(texts, got, strict=True):
        assert answers == re.findall("(?s)<answer>(.*?)</answer>", t) and searches == re.findall("(?s)<search>(.*?)</search>", t)
        found = re.search("(?s).*<answer>(.*)</answer>", t)
        assert last == (found and found[1].strip() or None)


def test_long_open_traces(spark):
    """Work on traces whose tags stay open grows with their length, not with its square."""
    df = spark.range(2).select(F.repeat(F.lit("<search>q</search><answer> some words "), 20_000).alias("t"))
    began = time.time()
    got = df.select(traces.final_answer(F.col("t"), "last_open").alias("last"), traces.final_answer(F.col("t")).alias("closed"), F.size(traces.queries_of(F.col("t"))).alias("n")).collect()
    assert [tuple(r) for r in got] == [(None, None, 20_000)] * 2 and time.time() - began < 60


def test_trim_takes_all_white_space(spark):
    """Each character of the basic plane at both ends, as Java's Unicode pattern has it; and a long run within a text, in one pass."""
    df = spark.range(1, 65536).filter("id not between 55296 and 57343").selectExpr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE') AS c")
    df = df.select(F.concat("c", F.lit("a"), "c", F.lit("b"), "c").alias("x"))
    assert df.filter(~text.trim(F.col("x")).eqNullSafe(F.regexp_replace("x", f"(?U)^[{text.BLANK}]+|[{text.BLANK}]+$", ""))).count() == 0
    began = time.time()
    long = spark.range(4).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b ")).alias("x"))
    assert [r[0] for r in long.select(F.length(text.trim(F.col("x")))).collect()] == [300_002] * 4 and time.time() - began < 30


def test_names_in_texts_without_chinese(spark):
    assert many(spark, text.entity, ["x" * 99, "", None, "TCL中环 x"]) == [None, None, None, "TCL中环"]
    assert many(spark, lambda x: text.valued_metric(x)["metric"], ["PE 3", "the PE12倍", "ROE7%", None, "营收"]) == [None, "市盈率", "净资产收益率", None, None]


def test_final_answers(spark):
    t = ["<answer>a</answer><answer> </answer>", "<answer>a</answer>", "none"]
    assert many(spark, traces.final_answer, t) == [None, "a", None]
    assert many(spark, lambda x: traces.final_answer(x, "keep_blank"), t) == ["", "a", None]
    assert many(spark, lambda x: traces.final_answer(x, "last_open"), ["<answer>a<answer>b</answer>c</answer>"]) == ["b</answer>c"]


def test_repeats(spark):
    df = spark.createDataFrame([(["annual report", "ANNUAL REPORT", "x"],), (["a", "b"],)], "q array<string>")
    got = [tuple(r) for r in df.select(traces.has_repeat(F.col("q"), True), traces.has_repeat(F.col("q")), traces.first_repeat(F.col("q"))).collect()]
    assert got == [(True, False, 1), (False, False, None)]


def test_env_mask(spark):
    parts = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(t).alias("text")) for o, t in (("assistant", "AB"), ("environment", "XYZ"), ("assistant", "C"))])
    assert one(spark, traces.env_mask(parts, traces.character_offsets(F.lit("ABXYZC"))), x="") == [1, 1, 0, 0, 0, 1]
    crossing = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    assert one(spark, traces.env_mask(parts, crossing), x="") is None


def test_token_lists(spark):
    ids, probs = F.array(F.lit(101), F.lit(102)), F.array(F.create_map(F.lit(101), F.lit(-0.1)), F.create_map(F.lit(102), F.lit(-0.2)))
    assert one(spark, traces.sampled_logprobs(ids, probs), x="") == [-0.1, -0.2]
    assert one(spark, traces.sampled_logprobs(F.array(F.lit(101), F.lit(9)), probs), x="") is None
    end = traces.strip_chat_end(F.lit("hi<|im_end|>"), F.array(F.lit(5), F.lit(7)), F.array(F.lit(0.1), F.lit(0.2)), 7)
    assert tuple(one(spark, end, x="")) == ("hi", [5], [0.1])
    part = lambda o, i: F.struct(F.lit(o).alias("owner"), F.array(F.lit(i)).alias("ids"), F.array(F.lit(-1.0)).alias("logprobs"))
    assert tuple(one(spark, traces.completion_lists(F.array(part("assistant", 1), part("environment", 2))), x="")) == ([1, 2], [1, 0], [-1.0, 0.0])
    assert one(spark, traces.observation_bridge(F.lit("o")), x="").endswith("assistant\n")


def test_public_names():
    from tallyloom import api

    assert {"search", "build_facts", "breakdown", "read_samples", "load_records", "RunConfig", "TallyloomError"} <= set(api.__all__)
    assert all(hasattr(api, name) for name in api.__all__) and issubclass(api.RecordError, api.TallyloomError)
