"""Facts from sources: wide tables, research reports, announcements, question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.keys import short_hash
from tallyloom.functions.text import entity, let, metric, trim, truthy, valued_metric, without_format_hint, without_latex
from tallyloom.functions.values import parse_answer_value, parse_value, quarter_label, value_type
from tallyloom.operators.dedup import keep_first, keep_last
from tallyloom.operators.dimensions import UNKNOWN, infer_industry, is_chinese, keep_codes, last_days, lookup, name_in_title, small
from tallyloom.sources.schemas import FACT

# Columns of the wide table and the metrics that they hold.
WIDE_METRICS = {
    "净利润": "净利润",
    "净利润同比增长率": "净利润同比增速",
    "扣非净利润": "扣非净利润",
    "扣非净利润同比增长率": "扣非净利润同比增速",
    "营业总收入": "营业总收入",
    "营业总收入同比增长率": "营业总收入同比增速",
    "基本每股收益": "基本每股收益",
    "每股净资产": "每股净资产",
    "每股经营现金流": "每股经营现金流",
    "销售毛利率": "销售毛利率",
    "销售净利率": "销售净利率",
    "净资产收益率": "净资产收益率",
    "资产负债率": "资产负债率",
    "流动比率": "流动比率",
    "速动比率": "速动比率",
}
NO_VALUE = ("false", "true", "nan")
ABSTRACT_URL = "https://data.10jqka.com.cn/financial/yjgg/opp/"
CONTEXT_METRIC, FORMULA_METRIC = "金融上下文", "金融公式/知识点"


def unpivot_metrics(df: DataFrame, ids: list[str], metrics: dict[str, str], name: str = "metric", value: str = "raw_value") -> DataFrame:
    """A row per id and metric that has a value; null, NaN and truth values are none; metrics get their new names."""
    wide = [c for c in metrics if c in df.columns]
    long = df.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in wide]).unpivot(ids, wide, name, value)
    names = F.create_map(*[F.lit(x) for c in wide for x in (c, metrics[c])])
    return long.filter(F.col(value).isNotNull() & ~F.lower(value).isin(*NO_VALUE)).withColumn(name, names[F.col(name)])


def today() -> Column:
    """The day on which a source is read, as text."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def as_facts(df: DataFrame, retrieved: Column | None = None) -> DataFrame:
    """Exactly the columns of a fact, in order: those that ``df`` has, the others with what a plain text fact has there."""
    plain = {"source_url": "", "value_type": "text", "unit": "", "scale": "", "date": "", "published_at": "", "structured": True}
    have, out = set(df.columns), []
    for name, kind in (c.split() for c in FACT.split(", ")):
        if name in have:
            value = F.col(name)
        elif name == "industry":
            value = infer_industry(F.col("entity"))
        elif name == "retrieved_at":
            value = retrieved if retrieved is not None else today()
        else:
            value = F.lit(plain.get(name))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def build_facts(df: DataFrame, legacy: bool = False, retrieved: Column | None = None) -> DataFrame:
    """Facts of (entity, metric, raw_value, source_doc, source_url, source_type, document_id, date, published_at).

    An amount or a percentage without a number is no fact.  An ``extra`` column is added to the sentence.  A null value is
    an empty text; what is hashed then has the word None in its place.
    """
    v = parse_value(F.col("raw_value"), legacy)
    safe = [F.coalesce(F.col(c), F.lit("")) for c in ("entity", "source_doc", "metric")]
    content = F.concat_ws("|", *safe, F.coalesce("raw_value", F.lit("None")), F.coalesce("date", F.lit("")))
    out = df.withColumn("v", v).withColumn("value_type", value_type(F.col("v.unit"))).filter(~F.col("value_type").isin("amount", "percentage") | F.col("v.number").isNotNull())
    extra = F.when(truthy(F.col("extra")), F.concat(F.lit("，"), F.col("extra"))).otherwise("") if "extra" in df.columns else F.lit("")
    out = out.withColumn("value_text", F.coalesce("raw_value", F.lit(""))).withColumn("raw_content_hash", short_hash(content))
    out = out.withColumn("fact", F.concat("entity", F.coalesce("date", F.lit("")), "metric", F.lit("为"), "value_text", extra, F.lit("。")))
    out = out.withColumn("fact_id", F.concat(F.substring("source_type", 1, 4), F.lit("_"), "raw_content_hash"))
    parts = {"value_number": "number", "unit": "unit", "currency": "currency", "scale": "scale"}
    return as_facts(out.withColumns({c: F.col(f"v.{x}") for c, x in parts.items()}), retrieved)


def abstract_facts(wide: DataFrame, retrieved: Column | None = None) -> DataFrame:
    """Facts of a wide table of financial abstracts (code, name, 报告期, one column per metric)."""
    long = unpivot_metrics(wide.filter(truthy(F.col("报告期"))), ["code", "name", "报告期"], WIDE_METRICS)
    period = F.col("报告期")
    doc, url = F.concat("name", period, F.lit("财报摘要(同花顺)")), F.concat(F.lit(ABSTRACT_URL), "code", F.lit("/"))
    rows = long.select(F.col("name").alias("entity"), "metric", "raw_value", doc.alias("source_doc"), url.alias("source_url"), F.lit("financial_report").alias("source_type"), F.concat(F.lit("ths_abstract_"), "code", F.lit("_"), period).alias("document_id"), quarter_label(period).alias("date"), period.alias("published_at"))
    return build_facts(rows, retrieved=retrieved)


def _named(x: Column) -> Column:
    """Neither null nor empty nor the text of a missing cell."""
    return truthy(x) & (x != "nan")


def report_facts(reports: DataFrame, years: list[str], retrieved: Column | None = None) -> DataFrame:
    """Facts of research reports (code, name, broker, title, date, rating, url, and eps_<year>, pe_<year>): a rating, and estimates.

    A report without a title gives none.  A rating is a text; estimates are built like other values.
    """
    day, title, broker = F.col("date").cast("string"), F.col("title"), F.coalesce("broker", F.lit(""))
    each = [F.struct(F.lit("东财评级").alias("metric"), F.when(_named(F.col("rating")) & (F.col("rating") != "False"), F.col("rating")).alias("raw_value"))]
    for year in years:
        for kind, label in (("eps", "预测每股收益"), ("pe", "预测市盈率")):
            if f"{kind}_{year}" in reports.columns:
                each.append(F.struct(F.lit(f"{year}{label}").alias("metric"), F.nullif(F.col(f"{kind}_{year}").cast("string"), F.lit("NaN")).alias("raw_value")))
    long = reports.filter(_named(title)).withColumn("e", F.explode(F.array(*each))).filter("e.raw_value is not null")
    doc = F.concat(F.lit("研报《"), title, F.lit("》("), broker, F.lit(")"))
    url = F.when(_named(F.col("url")), F.col("url")).otherwise("") if "url" in reports.columns else F.lit("")
    name, raw = F.col("name"), F.col("e.raw_value")
    rows = long.select(
        name.alias("entity"), "e.metric", raw.alias("raw_value"), doc.alias("source_doc"), url.alias("source_url"), F.lit("research_report").alias("source_type"),
        F.concat_ws("_", F.lit("em_rpt"), "code", day, short_hash(title)).alias("document_id"), day.alias("date"), day.alias("published_at"),
        F.concat(F.lit("来源："), broker, F.lit("于"), day, F.lit("发布的研报")).alias("extra"),
        F.concat(name, F.lit("在"), day, F.lit("获"), broker, F.lit("研报评级为「"), raw, F.lit("」，报告标题：《"), title, F.lit("》。")).alias("sentence"),
        F.concat(F.lit("rrpt_"), short_hash(F.concat_ws("_", name, day, raw))).alias("rating_id"), short_hash(F.concat_ws("_", name, day, raw, broker)).alias("rating_hash"),
    )
    rated = F.col("metric") == "东财评级"
    ratings = rows.filter(rated).select("*", F.col("raw_value").alias("value_text"), F.col("sentence").alias("fact"), F.col("rating_id").alias("fact_id"), F.col("rating_hash").alias("raw_content_hash"))
    return as_facts(ratings, retrieved).unionByName(build_facts(rows.filter(~rated), retrieved=retrieved))


def announcement_facts(rows: DataFrame, order: list[str], prefix: str = "anno", retrieved: Column | None = None) -> DataFrame:
    """Facts of announcements (code, name, title, date, url, and kind if known): the first of each code and title."""
    first = keep_first(rows.filter(_named(F.col("title"))), ["code", "title"], order)
    code, title, day = F.col("code"), F.col("title"), F.col("date").cast("string")
    name = F.coalesce("name", "code")
    kind = F.coalesce(F.col("kind"), F.lit("")) if "kind" in rows.columns else F.lit("")
    out = first.select(
        F.concat(F.lit(f"{prefix}_"), short_hash(F.concat_ws("_", code, title))).alias("fact_id"), F.concat(name, F.lit("于"), day, F.lit("发布"), kind, F.lit("公告：《"), title, F.lit("》。")).alias("fact"),
        F.concat(F.lit("公告《"), title, F.lit("》("), name, F.lit(")")).alias("source_doc"), F.when(_named(F.col("url")), F.col("url")).otherwise("").alias("source_url"), F.lit("announcement").alias("source_type"),
        F.concat_ws("_", F.lit("em_notice"), code, day, short_hash(title)).alias("document_id"), name.alias("entity"), F.lit("公告").alias("metric"), title.alias("value_text"), day.alias("date"), day.alias("published_at"),
        short_hash(F.concat_ws("_", code, title, day)).alias("raw_content_hash"),
    )
    return as_facts(out, retrieved)


def requested_announcements(rows: DataFrame, companies: DataFrame, days: list[str], kinds: list[str], order: str = "ordinal", retrieved: Column | None = None) -> DataFrame:
    """Facts of the announcements (day, kind, code, title, date, url) of wanted days, kinds and companies (code, name).

    Every day is asked for with every kind, in the order given; of a code and title the first answer counts.
    """
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(d, k, i * len(kinds) + j) for i, d in enumerate(days) for j, k in enumerate(kinds)], "day string, kind string, asked int")
    own = lookup(keep_codes(rows, companies, "code"), companies, "code", "code", ["name"])
    return announcement_facts(own.join(F.broadcast(wanted), ["day", "kind"]), ["asked", order], retrieved=retrieved)  # days x kinds is the caller's list


def recent_announcements(rows: DataFrame, companies: DataFrame, end: str, n: int = 60, order: str = "ordinal", retrieved: Column | None = None) -> DataFrame:
    """Facts of the announcements (day, code, title, date, url) of the ``n`` days before ``end``, the latest day first.

    ``companies`` is (code, name, place).  A row belongs to the company of its code if that is known, else to the first whose
    name the title contains; other rows go.
    """
    own = rows.join(F.broadcast(last_days(rows.sparkSession, end, n)), "day", "left_semi")  # n rows
    own = name_in_title(own, "title", companies, "name", "place", "code", "code").filter("matched is not null")
    codes = companies.groupBy(F.col("name").alias("matched")).agg(F.min_by("code", "place").alias("own_code"))
    own = own.join(small(codes), "matched").withColumn("code", F.col("own_code")).withColumn("name", F.col("matched"))
    return announcement_facts(own.withColumn("back", -F.col("day").cast("int")), ["back", order], "anno2", retrieved)


def question_facts(rows: DataFrame, retrieved: Column | None = None) -> DataFrame:
    """Up to two facts per row of a question set: what a question says, and the knowledge given with it.

    Answers never become facts.
    """
    company = F.coalesce("company_with_period", F.lit(""))
    # Each is a column of its own before it is used several times: written into its uses, a pattern would run once per use.
    rows = rows.select(F.coalesce("finqa_id", F.lit("")).alias("id"), F.coalesce("doc_type", F.lit("")).alias("doc"), "doc_type", let(company, lambda c: F.coalesce(entity(c), F.nullif(c, F.lit("")), F.lit(UNKNOWN))).alias("name"), without_format_hint(F.coalesce("question", F.lit(""))).alias("q"), F.coalesce("external_knowledge", F.lit("")).alias("k"))
    rows = rows.withColumn("m", F.when(F.length("q") > 20, let(F.col("q"), metric))).withColumn("clean", without_latex(F.col("k")))
    rows = rows.withColumn("v", parse_answer_value(F.col("m.value_text")))
    id_, doc, name, q, k, m, v, clean = map(F.col, ("id", "doc", "name", "q", "k", "m", "v", "clean"))

    def fact(kind: str, fact_text: Column, metric_: Column, value_text: Column, number: Column, type_: Column, unit: Column, currency: Column, scale: Column, content: Column, structured: Column) -> Column:
        return F.struct(F.concat(F.lit(f"fcqa_{kind}_"), short_hash(F.concat(id_, F.lit(f"_{kind}")))).alias("fact_id"), fact_text.alias("fact"), metric_.alias("metric"), value_text.alias("value_text"), number.alias("value_number"), type_.alias("value_type"), unit.alias("unit"), currency.alias("currency"), scale.alias("scale"), short_hash(content).alias("raw_content_hash"), structured.alias("structured"))

    none = F.lit(None)
    asked = fact("q", F.concat(F.lit("FinanceComplexQA金融问答上下文: "), F.substring(q, 1, 400)), F.coalesce(m["metric"], F.lit(CONTEXT_METRIC)), F.coalesce(F.nullif(m["value_text"], F.lit("")), F.substring(q, 1, 150)), v["number"], m["value_type"], v["unit"], v["currency"], v["scale"], F.concat(id_, F.substring(q, 1, 200)), m["metric"].isNotNull())
    known = fact("k", F.concat(F.lit("金融公式/领域知识: "), F.substring(clean, 1, 400)), F.lit(FORMULA_METRIC), F.substring(clean, 1, 200), none.cast("double"), F.lit("text"), F.lit(""), none.cast("string"), F.lit(""), F.concat(id_, F.substring(clean, 1, 200)), F.lit(False))
    both = F.array_compact(F.array(F.when(F.length(q) > 20, asked), F.when(F.length(k) > 20, known)))
    out = rows.select(name.alias("entity"), let(name, lambda n: infer_industry(n, F.col("doc_type"))).alias("industry"), F.concat(F.lit("FinanceComplexQA/"), doc, F.lit(" (id: "), id_, F.lit(")")).alias("source_doc"), F.concat(F.lit("fcqa_"), id_).alias("document_id"), F.explode(both).alias("f"))
    return as_facts(out.select("f.*", "entity", "industry", "source_doc", "document_id", F.lit("opensource_dataset").alias("source_type")), retrieved)


def question_labels(rows: DataFrame, order: list[str], gold: str = "gold") -> DataFrame:
    """(qid, prompt, targets, source): a row's answer, scalar or list; of several rows with an id the last."""
    golds = F.col(gold)
    golds = golds if rows.schema[gold].dataType.typeName() == "array" else F.when(golds.isNotNull(), F.array(golds))
    targets = F.filter(F.transform(golds, lambda g: trim(F.coalesce(g.cast("string"), F.lit("")))), lambda g: g != "")
    q = without_format_hint(F.coalesce("question", F.lit("")))
    named = rows.select(F.concat(F.lit("fcqa_"), F.coalesce("finqa_id", F.lit(""))).alias("qid"), q.alias("prompt"), targets.alias("targets"), F.struct(F.lit("FinanceComplexQA").alias("source_type"), F.col("finqa_id").alias("document_id"), "doc_type", "task_type").alias("source"), *order)
    return keep_last(named.filter((F.col("prompt") != "") & (F.size("targets") > 0)), ["qid"], order).drop(*order)


def passage_facts(rows: DataFrame, dataset: str, docs: str = "docs", place: str = "place", question: str = "question", lang: str | None = "lang", least: int = 20, retrieved: Column | None = None) -> DataFrame:
    """Facts of the passages in an array column, of rows in Chinese or no language (``lang`` None: all rows).

    Shorter passages than ``least``, white space aside, give none.  ``place`` is a row's number in its dataset.  The lengths of a
    fact's parts are those of the fact's format.
    """
    own = rows.filter(is_chinese(F.col(lang))) if lang else rows
    long = own.select(F.col(place).cast("string").alias("i"), F.coalesce(F.col(question), F.lit("")).alias("q"), F.posexplode(docs).alias("j", "passage")).filter(F.length(trim(F.col("passage"))) >= least)
    text, m = F.col("passage"), valued_metric(F.col("passage"))
    asked = F.when(F.col("q") != "", F.concat(F.lit(" (Q: "), F.substring("q", 1, 80), F.lit(")"))).otherwise("")
    out = long.withColumn("m", m).select(
        F.concat(F.lit("fcqa_"), short_hash(F.substring(text, 1, 500))).alias("fact_id"), F.substring(trim(text), 1, 500).alias("fact"), F.concat(F.lit("FinanceComplexQA #"), "i", asked).alias("source_doc"), F.lit(f"https://huggingface.co/datasets/{dataset}").alias("source_url"),
        F.lit("opensource_dataset").alias("source_type"), F.concat(F.lit("fcqa_sample_"), "i", F.lit("_doc_"), "j").alias("document_id"), F.coalesce(entity(text, with_company=False), F.lit(UNKNOWN)).alias("entity"), F.lit(None).alias("industry"),
        F.coalesce("m.metric", F.lit("")).alias("metric"), F.coalesce("m.value_text", F.substring(text, 1, 200)).alias("value_text"), F.col("m").isNotNull().alias("structured"), short_hash(F.substring(text, 1, 500)).alias("raw_content_hash"),
    )
    return as_facts(out, retrieved)


def as_list(v: Column) -> Column:
    """A VARIANT text, list or object as an array of texts: one, its elements, its values."""
    one, many, named = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "array<string>"), F.try_variant_get(v, "$", "map<string,string>")
    return F.coalesce(many, F.map_values(named), F.when(one.isNotNull(), F.array(one)))
