"""Lookups in small dimensions: companies, industries, names in titles, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.scratch import scratch_dir, written

# Companies with their codes and industries, and what else tells an industry.
COMPANIES = (
    ("600519", "贵州茅台", "白酒"), ("000858", "五粮液", "白酒"), ("000568", "泸州老窖", "白酒"), ("600036", "招商银行", "银行"), ("601398", "工商银行", "银行"),
    ("000001", "平安银行", "银行"), ("600276", "恒瑞医药", "医药"), ("300760", "迈瑞医疗", "医药"), ("000538", "云南白药", "医药"), ("002415", "海康威视", "科技"),
    ("300124", "汇川技术", "科技"), ("002049", "紫光国微", "科技"), ("300750", "宁德时代", "新能源"), ("601012", "隆基绿能", "新能源"), ("002129", "TCL中环", "新能源"),
    ("002594", "比亚迪", "汽车"), ("601633", "长城汽车", "汽车"), ("000625", "长安汽车", "汽车"), ("601318", "中国平安", "保险"), ("601628", "中国人寿", "保险"),
    ("000002", "万科A", "地产"), ("600048", "保利发展", "地产"), ("000333", "美的集团", "家电"), ("000651", "格力电器", "家电"), ("600690", "海尔智家", "家电"),
    ("688981", "中芯国际", "芯片"), ("603501", "韦尔股份", "芯片"), ("600887", "伊利股份", "食品"), ("002714", "牧原股份", "食品"), ("600309", "万华化学", "化工"),
    ("002601", "龙佰集团", "化工"), ("000063", "中兴通讯", "通信"), ("688036", "传音控股", "通信"), ("600760", "中航沈飞", "军工"), ("002025", "航天电器", "军工"),
    ("600900", "长江电力", "电力"), ("003816", "中国广核", "电力"),
)
ALIASES = (("万科", "地产"),)
DOC_TYPE_INDUSTRIES = {"Bank_Financial_Statements": "银行"}
UNKNOWN = "未知"
CHINESE = ("zh", "chinese", "cn", "")

#: A dimension of at most so many rows may be broadcast.
BROADCAST_ROWS = 100_000


def companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPANIES, "code string, name string, industry string")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcasting if it has at most ``limit`` rows; joins with a larger one shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, values: list[str], default: str | None = None) -> DataFrame:
    """``values`` of the dimension row with the key, ``default`` where there is none; no row is lost or repeated.

    Of several dimension rows with a key the least counts.
    """
    picked = dim.groupBy(F.col(dim_key).alias("__dim")).agg(F.min(F.struct(*values)).alias("__v"))
    out = df.join(small(picked), F.col(key) == F.col("__dim"), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(F.col(f"__v.{v}"), F.lit(default)))
    return out.drop("__dim", "__v")


def infer_industry(entity: Column, doc_type: Column | None = None) -> Column:
    """Industry of a company: by its name, by an alias in it, by the kind of document, else unknown.

    The table is a constant of the plan, so no join is needed.
    """
    names = F.create_map(*[F.lit(x) for _, name, industry in COMPANIES for x in (name, industry)])
    out = F.when(F.coalesce(entity, F.lit("")).isin("", UNKNOWN), UNKNOWN).when(F.try_element_at(names, entity).isNotNull(), F.try_element_at(names, entity))
    for alias, industry in ALIASES:
        out = out.when((entity == alias) | F.contains(entity, F.lit(alias)), industry)
    for kind, industry in DOC_TYPE_INDUSTRIES.items() if doc_type is not None else ():
        out = out.when(doc_type == kind, industry)
    return out.otherwise(UNKNOWN)


def enrich_industry(df: DataFrame, overwrite: bool = False) -> DataFrame:
    """Industry where it is missing or unknown, or, with ``overwrite``, everywhere; ``changed`` says where it changed."""
    new = infer_industry(F.col("entity"), F.col("doc_type") if "doc_type" in df.columns else None)
    old = F.col("industry") if "industry" in df.columns else F.lit(None).cast("string")
    value = new if overwrite else F.when(F.coalesce(old, F.lit("")).isin("", UNKNOWN), new).otherwise(old)
    return df.withColumn("__new", value).withColumn("changed", ~old.eqNullSafe(F.col("__new"))).withColumn("industry", F.col("__new")).drop("__new")


def name_in_title(df: DataFrame, title: str, names: DataFrame, name: str, order: str, code: str | None = None, name_code: str | None = None, limit: int = 10_000) -> DataFrame:
    """Each title's ``name`` in ``matched``: by code if given and known, else the first name by ``order`` that the title contains.

    Up to ``limit`` names go along as one sorted list in each task, so that a title meets them in its own row.  More
    names are met by equality: a title is taken apart into its substrings of the lengths that names have.
    """
    pairs = names.select(F.col(order).alias("o"), F.col(name).alias("n"), (F.col(name_code) if name_code else F.lit(None).cast("string")).alias("c")).filter("n <> ''")
    if pairs.limit(limit + 1).count() <= limit:
        listed = pairs.agg(F.sort_array(F.collect_list(F.struct("o", "n", "c"))).alias("__names"))
        found = F.try_element_at(F.filter("__names", lambda x: F.contains(F.col(title), x["n"])), F.lit(1))["n"]
        if code:
            found = F.coalesce(F.try_element_at(F.filter("__names", lambda x: x["c"] == F.col(code)), F.lit(1))["n"], found)
        return df.join(F.broadcast(listed)).withColumn("matched", found).drop("__names")
    lengths = [r[0] for r in pairs.select(F.length("n").alias("k")).distinct().collect()]  # as many as the longest name has characters
    part = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - k + 1, F.lit(1))), lambda i: F.substring(F.col(title), i, F.lit(k)))
    keyed = written(df.withColumn("__row", F.monotonically_increasing_id()), f"{scratch_dir(df.sparkSession)}/rows")
    cut = keyed.select("__row", F.explode(F.array_distinct(F.flatten(F.array(*[part(k) for k in lengths])))).alias("n"))
    best = cut.join(pairs, "n").groupBy("__row").agg(F.min_by("n", "o").alias("__by_name"))
    out = keyed.join(best, "__row", "left").drop("__row")
    if not code:
        return out.withColumnRenamed("__by_name", "matched")
    by_code = pairs.filter("c is not null").groupBy(F.col("c").alias("__c")).agg(F.min_by("n", "o").alias("__by_code"))
    return out.join(by_code, F.col(code) == F.col("__c"), "left").withColumn("matched", F.coalesce("__by_code", "__by_name")).drop("__c", "__by_code", "__by_name")


def keep_codes(df: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Rows whose code is wanted."""
    return df.join(small(codes.select(key).distinct()), key, "left_semi")


def is_chinese(lang: Column) -> Column:
    """Whether a language label means Chinese or nothing."""
    return F.lower(F.coalesce(lang, F.lit(""))).isin(*CHINESE)


def last_days(spark: SparkSession, end: str, n: int) -> DataFrame:
    """The ``n`` days before ``end`` as yyyyMMdd."""
    days = F.sequence(F.date_sub(F.to_date(F.lit(end)), F.lit(n)), F.date_sub(F.to_date(F.lit(end)), F.lit(1)))
    return spark.range(1).select(F.explode(days).alias("d")).select(F.date_format("d", "yyyyMMdd").alias("day"))
