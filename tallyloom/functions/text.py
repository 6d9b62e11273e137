"""Text expressions: trimming, tokens, numbers and the extraction of entities and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the extraction rules recognise, in order of priority.
KNOWN_ENTITIES = (
    "贵州茅台", "五粮液", "泸州老窖", "招商银行", "工商银行", "平安银行", "恒瑞医药", "迈瑞医疗", "云南白药", "海康威视", "汇川技术", "紫光国微",
    "宁德时代", "隆基绿能", "TCL中环", "比亚迪", "长城汽车", "长安汽车", "中国平安", "中国人寿", "万科", "保利发展", "美的集团", "格力电器",
    "海尔智家", "中芯国际", "韦尔股份", "伊利股份", "牧原股份", "万华化学", "龙佰集团", "中兴通讯", "传音控股", "中航沈飞", "航天电器", "长江电力", "中国广核",
)
ENTITY_SUFFIXES = ("集团", "股份", "控股", "科技", "银行", "保险", "汽车", "能源", "医药", "电力", "通信")
METRICS = (
    ("流动比率|速动比率|资产负债率|产权比率|保守速动比率", "ratio"),
    ("净资产收益率|ROE|销售净利率|销售毛利率|营业利润率|EBITDA\\s*利润率|毛利率|净利率", "percentage"),
    ("每股收益|每股净资产|每股经营现金流|每股资本公积金|每股未分配利润", "amount"),
    ("营业(?:总)?收入|营收|净利润|扣非净利润|总资产|流动资产|流动负债|存货", "amount"),
    ("同比(?:增长|增速|下滑|下降|上升)|增速|增长率", "percentage"),
    ("市盈率|PE|市净率|PB|市销率", "ratio"),
    ("市(?:场)?占(?:有)?率|份额|排名", "percentage"),
)
VALUED_METRICS = (
    ("(?:营业(?:总)?收入|营收)[约达]?[0-9,.]+[万亿元百千]*", "营业总收入"),
    ("(?:净利润|净利)[约达]?[0-9,.]+[万亿元百千]*", "净利润"),
    ("(?:同比)?(?:增长|增速|下滑|下降|上升)[0-9,.]+%", "同比增速"),
    ("(?:毛利率|净利率)[0-9,.]+%", "利润率"),
    ("(?:市(?:场)?占(?:有)?率|份额)[约达]?[0-9,.]+%", "市占率"),
    ("(?:PE|市盈率)[约达]?[0-9,.]+倍?", "市盈率"),
    ("(?:总资产|资产)[约达]?[0-9,.]+[万亿元百千]*", "总资产"),
    ("(?:ROE|净资产收益率)[0-9,.]+%", "净资产收益率"),
)
#: White space as a set for patterns: Unicode's, and the four separators that Java's class leaves out.
BLANK = r"\s\x1c-\x1f"
#: The same characters one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(x: Column) -> Column:
    """Strip white space of any kind from both ends."""
    return F.btrim(x, F.lit(BLANKS))


def squeeze(x: Column) -> Column:
    """Collapse white space to single spaces and strip it and quotes from the ends."""
    return F.regexp_replace(trim(F.regexp_replace(x, f"(?U)[{BLANK}]+", " ")), "^[\"'“”]+|[\"'“”]+$", "")


def truthy(x: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def ascii_digits(x: Column) -> Column:
    """Full-width digits, signs and points as ASCII."""
    return F.translate(x, "０１２３４５６７８９．－＋％", "0123456789.-+%")


def to_number(x: Column) -> Column:
    """A plain decimal number as a double, else null; unlike a cast it takes no suffixes and no names of numbers."""
    return F.when(x.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), x.try_cast("double"))


def tokens(x: Column) -> Column:
    """Chinese characters one by one, other runs without white space whole."""
    return F.regexp_extract_all(x, F.lit(rf"(?U)[一-鿿]|[^{BLANK}一-鿿]+"), F.lit(0))


def numbers(x: Column) -> Column:
    """All numbers in a text, with per cent signs dropped."""
    found = F.regexp_extract_all(ascii_digits(x), F.lit(r"-?\d+\.?\d*%?"), F.lit(0))
    return F.transform(found, lambda v: F.regexp_replace(v, "%$", "").try_cast("double"))


def affirmative(x: Column) -> Column:
    """Whether a verdict begins with yes, white space and quotes aside."""
    return F.startswith(F.regexp_replace(F.regexp_replace(x, f"(?U)[{BLANK}]+", ""), "^[\"'“”]+|[\"'“”]+$", ""), F.lit("是"))


def candidate_choice(x: Column, n: Column) -> Column:
    """The zero-based choice of ``n`` that a reply consists of, else null."""
    number = F.regexp_extract(ascii_digits(x), rf"(?U)^[{BLANK}]*(\d+)[{BLANK}]*[。.]?[{BLANK}]*$", 1).try_cast("int")
    return F.when((number >= 1) & (number <= n), number - 1)


def entity(x: Column, with_company: bool = True) -> Column:
    """The first known company in a text, or two to six Chinese characters with a company suffix; null if none."""
    suffixes = "|".join((*ENTITY_SUFFIXES, *(("公司",) if with_company else ())))
    # All names have a Chinese character; a text without any needn't be tried name by name.
    return F.when(x.rlike("[一-鿿]"), F.nullif(F.regexp_extract(x, rf"({'|'.join(KNOWN_ENTITIES)}|[一-鿿]{{2,6}}(?:{suffixes}))", 1), F.lit("")))


def metric(x: Column) -> Column:
    """struct(metric, value_text, value_type): the first metric by priority and the value within 200 characters.

    The value is the first percentage, else the first number once the metric's name is cut out, else the name.
    """

    def found(pattern: str, kind: str) -> Column:
        raw = F.regexp_extract(x, f"({pattern})", 1)
        near = F.substring(x, F.regexp_instr(x, F.lit(pattern)), 200)
        rest = F.substring(near, F.length(raw) + 1, F.lit(200))  # the metric begins what is near
        percent = F.regexp_extract(near, r"([+-]?\d+\.?\d*\s*%)", 1)
        plain = F.regexp_extract(rest, r"([+-]?\d+\.?\d*)", 1)
        value = F.when(percent != "", percent).when(plain != "", plain).otherwise(raw)
        return F.when(x.rlike(pattern), F.struct(raw.alias("metric"), value.alias("value_text"), F.lit(kind).alias("value_type")))

    return F.coalesce(*[found(p, k) for p, k in METRICS], F.struct(F.lit(None).cast("string").alias("metric"), F.lit(None).cast("string").alias("value_text"), F.lit("text").alias("value_type")))


def valued_metric(x: Column) -> Column:
    """struct(metric, value_text): the first pattern with its number, by priority; null if none."""
    hit = lambda p, name: F.when(x.rlike(p), F.struct(F.lit(name).alias("metric"), F.regexp_extract(x, f"({p})", 1).alias("value_text")))
    return F.when(x.rlike("[一-鿿]|PE|ROE"), F.coalesce(*[hit(p, name) for p, name in VALUED_METRICS]))  # one of these is in each name


def without_format_hint(x: Column) -> Column:
    """A question up to the instructions on the output format."""
    return F.split(x, "\n\n###", 2)[0]


def without_latex(x: Column) -> Column:
    """Formula text without ``\\text{``, closing braces and backslashes."""
    return F.replace(F.replace(F.replace(x, F.lit("\\text{"), F.lit("")), F.lit("}"), F.lit("")), F.lit("\\"), F.lit(""))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of character trigrams; 0 where a side has fewer than three characters."""

    def grams(x: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, 3)))

    both = F.size(F.array_intersect(grams(a), grams(b)))
    return F.when((F.length(a) >= 3) & (F.length(b) >= 3), both / F.size(F.array_union(grams(a), grams(b)))).otherwise(0.0)
