"""Human-written amounts, percentages and reporting periods as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import ascii_digits, let, to_number, trim

# Texts that stand for nothing, unit suffixes with their scales.
NOTHING = ("false", "none", "nan", "n/a")
SUFFIXES = (("万亿元", "万亿"), ("万亿", "万亿"), ("亿元", "亿"), ("万元", "万"), ("亿", "亿"), ("万", "万"))
AMOUNT_UNITS = ("亿", "万", "万亿", "万亿元", "亿元", "万元")
CURRENCY, PLAIN = "CNY", "raw"


def _value(number: Column, unit: Column | str, currency: str | None, scale: str) -> Column:
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return F.struct(number.cast("double").alias("number"), unit.alias("unit"), F.lit(currency).cast("string").alias("currency"), F.lit(scale).alias("scale"))


def _nothing() -> Column:
    return _value(F.lit(None), "", None, "")


def parse_value(raw: Column, legacy: bool = False) -> Column:
    """struct(number, unit, currency, scale) of a text.

    Nothing gives nulls; a percentage has unit ``%`` and no currency; a suffix gives unit and scale; what is left
    must begin with a number, else the whole text is the unit.  ``legacy`` has no 万亿 without 元 and stops
    a number at a thousands separator.
    """
    suffixes = [s for s in SUFFIXES if not legacy or s[0] != "万亿"]
    scales = F.create_map(*[F.lit(x) for pair in suffixes for x in pair])

    def read(text: Column) -> Column:
        suffix = F.regexp_extract(text, f"({'|'.join(s for s, _ in suffixes)})$", 1)
        return let(F.struct(text.alias("text"), suffix.alias("suffix"), leading(text)), value)

    def leading(text: Column) -> Column:
        plain = text if legacy else F.replace(text, F.lit(","), F.lit(""))
        return to_number(F.regexp_extract(plain, r"^([+-]?\d+\.?\d*)", 1)).alias("number")

    def value(r: Column) -> Column:
        text, suffix, number = r["text"], r["suffix"], r["number"]
        out = F.when(F.coalesce(text == "", F.lit(True)) | F.lower(text).isin(*NOTHING), _nothing())
        out = out.when(F.endswith(text, F.lit("%")), _value(to_number(trim(F.regexp_replace(text, "%$", ""))), "%", None, ""))
        out = out.when(number.isNull(), _value(number, text, CURRENCY, ""))
        unit, scale = F.when(suffix == "", PLAIN).otherwise(suffix), F.coalesce(F.try_element_at(scales, suffix), F.lit(""))
        return out.otherwise(F.struct(number.alias("number"), unit.alias("unit"), F.lit(CURRENCY).alias("currency"), scale.alias("scale")))

    return let(trim(ascii_digits(raw)), read)


def parse_number(raw: Column) -> Column:
    """The same struct for a numeric column; NaN and null are nothing."""
    return F.when(raw.isNull() | F.isnan(raw), _nothing()).otherwise(_value(raw, PLAIN, CURRENCY, ""))


def parse_answer_value(raw: Column) -> Column:
    """The variant for answers: before a suffix all but digits, points and minus is dropped, commas are ignored."""

    def read(text: Column) -> Column:
        out = F.when(F.coalesce(text == "", F.lit(True)), _nothing())
        out = out.when(F.endswith(text, F.lit("%")), _value(to_number(trim(F.regexp_replace(text, "%$", ""))), "%", None, ""))
        for suffix, scale in SUFFIXES:
            if suffix != "万亿":
                number = to_number(F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - len(suffix)), r"[^0-9.\-]", ""))
                out = out.when(F.endswith(text, F.lit(suffix)), _value(number, suffix, CURRENCY, scale))
        number = to_number(F.replace(text, F.lit(","), F.lit("")))
        return out.when(number.isNotNull(), _value(number, PLAIN, CURRENCY, "")).otherwise(_value(number, text, CURRENCY, ""))

    return let(trim(ascii_digits(raw)), read)


def value_type(unit: Column) -> Column:
    """percentage, amount or text."""
    return F.when(unit == "%", "percentage").when(unit.isin(*AMOUNT_UNITS), "amount").otherwise("text")


def quarter_label(date: Column) -> Column:
    """``2025-Q2`` of a text that begins with a date; other texts stay."""
    head = F.substring(date, 1, 10)
    day = F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), F.lit("-Q"), F.quarter(day).cast("string")), date)


def plain_number(x: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", "")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def answer_targets(value_text: Column, number: Column, unit: Column) -> Column:
    """Accepted answers: the value as written and, if different, its number with its unit."""
    written = trim(value_text)
    normal = F.concat(plain_number(number), trim(F.coalesce(unit, F.lit(""))))
    return F.when(finite(number), F.array_distinct(F.array(written, normal))).otherwise(F.array(written))
