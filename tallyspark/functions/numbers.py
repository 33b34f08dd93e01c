"""Null-safe arithmetic, number parsing, units and display of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(n: str, d: str) -> Column:
    """n / d; null if either is null or d is 0."""
    return F.try_divide(F.col(n), F.col(d))


def growth_rate(current: str, previous: str) -> Column:
    return F.try_divide(F.col(current), F.col(previous)) - 1


def parse_number(text: Column) -> Column:
    """A printed number: minus variants, thousands commas, (parentheses) as negative, a trailing %; null if it is none."""
    plain = F.trim(F.translate(text, "−％", "-%"))
    percent = plain.endswith("%")
    body = F.trim(F.regexp_replace(plain, "%$", ""))
    token = F.regexp_replace(body, "[, ]", "")
    good = token.rlike(r"^(\([0-9]+(\.[0-9]+)?\)|-?[0-9]+(\.[0-9]+)?)$")
    value = F.regexp_replace(token, "[()-]", "").cast("double")
    signed = F.when(token.startswith("(") | token.startswith("-"), -value).otherwise(value)
    return F.when(good, F.when(percent, signed / 100).otherwise(signed))


# Marks of scale, the longest first so that a mark inside another is not taken for it; and of currency.
SCALES = [("ten-thousand", 1e4), ("百万元", 1e6), ("million", 1e6), ("万元", 1e4), ("千元", 1e3), ("'000", 1e3), ("thousand", 1e3)]
CURRENCIES = [("HKD", ["hk$", "hkd", "港元", "港币"]), ("USD", ["usd", "us$", "美元"]), ("CNY", ["cny", "rmb", "人民币", "元"])]


def unit_scale(text: Column) -> Column:
    """The scale that a table's heading states, else 1."""
    flat = F.regexp_replace(F.lower(text), r"\s+", "")
    out = F.lit(1.0)
    for mark, scale in reversed(SCALES):
        out = F.when(flat.contains(mark), scale).otherwise(out)
    return out


def unit_currency(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(text), r"\s+", "")
    out = F.lit("")
    for name, marks in reversed(CURRENCIES):
        hit = F.lit(False)
        for m in marks:
            hit = hit | flat.contains(m)
        out = F.when(hit, name).otherwise(out)
    return out


def format_money(value: Column, currency: Column) -> Column:
    """Value with its currency's sign and T, B or M; a dash for null."""
    sign = F.when(currency == "USD", "$").when(currency == "CNY", "¥").when(currency == "HKD", "HK$").otherwise(F.concat(currency, F.lit(" ")))
    size = F.abs(value)
    text = F.concat(F.format_number(value, 0))
    for limit, mark in ((1e6, "M"), (1e9, "B"), (1e12, "T")):
        text = F.when(size >= limit, F.concat(F.format_number(value / limit, 2), F.lit(mark))).otherwise(text)
    return F.coalesce(F.concat(sign, text), F.lit("—"))


def confidence(value: Column) -> Column:
    """Clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def confidence_tier(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value >= 0.8, "high").when(value >= 0.55, "medium").otherwise("low")


#: A printed number as it stands in statement rows, and the marks of a footnote before it.
ROW_NUMBER = r"(?<![\p{L}\p{N}_.])(?:\(\s*[+-]?[0-9,]+(?:\.[0-9]+)?\s*\)|[+-]?\s*[0-9,]+(?:\.[0-9]+)?|[—–-])"
FOOTNOTE = r"^(?:\([^)]{0,4}\)|\[[^\]]{0,4}\]|[①②③④⑤⑥⑦⑧⑨⑩])\s*"


def row_value(tail: Column) -> Column:
    """The first value behind a row's label: a footnote mark is passed over, and a short note number before a number with commas; a dash is none."""
    head = F.substring(F.regexp_replace(F.btrim(tail), FOOTNOTE, ""), 1, 400)

    def value(found: Column) -> Column:
        first, second = F.get(found, 0), F.coalesce(F.get(found, 1), F.lit(""))
        note = F.regexp_replace(first, ",", "").rlike(r"^\s*[0-9]{1,3}\s*$") & second.contains(",")
        token = F.regexp_replace(F.when(note, second).otherwise(first), r"[\s,]", "")
        size = F.regexp_replace(token, "[()-]", "").try_cast("double")
        return F.when(token.startswith("(") | token.startswith("-"), -size).otherwise(size)

    return F.get(F.transform(F.array(F.regexp_extract_all(head, F.lit(ROW_NUMBER), 0)), value), 0)


def plausible(value: Column) -> Column:
    return (value != 0) & (F.abs(value) < 1e18)


def ratio(value: Column) -> Column:
    """A ratio that may be told in per cent."""
    return F.when(F.abs(value) > 1, value / 100).otherwise(value)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def probability_pair(value: Column) -> Column:
    """(low, high) of a variant {"low":, "high":} or [low, high]; null unless 0 <= low <= high <= 1."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
    listed = F.try_variant_get(value, "$", "array<variant>")
    part = lambda name, i: F.when(kind.startswith("OBJECT"), F.try_variant_get(value, f"$.{name}", "double")).when(F.size(listed) == 2, F.try_variant_get(value, f"$[{i}]", "double"))
    low, high = part("low", 0), part("high", 1)
    return F.when((low >= 0) & (low <= high) & (high <= 1), F.struct(low.alias("low"), high.alias("high")))


def format_percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.1f%%", value * 100))


def format_range(pair: Column, none: str = "Insufficient evidence") -> Column:
    return F.when(pair.isNull(), none).otherwise(F.format_string("%.0f%%–%.0f%%", pair["low"] * 100, pair["high"] * 100))
