"""Text cleaning, topics, key-value pairs, titles, symbols, languages and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Topics and the patterns that mark them, in order.
TOPICS = {
    "business": [r"\bitem\s+1[.\s:-]+business\b", r"\bour business\b", r"\bbusiness overview\b"],
    "risk_factors": [r"\bitem\s+1a[.\s:-]+risk factors\b", r"\brisk factors\b"],
    "management_discussion": [r"\bitem\s+7[.\s:-]+management.{0,20}discussion", r"\bmanagement.{0,20}discussion and analysis\b"],
    "competition": [r"\bcompetitive environment\b", r"\bcompetition\b"],
    "customers": [r"\bcustomer concentration\b", r"\bour customers\b"],
    "segments": [r"\breportable segments?\b", r"\bsegment revenue\b"],
    "capital_allocation": [r"\bcapital expenditures?\b", r"\bcapital allocation\b"],
    "growth": [r"\bgrowth strateg(?:y|ies)\b", r"\bgrowth opportunities\b", r"\bnew products?\b"],
}
# Title markers and the form and period that they mean; the first that fits counts.
TITLES = [
    ("interim report|half-year report|半年度报告|中期报告", "INTERIM_REPORT", "H1"),
    ("prospectus|招股说明书", "PROSPECTUS", "IPO"),
    ("listing document|上市公告书", "LISTING_REPORT", "IPO"),
    ("一季度报告|1季度报告", "QUARTERLY_REPORT", "Q1"),
    ("三季度报告|3季度报告", "QUARTERLY_REPORT", "Q3"),
    (r"\b(first|1st) quarter(ly)?(\s+financial)?\s+report\b", "QUARTERLY_REPORT", "Q1"),
    (r"\b(third|3rd) quarter(ly)?(\s+financial)?\s+report\b", "QUARTERLY_REPORT", "Q3"),
    ("annual report|年度报告|年报", "ANNUAL_REPORT", "FY"),
    ("quarterly report|季度报告", "QUARTERLY_REPORT", "Q"),
]
# Exchanges of symbol suffixes, and of A-share code prefixes.
SUFFIXES = [(".SH", "SSE", "CN_A"), (".SS", "SSE", "CN_A"), (".SZ", "SZSE", "CN_A"), (".BJ", "BSE", "CN_A"), (".HK", "HKEX", "HK")]
PREFIXES = [("^(43|83|87|88|92)", "BSE"), ("^[023]", "SZSE"), ("^[569]", "SSE")]
# Language tags.
LANGUAGES = [
    ("zh-Hant", "^(zh-hant|zh-tw|zh-hk|zh-mo)(-.*)?$"),
    ("zh-CN", "^(zh-hans|zh-cn|zh-sg|zh)(-.*)?$"),
    ("en", "^en(-.*)?$"),
]
# Fixed value: how internal ids look.
INTERNAL_ID = r"(?i)(fact|evidence|filing|artifact|run):[A-Za-z0-9_.:/-]+"


def clean_text(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))


def strip_markup(text: Column) -> Column:
    """Tags out, the five named entities decoded, white space collapsed."""
    plain = F.regexp_replace(text, "<[^>]+>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(mark))
    return clean_text(plain)


def strip_internal_ids(text: Column) -> Column:
    return clean_text(F.regexp_replace(text, INTERNAL_ID, ""))


def classify_title(title: Column) -> tuple[Column, Column]:
    """Form and period of a report by its title."""
    low, form, period = F.lower(title), F.lit(""), F.lit("")
    for pattern, f, p in reversed(TITLES):
        form, period = F.when(low.rlike(pattern), f).otherwise(form), F.when(low.rlike(pattern), p).otherwise(period)
    return form, period


def content_id(*parts: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def normalize_symbol(symbol: Column) -> Column:
    """A struct (code, exchange, market) of a security symbol; null where no rule fits. The first rule that fits counts."""

    def of(code: Column, exchange: str, market: str) -> Column:
        five = F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code) if market == "HK" else code
        return F.struct(five.alias("code"), F.lit(exchange).alias("exchange"), F.lit(market).alias("market"))

    def rules(raw: Column) -> Column:
        out = F.when(raw.rlike("^[A-Z][A-Z0-9.-]{0,14}$"), of(raw, "NASDAQ", "US"))
        for pattern, exchange in reversed(PREFIXES):
            out = F.when(raw.rlike("^[0-9]{6}$") & raw.rlike(pattern), of(raw, exchange, "CN_A")).otherwise(out)
        out = F.when(raw.rlike("^[0-9]{4,5}$"), of(raw, "HKEX", "HK")).otherwise(out)
        for suffix, exchange, market in SUFFIXES:
            out = F.when(raw.endswith(suffix), of(F.substring_index(raw, suffix, 1), exchange, market)).otherwise(out)
        return out

    raw = F.upper(F.replace(F.trim(symbol), F.lit(" "), F.lit("")))
    return F.element_at(F.transform(F.array(raw), rules), 1)  # the symbol is cleaned once


def normalize_language(tag: Column) -> Column:
    flat, out = F.replace(F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lit("_"), F.lit("-")), F.lit("zh-CN")
    for name, pattern in reversed(LANGUAGES):
        out = F.when(flat.rlike(pattern), name).otherwise(out)
    return out


def key_values(text: Column) -> Column:
    """A map of the key=value pairs of a snapshot; of equal keys the last counts."""
    keys, values = F.regexp_extract_all(text, F.lit("([A-Za-z_]+)=([^|]*)"), 1), F.regexp_extract_all(text, F.lit("([A-Za-z_]+)=([^|]*)"), 2)
    return F.map_from_entries(F.arrays_zip(keys.alias("k"), values.alias("v")))


def topic_pattern(topic: str) -> str:
    return "(?i)(" + "|".join(TOPICS[topic]) + ")"


# Words that mark banks, insurers and brokers.
FINANCIAL = ["银行", "保险", "证券", "信托", "bank", "insurance", "securities", "brokerage"]
# Default currency and accounting standard of a market.
MARKETS = {"US": ("USD", "US_GAAP"), "CN_A": ("CNY", "CAS"), "HK": ("HKD", "UNKNOWN")}
# Titles of the three statements, and marks of scope.
STATEMENTS = {
    "balance_sheet": ["合并资产负债表", "资产负债表", "consolidated balance sheet", "statement of financial position"],
    "income_statement": ["合并利润表", "利润表", "consolidated income statement", "statement of profit or loss"],
    "cash_flow": ["合并现金流量表", "现金流量表", "consolidated cash flow statement", "statement of cash flows"],
}
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
EMAIL_WITHIN = r"[^@\s()<>;,]+@[^@\s()<>;,]+\.[^@\s()<>;,]+"


def holds(text: Column, marks: list[str]) -> Column:
    """Whether a text holds one of the marks."""
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def industry_support(name: Column, industry: Column) -> Column:
    return F.when(holds(F.lower(F.concat_ws(" ", name, industry)), FINANCIAL), "financial_beta").otherwise("standard")


def build_company(symbol: Column, name: Column, industry: Column, currency: Column) -> Column:
    """A listing: code, exchange, market, security id, currencies, standard and support; null where the symbol fits no rule."""

    def of(s: Column) -> Column:
        money, standard = F.lit(None).cast("string"), F.lit(None).cast("string")
        for market, (m, a) in MARKETS.items():
            money, standard = F.when(s["market"] == market, m).otherwise(money), F.when(s["market"] == market, a).otherwise(standard)
        label = F.coalesce(F.nullif(F.trim(name), F.lit("")), s["code"])
        return F.struct(
            s["code"].alias("ticker"), label.alias("name"), s["exchange"].alias("exchange"), s["market"].alias("market"), F.concat_ws(":", s["market"], s["exchange"], s["code"]).alias("security_id"),
            money.alias("listing_currency"), F.coalesce(F.nullif(F.upper(F.trim(currency)), F.lit("")), money).alias("reporting_currency"), standard.alias("accounting_standard"), industry_support(name, industry).alias("industry_support"),
        )

    known = F.filter(F.array(normalize_symbol(symbol)), lambda s: s.isNotNull())
    return F.get(F.transform(known, of), 0)


def statement_title(text: Column) -> Column:
    """(statement, scope) of a page whose first two lines hold a statement's title, else null."""

    def of(heading: Column) -> Column:
        scope = F.when(holds(heading, ["consolidated", "合并"]), "consolidated").when(holds(heading, ["parent", "母公司"]), "parent").otherwise("unknown")
        out = F.lit(None).cast("struct<statement:string,scope:string>")
        for statement, titles in reversed(STATEMENTS.items()):
            out = F.when(holds(heading, titles), F.struct(F.lit(statement).alias("statement"), scope.alias("scope"))).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.lower(F.substring_index(text, "\n", 2))), of), 0)


def authority(title: Column, company_id: Column) -> Column:
    """How native a document is to an A-share issuer: full annual reports count, translations, mirrored notices and summaries count against."""
    t = F.lower(title)
    points = F.when(holds(t, ["港股公告", "h股公告", "英文版", "english"]), -100).otherwise(0) + F.when(holds(t, ["年度报告", "年度報告", "annual report"]), 30).otherwise(0)
    return F.when(F.lower(company_id).startswith("cn_a:"), points - F.when(holds(t, ["摘要", "summary"]), 40).otherwise(0)).otherwise(0)


def revision_rank(title: Column, revision: Column, supersedes: Column) -> Column:
    """Corrected versions by their mark or title, one more where they name what they replace."""
    corrected = ~F.lower(revision).isin("", "original", "orig") | holds(F.lower(title), ["更正", "修订", "revision", "restated", "corrigendum"])
    return corrected.cast("int") + (F.coalesce(supersedes, F.lit("")) != "").cast("int")


def redact(text: Column, secrets: list[str]) -> Column:
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]")) if s else text
    return text


def filing_titled(title: Column, period: Column, form: Column) -> tuple[Column, Column]:
    """Period and form of a filing by its title (half-year before quarters before years), else those given; null period where neither says."""
    low = F.lower(title)
    rules = [(["半年度报告", "中期报告", "interim report"], "H1", "INTERIM_REPORT"), (["第一季度报告", "first quarter"], "Q1", "QUARTERLY_REPORT"), (["第三季度报告", "third quarter"], "Q3", "QUARTERLY_REPORT"), (["年度报告", "年报", "annual report"], "FY", "ANNUAL_REPORT")]
    given = F.when(F.upper(period).isin("FY", "H1", "Q1", "Q3"), F.upper(period))
    out_period, out_form = given, F.when(given.isNotNull(), F.coalesce(F.nullif(form, F.lit("")), F.when(given == "FY", "ANNUAL_REPORT").otherwise("INTERIM_REPORT")))
    for marks, p, f in reversed(rules):
        out_period, out_form = F.when(holds(low, marks), p).otherwise(out_period), F.when(holds(low, marks), f).otherwise(out_form)
    return out_period, out_form
