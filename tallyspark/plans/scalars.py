"""Queries over single values: printed numbers, ratios, ranges, dates, titles, companies. Each oracle works out the value from the row, not from the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FILINGS_SQL, filings, table
from ..functions import dates, numbers, texts
from .registry import query


def pick(n: Column, *values: Column | str) -> Column:
    """The n-th of some values, counted from 0."""
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (n + 1).cast("int"))


@query(
    "select o_orderkey, cast(case o_orderkey % 6 when 0 then o_custkey * 1000.0 when 1 then o_custkey * 1000 + 500.25 when 2 then -(o_custkey + 10000.5) when 4 then -o_custkey end as double) + 0 as value from orders"
)
def row_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value behind a label: footnotes, note numbers, parentheses, dashes, minus signs, none."""
    c = F.col("o_custkey").cast("string")
    far = (F.col("o_custkey") + 10000).cast("string")
    tail = pick(F.col("o_orderkey") % 6, F.concat(F.lit(" (1) "), c, F.lit(",000 9")), F.concat(F.lit("7  "), c, F.lit(",500.25")), F.concat(F.lit("("), far, F.lit(".5) 3")), "— 12", F.concat(F.lit("① -"), c), "n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", (numbers.row_value(tail) + 0).alias("value"))


@query("select event_id, case when abs(v) > 1 then v / 100 else v end as roe, abs(v) as spent, v <> 0 and abs(v) < 1e18 as plausible from (select event_id, case event_id % 9 when 0 then 0.0 when 1 then 1e18 else value - 50 end::double as v from events)")
def normal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 9 == 0, 0.0).when(F.col("event_id") % 9 == 1, 1e18).otherwise(F.col("value") - 50)
    return table(spark, sf_dir, "events").select("event_id", numbers.ratio(v).alias("roe"), F.abs(v).alias("spent"), numbers.plausible(v).alias("plausible"))


@query(
    "with p as (select event_id, event_id % 5 as kind, (event_id % 10) / 10.0::double as low, (event_id % 7 + 3) / 10.0::double as high from events) "
    "select event_id, case when good then low end as low, case when good then high end as high, case when good then printf('%.0f%%–%.0f%%', low * 100, high * 100) else 'Insufficient evidence' end as label from (select *, kind < 2 and low <= high as good from p)"
)
def probability_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs told as an object or a list; none of other shapes or the wrong way round."""
    low, high = ((F.col("event_id") % 10) / 10.0).cast("string"), ((F.col("event_id") % 7 + 3) / 10.0).cast("string")
    told = pick(F.col("event_id") % 5, F.concat(F.lit('{"low": '), low, F.lit(', "high": '), high, F.lit("}")), F.concat(F.lit("["), low, F.lit(", "), high, F.lit("]")), F.concat(F.lit("["), low, F.lit("]")), '{"low": "x"}', "broken")
    made = table(spark, sf_dir, "events").select("event_id", numbers.probability_pair(F.try_parse_json(told)).alias("p"))
    return made.select("event_id", "p.low", "p.high", numbers.format_range(F.col("p")).alias("label"))


@query("select event_id, greatest(1, least(200, event_id % 400 - 50))::bigint as rows, greatest(30.0, least(600.0, value * 10)) as timeout, greatest(0.0, least(100.0, value * 2 - 30)) as percent from events")
def clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", numbers.clamp(F.col("event_id") % 400 - 50, 1, 200).cast("long").alias("rows"), numbers.clamp(v * 10, 30.0, 600.0).alias("timeout"), numbers.clamp(v * 2 - 30, 0.0, 100.0).alias("percent"))


@query(
    f"with {FILINGS_SQL}, d as (select document_id, fiscal_period as p, year, case when document_id % 11 <> 0 then cast(period_end as date) end as e, case when document_id % 2 = 0 then 'balance_sheet' else 'cash_flow' end as s from filings), "
    "b as (select *, case when month(e) = 2 and day(e) = 29 then e - 364 else cast(e - interval 1 year + interval 1 day as date) end as back from d) "
    "select document_id, coalesce(case when p = 'FY' then back when p = 'Q1' then cast(date_trunc('quarter', e) as date) else cast(date_trunc('month', e) - to_months(case p when 'H1' then 5 when 'Q3' then 8 else 0 end) as date) end, make_date(year, 1, 1)) as elapsed, "
    "case when s <> 'balance_sheet' then case when p = 'FY' then back else make_date(year(e), 1, 1) end end as statement from b"
)
def cumulative_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts by the months gone by, and those of a statement's reader."""
    end = F.when(F.col("document_id") % 11 != 0, F.to_date("period_end"))
    kind = F.when(F.col("document_id") % 2 == 0, "balance_sheet").otherwise("cash_flow")
    return filings(spark, sf_dir).select("document_id", dates.elapsed_start(end, F.col("fiscal_period"), F.col("year")).alias("elapsed"), dates.statement_start(end, F.col("fiscal_period"), kind).alias("statement"))


@query(f"with {FILINGS_SQL} select document_id, case document_id % 4 when 0 then year(cast(filed_at as date)) when 1 then 0 else year end::int as year from filings")
def fiscal_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("document_id") % 4
    end, filed = F.when(kind < 2, "n/a").otherwise(F.col("period_end")), F.when(kind == 1, "").otherwise(F.col("filed_at"))
    return filings(spark, sf_dir).select("document_id", dates.fiscal_year(end, filed).alias("year"))


@query(
    "select event_id, case event_id % 4 when 0 then date_trunc('minute', ts) when 1 then date_trunc('day', ts) when 2 then date_trunc('second', ts) else make_timestamp(2000 + event_id % 25, 1, 1, 0, 0, 0) end as filed from events"
)
def printed_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the formats of title searches; else the year of the title."""
    text = pick(F.col("event_id") % 4, F.date_format("ts", "dd/MM/yyyy HH:mm"), F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "soon")
    return table(spark, sf_dir, "events").select("event_id", dates.printed_date(text, (2000 + F.col("event_id") % 25).cast("int")).alias("filed"))


@query("select p_partkey, case when p_partkey % 6 < 3 then 'financial_beta' else 'standard' end as support from part")
def industry_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick(F.col("p_partkey") % 6, "First BANK of ", "中国保险 ", "Acme ", "River ", "Baker ", "Trust me ")
    industry = F.when(F.col("p_partkey") % 6 == 2, "Securities dealing").otherwise("trade")
    return table(spark, sf_dir, "part").select("p_partkey", texts.industry_support(F.concat(name, F.col("p_partkey").cast("string")), industry).alias("support"))


@query(
    "with c as (select c_custkey as k, c_custkey % 4 as kind from customer) select k as c_custkey, case kind when 0 then '6' || lpad(k::varchar, 5, '0') when 1 then lpad((k % 9000 + 1000)::varchar, 5, '0') when 2 then 'ACME' end as ticker, "
    "case kind when 0 then 'CN_A:SSE:6' || lpad(k::varchar, 5, '0') when 1 then 'HK:HKEX:' || lpad((k % 9000 + 1000)::varchar, 5, '0') when 2 then 'US:NASDAQ:ACME' end as security_id, case kind when 0 then 'CNY' when 1 then 'HKD' when 2 then 'USD' end as listing_currency, "
    "case when kind <> 3 then case when k % 5 = 0 then 'EUR' else case kind when 0 then 'CNY' when 1 then 'HKD' else 'USD' end end end as reporting_currency, case kind when 0 then 'CAS' when 1 then 'UNKNOWN' when 2 then 'US_GAAP' end as accounting_standard, "
    "case when kind <> 3 then case when k % 3 = 0 then 'financial_beta' else 'standard' end end as industry_support from c"
)
def build_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings from symbols and names; a symbol that fits no rule gives none."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    symbol = pick(kind, F.concat(F.lit("6"), F.lpad(k.cast("string"), 5, "0"), F.lit(".SS")), (k % 9000 + 1000).cast("string"), "acme", "?")
    made = texts.build_company(symbol, F.col("c_name"), F.when(k % 3 == 0, "Insurance").otherwise("trade"), F.when(k % 5 == 0, " eur ").otherwise(""))
    company = table(spark, sf_dir, "customer").select("c_custkey", made.alias("c"))
    return company.select("c_custkey", *[f"c.{x}" for x in ("ticker", "security_id", "listing_currency", "reporting_currency", "accounting_standard", "industry_support")])


@query(
    "select p_partkey, ['balance_sheet', 'income_statement', 'cash_flow', 'balance_sheet', NULL, NULL][p_partkey % 6 + 1] as statement, ['consolidated', 'parent', 'unknown', 'consolidated', NULL, NULL][p_partkey % 6 + 1] as scope from part"
)
def statement_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles count in the first two lines of a page only."""
    page = pick(F.col("p_partkey") % 6, "Acme\nConsolidated Balance Sheet\nx", "母公司利润表\n2", "Statement of Cash Flows", "合并资产负债表\nRMB", "a\nb\nbalance sheet: 资产负债表", "prose")
    made = table(spark, sf_dir, "part").select("p_partkey", texts.statement_title(page).alias("t"))
    return made.select("p_partkey", "t.statement", "t.scope")


TITLED = ["2020年年度报告（英文版）", "Annual Report 2020 summary", "H股公告 revised", "notes restated", "2021年年度报告 更正"]
FILED_SQL = f"""with {FILINGS_SQL}, t as (
  select *, case when document_id % 2 = 0 then 'CN_A:x' else 'HK:y' end as issuer, [-70, -10, -100, 0, 30][document_id % 5 + 1] as points, document_id % 5 in (3, 4) or revision <> 'original' as corrected from filings
), r as (select *, case when document_id % 2 = 0 then points else 0 end as authority, corrected::int + (document_id % 3 = 0)::int as rev,
  case form_type when 'ANNUAL_REPORT' then 4 when 'QUARTERLY_REPORT' then 3 when 'INTERIM_REPORT' then 2 else 1 end as kind from t)"""


@query(FILED_SQL + " select document_id, authority, rev as revision_rank, row_number() over (partition by company order by period_end desc, kind desc, authority desc, filed_at desc, document_id) as place from r")
def filing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority and revision rank of filings, and their order within a company: newest period, kind, authority, filed."""
    from pyspark.sql import Window as W

    from ..operators.selection import filing_sort

    d = F.col("document_id")
    title, issuer = pick(d % 5, *TITLED), F.when(d % 2 == 0, "CN_A:x").otherwise("HK:y")
    named = filings(spark, sf_dir).withColumns({"authority": texts.authority(title, issuer), "revision_rank": texts.revision_rank(title, F.col("revision"), F.when(d % 3 == 0, "old").otherwise(""))})
    place = F.row_number().over(W.partitionBy("company").orderBy(*filing_sort(), "document_id")).cast("long")
    return named.select("document_id", "authority", "revision_rank", place.alias("place"))


@query("select event_id, printf('%.1f%%', (event_id % 1000) / 1000.0 * 100) as share, case when event_id % 3 = 0 then 'key [REDACTED] of ' || event_id || ' [REDACTED]' else 'none' end as safe from events")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("key s3cr3t of "), F.col("event_id").cast("string"), F.lit(" t0ken"))).otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", numbers.format_percent((F.col("event_id") % 1000) / 1000.0).alias("share"), texts.redact(said, ["s3cr3t", "t0ken", ""]).alias("safe"))


@query("select event_id, event_id % 3 = 0 as valid, case event_id % 3 when 0 then 'u' || event_id || '@site.org' when 1 then 'u' || event_id || '@site.org' else '' end as email from events")
def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.concat(F.lit("u"), F.col("event_id").cast("string"), F.lit("@site.org"))
    said = pick(F.col("event_id") % 3, F.concat(F.lit(" "), one), F.concat(F.lit("agent/1 (name; contact: "), one, F.lit(")")), "u@site")
    return table(spark, sf_dir, "events").select("event_id", F.trim(said).rlike(texts.EMAIL).alias("valid"), F.regexp_extract(said, f"({texts.EMAIL_WITHIN})", 1).alias("email"))


@query(
    f"with {FILINGS_SQL}, k as (select document_id, document_id % 6 as kind, fiscal_period, form_type, year, period_end from filings) select document_id, case kind when 0 then 'H1' when 1 then 'Q1' when 2 then 'Q3' when 3 then 'FY' else nullif(fiscal_period, 'IPO') end as period, "
    "case kind when 0 then 'INTERIM_REPORT' when 1 then 'QUARTERLY_REPORT' when 2 then 'QUARTERLY_REPORT' when 3 then 'ANNUAL_REPORT' else case when fiscal_period <> 'IPO' then form_type end end as form, "
    "case when document_id % 2 = 0 then period_end else case case kind when 0 then 'H1' when 1 then 'Q1' when 2 then 'Q3' when 3 then 'FY' else fiscal_period end when 'FY' then year || '-12-31' when 'H1' then year || '-06-30' when 'Q1' then year || '-03-31' when 'Q3' then year || '-09-30' end end as period_end from k where kind < 4 or fiscal_period <> 'IPO'"
)
def titled_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period and form by title (half-year first), the supplied end where it is a date."""
    title = pick(F.col("document_id") % 6, "2020年半年度报告（年度报告）", "First Quarter 2020", "2020年第三季度报告", "Annual Report", "notice", "")
    period, form = texts.filing_titled(title, F.col("fiscal_period"), F.col("form_type"))
    supplied = F.when(F.col("document_id") % 2 == 0, F.col("period_end")).otherwise("unknown")
    made = filings(spark, sf_dir).select("document_id", "year", "filed_at", period.alias("period"), form.alias("form"), supplied.alias("supplied")).filter("period is not null")
    return made.select("document_id", "period", "form", dates.calendar_end(F.col("year"), F.col("period"), F.col("filed_at"), F.col("supplied")).alias("period_end"))


@query(
    "with r as (select s_nationkey as company, s_suppkey, case when s_nationkey % 3 <> 0 then s_acctbal end as margin, case when s_suppkey % 2 = 0 then s_acctbal end as growth, null::double as roe from supplier qualify row_number() over (partition by s_nationkey order by s_suppkey desc) <= 5) "
    "select company, count(*) as rows, concat_ws('|', case when count(margin) > 0 then 'margin' end, case when count(growth) > 0 then 'growth' end) as columns from r group by company"
)
def coverage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five rows of each company, and the columns that have a value in any of them."""
    from ..operators.metrics import covered_columns

    key, value = F.col("s_suppkey"), F.col("s_acctbal")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("company"), key, F.when(F.col("s_nationkey") % 3 != 0, value).alias("margin"), F.when(key % 2 == 0, value).alias("growth"), F.lit(None).cast("double").alias("roe"))
    return covered_columns(rows, "company", "s_suppkey", ["margin", "growth", "roe"], 5)
