"""Queries over groups with a whole identity, sources that are reconciled, and second listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..operators import identity
from .records import said
from .registry import query
from .scalars import pick

# Concept, value, statement.
SOUND = [("revenue", 10.0, "income_statement"), ("net_income", 2.0, "income_statement"), ("operating_cash_flow", 3.0, "cash_flow"), ("assets", 100.0, "balance_sheet"), ("liabilities", 40.0, "balance_sheet"), ("total_equity", 60.0, "balance_sheet"), ("reported_roe", 0.1, "summary")]


def group_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, facts and evidence of suppliers; each twelfth supplier has its own fault."""
    k = F.col("s_suppkey")
    kind, concept = k % 12, F.col("f.concept")
    suppliers = table(spark, sf_dir, "supplier").select(k)
    groups = suppliers.select(said("a", k).alias("accession"), F.lit("2024-12-31").alias("end_date"), F.lit("FY").alias("period"), F.lit("consolidated").alias("scope"), F.lit("USD").alias("currency"))
    listed = suppliers.withColumn("f", F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(v).alias("value"), F.lit(s).alias("statement")) for c, v, s in SOUND])))
    listed = listed.filter((kind != 8) & ~((kind == 10) & (concept == "operating_cash_flow")))
    value = F.when((kind == 1) & (concept == "revenue"), -10.0).when((kind == 7) & (concept == "reported_roe"), 9.0).when((kind == 11) & (concept == "liabilities"), 0.5).otherwise(F.col("f.value"))
    facts = listed.select(
        said(k, "-", concept).alias("fact_id"), said("a", k).alias("accession"), F.lit("2024-12-31").alias("end_date"), F.when(k % 2 == 0, "fy").otherwise("").alias("period"), F.lit("consolidated").alias("scope"),
        F.when((kind == 2) & (concept == "assets"), "EUR").otherwise("USD").alias("currency"), F.when((kind == 9) & (concept == "total_equity"), "equity").otherwise(concept).alias("concept"), value.alias("value"),
        F.when((kind == 4) & (concept == "revenue"), "balance_sheet").otherwise(F.col("f.statement")).alias("statement"), F.lit("u").alias("source_url"), F.when((kind == 3) & (concept == "net_income"), "").otherwise("row").alias("raw_text"),
        F.when(kind == 5, "financial-ingestion-ast-v2").when(kind == 6, "vision-json-v1").otherwise("text").alias("parser"), F.lit(7).alias("page"),
    )
    evidence = facts.select(F.concat(F.lit("fact:"), "fact_id").alias("evidence_id"), F.when(F.col("concept") == "assets", "page:8").otherwise("page:7").alias("locator"), F.lit("h").alias("content_hash"), F.when(F.col("concept") != "revenue", F.array(F.lit(1.0))).alias("bbox"))
    return groups, facts, evidence


GATED = """with k as (select s_suppkey as k, s_suppkey % 12 as kind from supplier), g as (select 'a' || k as accession, kind, concat_ws('|', case when kind in (8) then 'balance_sheet_core_missing' end, case when kind = 11 then 'balance_sheet_imbalance' end, case when kind in (8, 10) then 'cash_flow_core_missing' end,
  case when kind in (8, 10) then 'core_coverage_insufficient' end, case when kind = 2 then 'group_identity_inconsistent' end, case when kind = 11 then 'implausible_liabilities_to_assets' end, case when kind = 7 then 'implausible_reported_roe' end, case when kind = 8 then 'income_statement_core_missing' end,
  case when kind = 1 then 'negative_revenue' end, case when kind = 8 then 'no_financial_facts' end, case when kind = 5 then 'pdf_evidence_bbox_missing' end, case when kind = 3 then 'provenance_missing' end, case when kind = 4 then 'statement_mismatch' end, case when kind = 6 then 'vision_evidence_provenance_missing' end) as issues from k)"""


@query(
    GATED + " select accession, issues, case when issues = '' then 'VERIFIED' else 'REJECTED' end as status, case kind when 8 then '' when 9 then 'assets|equity|liabilities|net_income|operating_cash_flow|reported_roe|revenue' when 10 then 'assets|liabilities|net_income|reported_roe|revenue|total_equity' else 'assets|liabilities|net_income|operating_cash_flow|reported_roe|revenue|total_equity' end as covered from g"
)
def identity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of each group, by its whole identity, its facts and their evidence."""
    return identity.validate_groups(*group_tables(spark, sf_dir)).select("accession", "issues", "status", "covered")


@query(GATED + " select accession, concept, value::double as value from g join (values ('revenue', 10.0), ('net_income', 2.0), ('operating_cash_flow', 3.0), ('assets', 100.0), ('liabilities', 40.0), ('total_equity', 60.0), ('reported_roe', 0.1)) f(c, value) on issues = '', lateral (select case when kind = 9 and c = 'total_equity' then 'equity' else c end as concept)")
def identity_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose identity is that of a good group."""
    groups, facts, evidence = group_tables(spark, sf_dir)
    return identity.accepted_facts(identity.validate_groups(groups, facts, evidence), facts, "usd").select("accession", "concept", "value")


@query(
    "with g as (select s_nationkey as company, 2018 + s_suppkey % 3 || '-12-31' as end_date, case s_suppkey % 5 when 0 then 'EUR' when 1 then '' else 'USD' end as currency, s_suppkey % 4 <> 0 and s_suppkey % 7 <> 0 as good from supplier), "
    "l as (select company, max(end_date) as latest from g group by 1), c as (select l.company, count(distinct currency) as n, max(currency) as currency from l left join g on g.company = l.company and end_date = latest and good and currency <> '' group by 1) "
    "select company, case when n = 1 then currency end as currency, case when n > 1 then 'ambiguous' when n = 1 then 'promoted' else 'kept' end as status from c"
)
def promoted_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    groups = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("company"), said(2018 + k % 3, "-12-31").alias("end_date"), F.lit("FY").alias("period"), F.when(k % 7 == 0, "parent").otherwise("consolidated").alias("scope"),
        pick(k % 5, "eur", "", "USD", "usd", "USD").alias("currency"), F.when(k % 4 == 0, "REJECTED").otherwise("VERIFIED").alias("status"),
    )
    return identity.promoted_currency(groups, "company")


@query("select s_suppkey as document_id, case s_suppkey % 5 when 1 then 'assets' when 2 then 'liabilities|total_equity' else '' end as from_vision from supplier")
def reconciled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound as it is; one replacement; two; two ways; none that passes."""
    k = F.col("s_suppkey")
    kind = k % 5
    numbers = {"revenue": (10, None), "net_income": (2, None), "operating_cash_flow": (3, None)}
    local = {**{c: F.lit(float(v)) for c, (v, _) in numbers.items()}, "assets": F.when(kind == 1, 1e5).otherwise(100.0), "liabilities": F.when(kind == 2, 9.0).when(kind.isin(3, 4), 30.0).otherwise(40.0), "total_equity": F.when(kind == 2, 20.0).when(kind.isin(3, 4), 30.0).otherwise(60.0)}
    vision = {"assets": F.when(kind == 4, 900.0).otherwise(100.0), "liabilities": F.when(kind == 3, 70.0).when(kind == 4, 31.0).when(kind == 2, 50.0).otherwise(41.0), "total_equity": F.when(kind == 3, 70.0).when(kind == 4, 32.0).when(kind == 2, 50.0).otherwise(61.0)}
    rows = lambda values: table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.inline(F.array(*[F.struct(F.lit(c).alias("concept"), v.alias("value")) for c, v in values.items()])))
    return identity.reconcile(rows(local), rows(vision), "document_id")


CANDIDATES = "c as (select user_id, event_id, value, ['assets', 'liabilities', 'equity', 'reported_roe'][event_id % 4 + 1] as concept, ['summary', 'income_statement', 'other'][event_id % 3 + 1] as statement, (event_id % 5 = 0)::int as scope from events)"


@query(
    f"with {CANDIDATES}, r as (select *, case when concept = 'reported_roe' then case when statement = 'summary' then 10 else 2 end + scope when statement = 'income_statement' then 10 + scope when statement = 'summary' then 1 else 0 end as rank from c), "
    "b as (select * from r where concept in ('assets', 'liabilities') qualify row_number() over (partition by user_id, concept order by rank desc, event_id) = 1), t as (select user_id, max(case when concept = 'assets' then value end) - max(case when concept = 'liabilities' then value end) as target from b group by 1) "
    "select user_id, concept, event_id, rank from r left join t using (user_id) qualify row_number() over (partition by user_id, concept order by rank desc, coalesce(case when concept = 'equity' then -abs(value - target) end, 0) desc, event_id) = 1"
)
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    told = table(spark, sf_dir, "events").select("user_id", "event_id", "value", pick(e % 4, "assets", "liabilities", "equity", "reported_roe").alias("concept"), pick(e % 3, "summary", "income_statement", "other").alias("statement"), F.when(e % 5 == 0, "consolidated").otherwise("parent").alias("scope"))
    return identity.ranked_candidates(told, "user_id", "event_id").select("user_id", "concept", "event_id", "rank")


@query(
    "with r as (select o_custkey % 50 as company, case when o_orderkey % 2 = 0 then 'revenue' else 'shares_outstanding' end as concept, o_orderkey % 3 as priority, ['USD', 'EUR', 'shares', 'GBP'][o_orderkey % 4 + 1] as unit, o_orderkey % 4 as unit_pos, ['10-K', '20-F', '40-F', '10-Q', '10-K'][o_orderkey % 5 + 1] as form, o_orderkey % 7 <> 0 as fy, "
    "case when o_orderkey % 11 <> 0 then year(o_orderdate) end as year, strftime(o_orderdate, '%Y-%m') as \"end\", o_orderkey as filed, o_totalprice as value from orders), "
    "u as (select *, case when concept = 'shares_outstanding' and unit = 'shares' then 0 when unit = 'EUR' then 1 when concept <> 'shares_outstanding' and unit = 'USD' then 2 else 3 end as rank from r), p as (select company, concept, priority, arg_min(unit, rank * 10 + unit_pos) as preferred from u group by all), "
    "o as (select r.* from r join p using (company, concept, priority) where unit = preferred and form <> '10-Q' and fy and year is not null qualify row_number() over (partition by company, concept, priority, year order by \"end\" desc, filed desc) = 1), "
    "b as (select * from o qualify row_number() over (partition by company, concept, year order by priority) = 1) select company, concept, year::int as year, 't' || priority as tag, value, \"end\" as end_date from b qualify row_number() over (partition by company, concept order by year desc) <= 10"
)
def annual_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("company"), F.when(o % 2 == 0, "revenue").otherwise("shares_outstanding").alias("concept"), said("t", o % 3).alias("tag"), (o % 3).alias("priority"), pick(o % 4, "USD", "EUR", "shares", "GBP").alias("unit"), (o % 4).alias("unit_pos"),
        pick(o % 5, "10-K", "20-F", "40-F", "10-Q", "10-K").alias("form"), F.when(o % 7 == 0, "Q1").otherwise("FY").alias("fp"), F.when(o % 11 == 0, "n/a").otherwise(F.year("o_orderdate").cast("string")).alias("fy"), F.date_format("o_orderdate", "yyyy-MM").alias("end"), o.alias("filed"), F.col("o_totalprice").alias("value"),
    )
    return identity.annual_by_tag(rows, "eur")


@query("select s_suppkey as document_id, case when s_suppkey % 3 = 2 then 'not_mapped' when s_suppkey % 2 = 1 or s_suppkey % 3 = 1 and s_suppkey % 4 = 0 then 'period_not_found' else 'ok' end as status, case when s_suppkey % 3 <> 2 and s_suppkey % 2 = 0 and not (s_suppkey % 3 = 1 and s_suppkey % 4 = 0) then case s_suppkey % 3 when 0 then 2 else 1 end else 0 end::bigint as n_facts from supplier")
def dual_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of a listing served by the facts of the issuer's other listing."""
    # Tickers with a second listing, its issuer and currency.
    issuers = spark.createDataFrame([("00005.HK", "0001089113", "USD"), ("09988.HK", "0001577552", "CNY")], "ticker string, issuer string, currency string")
    k = F.col("s_suppkey")
    filings = table(spark, sf_dir, "supplier").select(k.alias("document_id"), pick(k % 3, "00005.HK", "09988.HK", "00001.HK").alias("ticker"), said(2000 + k % 4, "-12-31").alias("period_end"), F.lit("FY").alias("fiscal_period"))
    facts = spark.createDataFrame([("0001089113", "2000-12-31", "fy", "usd"), ("0001089113", "2000-12-31", "FY", "USD"), ("0001089113", "2002-12-31", "FY", "USD"), ("0001089113", "2002-12-31", "FY", "USD"), ("0001089113", "2001-12-31", "FY", "EUR"), ("0001577552", "2002-12-31", "FY", "CNY"), ("0001577552", "2000-12-31", "H1", "CNY")], "issuer string, end_date string, period string, currency string")
    return identity.dual_listed(filings, issuers, facts)
