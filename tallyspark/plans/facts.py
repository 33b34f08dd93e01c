"""Queries over facts: matrices, growth, metrics, valuation and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CONCEPTS, FACTS_SQL, GROUPS_SQL, MATRIX_SQL, facts, money, table, wide_groups
from ..functions.numbers import format_money, safe_divide
from ..operators import gates, metrics, valuation
from .registry import query, rounded

RATIOS = ["operating_margin", "net_margin", "cash_conversion", "debt_to_assets", "return_on_equity"]
RATIO_SQL = """operating_income / nullif(revenue, 0) as operating_margin, net_income / nullif(revenue, 0) as net_margin, operating_cash_flow / nullif(net_income, 0) as cash_conversion,
  operating_cash_flow - capital_expenditure as free_cash_flow, liabilities / nullif(assets, 0) as debt_to_assets, net_income / nullif(total_equity, 0) as return_on_equity"""
ANNUAL_SQL = MATRIX_SQL + ", annual as (select * exclude (period) from matrix where period = 'FY')"
INTERIM_SQL = MATRIX_SQL + ", ends as (select company, year, period, max(end_date) as period_end from facts group by all), interim as (select matrix.*, period_end from matrix join ends using (company, year, period) where period <> 'FY')"


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.matrix(facts(spark, sf_dir).filter(metrics.is_annual()), ["company", "year"], CONCEPTS)


def interim(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir).filter(~metrics.is_annual())
    return metrics.matrix(known, ["company", "year", "period"], CONCEPTS, F.max("end_date").alias("period_end"))


def shown(df: DataFrame, keys: list[str], ratio: list[str] = ()) -> DataFrame:
    """Money to its four decimals, ratios to six digits."""
    own = [c for c in (*CONCEPTS, "free_cash_flow") if c in df.columns]
    return df.select(*keys, *[F.round(c, 4).alias(c) for c in own], *[F.round(c, 6).alias(c) for c in ratio])


@query(f"with {FACTS_SQL} select company, year, period, concept, round(value, 4) as value, filed_at from facts where period = 'FY'")
def annual_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter(metrics.is_annual()).select("company", "year", "period", "concept", F.round("value", 4).alias("value"), "filed_at")


@query(f"with {FACTS_SQL} select company, year, period, concept, round(value, 4) as value, filed_at from facts where period <> 'FY'")
def interim_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).filter(~metrics.is_annual()).select("company", "year", "period", "concept", F.round("value", 4).alias("value"), "filed_at")


@query(f"with {ANNUAL_SQL} select company, year, {rounded(CONCEPTS, 4)} from annual")
def annual_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(annual(spark, sf_dir), ["company", "year"])


@query(f"with {ANNUAL_SQL}, g as (select company, year, revenue, lag(revenue) over (partition by company order by year) as p from annual) select company, year, round(p, 4) as previous_revenue, round(revenue / nullif(p, 0) - 1, 6) as revenue_growth from g")
def annual_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.annual_growth(annual(spark, sf_dir)).select("company", "year", F.round("previous_revenue", 4).alias("previous_revenue"), F.round("revenue_growth", 6).alias("revenue_growth"))


@query(
    f"with {ANNUAL_SQL}, g as (select *, revenue / nullif(lag(revenue) over (partition by company order by year), 0) - 1 as revenue_growth, {RATIO_SQL} from annual) "
    f"select company, year, {rounded([*CONCEPTS, 'free_cash_flow'], 4)}, {rounded(['revenue_growth', *RATIOS])} from g"
)
def annual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(metrics.annual_metrics(annual(spark, sf_dir)), ["company", "year"], ["revenue_growth", *RATIOS])


@query("select l_orderkey, l_linenumber, cast(l_extendedprice as double) / nullif(l_tax, 0) as quotient from lineitem")
def safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", safe_divide("l_extendedprice", "l_tax").alias("quotient"))


@query(f"with {INTERIM_SQL} select company, year, period, period_end, {rounded(CONCEPTS, 4)} from interim")
def interim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(interim(spark, sf_dir), ["company", "year", "period", "period_end"])


COMPARED_SQL = (
    INTERIM_SQL
    + """, compared as (
  select i.*, case when p.company is not null then (i.year - 1) || ' ' || i.period end as comparison_period,
    case when p.revenue is not null then null when p.company is not null then 'prior_revenue_unavailable' else 'prior_period_unavailable' end as comparison_gap,
    i.revenue / nullif(p.revenue, 0) - 1 as revenue_growth
  from interim i left join interim p on p.company = i.company and p.year = i.year - 1 and p.period = i.period
)"""
)


@query(f"with {COMPARED_SQL} select company, year, period, comparison_period, comparison_gap, round(revenue_growth, 6) as revenue_growth from compared")
def interim_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.interim_comparison(interim(spark, sf_dir)).select("company", "year", "period", "comparison_period", "comparison_gap", F.round("revenue_growth", 6).alias("revenue_growth"))


@query(
    f"with {COMPARED_SQL}, g as (select *, {RATIO_SQL} from compared) select company, year, period, period_end, comparison_period, comparison_gap, "
    f"{rounded([*CONCEPTS, 'free_cash_flow'], 4)}, {rounded(['revenue_growth', *RATIOS])} from g"
)
def interim_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["company", "year", "period", "period_end", "comparison_period", "comparison_gap"]
    return shown(metrics.interim_metrics(interim(spark, sf_dir)), keys, ["revenue_growth", *RATIOS])


# Valuation: the latest year of each company against the sum of its orders as market value.

BASE_SQL = (
    ANNUAL_SQL
    + """, caps as (select c_nationkey as company, cast(sum(cast(o_totalprice as decimal(18,2))) as double) / 10 as market_cap from orders join customer on o_custkey = c_custkey group by 1),
base as (
  select company, year, operating_cash_flow - capital_expenditure as fcf, market_cap from annual join caps using (company)
  qualify row_number() over (partition by company order by year desc) = 1
)"""
)


def multiple_sql(growth: str) -> str:
    g = f"(1 + ({growth}))"
    years = " + ".join(f"{g}**{t} / 1.1::double**{t}" for t in range(1, 6))
    return f"({years} + {g}**5 * 1.03 / 0.07 / 1.1::double**5)"


def valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = metrics.annual_metrics(annual(spark, sf_dir)).groupBy("company").agg(F.max("year").alias("year"), F.max_by("free_cash_flow", "year").alias("fcf"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("company"))
    orders = table(spark, sf_dir, "orders")
    caps = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("company").agg((F.sum(money("o_totalprice")).cast("double") / 10).alias("market_cap"))
    return own.join(caps, "company")


@query(f"with {BASE_SQL} select company, year, round(fcf, 2) as fcf, case when fcf > 0 then round(fcf * {multiple_sql('0.12')}, 2) end as value from base")
def dcf_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(spark, sf_dir).select("company", "year", F.round("fcf", 2).alias("fcf"), F.round(valuation.dcf_value(F.col("fcf"), F.lit(0.12)), 2).alias("value"))


@query(f"with {BASE_SQL} select company, growth, case when fcf > 0 then round(fcf * {multiple_sql('growth')}, 2) end as value from base, (select cast(unnest([-0.05, 0, 0.05, 0.10, 0.15, 0.20, 0.30]) as double) as growth)")
def dcf_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.explode(F.array(*[F.lit(s) for s in valuation.STEPS])).alias("growth")
    return valued(spark, sf_dir).select("company", "fcf", steps).select("company", "growth", F.round(valuation.dcf_value(F.col("fcf"), F.col("growth")), 2).alias("value"))


@query(
    f"with recursive {BASE_SQL}, search as (select company, market_cap / fcf as wanted, -0.6::double as low, 1.5::double as high, 0 as n from base where fcf > 0 and market_cap > 0 "
    f"union all select company, wanted, case when {multiple_sql('(low + high) / 2')} < wanted then (low + high) / 2 else low end, case when {multiple_sql('(low + high) / 2')} < wanted then high else (low + high) / 2 end, n + 1 from search where n < 100) "
    f"select base.company, case when wanted between {multiple_sql('-0.6::double')} and {multiple_sql('1.5::double')} then round((low + high) / 2, 6) end as implied_growth from base left join (select * from search where n = 100) s on s.company = base.company"
)
def implied_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valued(spark, sf_dir).select("company", F.round(valuation.implied_growth(F.col("market_cap"), F.col("fcf")), 6).alias("implied_growth"))


@query(f"with {BASE_SQL} select company, case when company % 6 = 0 then 'not_applicable' when company % 4 = 1 then 'currency_mismatch' when coalesce(fcf, 0) <= 0 then 'insufficient_data' else 'ok' end as status from base")
def valuation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("company") % 6 == 0, "not_applicable").when(F.col("company") % 4 == 1, "currency_mismatch").when(F.coalesce("fcf", F.lit(0.0)) <= 0, "insufficient_data").otherwise("ok")
    return valued(spark, sf_dir).select("company", status.alias("status"))


# Gates.

FLAGGED_SQL = (
    GROUPS_SQL
    + f""", flags as (select company, year, period, bool_or(accession = '') as blank_accession, bool_or(currency = '') as blank_currency from (with {FACTS_SQL} select * from facts) group by all),
flagged as (select groups.*, blank_accession, blank_currency from groups join flags using (company, year, period))"""
)
BALANCE_SQL = {
    "negative_revenue": "revenue < 0",
    "implausible_liabilities_to_assets": "(liabilities / nullif(assets, 0) < 0.01 or liabilities / nullif(assets, 0) > 1.5)",
    "implausible_total_equity": "abs(total_equity) / nullif(abs(assets), 0) < 0.01",
    "balance_sheet_imbalance": "(assets <> 0 and abs(assets - liabilities - total_equity) / greatest(abs(assets), 1) > 0.08)",
}
STRICT_SQL = {
    "income_statement_core_missing": "(revenue is null or net_income is null)",
    "cash_flow_core_missing": "operating_cash_flow is null",
    "balance_sheet_core_missing": "(assets is null or liabilities is null or total_equity is null)",
    "core_coverage_insufficient": "(revenue is null or net_income is null or operating_cash_flow is null or assets is null or liabilities is null or total_equity is null)",
    "group_identity_inconsistent": "blank_currency",
    "provenance_missing": "blank_accession",
}
LENIENT_SQL = {"core_coverage_insufficient": "(" + " + ".join(f"({c} is not null)::int" for c in gates.CORE) + " < 3)"}


def issues_sql(rules: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"case when {rules[r]} then '{r}' end" for r in sorted(rules)) + ")"


VALID_SQL = FLAGGED_SQL + f", valid as (select *, {issues_sql(BALANCE_SQL | STRICT_SQL)} as issues, case when {issues_sql(BALANCE_SQL | STRICT_SQL)} = '' then 'VERIFIED' else 'REJECTED' end as status from flagged)"


def validated(spark: SparkSession, sf_dir: str, known: DataFrame | None = None) -> DataFrame:
    """Groups with their issues and status. known: the groups of wide_groups(), where a caller reads them too: one plan, whose exchanges Spark reuses."""
    keys = ["company", "year", "period"]
    known = wide_groups(spark, sf_dir) if known is None else known
    groups = known.join(gates.group_flags(facts(spark, sf_dir, known), keys), keys)
    return gates.validate(groups, gates.balance_rules() | gates.coverage_rules())


@query(f"with {VALID_SQL} select company, year, period, issues, status from valid")
def group_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir).select("company", "year", "period", "issues", "status")


@query(f"with {GROUPS_SQL}, v as (select *, {issues_sql(BALANCE_SQL | LENIENT_SQL)} as issues from groups) select company, year, period, issues, case when issues = '' then 'VERIFIED' else 'REJECTED' end as status from v")
def group_validation_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.validate(wide_groups(spark, sf_dir), gates.balance_rules() | gates.lenient_rules()).select("company", "year", "period", "issues", "status")


@query(f"with {VALID_SQL} select company, count(*) filter (status = 'VERIFIED') as accepted, count(*) filter (status <> 'VERIFIED') as rejected, case when not bool_or(status = 'VERIFIED') then 'REJECTED' when bool_and(status = 'VERIFIED') then 'VERIFIED' else 'READY_WITH_WARNINGS' end as status from valid group by company")
def dataset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.dataset_status(validated(spark, sf_dir), "company")


@query(
    f"with {FACTS_SQL}, d as (select c_custkey as company from customer where c_custkey <= 40), f as (select company + case when company % 3 = 0 then 15 else 0 end as company, concept from facts where company % 2 = 0 or concept in ('liabilities', 'total_equity')), "
    "c as (select company, bool_or(concept in ('revenue', 'net_income', 'assets', 'operating_cash_flow')) as core from f group by company) select d.company, case when core is null then 'no_financial_facts' when not core then 'no_core_financial_facts' else '' end as issue from d left join c using (company)"
)
def dataset_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies without facts, or with none of the core."""
    known = facts(spark, sf_dir).filter((F.col("company") % 2 == 0) | F.col("concept").isin("liabilities", "total_equity"))
    moved = known.withColumn("company", F.col("company") + F.when(F.col("company") % 3 == 0, 15).otherwise(0))
    return gates.dataset_presence(table(spark, sf_dir, "customer").filter("c_custkey <= 40").select(F.col("c_custkey").alias("company")), moved, "company")


@query(f"with {VALID_SQL}, l as (select * from valid where period = 'FY' qualify row_number() over (partition by company order by year desc) = 1) select company, year, round(revenue, 4) as revenue from l where status = 'VERIFIED'")
def fail_closed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.latest_or_nothing(validated(spark, sf_dir).filter("period = 'FY'"), "company", "year").select("company", "year", F.round("revenue", 4).alias("revenue"))


@query(f"with {FACTS_SQL}, ok as (with {VALID_SQL} select company, year, period from valid where status = 'VERIFIED') select company, year, period, concept, input_pos, round(value, 4) as value from facts semi join ok using (company, year, period) where currency = 'USD'")
def accepted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = wide_groups(spark, sf_dir)
    good = validated(spark, sf_dir, known).filter("status = 'VERIFIED'").select("company", "year", "period")
    return facts(spark, sf_dir, known).filter("currency = 'USD'").join(good, ["company", "year", "period"], "left_semi").select("company", "year", "period", "concept", "input_pos", F.round("value", 4).alias("value"))


@query(
    f"with {VALID_SQL}, s as (select distinct company || '-' || year as accession, year || '-12-31' as period_end, 'ANNUAL_REPORT' as form_type from valid where year % 2 = 0), "
    f"m as (select distinct company || '-' || year as accession, year || '-12-30' as period_end, 'CORRECTED' as form_type from valid where year % 3 = 0), "
    f"g as (select company || '-' || year as accession, year || '-12-31' as period_end, status, issues from valid where period = 'FY' and year >= 1998) "
    f"select accession, coalesce(g.period_end, m.period_end, s.period_end) as period_end, coalesce(m.form_type, s.form_type, '') as form_type, "
    f"case when status is null then 'no_facts' when status = 'REJECTED' then 'rejected' else 'accepted' end as status, coalesce(issues, '') as issues from s full join m using (accession) full join g using (accession)"
)
def continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validated(spark, sf_dir).filter("period = 'FY'").withColumn("accession", F.concat_ws("-", "company", "year"))
    year = F.col("year").cast("string")
    selected = valid.filter("year % 2 = 0").select("accession", F.concat(year, F.lit("-12-31")).alias("period_end"), F.lit("ANNUAL_REPORT").alias("form_type"))
    manifests = valid.filter("year % 3 = 0").select("accession", F.concat(year, F.lit("-12-30")).alias("period_end"), F.lit("CORRECTED").alias("form_type"))
    groups = valid.filter("year >= 1998").select("accession", F.concat(year, F.lit("-12-31")).alias("period_end"), "status", "issues")
    return gates.continuity(selected, manifests, groups)


@query(f"with {ANNUAL_SQL} select company, cast(sum({' + '.join(f'({c} is null)::int' for c in CONCEPTS)}) as bigint) as missing, count(*) * {len(CONCEPTS)} as cells from annual group by company")
def metric_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = sum((F.col(c).isNull().cast("long") for c in CONCEPTS), F.lit(0))
    return annual(spark, sf_dir).groupBy("company").agg(F.sum(gaps).alias("missing"), (F.count("*") * len(CONCEPTS)).alias("cells"))


@query(
    f"with {ANNUAL_SQL}, s as (select company, year, revenue, lag(year) over w as py, lag(revenue) over w as pr from annual where revenue > 0 window w as (partition by company order by year)) "
    "select company, year, round(greatest(revenue, pr) / greatest(least(revenue, pr), 1), 6) as ratio, greatest(revenue, pr) / greatest(least(revenue, pr), 1) > 20 as implausible from s where year - py = 1"
)
def revenue_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.consecutive_jumps(annual(spark, sf_dir))


@query(f"with {ANNUAL_SQL}, x as (select company, year, case when revenue >= 1e9 then round(revenue / 1e9, 2) when revenue >= 1e6 then round(revenue / 1e6, 2) end as v, case when revenue >= 1e9 then 'B' else 'M' end as m from annual where revenue >= 1e6) select company, year, '$' || format('{{:,.2f}}', v) || m as shown from x")
def format_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual(spark, sf_dir).filter("revenue >= 1e6").select("company", "year", format_money(F.col("revenue"), F.lit("USD")).alias("shown"))
