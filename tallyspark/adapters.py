"""Views that give the star tables the shape of facts, filings, claims and listings.

Money is DECIMAL until the last step, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONCEPTS = ["revenue", "net_income", "operating_income", "operating_cash_flow", "capital_expenditure", "assets", "liabilities", "total_equity"]
STATEMENT = {
    "revenue": "income_statement", "net_income": "income_statement", "operating_income": "income_statement", "operating_cash_flow": "cash_flow",
    "capital_expenditure": "cash_flow", "assets": "balance_sheet", "liabilities": "balance_sheet", "total_equity": "balance_sheet",
}
#: Period, last month that it covers, last day.
PERIODS = [("FY", 12, "12-31"), ("Q1", 3, "03-31"), ("H1", 6, "06-30"), ("Q3", 9, "09-30")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def wide_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each company, year and period with a DOUBLE column for each concept (null: no such fact).

    Lines are summed by month first (partial sums before the exchange); the few hundred monthly rows are then dealt to periods.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    companies = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("company"))
    placed = orders.join(companies, orders["o_custkey"] == companies["c_custkey"])
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus", (money("l_extendedprice") * (1 - money("l_discount"))).alias("net"))
    joined = lines.join(placed.select("o_orderkey", "company", "year", "month"), lines["l_orderkey"] == F.col("o_orderkey"))
    net = F.col("net")
    by_line = joined.groupBy("company", "year", "month").agg(
        F.sum(net).alias("revenue"),
        F.sum(F.when(F.col("l_returnflag") == "N", net)).alias("net_income"),
        F.sum(F.when(F.col("l_quantity") > 20, net)).alias("operating_income"),
        F.sum(F.when(F.col("l_linestatus") == "F", net)).alias("operating_cash_flow"),
        F.sum(F.when(F.col("l_returnflag") == "R", net)).alias("capital_expenditure"),
    )
    price, status = money("o_totalprice"), F.col("o_orderstatus")
    own = F.when(F.col("company") % 5 == 0, status == "F").otherwise(status != "O")
    by_order = placed.groupBy("company", "year", "month").agg(
        F.sum(price).alias("assets"), F.sum(F.when(status == "O", price)).alias("liabilities"), F.sum(F.when(own, price)).alias("total_equity")
    )
    monthly = by_order.join(by_line, ["company", "year", "month"], "left")
    period = F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.lit(last).alias("last")) for p, last, _ in PERIODS])).alias("p")
    dealt = monthly.select("*", period).filter(F.col("month") <= F.col("p.last"))
    return dealt.groupBy("company", "year", F.col("p.period").alias("period")).agg(*[F.sum(c).cast("double").alias(c) for c in CONCEPTS])


def facts(spark: SparkSession, sf_dir: str, groups: DataFrame | None = None) -> DataFrame:
    """The groups as a long table of facts; companies with an even key file again a month later, with exact values.

    A few facts lack their accession or their currency, so that the gates have something to find. groups: those of wide_groups(), if they are at hand.
    """
    long = (wide_groups(spark, sf_dir) if groups is None else groups).unpivot(["company", "year", "period"], CONCEPTS, "concept", "exact").filter("exact is not null")
    end = F.lit(None).cast("string")
    for p, _, day in PERIODS:
        end = F.when(F.col("period") == p, F.concat(F.col("year").cast("string"), F.lit("-" + day))).otherwise(end)
    statement = F.lit(None).cast("string")
    for c, s in STATEMENT.items():
        statement = F.when(F.col("concept") == c, s).otherwise(statement)
    revision = F.explode(F.when(F.col("company") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("input_pos")
    told = long.select("*", end.alias("end_date"), statement.alias("statement"), revision)
    draft = (F.col("input_pos") == 0) & (F.col("company") % 2 == 0)
    return told.select(
        "company", "year", "period", "concept", F.when(draft, F.floor("exact").cast("double")).otherwise(F.col("exact")).alias("value"),
        F.concat((F.col("year") + 1).cast("string"), F.when(F.col("input_pos") == 0, "-02-15").otherwise("-03-15")).alias("filed_at"),
        "input_pos", "end_date", "statement",
        F.when((F.col("company") % 7 == 3) & (F.col("year") % 3 == 0) & (F.col("concept") == "assets"), "").otherwise(F.concat_ws("-", "company", "year", "period")).alias("accession"),
        F.when((F.col("company") == 4) & (F.col("year") == 1998), "").otherwise("USD").alias("currency"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: period from the priority, revised when finished."""
    first = F.substring("o_orderpriority", 1, 1)
    period = F.element_at(F.create_map(*[F.lit(x) for x in ("1", "FY", "2", "Q1", "3", "H1", "4", "Q3", "5", "IPO")]), first)
    form = F.element_at(F.create_map(*[F.lit(x) for x in ("FY", "ANNUAL_REPORT", "Q1", "QUARTERLY_REPORT", "H1", "INTERIM_REPORT", "Q3", "QUARTERLY_REPORT", "IPO", "PROSPECTUS")]), F.col("fiscal_period"))
    day = F.to_date("o_orderdate")
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("company"), period.alias("fiscal_period"), F.date_format(day, "yyyy-MM-dd").alias("period_end"),
        F.year(day).alias("year"), F.date_format(F.date_add(day, (F.col("o_orderkey") % 90).cast("int")), "yyyy-MM-dd").alias("filed_at"),
        F.when(F.col("o_orderstatus") == "F", "revised").otherwise("original").alias("revision"), F.col("o_orderkey").alias("input_pos"),
    )
    return base.withColumn("form_type", form)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as claims that each cite one document; the number of documents is counted."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_documents"))
    turns = table(spark, sf_dir, "conversations").crossJoin(F.broadcast(n))  # one row
    return turns.select("conv_id", "turn", "role", "text", ((F.col("conv_id") * 7 + F.col("turn")) % F.col("n_documents")).alias("cited_id"))


# The same views in SQL, for the oracles.

GROUPS_SQL = """
placed as (
  select o_orderkey, o_orderstatus as status, cast(o_totalprice as decimal(18,2)) as price, c_nationkey as company, year(o_orderdate) as year, month(o_orderdate) as month
  from orders join customer on o_custkey = c_custkey
), by_line as (
  select company, year, month, sum(net) as revenue, sum(case when l_returnflag = 'N' then net end) as net_income, sum(case when l_quantity > 20 then net end) as operating_income,
    sum(case when l_linestatus = 'F' then net end) as operating_cash_flow, sum(case when l_returnflag = 'R' then net end) as capital_expenditure
  from (select *, cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2))) as net from lineitem) join placed on l_orderkey = o_orderkey
  group by all
), by_order as (
  select company, year, month, sum(price) as assets, sum(case when status = 'O' then price end) as liabilities,
    sum(case when (company % 5 = 0 and status = 'F') or (company % 5 <> 0 and status <> 'O') then price end) as total_equity
  from placed group by all
), periods(period, last, day) as (values ('FY', 12, '12-31'), ('Q1', 3, '03-31'), ('H1', 6, '06-30'), ('Q3', 9, '09-30')),
groups as (
  select company, cast(year as int) as year, period, day, cast(sum(revenue) as double) as revenue, cast(sum(net_income) as double) as net_income, cast(sum(operating_income) as double) as operating_income,
    cast(sum(operating_cash_flow) as double) as operating_cash_flow, cast(sum(capital_expenditure) as double) as capital_expenditure, cast(sum(assets) as double) as assets,
    cast(sum(liabilities) as double) as liabilities, cast(sum(total_equity) as double) as total_equity
  from by_order left join by_line using (company, year, month) join periods on month <= last group by company, year, period, day
)"""

FACTS_SQL = (
    GROUPS_SQL
    + """, long as (
  unpivot (select * from groups) on revenue, net_income, operating_income, operating_cash_flow, capital_expenditure, assets, liabilities, total_equity into name concept value exact
), facts as (
  select company, year, period, concept, case when company % 2 = 0 and pos = 0 then floor(exact) else exact end as value,
    (year + 1) || case when pos = 0 then '-02-15' else '-03-15' end as filed_at, pos as input_pos, year || '-' || day as end_date,
    case when concept in ('revenue', 'net_income', 'operating_income') then 'income_statement' when concept in ('operating_cash_flow', 'capital_expenditure') then 'cash_flow' else 'balance_sheet' end as statement,
    case when company % 7 = 3 and year % 3 = 0 and concept = 'assets' then '' else company || '-' || year || '-' || period end as accession,
    case when company = 4 and year = 1998 then '' else 'USD' end as currency
  from long join (values (0), (1)) as r(pos) on pos = 0 or company % 2 = 0
)"""
)

MATRIX_SQL = (
    FACTS_SQL
    + """, latest as (
  select * from facts qualify row_number() over (partition by company, year, period, concept order by filed_at desc, input_pos desc) = 1
), matrix as (
  select company, year, period, """
    + ", ".join(f"max(case when concept = '{c}' then value end) as {c}" for c in CONCEPTS)
    + """ from latest group by company, year, period
)"""
)

FILINGS_SQL = """
filings as (
  select document_id, company, fiscal_period, period_end, year, filed_at, revision, input_pos,
    case fiscal_period when 'FY' then 'ANNUAL_REPORT' when 'H1' then 'INTERIM_REPORT' when 'IPO' then 'PROSPECTUS' else 'QUARTERLY_REPORT' end as form_type
  from (select o_orderkey as document_id, o_custkey as company, case left(o_orderpriority, 1) when '1' then 'FY' when '2' then 'Q1' when '3' then 'H1' when '4' then 'Q3' else 'IPO' end as fiscal_period,
      strftime(o_orderdate, '%Y-%m-%d') as period_end, cast(year(o_orderdate) as int) as year, strftime(cast(o_orderdate as date) + cast(o_orderkey % 90 as int), '%Y-%m-%d') as filed_at,
      case when o_orderstatus = 'F' then 'revised' else 'original' end as revision, o_orderkey as input_pos from orders)
)"""

CLAIMS_SQL = """
claims as (
  select conv_id, turn, role, text, (conv_id * 7 + turn) % (select count(*) from documents) as cited_id from conversations
)"""
