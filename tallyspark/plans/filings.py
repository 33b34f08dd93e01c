"""Queries over filings, listings and runs: selection, lookups, search and changes to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FILINGS_SQL, filings, money, table
from ..functions import dates, texts
from ..operators import dml, latest, selection
from .registry import query

BEST_SQL = FILINGS_SQL + """, best as (
  select * from filings qualify row_number() over (partition by company, year, fiscal_period order by (revision = 'revised')::int desc, filed_at desc, input_pos) = 1
)"""


@query(f"with {BEST_SQL} select document_id, company, year, fiscal_period, revision, filed_at from best")
def best_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_revisions(filings(spark, sf_dir)).select("document_id", "company", "year", "fiscal_period", "revision", "filed_at")


@query(
    f"""with {BEST_SQL}, marked as (
  select *, bool_or(form_type = 'ANNUAL_REPORT') over (partition by company, year) as yha, bool_or(form_type = 'ANNUAL_REPORT') over (partition by company) as ha from best
), annuals as (
  select * from marked where form_type = 'ANNUAL_REPORT' qualify dense_rank() over (partition by company order by year desc) <= 5
), periodic as (
  select * from marked where form_type in ('QUARTERLY_REPORT', 'INTERIM_REPORT') and not yha
), companions as (
  select m.* from marked m where exists (select 1 from periodic p where p.company = m.company and p.year - 1 = m.year and p.fiscal_period = m.fiscal_period)
    and m.document_id not in (select document_id from annuals union all select document_id from periodic)
), listing as (
  select * from marked where form_type = 'PROSPECTUS' and not ha qualify row_number() over (partition by company order by period_end desc, filed_at desc, input_pos) <= 2
)
select document_id, company, year, fiscal_period, 'annual' as reason from annuals union all select document_id, company, year, fiscal_period, 'periodic' from periodic
union all select document_id, company, year, fiscal_period, 'companion' from companions union all select document_id, company, year, fiscal_period, 'listing' from listing"""
)
def filing_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_filings(filings(spark, sf_dir)).select("document_id", "company", "year", "fiscal_period", "reason")


@query(f"with {FILINGS_SQL} select document_id, company, year, fiscal_period from filings f where form_type in ('QUARTERLY_REPORT', 'INTERIM_REPORT') and not exists (select 1 from filings a where a.form_type = 'ANNUAL_REPORT' and a.company = f.company and a.year = f.year)")
def interim_without_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.interim_without_annual(filings(spark, sf_dir)).select("document_id", "company", "year", "fiscal_period")


@query(f"with {FILINGS_SQL} select document_id, company, filed_at from filings qualify row_number() over (partition by company order by filed_at desc, input_pos) <= 2")
def topk_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.top_k_per_key(filings(spark, sf_dir), ["company"], [F.col("filed_at").desc(), F.col("input_pos")], 2).select("document_id", "company", "filed_at")


@query(f"with {FILINGS_SQL} select document_id, year || case fiscal_period when 'FY' then '-12-31' when 'H1' then '-06-30' when 'Q1' then '-03-31' when 'Q3' then '-09-30' end as calendar_end, filed_at from filings where fiscal_period <> 'IPO' union all select document_id, filed_at, filed_at from filings where fiscal_period = 'IPO'")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("document_id", dates.period_end(F.col("year"), F.col("fiscal_period"), F.col("filed_at")).alias("calendar_end"), "filed_at")


@query(
    f"with {FILINGS_SQL}, d as (select document_id, fiscal_period, cast(period_end as date) as e from filings) select document_id, case when fiscal_period = 'FY' then case when month(e) = 2 and day(e) = 29 then make_date(year(e), 1, 1) else cast(e - interval 1 year + interval 1 day as date) end "
    "when fiscal_period in ('H1', 'Q1', 'Q3') then make_date(year(e), 1, 1) end as period_start from d"
)
def period_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("document_id", dates.period_start(F.to_date("period_end"), F.col("fiscal_period")).alias("period_start"))


@query(
    f"with {FILINGS_SQL}, c as (select *, case fiscal_period when 'Q1' then 'structured' when 'FY' then 'document' else 'vision' end as source, document_id % 3 <> 0 as valid from filings) "
    "select company, year, document_id, source from c where valid qualify row_number() over (partition by company, year order by case source when 'structured' then 0 when 'document' then 1 else 2 end, input_pos) = 1"
)
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("fiscal_period") == "Q1", "structured").when(F.col("fiscal_period") == "FY", "document").otherwise("vision")
    candidates = filings(spark, sf_dir).withColumns({"source": source, "valid": F.col("document_id") % 3 != 0})
    return selection.first_source(candidates, ["company", "year"], ["structured", "document", "vision"], "input_pos").select("company", "year", "document_id", "source")


@query(
    f"with {FILINGS_SQL}, y as (select company, year, document_id, period_end, filed_at, input_pos, revision from filings where form_type = 'ANNUAL_REPORT'), a as (select * from y qualify row_number() over (partition by company, year order by period_end desc, filed_at desc, input_pos) = 1), "
    "t as (select *, dense_rank() over (partition by company order by year desc) as recency from a) select company, year, document_id, recency from t where recency <= 10"
)
def annual_xbrl_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest annual filing of each year, and the ten newest years."""
    from pyspark.sql import Window as W

    own = latest.best_per_key(filings(spark, sf_dir).filter("form_type = 'ANNUAL_REPORT'"), ["company", "year"], [F.col("period_end"), F.col("filed_at")], "input_pos")
    recency = F.dense_rank().over(W.partitionBy("company").orderBy(F.col("year").desc())).cast("long")
    return own.withColumn("recency", recency).filter("recency <= 10").select("company", "year", "document_id", "recency")


# Lookups and searches.


@query("select c_custkey as security_id, c_name as name, n_name as issuer, r_name as market from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def listing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings with issuer and market. The two dimensions are small; Spark broadcasts them by their measured size."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("security_id"), F.col("c_name").alias("name"), F.col("n_name").alias("issuer"), F.col("r_name").alias("market"))


@query(
    "with l as (select c_custkey, case when c_nationkey % 3 = 0 then 'eur' when c_nationkey % 3 = 1 then 'usd' end as reporting from customer where c_custkey % 10 <> 0) "
    "select o_orderkey, o_custkey, coalesce(upper(reporting), '') as currency from orders left join l on o_custkey = c_custkey where o_orderstatus <> 'P' and (reporting is null or upper(reporting) = 'USD')"
)
def trusted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that are not rejected, whose listing is absent or reports in the wanted currency."""
    reporting = F.when(F.col("c_nationkey") % 3 == 0, "eur").when(F.col("c_nationkey") % 3 == 1, "usd")
    listings = table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select("c_custkey", reporting.alias("reporting"))
    told = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").join(listings, F.col("o_custkey") == F.col("c_custkey"), "left")
    return told.filter("reporting is null or upper(reporting) = 'USD'").select("o_orderkey", "o_custkey", F.coalesce(F.upper("reporting"), F.lit("")).alias("currency"))


@query("select o_orderkey as run_id, c_name as company, o_orderdate as created_at from orders join customer on o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 50")
def recent_runs(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    """The most recent runs; the limit, 1 to 200, is the feature."""
    runs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = runs.select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("company"), F.col("o_orderdate").alias("created_at"))
    return named.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(max(1, min(200, limit)))


@query(
    "with c as (select c_custkey, 'C.' || c_custkey as ticker, c_name as name from customer), s as (select *, (lower(ticker) = 'c.12')::int * 100 + (lower(name) = 'c.12')::int * 80 + starts_with(lower(ticker), 'c.12')::int * 40 + starts_with(lower(name), 'c.12')::int * 20 as score from c "
    "where contains(lower(ticker), 'c.12') or contains(lower(name), 'c.12') or contains(replace(lower(ticker), '.', ''), 'c.12')) select c_custkey, ticker, score from s order by score desc, ticker limit 15"
)
def company_search(spark: SparkSession, sf_dir: str, wanted: str = "c.12", limit: int = 15) -> DataFrame:
    """Companies whose name or ticker (with or without its dots) holds the wanted text, whatever its case: exact tickers, exact names, prefixes. The limit is the feature."""
    companies = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("C."), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("name"))
    return selection.search(companies, wanted, limit).select("c_custkey", "ticker", "score")


# Changes to tables.

@query(
    "with k as (select user_id, event_type, event_id, value, ts from events), old as (select * from k where event_id % 2 = 0 qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1), "
    "new as (select * from k where event_id % 2 = 1 qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1) "
    "select user_id, event_type, event_id, value from old anti join new using (user_id, event_type) union all select user_id, event_type, event_id, value from new"
)
def upsert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    old = latest.latest_per_key(events.filter("event_id % 2 = 0"), ["user_id", "event_type"], "event_id", "event_id")
    return dml.upsert(old, events.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query(
    "with new as (select user_id, event_type, event_id, value * 2 as value from events where user_id % 5 = 0 and event_type = 'click') "
    "select user_id, event_type, event_id, value from events anti join (select distinct user_id, event_type from new) using (user_id, event_type) union all select * from new"
)
def replace_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    new = events.filter("user_id % 5 = 0 and event_type = 'click'").withColumn("value", F.col("value") * 2)
    return dml.replace_scope(events, new, new, ["user_id", "event_type"])


@query(
    "with old as (select user_id, row_number() over (partition by user_id order by event_id) as version from events where event_type = 'signup'), last as (select user_id, max(version) as last from old group by 1) "
    "select user_id, event_id, coalesce(last, 0) + row_number() over (partition by user_id order by event_id) as version from events left join last using (user_id) where event_type = 'purchase'"
)
def append_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    old = events.filter("event_type = 'signup'").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("version"))
    return dml.append_versions(old, events.filter("event_type = 'purchase'").select("user_id", "event_id"), "user_id", "event_id")


@query(
    "with gone as (select o_orderkey from orders where o_custkey % 7 = 0 and o_orderstatus <> 'P') "
    "select case when g.o_orderkey is null then l_orderkey end as l_orderkey, l_linenumber, l_partkey from lineitem l left join gone g on l_orderkey = g.o_orderkey where g.o_orderkey is null or l_returnflag = 'R'"
)
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after deleting runs: returned lines stay without their run, active runs are not deleted."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    _, kept = dml.delete_cascade(orders, lines, F.col("l_returnflag") == "R", F.col("o_custkey") % 7 == 0, F.col("o_orderstatus") == "P", "l_orderkey")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey")


@query("select o_orderkey, case when o_orderstatus = 'P' then 'cancelled' else o_orderstatus end as status, case when o_orderstatus = 'P' then 'restart' else '' end as errors from orders")
def interrupt_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "running").otherwise(F.col("o_orderstatus")).alias("status"), F.array().cast("array<string>").alias("errors"))
    return dml.interrupt_running(dml.interrupt_running(runs, "restart"), "restart").select("o_orderkey", "status", F.array_join("errors", "|").alias("errors"))


@query("select o_orderkey, sum(cast(l_extendedprice as decimal(18,2))) = cast(o_totalprice as decimal(18,2)) or abs(sum(cast(l_extendedprice as decimal(18,2))) - cast(o_totalprice as decimal(18,2))) <= greatest(1, cast(o_totalprice as decimal(18,2)) * 0.01) as agrees, count(*) as details from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_totalprice having count(*) >= 2")
def subtotal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the details add up to the total, within 1 or one per cent; two details at least."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).alias("parts"), F.count("*").alias("details")).filter("details >= 2")
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    total = money("o_totalprice")
    return joined.select("o_orderkey", (F.abs(F.col("parts") - total) <= F.greatest(F.lit(1).cast("decimal(18,2)"), total * F.lit("0.01").cast("decimal(3,2)"))).alias("agrees"), "details")


@query("select o_orderkey, upper(left(sha256(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus)), 24)) as content_id from orders")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.upper(texts.content_id(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"))).alias("content_id"))
