"""Queries over disclosure files and pages, made from suppliers; oracles read the suppliers. Also additive migration and job snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..functions import texts
from ..operators import dml, extraction
from ..sinks.store import scratch
from ..sources import disclosures, fact_files, markup
from .records import said
from .registry import query
from .scalars import pick

KEY = "s_suppkey"


def listed(spark: SparkSession, sf_dir: str, one: Column, open_: str, close: str) -> DataFrame:
    """One document for each nation: the entries of its suppliers, in their order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(KEY, one.alias("t")))), lambda r: r["t"])
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(rows.alias("rows")).select("s_nationkey", said(open_, F.array_join("rows", ", "), close).alias("raw"))


@query("select lpad(s_suppkey::varchar, 10, '0') as cik, 'S' || s_suppkey as ticker, s_name as name from supplier")
def ticker_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(KEY)
    return disclosures.tickers(listed(spark, sf_dir, said('"', k, '": {"cik_str": ', k, ', "ticker": "s', k, '", "title": "', F.col("s_name"), '"}'), "{", "}").select("raw"))


@query(
    "with s as (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as position from supplier), a as (select *, row_number() over (partition by s_nationkey order by position) as n from s where s_suppkey % 4 in (0, 1)) "
    "select lpad(s_nationkey::varchar, 10, '0') as cik, position::int as position, case s_suppkey % 4 when 0 then '10-K' else '20-F' end as form_type, 'n' || s_suppkey as accession_number from a where n <= 5"
)
def submission_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays as rows; the five first annual forms of each company. The limit is the feature."""
    k = F.col(KEY)
    of = lambda name, value: said('"', name, '": [', F.array_join(F.transform("keys", lambda x: F.concat(F.lit('"'), value(x), F.lit('"'))), ", "), "]")
    keys = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(k)).alias("keys"))
    form = lambda x: F.when(x % 4 == 0, "10-K").when(x % 4 == 1, "20-F").when(x % 4 == 2, "8-K").otherwise("10-Q")
    raw = keys.select(said('{"cik": "', F.col("s_nationkey"), '", "filings": {"recent": {', of("form", form), ", ", of("accessionNumber", lambda x: F.concat(F.lit("n"), x.cast("string"))), "}}}").alias("raw"))
    return disclosures.filings(raw, newest=5).select("cik", "position", "form_type", "accession_number")


@query(
    "select lpad(s_suppkey::varchar, 10, '0') as cik, v.tag, v.unit, v.fy::int as fy, (s_suppkey * v.f)::double as value from supplier, (values ('Revenues', 'USD', 2023, 1), ('Revenues', 'USD', 2022, 2), ('Revenues', 'EUR', 2023, 3), ('Shares', 'shares', 2023, 4)) v(tag, unit, fy, f)"
)
def company_fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(KEY)
    value = lambda n, fy: said('{"end": "2023-12-31", "val": ', k * n, ', "fy": ', str(fy), ', "fp": "FY", "form": "10-K"}')
    raw = said('{"cik": "', k, '", "facts": {"us-gaap": {"Revenues": {"units": {"USD": [', value(1, 2023), ", ", value(2, 2022), '], "EUR": [', value(3, 2023), ']}}}, "dei": {"Shares": {"units": {"shares": [', value(4, 2023), "]}}}}}")
    return disclosures.company_facts(table(spark, sf_dir, "supplier").select(raw.alias("raw"))).select("cik", "tag", "unit", "fy", "value")


@query("select lpad(s_suppkey::varchar, 5, '0') as code, 'n' || s_suppkey as name, 'i' || s_suppkey as stock_id from supplier where s_suppkey % 4 <> 3")
def stock_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of the keys; a row without a name is left out."""
    k = F.col(KEY)
    one = pick(k % 4, said('{"code": "', k, '", "name": "n', k, '", "id": "i', k, '"}'), said('{"stockCode": "', k, '", "stockName": "n', k, '", "stockId": "i', k, '"}'), said('{"c": "', k, '", "n": "n', k, '", "s": "i', k, '"}'), said('{"code": "', k, '", "name": "", "id": "i"}'))
    return disclosures.stocks(listed(spark, sf_dir, one, '{"list": [', "]}").select("raw"))


@query("select s_suppkey, ['found', 'empty', 'found', 'failed', 'failed'][s_suppkey % 5 + 1] as status, case s_suppkey % 5 when 0 then 1 when 1 then 0 when 2 then 2 end::int as n from supplier")
def title_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col(KEY)
    raw = pick(k % 5, said('{"result": [{"a": ', k, "}]}"), '{"result": "[]"}', '{"result": "{\\"rows\\": [{\\"b\\": 2}, {\\"b\\": 3}]}"}', '{"result": [1]}', "timeout")
    told = disclosures.title_results(table(spark, sf_dir, "supplier").select(k, raw.alias("raw")))
    return told.select(k, "status", F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n"))


@query("select s_suppkey, r.row_no::int as row_no, replace(r.cells, '?', s_suppkey::varchar) as cells from supplier, (values (0, 'year|2024'), (1, 'value of ?|? inner 5')) r(row_no, cells) where s_suppkey % 3 <> 2")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of outermost tables with enough cells and a number; a table within a cell is that cell's text."""
    k = F.col(KEY)
    page = F.when(k % 3 == 2, "<table><tr><td>a</td><td>b</td></tr></table>").otherwise(said("<p>x</p><table><tr><th>year</th><th> 2024</th></tr><tr><td></td></tr><tr><td>value <b>of</b> ", k, "</td><td>", k, " <table><tr><td>inner</td><td> 5</td></tr></table></td></tr></table>"))
    rows = markup.table_rows(table(spark, sf_dir, "supplier").select(k, page.alias("html")), KEY, "html")
    return rows.select(k, "row_no", F.array_join("cells", "|").alias("cells"))


@query("select s_suppkey, e.place::int as place, e.start::int as start from supplier, (values (0, 0), (1, 1199)) e(place, start) where s_suppkey % 2 = 0 union all select s_suppkey, 0, 0 from supplier where s_suppkey % 2 = 1")
def topic_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a topic in the order of its patterns and places, none over another, two at most; where their excerpts begin."""
    k = F.col(KEY)
    front, filler = F.rpad(F.lit("Our business of the year "), 1411, "x "), F.repeat(F.lit("word "), 300)
    near, far = said(F.rpad(F.lit("Our business, and our business again "), 1500, "y ")), said(front, "our business ", filler, "business overview ", filler)
    found = extraction.topic_evidence(table(spark, sf_dir, "supplier").select(k, F.when(k % 2 == 0, far).otherwise(near).alias("text")), "text", {"business": texts.TOPICS["business"]})
    return found.select(k, F.posexplode("evidence").alias("place", "e")).select(k, "place", "e.start")


@query("select o_orderkey, o_custkey, 'none' as status, 0 as retries from orders")
def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table after an additive migration: new columns with their defaults, the others as they were."""
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return dml.add_missing_columns(old, {"status": F.lit("none"), "retries": F.lit(0), "o_custkey": F.lit(None)})


@query(
    "with e as (select user_id, event_id, event_type, greatest(0.0, least(100.0, value)) as p from events), l as (select user_id, arg_max(event_type, event_id) as stage, max(p) as percent from e group by 1), "
    "s as (select user_id, max(event_id) filter (event_type <> stage) as before from e join l using (user_id) group by 1) select user_id, stage, percent, count(*) filter (event_id > coalesce(before, -1)) as in_stage from e join l using (user_id) join s using (user_id) group by all"
)
def job_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each job: its stage, the highest percentage so far, and reports since the stage began."""
    from ..operators.series import job_snapshot as snapshot

    return snapshot(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


@query("select event_id, case event_id % 4 when 0 then event_id end as k, event_id % 4 in (0, 1) as readable from events")
def safe_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no JSON reads as an empty object."""
    text = pick(F.col("event_id") % 4, said('{"k": ', F.col("event_id"), "}"), "{}", "broken", "")
    tree = F.coalesce(F.try_parse_json(text), F.parse_json(F.lit('{"_empty": true}')))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(tree, "$.k", "long").alias("k"), F.try_variant_get(tree, "$._empty", "boolean").isNull().alias("readable"))


@query(
    "select lpad(o_custkey::varchar, 10, '0') as cik, o_orderkey::varchar as accession_number, o_totalprice::double as value, case o_orderstatus when 'F' then '10-K' else '10-Q' end as form "
    "from orders where o_orderstatus = 'F' and year(o_orderdate) % 4 = 1"
)
def pushed_fact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as documents of facts in a folder for each form, read back by the data source: a form is chosen by folder, years while reading."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", F.year("o_orderdate").alias("year"))
    value = F.struct(F.col("o_totalprice").cast("double").alias("val"), F.col("o_orderkey").cast("string").alias("accn"), F.col("year").alias("fy"), F.lit("FY").alias("fp"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"))
    facts = orders.groupBy("o_custkey", F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form")).agg(F.collect_list(value).alias("values"))  # the orders of one customer
    body = F.struct(F.col("o_custkey").cast("string").alias("cik"), F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Price"), F.struct(F.create_map(F.lit("USD"), F.col("values")).alias("units")))).alias("facts"))
    folder = scratch(spark, "facts")
    facts.select("form", F.to_json(body).alias("value")).write.partitionBy("form").text(folder)
    read = fact_files.company_fact_files(spark, folder, bytes_per_partition="65536")
    chosen = read.filter((F.col("form") == "10-K") & F.col("fy").isin(1993, 1997, 2001, 2005))
    return chosen.select("cik", "accession_number", "value", "form")
