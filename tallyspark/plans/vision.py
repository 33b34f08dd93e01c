"""Queries over answers of vision services, results by id, and reads and changes around runs. Oracles take what each row was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FILINGS_SQL, filings, table
from ..operators import dml, vision
from .records import said
from .registry import query
from .scalars import pick


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Six kinds: sound, other scale, other page, other end, no text, no JSON."""
    k = F.col("s_suppkey")
    kind = k % 6
    row = said(
        '{"facts": [{"concept": "assets", "value": ', k, ', "unit_scale": ', pick(kind, "1000", "7", "1", "1", "1", "1"), ', "original_page": ', pick(kind, "1", "1", "9", "1", "1", "1"), ', "scope": "consolidated", "period_end": "', pick(kind, "2024-02-29", "2024-02-29", "2024-02-29", "2023-12-31", "2024-02-29", "2024-02-29"),
        '", "currency": "usd", "statement": "balance_sheet", "raw_text": "', pick(kind, "Total assets", "x", "x", "x", " ", "x"), '"}, {"concept": "revenue", "value": "', k + 1, '", "original_page": 2, "scope": "consolidated", "period_end": "2024-02-29", "currency": "USD", "statement": "income_statement", "raw_text": "Revenue"}, {"concept": "goodwill", "value": 1}, 7]}',
    )
    payload = F.when(kind == 5, "no json").when(k % 12 == 4, '{"facts": [{"concept": "revenue"}]}').otherwise(row)
    told = table(spark, sf_dir, "supplier").select(k.alias("document_id"), payload.alias("payload"), F.lit("FY").alias("period"), F.lit("2024-02-29").alias("period_end"), F.lit("USD").alias("currency"))
    pages = table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("page")).withColumn("content_hash", F.lit("h"))
    return told, pages


@query(
    "select s_suppkey as document_id, concept, value::double as value, period_start from supplier, lateral (values ('assets', s_suppkey * 1000.0, null::date), ('revenue', s_suppkey + 1.0, date '2023-03-02')) v(concept, value, period_start) where s_suppkey % 6 <> 5 and s_suppkey % 12 <> 4 and (concept = 'revenue' or s_suppkey % 6 = 0)"
)
def vision_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of strict answers that are as asked for."""
    facts, _ = vision.json_facts(*answers(spark, sf_dir))
    return facts.select("document_id", "concept", "value", "period_start")


@query("select s_suppkey as document_id, case when s_suppkey % 6 = 5 then 'structured_json_required' when s_suppkey % 12 = 4 then 'no_candidates' else 'candidates_only' end as status from supplier")
def vision_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.json_facts(*answers(spark, sf_dir))[1]


@query(
    "with s as (select s_suppkey as k, case when s_suppkey % 2 = 0 then 1e6 else 1e3 end as u from supplier) select k as document_id, concept, value::double as value from s, lateral (values ('revenue', (k * 1000 + 1) * u), ('liabilities', -k * u), ('net_income', (k + 0.5) * u)) v(concept, value) where concept <> 'net_income' or k % 2 = 0"
)
def markdown_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first labelled line of each concept."""
    k = F.col("s_suppkey")
    text = said("# Report\n", F.when(k % 2 == 0, "in RMB million").otherwise("HK$ thousand"), "\nRevenue | ", k, ",001 | 7\nRevenue 5\nTotal liabilities (", k, ") 3\n", F.when(k % 2 == 0, said("净利润 ", k, ".5")).otherwise("no 净利润 5"))
    return table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.inline(vision.markdown_facts(text))).select("document_id", "concept", "value")


@query("select user_id, sum(event_id % 100 + 1)::bigint as bytes, count(*) filter (event_id % 4 = 0) as lost from events group by user_id")
def results_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results joined to what was sent by their ids; those that are lost, and all bytes."""
    sent = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("data_id"), (F.col("event_id") % 100 + 1).alias("bytes"))
    back = table(spark, sf_dir, "events").filter("event_id % 4 <> 0").select(F.col("event_id").alias("data_id"), F.lit("text").alias("text"))
    return vision.with_results(sent, back).groupBy("user_id").agg(F.sum("bytes").alias("bytes"), F.count_if(F.col("error") == "provenance_missing").alias("lost"))


@query(
    "with w as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as place, sum(event_id % 100 + 1) over (partition by user_id order by event_id rows unbounded preceding) as so_far from events) select user_id, event_id, so_far::bigint as bytes_so_far from w where place <= 20 and so_far <= 600"
)
def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pages within 20 pages and 600 bytes; both limits are the feature."""
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 100 + 1).alias("bytes"))
    return vision.page_budget(pages, "user_id", "event_id", 20, 600).select("user_id", "event_id", "bytes_so_far")


# Joins and reads around filings and runs.


@query(f"with {FILINGS_SQL} select document_id, case when document_id % 3 = 0 then '2001-01-01' else period_end end as period_end, case when document_id % 3 = 0 then 'CORRECTED' else form_type end as form_type from filings")
def corrected_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with the period and form of their manifest, where there is one."""
    own = filings(spark, sf_dir)
    manifest = own.filter("document_id % 3 = 0").select("document_id", F.lit("2001-01-01").alias("m_end"), F.lit("CORRECTED").alias("m_form"))
    return own.join(manifest, "document_id", "left").select("document_id", F.coalesce("m_end", "period_end").alias("period_end"), F.coalesce("m_form", "form_type").alias("form_type"))


@query("select o_orderkey as thesis_id, c_name as company, c_mktsegment as segment from orders join customer on o_custkey = c_custkey where c_custkey % 5 = 0 order by o_orderdate desc, o_orderkey desc limit 500")
def company_theses(spark: SparkSession, sf_dir: str, limit: int = 500, only=None) -> DataFrame:
    """The newest theses with their companies, of some companies if wanted; the limit, 1 to 500, is the feature."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    chosen = joined.filter(F.col("c_custkey") % 5 == 0 if only is None else only)
    return chosen.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(max(1, min(500, limit))).select(F.col("o_orderkey").alias("thesis_id"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("segment"))


@query("select user_id, count(*) filter (event_type = 'purchase') as completed, count(*) as total, string_agg(distinct event_type, '|' order by event_type) as states from events group by user_id")
def agent_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed and all steps of a run, and the states that it has seen."""
    states = F.array_join(F.array_sort(F.collect_set("event_type")), "|")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count("*").alias("total"), states.alias("states"))


@query("select user_id, event_id as artifact_id, event_type from events where event_type in ('view', 'click') qualify row_number() over (partition by user_id, event_type order by date_trunc('day', ts) desc, event_id desc) = 1")
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest artifact of each wanted type; of one day, the one that was written last."""
    from ..operators.latest import latest_per_key

    made = table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).select("user_id", "event_type", F.date_trunc("day", "ts").alias("created_at"), F.col("event_id").alias("artifact_id"))
    return latest_per_key(made, ["user_id", "event_type"], "created_at", "artifact_id").select("user_id", "artifact_id", "event_type")


@query(f"with {FILINGS_SQL}, r as (select *, case fiscal_period when 'Q3' then 3 when 'H1' then 2 when 'Q1' then 1 else 0 end as o from filings where fiscal_period in ('Q1', 'H1', 'Q3')) select company, document_id, row_number() over (partition by company order by year desc, o desc, fiscal_period desc, document_id) as place from r")
def interim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interim periods, the newest first: year, then the place of the period in it."""
    from pyspark.sql import Window as W

    place = F.when(F.col("fiscal_period") == "Q3", 3).when(F.col("fiscal_period") == "H1", 2).otherwise(1)
    w = W.partitionBy("company").orderBy(F.col("year").desc(), place.desc(), F.col("fiscal_period").desc(), "document_id")
    own = filings(spark, sf_dir).filter(F.col("fiscal_period").isin("Q1", "H1", "Q3"))
    return own.select("company", "document_id", F.row_number().over(w).cast("long").alias("place"))


@query(
    "with l as (select o_orderkey, l_linenumber, l_linestatus || '-' || l_returnflag as excerpt, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n from orders join lineitem on o_orderkey = l_orderkey) select o_orderkey, l_linenumber, excerpt from l where n <= 5"
)
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five entries of each list, shortened; both limits are the feature."""
    from ..operators.latest import top_k_per_key

    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    first = top_k_per_key(joined, ["o_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], 5)
    return first.select("o_orderkey", "l_linenumber", F.substring(F.concat_ws("-", "l_linestatus", "l_returnflag"), 1, 12).alias("excerpt"))


@query(
    "with facts as (select o_orderkey as document, o_custkey as accession, o_totalprice as value from orders), incoming as (select document, accession, value * 2 as value from facts where accession % 7 = 0), "
    "ev as (select l_orderkey as document, l_linenumber::bigint as n, l_partkey::bigint as part from lineitem), fresh as (select l_orderkey as document, 99::bigint as n, 0::bigint as part from lineitem where l_linenumber = 1 and l_orderkey % 50 = 1), "
    "gone as (select document from facts where accession % 7 = 0 union select document from fresh) select document, n, part from ev where document not in (select document from gone) union all select document, n, part from fresh"
)
def replace_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after a replacement: that of the replaced accessions' documents and of every document that comes in goes, what comes in stays."""
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("accession"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").cast("long").alias("part"))
    fresh = lines.filter("n = 1 and document % 50 = 1").select("document", F.lit(99).cast("long").alias("n"), F.lit(0).cast("long").alias("part"))
    return dml.replace_evidence(lines, fresh, documents, documents.filter("accession % 7 = 0").select("accession"))
