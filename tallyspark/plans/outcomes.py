"""Queries over the outcome of documents and answers, and the golden company. Oracles take what each row was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FILINGS_SQL, filings, table
from ..functions import texts, trees
from ..operators import metrics, outcomes
from ..operators.latest import top_k_per_key
from .records import said
from .registry import query
from .scalars import pick

# The golden company, in millions, by concept for 2021 to 2025.
GOLDEN = {
    "revenue": (4200, 4830, 5600, 6380, 7150), "operating_income": (630, 773, 952, 1085, 1180), "net_income": (470, 560, 690, 780, 835), "operating_cash_flow": (760, 870, 1020, 1090, 1010), "capital_expenditure": (260, 310, 390, 520, 710),
    "assets": (6800, 7450, 8420, 9650, 11200), "liabilities": (3100, 3350, 3720, 4250, 5050), "equity": (3700, 4100, 4700, 5400, 6150), "cash": (1050, 1180, 1290, 1180, 1020), "accounts_receivable": (520, 610, 730, 940, 1260), "inventory": (90, 95, 110, 145, 205),
}


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden company's 55 facts of five years, told by each supplier in units of its own (1 to 5); even suppliers filed a draft before."""
    k = F.col("s_suppkey")
    told = F.array(*[F.struct(F.lit(2021 + i).alias("year"), F.lit(c).alias("concept"), F.lit(v * 1e6).alias("base")) for c, values in GOLDEN.items() for i, v in enumerate(values)])
    facts = table(spark, sf_dir, "supplier").select(k.alias("company"), (k % 5 + 1).alias("unit"), F.inline(told))
    filed = facts.select("*", F.explode(F.when(F.col("company") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("input_pos"))
    value = F.when(F.col("input_pos") == 0, F.col("base") / 3).otherwise(F.col("base")) * F.col("unit")
    return filed.select("company", "year", "concept", value.alias("value"), F.lit("FY").alias("period"), F.concat(F.lit("2026-0"), (F.col("input_pos") + 1).cast("string"), F.lit("-01")).alias("filed_at"), "input_pos")


GOLDEN_SQL = "g as (select s_suppkey as company, year, concept, value * (s_suppkey % 5 + 1) as value from supplier, (values " + ", ".join(f"({2021 + i}, '{c}', {v}e6)" for c, values in GOLDEN.items() for i, v in enumerate(values)) + ") v(year, concept, value))"


@query(
    f"with {GOLDEN_SQL}, w as (select company, year, max(value) filter (concept = 'revenue') as r, max(value) filter (concept = 'operating_income') as i, max(value) filter (concept = 'net_income') as n, max(value) filter (concept = 'operating_cash_flow') as o, max(value) filter (concept = 'capital_expenditure') as c, max(value) filter (concept = 'liabilities') as l, max(value) filter (concept = 'assets') as a, max(value) filter (concept = 'equity') as e, count(*) as facts from g group by all) "
    "select company, year, left(sha256(company || '|' || year || '|revenue'), 24) as revenue_id, facts, round(r / lag(r) over (partition by company order by year) - 1, 10) as revenue_growth, round(i / r, 10) as operating_margin, round(n / r, 10) as net_margin, round(o / n, 10) as cash_conversion, (o - c)::double as free_cash_flow, round(l / a, 10) as debt_to_assets, round(n / e, 10) as return_on_equity from w"
)
def golden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden company through the operators that all facts pass: latest value of each concept, then annual metrics."""
    concepts = ["total_equity" if c == "equity" else c for c in GOLDEN]
    facts = golden(spark, sf_dir).withColumn("concept", F.when(F.col("concept") == "equity", "total_equity").otherwise(F.col("concept")))
    annual = metrics.matrix(facts.filter(metrics.is_annual()), ["company", "year"], concepts, F.count_distinct("concept").alias("facts"))
    told = metrics.annual_metrics(annual)
    ratios = ["revenue_growth", "operating_margin", "net_margin", "cash_conversion", "debt_to_assets", "return_on_equity"]
    return told.select("company", "year", texts.content_id(F.concat_ws("|", "company", "year", F.lit("revenue"))).alias("revenue_id"), "facts", "free_cash_flow", *[F.round(r, 10).alias(r) for r in ratios])


@query(
    "select s_suppkey as document_id, case when s_suppkey % 2 = 0 then 'structured' when s_suppkey % 3 = 0 then 'document' when s_suppkey % 5 = 0 then 'vision' when s_suppkey % 7 = 0 then 'structured' else 'document' end as source from supplier"
)
def gated_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured groups that pass; documents that pass; vision; structured without a document; rejected documents."""
    k = F.col("s_suppkey")
    group = lambda source, status, when: F.when(when, F.struct(F.lit(source).alias("source"), status.alias("status")))
    only = (k % 2 != 0) & (k % 3 != 0) & (k % 5 != 0) & (k % 7 == 0)
    offered = F.array_compact(F.array(
        group("structured", F.when(k % 2 == 0, "VERIFIED").otherwise("REJECTED"), (k % 11 != 1) | (k % 2 == 0) | only), group("document", F.when(k % 3 == 0, "READY_WITH_WARNINGS").otherwise("REJECTED"), ~only), group("vision", F.lit("VERIFIED"), (k % 5 == 0)),
    ))
    groups = table(spark, sf_dir, "supplier").select(k.alias("document_id"), (~only).alias("has_document"), F.inline(offered))
    return outcomes.gated_source(groups)


@query(
    "select s_suppkey as document_id, p.page::int as page, p.statement from supplier, (values (2, 'balance_sheet', 0), (3, 'balance_sheet', 0), (4, 'balance_sheet', 0), (6, 'cash_flow', 1), (7, 'cash_flow', 1)) p(page, statement, odd) where odd = 0 or s_suppkey % 2 = 1"
)
def pages_to_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title and two pages behind it, up to the next title; accounts of the parent company end a statement and are none."""
    k = F.col("s_suppkey")
    pages = ["prose", "Acme\nConsolidated  balance sheet\n1", "more", "more", "too far", "Statement of cash flows\nfor the year", "more", "Notes\nof the parent company\nIncome statement", "more"]
    rows = table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.posexplode(F.array(*[F.lit(p) for p in pages])).alias("at", "text")).select("document_id", (F.col("at") + 1).alias("page"), "text")
    wanted = F.when(k % 2 == 1, F.array(F.lit("balance_sheet"), F.lit("cash_flow"), F.lit("income_statement"))).otherwise(F.array(F.lit("balance_sheet"), F.lit("income_statement")))
    return outcomes.pages_to_read_again(rows, table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.explode(wanted).alias("statement")))


@query(
    "with p as (select s_suppkey as k, i, (s_suppkey * 5 + i * i * 2 + s_suppkey * i // 3) % 7 as kind from supplier, range(1, 13) t(i)), "
    "o as (select *, last_value(case when kind < 3 then i end ignore nulls) over w as titled, last_value(case when kind < 3 then kind end ignore nulls) over w as opened from p window w as (partition by k order by i)) "
    "select k as document_id, i::int as page, ['balance_sheet', 'cash_flow'][opened + 1] as statement from o where opened < 2 and i - titled <= 2 and (opened = 0 or k % 2 = 1)"
)
def mixed_pages_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are read again where titles, accounts of the parent and other pages follow in an order that depends on the row."""
    k, i = F.col("s_suppkey"), F.col("i")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey")
    text = F.element_at(F.array(*[F.lit(t) for t in ("Acme\nConsolidated  balance sheet\n1", "Statement of cash flows\nfor the year", "Notes\nof the parent company\nIncome statement", "more", "more and more", "1 2 3", "")]), ((k * 5 + i * i * 2 + F.floor(k * i / 3)) % 7 + 1).cast("int"))
    rows = supplier.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("i")).select(k.alias("document_id"), i.alias("page"), text.alias("text"))
    wanted = F.explode(F.when(k % 2 == 1, F.array(F.lit("balance_sheet"), F.lit("cash_flow"), F.lit("income_statement"))).otherwise(F.array(F.lit("balance_sheet"), F.lit("income_statement"))))
    return outcomes.pages_to_read_again(rows, supplier.select(k.alias("document_id"), wanted.alias("statement")))


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag <> 'R' and l_orderkey not in (select l_orderkey from lineitem where l_quantity = 1)")
def trusted_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of accessions without a rejected group."""
    lines = table(spark, sf_dir, "lineitem")
    facts = lines.select(F.col("l_orderkey").alias("accession"), "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "REJECTED").otherwise("VERIFIED").alias("validation_status"))
    groups = lines.select(F.col("l_orderkey").alias("accession"), F.when(F.col("l_quantity") == 1, "REJECTED").otherwise("VERIFIED").alias("status"))
    return outcomes.trusted_profile(facts, groups).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "select s_suppkey as id, place::int as place, case when place = 0 and s_suppkey % 4 = 1 then 'Unnamed opportunity 1' else 't' || place end as title, case when place = 0 and s_suppkey % 4 = 2 then 'U' else 'A' end as grade, case when place > 0 or s_suppkey % 4 <> 3 then 0.25 end::double as low, case when place > 0 or s_suppkey % 4 <> 3 then 0.5 end::double as high, "
    "case when place > 0 or s_suppkey % 4 <> 0 then 3 end::int as horizon, concat_ws('|', case when place = 0 then ['horizon_invalid', 'no_title', 'grade_invalid', 'probability_invalid'][s_suppkey % 4 + 1] end, case when place = 0 and s_suppkey % 3 = 0 then 'unknown_evidence' end, case when place = 0 and s_suppkey % 5 = 0 then 'unknown_scenario' end) as issues from supplier, range(0, 5) r(place)"
)
def checked_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven opportunities of which five count; the first has the faults."""
    k = F.col("s_suppkey")
    kind = k % 4
    first = said(
        '{"title": "', F.when(kind == 1, " ").otherwise("t0"), '", "mechanism": "m", "evidence_grade": "', F.when(kind == 2, "x").otherwise("a"), '", "probability_range": ', F.when(kind == 3, "[0.5, 0.25]").otherwise('{"low": 0.25, "high": 0.5}'), ', "time_horizon_years": ', F.when(kind == 0, "30").otherwise("3"),
        ', "supporting_evidence_ids": ["e1", " "], "contradicting_evidence_ids": ["', F.when(k % 3 == 0, "e9").otherwise("e2"), '"], "scenario_eligibility": ["Base", "', F.when(k % 5 == 0, "moon").otherwise("BULL"), '"]}',
    )
    others = ", ".join(f'{{"title": "t{i}", "mechanism": "m", "evidence_grade": "A", "probability_range": [0.25, 0.5], "time_horizon_years": 3}}' for i in range(1, 7))
    answers = table(spark, sf_dir, "supplier").select(k.alias("id"), said('{"opportunities": [', first, ", ", others, "]}").alias("payload"))
    evidence = table(spark, sf_dir, "supplier").select(k.alias("id"), F.explode(F.array(F.lit("e1"), F.lit("e2"))).alias("evidence_id"))
    return outcomes.checked_opportunities(answers, evidence)


@query(
    "select event_id, ['', 'claims', 'scenarios|thesis', 'business_model|claims|competitive_position|counterarguments|executive_summary|financial_quality|growth_opportunities|invalidation_conditions|leading_indicators|scenarios|thesis|unresolved_questions'][event_id % 4 + 1] as missing, [1, 0, 1, 0][event_id % 4 + 1]::int as claims, event_id % 4 = 0 as passed from events"
)
def checked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = lambda **more: "{" + ", ".join(f'"{s}": {more.get(s, chr(34) + "x" + chr(34))}' for s in outcomes.SECTIONS) + "}"
    payload = pick(F.col("event_id") % 4, body(claims='[{"text": "a"}]'), body(claims="[]"), body(claims="[1]", scenarios='""', thesis="null"), "broken")
    made = table(spark, sf_dir, "events").select("event_id", outcomes.checked_report(payload).alias("r"))
    return made.select("event_id", "r.*")


@query("""select event_id, 'run' || user_id || ':' || event_type || ':' || left(sha256('agent|{"a":' || event_id || ',"b":[1]}'), 10) as artifact_id from events""")
def artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of artifacts by their content, whatever the order of its keys."""
    content = trees.canonical(said('{"b": [1], "a": ', F.col("event_id"), "}"))
    return table(spark, sf_dir, "events").select("event_id", outcomes.artifact_id(said("run", F.col("user_id")), F.col("event_type"), F.lit("agent"), content).alias("artifact_id"))


@query(
    f"with {FILINGS_SQL}, n as (select company, document_id, filed_at from filings qualify row_number() over (partition by company order by filed_at desc, document_id) <= 2), e as (select company, document_id, l_linenumber, row_number() over (partition by company order by filed_at desc, document_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from n join lineitem on l_orderkey = document_id) "
    "select company, document_id, l_linenumber, place from e where place <= 40"
)
def newest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the two newest filings of each company, forty pieces at most; both limits are the feature."""
    from pyspark.sql import Window as W

    newest = top_k_per_key(filings(spark, sf_dir), ["company"], [F.col("filed_at").desc(), F.col("document_id")], 2).select("company", "document_id", "filed_at")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    joined = newest.join(lines, F.col("l_orderkey") == F.col("document_id"))
    order = W.partitionBy("company").orderBy(F.col("filed_at").desc(), "document_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return joined.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 40").select("company", "document_id", "l_linenumber", "place")


@query(f"with {FILINGS_SQL} select company, document_id, row_number() over (partition by company order by year desc, fiscal_period, document_id) as place from filings")
def ordered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's filings in the order in which they are shown: newest year, then period, with a tie-break."""
    from pyspark.sql import Window as W

    order = W.partitionBy("company").orderBy(F.col("year").desc(), "fiscal_period", "document_id")
    return filings(spark, sf_dir).select("company", "document_id", F.row_number().over(order).cast("long").alias("place"))
