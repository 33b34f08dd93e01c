"""Queries over the text of statement pages, made from suppliers. Oracles take the values from the rows, not from the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..operators import statements
from .records import said
from .registry import query


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of seven pages: a balance sheet that goes on over a page, prose, an income statement, a cash flow statement, key figures."""
    k = F.col("s_suppkey")
    thousands = F.when(k % 2 == 0, "RMB'000").otherwise("单位：百万元")
    texts = [
        said("Report of ", k, "\nAbout the year"),
        said("合并资产负债表\n", thousands, "\n流动负债合计  7\n负债合计  七 (", k + 20000, ")\n资产总计 ", k, ",000 1,234\n"),
        said("(continued)\nTotal equity  12 ", k, ",500 99\nequity interest of 25% 5"),
        said("The year was good and 同比 revenue 9\nnothing else"),
        said("Consolidated income statement\nHK$ million\nTotal comprehensive income 1\nRevenue ", k + 100, " 77\nnet income — 3\nProfit attributable to owners of the company (", k + 1000, ".5)"),
        said("Statement of cash flows\nNet cash generated from operating activities ", k + 5, "\nCapital expenditure (", k + 20000, ")"),
        said("Weighted average return on equity\n% of net assets\n"),
        said("weighted average return on equity % ", k % 50 + 2, "\nend"),
    ]
    return table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.posexplode(F.array(*texts)).alias("at", "text")).select("document_id", (F.col("at") + 1).alias("page"), "text")


VALUES = (
    "select s_suppkey as k, case when s_suppkey % 2 = 0 then 1e3 else 1e6 end as u from supplier), v as (select k as document_id, unnest([{'concept': 'liabilities', 'value': -(k + 20000) * u, 'page': 2, 'statement': 'balance_sheet'}, {'concept': 'assets', 'value': k * 1000 * u, 'page': 2, 'statement': 'balance_sheet'}, "
    "{'concept': 'total_equity', 'value': (k * 1000 + 500) * u, 'page': 3, 'statement': 'balance_sheet'}, {'concept': 'revenue', 'value': (k + 100) * 1e6, 'page': 5, 'statement': 'income_statement'}, {'concept': 'net_income', 'value': -(k + 1000.5) * 1e6, 'page': 5, 'statement': 'income_statement'}, "
    "{'concept': 'operating_cash_flow', 'value': (k + 5) * 1.0, 'page': 6, 'statement': 'cash_flow'}, {'concept': 'capital_expenditure', 'value': (k + 20000) * 1.0, 'page': 6, 'statement': 'cash_flow'}, {'concept': 'reported_roe', 'value': (k % 50 + 2) / 100.0, 'page': 8, 'statement': 'income_statement'}], recursive := true) from s)"
)


@query(f"with s as ({VALUES} select document_id, concept, round(value::double, 6) as value, page, statement from v where value <> 0")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of each concept in each report."""
    return statements.page_facts(pages(spark, sf_dir)).select("document_id", "concept", F.round("value", 6).alias("value"), "page", "statement")


@query(
    "select s_suppkey as document_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) as page, unnest([NULL, 'balance_sheet', 'balance_sheet', NULL, 'income_statement', 'cash_flow', NULL, NULL]) as statement, unnest([1, u, u, 1, 1e6, 1, 1, 1]::double[]) as multiplier, unnest([0, 2, 1, 1, 2, 2, 1, 1]) as density from (select *, case when s_suppkey % 2 = 0 then 1e3 else 1e6 end as u from supplier)"
)
def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement and unit that hold on a page, and how many concepts it names."""
    read = statements.with_context(pages(spark, sf_dir))
    return read.select("document_id", "page", "statement", "multiplier", statements.concept_density(F.col("text")).alias("density"))


# Reports of ten pages whose kind depends on the row: titles of two statements, pages that are marked as continued, pages with a label of the balance sheet, prose.
KINDS_SQL = (
    "p as (select s_suppkey as k, i, i + case when s_suppkey % 4 = 0 and i >= 6 then 1 else 0 end as page, (s_suppkey * 3 + i * i + s_suppkey * i // 2) % 5 as kind from supplier, range(1, 11) t(i)), "
    "o as (select *, page - lag(page) over w as gap, last_value(case when kind in (0, 4) then i end ignore nulls) over w as titled, last_value(case when kind in (0, 4) then kind end ignore nulls) over w as opened from p window w as (partition by k order by i)), "
    "b as (select *, kind not in (0, 4) and not coalesce(gap = 1 and (kind = 1 or (kind = 2 and opened = 0)), false) as breaks from o), "
    "c as (select *, titled is not null and i - titled <= 3 and not bool_or(breaks) over (partition by k, titled order by i) as inside from b)"
)


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    listed = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("i"))
    kind = (k * 3 + i * i + F.floor(k * i / 2)) % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("合并资产负债表\n"), F.when(k % 2 == 0, "RMB'000").otherwise("单位：百万元"), F.lit("\nbegins")))
        .when(kind == 1, said("page ", i, " (continued)\nas before"))
        .when(kind == 2, said("Total assets ", k + i, "\n"))
        .when(kind == 3, F.when(k % 3 == 0, "Words about the year\nin thousands").otherwise("Words about the year\nand more"))
        .otherwise("Consolidated income statement\nHK$ million")
    )
    return listed.select(k.alias("document_id"), (i + F.when((k % 4 == 0) & (i >= 6), 1).otherwise(0)).alias("page"), text.alias("text"))


@query(
    f"with {KINDS_SQL}, u as (select *, case when opened = 4 then 1e6 when k % 2 = 0 then 1e3 else 1e6 end as unit from c) "
    "select k as document_id, page::int as page, case when inside then case opened when 0 then 'balance_sheet' else 'income_statement' end end as statement, "
    "(case when inside then unit when kind = 3 and k % 3 = 0 then 1e3 else 1 end)::double as multiplier, (case when kind = 2 then 1 else 0 end)::int as density from u"
)
def mixed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title holds for the pages that follow at once and go on with it, three at most; kinds and gaps of pages depend on the row."""
    read = statements.with_context(mixed_pages(spark, sf_dir))
    return read.select("document_id", "page", "statement", "multiplier", statements.concept_density(F.col("text")).alias("density"))


@query(
    "with l as (select s_suppkey as k, j, (s_suppkey * 7 + j * j) % 5 as kind from supplier, range(1, 6) t(j)), "
    "s as (select *, case kind when 0 then 14 + 60 + 45 when 1 then 14 + 45 when 2 then 16 + 60 + 45 when 4 then 16 + 45 end as score from l) "
    "select k as document_id, (k * 10 + j) * 1e6::double as value, score::int as score from s where score >= 40 qualify row_number() over (partition by k order by score desc, j) = 1"
)
def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among lines that name revenue the best by score: longer labels and labels in front count, narrative does not; the earlier of equal lines."""
    k = F.col("s_suppkey")
    heads = ["Revenue ", "group revenue ", "Turnover ", "同比 revenue ", "group turnover "]
    lines = [F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), ((k * 7 + j * j) % 5 + 1).cast("int")), (k * 10 + j).cast("string")) for j in range(1, 6)]
    text = F.concat(F.lit("Consolidated income statement\nHK$ million\n"), F.array_join(F.array(*lines), "\n"))
    found = statements.page_facts(table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.lit(1).alias("page"), text.alias("text")))
    return found.filter("concept = 'revenue'").select("document_id", "value", F.col("score").cast("int").alias("score"))


@query("select p_partkey, p_partkey % 6 in (0, 1, 2, 3) as rejected from part")
def label_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a label and mean something else."""
    kind = F.col("p_partkey") % 6
    rows = [("revenue", "Comprehensive income and revenue 5", "revenue"), ("liabilities", "非流动负债合计 7", "负债合计"), ("total_equity", "Total equity 25%", "total equity"), ("reported_roe", "weighted average return on equity 5", "weighted average return on equity"), ("revenue", "Revenue 5", "revenue"), ("total_equity", "total equity 1 2 3 %", "total equity")]
    chosen = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("concept", "line", "label"), strict=True)]) for r in rows]), (kind + 1).cast("int"))
    made = table(spark, sf_dir, "part").select("p_partkey", chosen.alias("r"))
    return made.select("p_partkey", statements.rejected(F.col("r.concept"), F.col("r.line"), F.col("r.label")).alias("rejected"))


@query("select event_id, case event_id % 3 when 0 then user_id when 1 then user_id + 10000.5 end::double as revenue, case when event_id % 3 = 0 then 7.0::double end as assets from events")
def snapshot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots told as pairs, or as labelled numbers."""
    user = F.col("user_id")
    text = F.when(F.col("event_id") % 3 == 0, said("revenue=", user, "|assets=7")).when(F.col("event_id") % 3 == 1, said("The total revenue of the year: ", user + 10000, ".5 in all")).otherwise("none")
    made = table(spark, sf_dir, "events").select("event_id", F.map_from_entries(statements.snapshot_values(text, {"revenue": "revenue|total revenue", "assets": "total assets"})).alias("v"))
    return made.select("event_id", F.element_at("v", "revenue").alias("revenue"), F.element_at("v", "assets").alias("assets"))


@query(
    "with p as (select s_suppkey as k, i, case (s_suppkey * 5 + i * i * 3) % 7 when 0 then repeat('ab ', s_suppkey % 90) || 'growth strategy' || repeat(' cd', (s_suppkey + i) % 60) when 1 then 'The Outlook ' || repeat('ef ', (s_suppkey * i) % 80) "
    "when 2 then repeat('gh ', i * 9) || 'OUTLOOK and growth  strategy' || repeat(' ij', s_suppkey % 70) else 'nothing ' || i end as text from supplier, range(1, 7) t(i)), "
    "m as (select *, case when contains(lower(text), 'growth strategy') then 'growth strategy' when contains(lower(text), 'outlook') then 'outlook' end as label from p), "
    "e as (select *, trim(regexp_replace(substr(text, greatest(instr(lower(text), label) - 50, 1), instr(lower(text), label) + 120 - greatest(instr(lower(text), label) - 50, 1)), '\\s+', ' ', 'g')) as excerpt from m where label is not null) "
    "select k as document_id, i::int as page, label, excerpt from e where length(excerpt) >= 100 qualify row_number() over (partition by k order by i) = 1"
)
def topic_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page with a label and enough text around it; which pages have one, and where, depends on the row."""
    from ..operators.extraction import topic_pages as first_pages

    k, i = F.col("s_suppkey"), F.col("i")
    listed = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i"))
    kind, again = (k * 5 + i * i * 3) % 7, lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    text = F.when(kind == 0, said(again("ab ", k % 90), "growth strategy", again(" cd", (k + i) % 60))).when(kind == 1, said("The Outlook ", again("ef ", (k * i) % 80))).when(kind == 2, said(again("gh ", i * 9), "OUTLOOK and growth  strategy", again(" ij", k % 70))).otherwise(said("nothing ", i))
    found = first_pages(listed.select(k.alias("document_id"), i.alias("page"), text.alias("text")), {"growth": ["growth strategy", "outlook"]}, before=50, after=120, least=100)
    return found.select("document_id", "page", "label", "excerpt")


@query("select s_suppkey as document_id, (s_suppkey % 2 + 1)::int as page, case s_suppkey % 2 when 0 then 'growth strategy' else 'outlook' end as label, case s_suppkey % 2 when 0 then 181 else 10 end as at from supplier")
def topic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page with a label of a topic: the first label in order that it holds, and the text around it."""
    from ..operators.extraction import topic_pages as first_pages

    k = F.col("s_suppkey")
    long = F.repeat(F.lit("ab "), 100)
    first = F.when(k % 2 == 0, said(long, "our Outlook and growth strategy of the firm ", long)).otherwise("no such thing")
    rows = table(spark, sf_dir, "supplier").select(k.alias("document_id"), F.posexplode(F.array(first, said("business outlook: OUTLOOK ", long))).alias("at", "text"))
    found = first_pages(rows.select("document_id", (F.col("at") + 1).alias("page"), "text"), {"growth": ["growth strategy", "outlook"]}, before=180, after=1800, least=100)
    return found.select("document_id", "page", "label", F.position("label", F.lower("excerpt")).alias("at"))
