"""Queries over words with places, made from suppliers. Where words stand, what they say and which pages there are depends on the row; the oracles apply the rules to the same geometry in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..operators import positions
from .records import said
from .registry import query


def key() -> Column:
    return F.col("s_suppkey")


def cell(page, x, top, text, width: float = 30.0) -> Column:
    """A word of height 6; page, x, top and text may be columns."""
    at = lambda v: (F.lit(v) if isinstance(v, (int, float)) else v).cast("double")
    return F.struct((F.lit(page) if isinstance(page, int) else page).cast("int").alias("page"), at(x).alias("x0"), at(top).alias("top"), (at(x) + width).alias("x1"), (at(top) + 6).alias("bottom"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def words_of(spark: SparkSession, sf_dir: str, cells: Column) -> DataFrame:
    """Words of one document for each supplier from an array of cells, in that order; null cells are left out."""
    K = key()  # noqa: N806
    return table(spark, sf_dir, "supplier").select(K.alias("document_id"), F.posexplode(F.filter(cells, lambda c: c.isNotNull())).alias("seq", "w")).select("document_id", "w.page", "seq", "w.x0", "w.top", "w.x1", "w.bottom", "w.text")


SLANTED = "select s_suppkey as k, r * 3 + c as seq, 100 + 12 * r + ((s_suppkey * (c + 1) + r) % 9) * 0.5 as top from supplier, range(8) t(r), range(3) u(c)"


@query(
    f"with recursive w as ({SLANTED}), walk(k, seq, anchor, line) as (select k, seq, top, 0 from w where seq = 0 union all "
    "select w.k, w.seq, case when abs(w.top - anchor) <= 2.5 then anchor else w.top end, case when abs(w.top - anchor) <= 2.5 then line else line + 1 end from walk join w on w.k = walk.k and w.seq = walk.seq + 1) "
    'select k as document_id, line::int as "row", count(*)::int as n from walk group by all'
)
def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on one line, measured from the line's first word; lines are slanted, so that some break."""
    K = key()  # noqa: N806
    r, c = F.floor(F.col("i") / 3), F.col("i") % 3
    slanted = table(spark, sf_dir, "supplier").select(K, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("i"))
    words = slanted.select(K.alias("document_id"), F.lit(1).alias("page"), F.col("i").alias("seq"), (c * 40.0).alias("x0"), (100 + 12 * r + ((K * (c + 1) + r) % 9) * 0.5).alias("top"), (c * 40.0 + 30).alias("x1"), F.lit(0.0).alias("bottom"), said("w", F.col("i")).alias("text"))
    return positions.visual_rows(words).select("document_id", "row", F.size("cells").alias("n"))


@query(
    "with recursive w as (select s_suppkey as k, i, ((s_suppkey * 7 + i * i * 13) % 40) * 5.0 + 15 as x from supplier, range(12) t(i)), "
    "walk(k, i, groups) as (select k, i, [{'n': 1, 'total': x}] from w where i = 0 union all select k, i, case when hit > 0 then list_transform(groups, lambda g, j: case when j = hit then {'n': g.n + 1, 'total': g.total + x} else g end) else list_append(groups, {'n': 1, 'total': x}) end "
    "from (select w.k, w.i, groups, w.x, coalesce(list_position(list_transform(groups, lambda g: abs(g.total / g.n - w.x) <= 24), true), 0) as hit from walk join w on w.k = walk.k and w.i = walk.i + 1) s) "
    "select k as document_id, g.n::int as n, round(g.total / g.n, 6) as center from (select k, unnest(groups) as g from walk where i = 11)"
)
def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where numbers stand above each other: each joins the first group whose mean so far is near."""
    K = key()  # noqa: N806
    cells = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: cell(1, ((K * 7 + i * i * 13) % 40) * 5.0, i * 20, said(i)))
    return positions.value_clusters(words_of(spark, sf_dir, cells)).select("document_id", "n", F.round("center", 6).alias("center"))


@query(
    "with c as (select s_suppkey as k, i, 2020 + (s_suppkey + i * 3) % 7 as year, 200 + 100 * i + (s_suppkey * (i + 1)) % 17 + 15.0 as center, 1 + s_suppkey % 3 as n from supplier, range(3) t(i)), "
    "own as (select *, lag(center) over w as before, lead(center) over w as behind from c where i < n window w as (partition by k order by center)), "
    "marks as (select s_suppkey as k, 0 as m, 215.0 + s_suppkey % 23 as x, 'CNY' as currency from supplier union all select s_suppkey, 1, 395.0 - s_suppkey % 29, 'USD' from supplier), "
    "nearest as (select own.k, i, first(currency order by abs(x - center), m) as currency from own join marks using (k) group by all) "
    'select k as document_id, year::int as year, center::double as center, coalesce((before + center) / 2, center - 90)::double as "left", coalesce((behind + center) / 2, center + 90)::double as "right", currency, 1000.0::double as scale from own join nearest using (k, i)'
)
def period_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three years in a heading, their bounds half-way, the currency of the nearest unit."""
    K = key()  # noqa: N806
    years = [F.when(i < 1 + K % 3, cell(1, 200 + 100 * i + (K * (i + 1)) % 17, 130, said(2020 + (K + i * 3) % 7))) for i in range(3)]
    cells = F.array(cell(1, 50, 100, "Statement of financial position"), *years, cell(1, 200 + K % 23, 150, "RMB"), cell(1, 380 - K % 29, 150, "US$"), cell(1, 50, 170, "in thousands"), cell(1, 50, 190, "Total assets"), cell(1, 300, 190, "5"))
    return positions.period_columns(words_of(spark, sf_dir, cells)).select("document_id", "year", "center", "left", "right", "currency", "scale")


@query(
    "with g as (select s_suppkey as k, 1 + (s_suppkey * 3) % 10 as first, 1 + (s_suppkey * 7) % 9 as second, (s_suppkey % 11) * 2 as shift from supplier), "
    "t as (select *, case when first > 6.5 then 1 when second > 6.5 or shift > 14 then 2 else 3 end as taken from g) "
    "select k as document_id, taken::int as taken, case when taken = 3 then 'totalliabilities' else 'total' end as label from t"
)
def wrapped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that wraps around its value is one row if its parts are close and aligned."""
    K = key()  # noqa: N806
    top = 106 + 1 + (K * 3) % 10
    cells = F.array(cell(1, 50, 100, "Total"), cell(1, 300, top, said("(", K, ".5)")), cell(1, 50 + (K % 11) * 2, top + 6 + 1 + (K * 7) % 9, "liabilities"))
    return positions.table_rows(words_of(spark, sf_dir, cells)).filter("row = 0").select("document_id", "taken", F.col("merged_label").alias("label"))


# Reports of up to five pages: a balance sheet with a line on each page. The page after the first may have its value out of all columns,
# a page may be missing, a page may state a unit of its own; an income statement with a group of lines ends the report.
LINES = [("Total assets", "assets"), ("Total liabilities", "liabilities"), ("Total equity", "total_equity"), ("Equity attributable to owners of the company", "equity"), ("Total assets", "assets")]


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    K = key()  # noqa: N806
    shift = K % 3 / 1.0  # rows are not quite straight
    cells = [cell(1, 50, 100, "Consolidated"), cell(1, 85, 100 + shift, "balance sheet"), cell(1, 300, 112, "2024"), cell(1, 400, 112, "2023"), cell(1, 50, 124, "in RMB'000")]
    for j, (label, _) in enumerate(LINES):
        page = 1 + j + F.when((K % 7 == 0) & (F.lit(j) >= 2), 1).otherwise(0)
        there = F.lit(j) <= K % 5
        own = [cell(page, 50, 150 + shift, label, 100.0), cell(page, F.when((K % 6 == 0) & (F.lit(j) == 1), 600).otherwise(300 + K % 9), 150, said(K * 10 + j)), cell(page, 400, 151, "77")]
        if j == 1:
            own = [F.when(K % 4 == 1, cell(page, 50, 100, "HK$ million"))] + own[:2]  # its only other number stands out of the columns, too
        cells += [F.when(there, c) for c in own]
    income = 9
    cells += [cell(income, 50, 90, "Consolidated income statement"), cell(income, 300, 110, "2024"), cell(income, 400, 110, "2023"), cell(income, 50, 130, "Revenues")]
    for i in range(10):
        top = 150 + 20 * i
        cells += [F.when(i < 1 + K % 10, cell(income, 50, top, said("Line ", F.lit("abcdefghij"[i])))), F.when((i < 1 + K % 10) & ((K + i) % 4 != 0), cell(income, 300 + i % 3, top, said(K * (i + 1)))), F.when(i < 1 + K % 10, cell(income, 400, top, "8"))]
    total = sum((F.when((i < 1 + K % 10) & ((K + i) % 4 != 0), K * (i + 1)).otherwise(0) for i in range(10)), F.lit(0))
    # a third of the reports add up to another total
    return words_of(spark, sf_dir, F.array(*cells, cell(income, 250, 400, "6"), cell(income, 300, 400, F.when(K % 3 == 0, total + F.floor(total / 20) + 2).otherwise(total).cast("string"))))


PAGES_SQL = (
    "p as (select s_suppkey as k, j, 1 + j + case when s_suppkey % 7 = 0 and j >= 2 then 1 else 0 end as page, not (s_suppkey % 6 = 0 and j = 1) as fits, "
    "case when j = 0 then {'scale': 1e3, 'currency': 'CNY'} when j = 1 and s_suppkey % 4 = 1 then {'scale': 1e6, 'currency': 'HKD'} end as unit from supplier, range(5) t(j) where j <= s_suppkey % 5), "
    "linked as (select *, j = 0 or (fits and page - lag(page) over w = 1) as goes, last_value(unit ignore nulls) over w as stated from p window w as (partition by k order by j)), "
    "held as (select * from linked where j <= 2 qualify bool_and(goes) over (partition by k order by j))"
)


@query(
    f"with {PAGES_SQL} select k as document_id, page::int as page, (case when j = 0 then 1 else 0 end)::int as section, 'balance_sheet' as statement, stated.scale::double as scale, stated.currency as currency, j::int as inherited from held "
    "union all select s_suppkey, 9, 1, 'income_statement', 1.0, 'CNY', 0 from supplier"
)
def statement_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statement each page goes on with: for two pages, while pages follow at once and values stand in its columns; with the unit stated last."""
    return positions.sections(report(spark, sf_dir)).select("document_id", "page", "section", "statement", "scale", "currency", "inherited")


GROUPS_SQL = (
    "l as (select s_suppkey as k, i, case when (s_suppkey + i) % 4 <> 0 then s_suppkey * (i + 1) end as v from supplier, range(10) t(i) where i < 1 + s_suppkey % 10), "
    "sums as (select k, count(*) as lines, count(v) as n, coalesce(sum(v), 0)::bigint as total from l group by k), "
    "said as (select *, case when k % 3 = 0 then total + total // 20 + 2 else total end as told from sums), "
    "groups_ as (select k, told from said where lines + 1 <= 9 and n >= 2 and abs(total - told) <= greatest(1, told * 0.01))"
)


@query(f"with {GROUPS_SQL} select k as document_id, told::double as value from groups_")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of the lines below "Revenues": the first number without a label within nine rows, if it is their sum."""
    return positions.candidates(report(spark, sf_dir), 2024).filter("concept = 'revenue'").select("document_id", "value")


@query(
    f"with {PAGES_SQL}, {GROUPS_SQL} select k as document_id, ['assets', 'liabilities', 'total_equity'][j + 1] as concept, (k * 10 + j) * stated.scale::double as value, stated.currency as currency, page::int as page from held "
    "union all select k, 'revenue', told::double, 'CNY', 9 from groups_"
)
def positional_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the wanted year over all pages of each report, scaled by the unit of their page."""
    return positions.positional_facts(report(spark, sf_dir), 2024).select("document_id", "concept", "value", "currency", F.col("page").cast("int").alias("page"))


@query(
    "with f as (select s_suppkey as k, (s_suppkey * 37) % 500 + 300 as assets, (s_suppkey * 11) % 200 as liabilities, i, (s_suppkey * (i + 3) * 29) % 700 as v, case i when 0 then 11 when 1 then 10 else 1 end as rank from supplier, range(3) t(i)), "
    "s as (select *, s_suppkey_is_even as bound from (select *, k % 2 = 0 as s_suppkey_is_even from f)), "
    "walk as (select k, bound, assets - liabilities as target, list(v order by i) as vs from s group by all), "
    "one as (select *, case when bound and abs(vs[2] - target) < abs(vs[1] - target) then vs[2] else vs[1] end as kept from walk) "
    "select k as document_id, (case when bound and abs(vs[3] - target) < abs(kept - target) then vs[3] else kept end)::double as value from one"
)
def nearest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity among three candidates: nearest to assets less liabilities where both are known (even suppliers), else by rank."""
    K = key()  # noqa: N806
    entry = lambda place, concept, value, rank: F.struct(F.lit(1).alias("page"), F.lit(0).alias("section"), F.lit(place).alias("row"), F.lit(0).alias("place"), F.lit(concept).alias("concept"), F.lit(concept).alias("label"), value.cast("double").alias("value"), F.lit("CNY").alias("currency"), F.lit(1.0).alias("scale"), F.lit("balance_sheet").alias("statement"), F.lit("parent").alias("scope"), F.lit("").alias("bbox"), F.lit("").alias("raw_text"), F.lit(rank).alias("rank"), F.lit(False).alias("prefixed"))
    equity = [entry(i, "total_equity", (K * (i + 3) * 29) % 700, (11, 10, 1)[i]) for i in range(3)]
    known = [entry(3, "assets", (K * 37) % 500 + 300, 10), entry(4, "liabilities", (K * 11) % 200, 10)]
    found = table(spark, sf_dir, "supplier").select(K.alias("document_id"), F.inline(F.when(K % 2 == 0, F.array(*known, *equity)).otherwise(F.array(known[0], *equity))))
    return positions.best_facts(found).filter("concept = 'total_equity'").select("document_id", "value")
