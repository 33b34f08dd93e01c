"""Statement values from the text of pages: contexts that carry over pages, labelled lines, scored candidates.

Pages are rows (document_id, page, text). Contexts are windows over a document's pages, everything else is
row by row: one pass, partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, texts
from .latest import best_per_key

# The labels of each concept, in the order in which they are tried.
LABELS = {
    "operating_cash_flow": "经营活动产生的现金流量净额|经营活动所得现金净额|net cash generated from operating activities|net cash flows from operating activities|经营活动现金流量净额",
    "capital_expenditure": "购建固定资产、无形资产和其他长期资产支付的现金|购建固定资产、无形资产及其他长期资产支付的现金|purchase of property, plant and equipment|capital expenditure|资本性支出",
    "net_income": "归属于上市公司股东的净利润|归属于母公司股东的净利润|本公司权益持有人应占盈利|本公司股东应占溢利|profit attributable to owners of the company|net profit attributable to shareholders|净利润|net income",
    "operating_income": "营业利润|经营利润|operating profit|profit from operations",
    "revenue": "营业收入|收入合计|營業收入|收入總額|revenue|turnover|营业总收入|营业额|收入",
    "assets": "资产总计|总资产|total assets|资产总额",
    "liabilities": "负债合计|总负债|total liabilities|负债总额",
    "equity": "归属于母公司所有者权益（或股东权益）合计|归属于母公司所有者权益合计|归属于上市公司股东的所有者权益|equity attributable to owners of the company",
    "total_equity": "所有者权益（或股东权益）合计|所有者权益合计|股东权益合计|权益总额|total equity",
    "reported_roe": "加权平均净资产收益率（%）|加权平均净资产收益率(%)|加权平均净资产收益率|weighted average return on equity",
}
STATEMENT_OF = {"assets": "balance_sheet", "liabilities": "balance_sheet", "equity": "balance_sheet", "total_equity": "balance_sheet", "operating_cash_flow": "cash_flow", "capital_expenditure": "cash_flow"}
UNITS = [(1e6, ["单位：百万元", "单位:百万元", "hk$ million", "rmb million"]), (1e4, ["单位：万元", "单位:万元"]), (1e3, ["单位：千元", "单位:千元", "hk$'000", "rmb'000", "in thousands"])]
COMPREHENSIVE = ["综合收益", "綜合收益", "其他综合收益", "其他綜合收益", "comprehensive income"]
DISCLAIMED = ["不是利润表", "不构成财务报表", "非财务报表"]
STRONG = ["主要会计数据", "主要财务数据"]
SUMMARY = ["quarterly summary"]
CONTINUED = ["续", "continued", "continuation"]
NARRATIVE = ["约占", "激励", "比例为", "同比", "说明："]
#: Pages after a title that may go on with its statement; and the least score of a candidate.
REACH, LEAST = 3, 40


def labels_of(concept: str) -> list[str]:
    return LABELS[concept].split("|")


def concepts_of(statement: str) -> list[str]:
    return [c for c in LABELS if c != "reported_roe" and STATEMENT_OF.get(c, "income_statement") == statement and c != "operating_income"] + (["operating_income"] if statement == "income_statement" else [])


def page_unit(text: Column) -> Column:
    """The multiplier that a page states near its top, else null."""
    head, out = F.lower(F.substring(text, 1, 4000)), F.lit(None).cast("double")
    for scale, marks in reversed(UNITS):
        out = F.when(texts.holds(head, marks), F.lit(scale)).otherwise(out)
    return out


def concept_density(text: Column) -> Column:
    """How many concepts have a label on a page."""
    low = F.lower(text)
    return sum((texts.holds(low, labels_of(c)).cast("int") for c in LABELS), F.lit(0))


def with_context(pages: DataFrame) -> DataFrame:
    """pages with statement, scope and multiplier of the context, and whether a unit is stated.

    A title opens a context. The next page keeps it if it follows at once, has no title itself and looks like
    more of the same, for REACH pages at most; any other page ends it.
    """
    by_page = W.partitionBy("document_id").orderBy("page")
    so_far = by_page.rowsBetween(W.unboundedPreceding, 0)
    plain = F.array_join(F.filter(F.transform(F.split(F.translate(F.replace("text", F.lit(" "), F.lit(" ")), "，", ","), "\n"), lambda x: F.btrim(x)), lambda x: x != ""), "\n")
    read = pages.withColumn("text", plain).filter("text <> ''").withColumns({"title": texts.statement_title(F.col("text")), "unit": page_unit(F.col("text"))})
    opened = F.when(F.col("title").isNotNull(), F.struct("title", F.coalesce("unit", F.lit(1.0)).alias("multiplier")))
    read = read.withColumns({"open": F.last(opened, ignorenulls=True).over(so_far), "place": F.row_number().over(by_page), "gap": F.col("page") - F.lag("page").over(by_page)})
    low = F.lower("text")
    more = texts.holds(low, CONTINUED)
    for statement in texts.STATEMENTS:
        more = more | ((F.col("open.title.statement") == statement) & texts.holds(low, [x for c in concepts_of(statement) for x in labels_of(c)]))
    broken = F.col("title").isNull() & ~F.coalesce((F.col("gap") == 1) & more, F.lit(False))
    read = read.withColumns({"breaks": F.sum(broken.cast("int")).over(so_far), "titled": F.last(F.when(F.col("title").isNotNull(), F.col("place")), ignorenulls=True).over(so_far)})
    at_title = F.last(F.when(F.col("title").isNotNull(), F.col("breaks")), ignorenulls=True).over(so_far)
    inside = F.coalesce((F.col("breaks") == at_title) & (F.col("place") - F.col("titled") <= REACH), F.lit(False))
    read = read.withColumn("inside", inside)
    return read.select(
        *pages.columns, "inside", F.when(F.col("inside"), F.col("open.title.statement")).alias("statement"), F.when(F.col("inside"), F.col("open.title.scope")).alias("scope"),
        F.when(F.col("inside"), F.col("open.multiplier")).otherwise(F.coalesce("unit", F.lit(1.0))).alias("multiplier"), F.col("unit").isNotNull().alias("stated"),
    )


def rejected(concept: Column, line: Column, label: Column) -> Column:
    """Lines that hold a label of a concept and mean something else."""
    low, few = F.lower(line), F.size(F.regexp_extract_all(line, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?"), 0)) <= 2
    part = label.isin("负债合计", "total liabilities") & texts.holds(line, ["流动负债合计", "非流动负债合计"])
    share = F.contains(line, F.lit("权益总额的")) | F.contains(low, F.lit("equity interest of")) | (F.contains(line, F.lit("%")) & few)
    return (
        ((concept == "revenue") & texts.holds(low, COMPREHENSIVE)) | ((concept == "liabilities") & part) | (concept.isin("equity", "total_equity") & share)
        | ((concept == "reported_roe") & ~texts.holds(low, ["%", "percentage"])) | texts.holds(line, DISCLAIMED)
    )


def score(concept: Column, line: Column, label: Column, inside: Column, stated: Column, summary: Column) -> Column:
    """How well a line fits a label of a concept."""
    first = F.startswith(F.lower(F.regexp_replace(line, r"^[\s（()一二三四五六七八九十、.0-9]+", "")), F.lower(label))
    bonus = F.when((concept == "liabilities") & label.isin("负债合计", "总负债", "total liabilities"), 30).when((concept == "equity") & texts.holds(F.lower(label), ["归属于", "attributable"]), 35)
    bonus = bonus.when((concept == "total_equity") & texts.holds(line, ["所有者权益合计", "股东权益合计"]), 30).otherwise(0)
    flow = concept.isin("revenue", "net_income", "operating_income", "operating_cash_flow")
    points = F.length(label) * 2 + F.when(first, 60).otherwise(0) + F.when(inside, 35).otherwise(0) + F.when(stated, 10).otherwise(0) + bonus
    return points - F.when(summary & flow, 90).otherwise(0) - F.when(texts.holds(line, NARRATIVE), 80).otherwise(0)


def candidates(pages: DataFrame) -> DataFrame:
    """Every line of every page that gives a plausible value for a concept, with its score."""
    low = F.lower("text")
    read = with_context(pages).withColumns({"density": concept_density(F.col("text")), "strong": texts.holds(low, STRONG), "summary": texts.holds(low, SUMMARY), "lines": F.split("text", "\n")})
    read = read.withColumn("lines", F.transform("lines", lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))))
    lines = read.select("*", F.posexplode("lines").alias("place", "line"))
    found = F.array(*[F.struct(F.lit(c).alias("concept"), F.get(F.filter(F.array(*[F.lit(x) for x in labels_of(c)]), lambda x: F.contains(F.lower("line"), x)), 0).alias("label")) for c in LABELS])
    told = lines.select("*", F.inline(F.filter(found, lambda m: m["label"].isNotNull())))
    concept, label, roe = F.col("concept"), F.col("label"), F.col("concept") == "reported_roe"
    loose = ~F.col("inside") & F.col("stated") & (F.col("density") < 3) & ~F.col("strong") & ~roe
    told = told.filter(~rejected(concept, F.col("line"), label) & ~loose)
    whole = F.when(roe, F.array_join(F.slice("lines", F.col("place") + 1, 3), " ")).otherwise(F.col("line"))
    tail = F.substring(whole, F.position(label, F.lower(whole)) + F.length(label), F.lit(1_000_000))
    number = numbers.row_value(tail)
    value = F.when(roe, numbers.ratio(number)).when(concept == "capital_expenditure", F.abs(number * F.col("multiplier"))).otherwise(number * F.col("multiplier"))
    told = told.withColumns({"value": value, "score": score(concept, F.col("line"), label, F.col("inside"), F.col("stated") | F.col("inside"), F.col("summary"))})
    own = F.when(concept.isin(*STATEMENT_OF), F.when(concept.isin(*[c for c, s in STATEMENT_OF.items() if s == "cash_flow"]), "cash_flow").otherwise("balance_sheet")).otherwise("income_statement")
    kept = told.filter(numbers.plausible(F.col("value")) & (F.col("score") >= LEAST))
    return kept.select("document_id", "concept", "label", "value", "page", "place", F.substring("line", 1, 1200).alias("excerpt"), "score", F.coalesce("statement", own).alias("statement"), F.coalesce("scope", F.lit("consolidated")).alias("scope"))


def page_facts(pages: DataFrame) -> DataFrame:
    """The best candidate of each document and concept: by score, then the later page, then the earlier line."""
    return best_per_key(candidates(pages), ["document_id", "concept"], [F.col("score"), F.col("page")], "place")


def snapshot_values(text: Column, labels: dict[str, str]) -> Column:
    """Values of a bounded snapshot by concept: key=value pairs, else the number within 300 characters behind a label, longest label first."""
    pairs = texts.key_values(text)
    entries = []
    for concept, names in labels.items():
        tries = [numbers.row_value(F.regexp_extract(text, f"(?is){name}(.{{1,300}})", 1)) for name in sorted(names.split("|"), key=len, reverse=True)]
        entries.append(F.struct(F.lit(concept).alias("concept"), F.coalesce(F.element_at(pairs, concept).try_cast("double"), *tries).alias("value")))
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
