"""What comes of a document and of an answer: sources by their gates, pages to read again, profiles, checked opportunities and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers, records, texts

GOOD = ["VERIFIED", "READY_WITH_WARNINGS"]
# Sections of a report, grades, scenarios, titles of statements and of accounts that are not consolidated.
SECTIONS = ["business_model", "claims", "competitive_position", "counterarguments", "executive_summary", "financial_quality", "growth_opportunities", "invalidation_conditions", "leading_indicators", "scenarios", "thesis", "unresolved_questions"]
GRADES, SCENARIOS, MOST_OPPORTUNITIES = ["A", "B", "C", "D", "E", "U"], ["bear", "base", "bull"], 5
TITLES = {
    "income_statement": ["consolidated income", "income statement", "statement of profit", "profit and loss", "profit or loss", "合并利润表", "合并损益表", "利润表"],
    "balance_sheet": ["consolidated balance", "balance sheet", "statement of financial position", "合并资产负债表", "资产负债表"],
    "cash_flow": ["consolidated statement of cash", "statement of cash flows", "cash flow statement", "cash flows from operating", "合并现金流量表", "现金流量表"],
}
PARENT = ["parent company", "parent-company", "company only", "company-only", "separate financial", "separate statement", "separate accounts", "母公司", "单体", "个别财务报表", "个别报表"]


def gated_source(groups: DataFrame) -> DataFrame:
    """(document_id, source) of groups (document_id, source, status, has_document).

    A structured source counts if its group passes, or where there is no document to read; else the document;
    vision where nothing was parsed or the document's group was rejected. None where nothing is left.
    """
    wide = groups.groupBy("document_id").agg(F.bool_or("has_document").alias("has_document"), *[F.max(F.when(F.col("source") == s, F.col("status"))).alias(s) for s in ("structured", "document", "vision")])
    good = lambda s: F.coalesce(F.col(s).isin(*GOOD), F.lit(False))
    own = F.when(good("structured"), "structured").when(F.col("structured").isNotNull() & ~F.col("has_document"), "structured").when(good("document"), "document").when(F.col("vision").isNotNull(), "vision").when(F.col("document").isNotNull(), "document")
    return wide.select("document_id", own.alias("source"))


def pages_to_read_again(pages: DataFrame, targets: DataFrame, reach: int = 2) -> DataFrame:
    """Pages (document_id, page, text) of the wanted statements (document_id, statement): the page of a formal title and up to `reach` pages behind it, up to the next title.

    The first title line of a page counts; one of accounts that are not consolidated is a boundary and no target.
    """
    flat = F.transform(F.split("text", "\n"), lambda x: F.lower(F.btrim(F.regexp_replace(x, r"\s+", " "))))
    kind = F.lit(None).cast("string")
    told = pages.select("document_id", "page", flat.alias("lines"))

    def of(x: Column) -> Column:
        out = kind
        for statement, marks in reversed(TITLES.items()):
            out = F.when(texts.holds(x, marks), statement).otherwise(out)
        return out

    found = F.transform("lines", lambda x, i: F.struct(of(x).alias("statement"), i.alias("i"), x.alias("line")))
    first = told.withColumn("t", F.get(F.filter(found, lambda s: s["statement"].isNotNull()), 0))
    around = F.array_join(F.slice("lines", F.greatest(F.col("t.i") - 1, F.lit(1)), F.least(F.col("t.i") + 1, F.lit(3))), " ")
    eligible = ~(texts.holds(around, PARENT) & ~texts.holds(F.col("t.line"), ["consolidated", "合并"]))
    marked = first.select("document_id", "page", F.col("t.statement").alias("statement"), F.coalesce(eligible, F.lit(False)).alias("eligible"))
    w = W.partitionBy("document_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    title = F.last(F.when(F.col("statement").isNotNull(), F.struct("page", "statement", "eligible")), ignorenulls=True).over(w)
    under = marked.withColumn("of", title).filter("of.eligible").select("document_id", "page", F.col("of.statement").alias("statement"), (F.col("page") - F.col("of.page")).alias("behind"))
    return under.filter(F.col("behind") <= reach).join(targets.distinct(), ["document_id", "statement"], "left_semi").select("document_id", "page", "statement")


def trusted_profile(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Facts that are not rejected, of accessions without any rejected group: one bad group takes its accession with it."""
    bad = groups.filter("status = 'REJECTED'").select("accession").distinct()
    return facts.filter("validation_status <> 'REJECTED'").join(bad, "accession", "left_anti")


def checked_opportunities(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, place, title, grade, low, high, horizon, issues) of answers (id, payload); evidence (id, evidence_id) is what they may cite.

    The first MOST_OPPORTUNITIES count. A bad field gets a standing value and an issue; unknown evidence and
    scenarios are issues.
    """
    item = F.col("o")
    text = lambda name: F.btrim(F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit("")))
    listed = answers.select("id", F.posexplode(F.slice(records.opportunity_list(F.try_parse_json("payload")), 1, MOST_OPPORTUNITIES)).alias("place", "o"))
    grade, pair = F.upper(F.coalesce(F.nullif(text("evidence_grade"), F.lit("")), F.lit("U"))), numbers.probability_pair(F.try_variant_get(item, "$.probability_range", "variant"))
    horizon = F.try_variant_get(item, "$.time_horizon_years", "int")
    lists = lambda name: records.string_list(F.try_variant_get(item, f"$.{name}", "variant"))
    read = listed.select(
        "id", "place", text("title").alias("title"), text("mechanism").alias("mechanism"), grade.alias("grade"), pair.alias("pair"), F.when(horizon.between(1, 20), horizon).alias("horizon"),
        F.concat(lists("supporting_evidence_ids"), lists("contradicting_evidence_ids")).alias("cited"), lists("scenario_eligibility").alias("scenarios"),
    )
    cited = read.select("id", "place", F.explode("cited").alias("evidence_id"))
    unknown = cited.join(evidence, ["id", "evidence_id"], "left_anti").groupBy("id", "place").agg(F.count("*").alias("unknown"))
    joined = read.join(unknown, ["id", "place"], "left")
    rules = {
        "no_title": F.col("title") == "", "no_mechanism": F.col("mechanism") == "", "grade_invalid": ~F.col("grade").isin(*GRADES), "probability_invalid": F.col("pair").isNull(), "horizon_invalid": F.col("horizon").isNull(),
        "unknown_evidence": F.col("unknown").isNotNull(), "unknown_scenario": F.exists("scenarios", lambda s: ~F.lower(s).isin(*SCENARIOS)),
    }
    issues = F.array_join(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])), "|")
    title = F.when(F.col("title") == "", F.concat(F.lit("Unnamed opportunity "), (F.col("place") + 1).cast("string"))).otherwise(F.col("title"))
    return joined.select("id", "place", title.alias("title"), F.when(F.col("grade").isin(*GRADES), F.col("grade")).otherwise("U").alias("grade"), "pair.low", "pair.high", "horizon", issues.alias("issues"))


def checked_report(payload: Column) -> Column:
    """(missing, claims, passed) of a report: sections that are absent or empty, in order, and the number of its claims."""
    tree = F.try_parse_json(payload)
    empty = lambda name: F.coalesce(F.to_json(F.try_variant_get(tree, f"$.{name}", "variant")), F.lit("null")).isin("null", '""', "[]")
    missing = F.array_join(F.array_compact(F.array(*[F.when(empty(s), F.lit(s)) for s in SECTIONS])), "|")
    claims = F.coalesce(F.size(F.try_variant_get(tree, "$.claims", "array<variant>")), F.lit(0))
    return F.struct(missing.alias("missing"), claims.alias("claims"), ((missing == "") & (claims > 0)).alias("passed"))


def artifact_id(run: Column, kind: Column, agent: Column, canonical: Column) -> Column:
    """run:type:hash of what an agent wrote; the same content has the same id."""
    return F.concat_ws(":", run, kind, texts.content_id(agent, canonical, length=10))
