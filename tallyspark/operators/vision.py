"""Facts from what a vision service read off pages: rows of strict JSON, or labelled lines of markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

# Concepts, scales and statements that a service may tell, and labels of lines.
CONCEPTS = ["revenue", "net_income", "operating_cash_flow", "assets", "liabilities", "equity", "total_equity"]
SCALES = [1.0, 1e3, 1e4, 1e5, 1e6]
STATEMENTS = ["income_statement", "balance_sheet", "cash_flow"]
LINES = {
    "revenue": "(?:revenue|operating revenue|营业收入)",
    "net_income": "(?:net income|net profit|净利润)",
    "operating_cash_flow": "(?:operating cash flow|cash flows? .*operating activities|经营活动.*现金流)",
    "assets": "(?:total assets|资产总计)",
    "liabilities": "(?:total liabilities|负债合计)",
    "total_equity": "(?:total equity|total shareholders.? equity|所有者权益合计)",
}
LINE_VALUE = r"[^\n]*?([\(\-]?[0-9][0-9,]*(?:\.[0-9]+)?\)?)(?:\s|$)"


def json_facts(answers: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, status) of answers (document_id, payload, period, period_end, currency); pages (document_id, page, content_hash) are those that were sent.

    A row counts when its concept, scale, scope, end, currency and statement are as asked for, its page was sent
    and its text is there; other rows are dropped. Status: structured_json_required, no_candidates or candidates_only.
    """
    tree = F.try_parse_json("payload")
    listed = F.try_variant_get(tree, "$.facts", "array<variant>")
    text = lambda name: F.try_variant_get("r", f"$.{name}", "string")
    rows = answers.select("document_id", "period", "period_end", "currency", F.posexplode(listed).alias("position", "r"))
    told = rows.select(
        "document_id", "position", "period", "period_end", "currency", text("concept").alias("concept"), F.try_variant_get("r", "$.value", "double").alias("number"), F.coalesce(F.try_variant_get("r", "$.unit_scale", "double"), F.lit(1.0)).alias("scale"),
        F.try_variant_get("r", "$.original_page", "int").alias("page"), text("statement").alias("statement"), F.btrim(F.coalesce(text("raw_text"), F.lit(""))).alias("raw_text"), text("scope").alias("scope"), text("period_end").alias("end"), F.upper(text("currency")).alias("money"),
    )
    asked = F.col("concept").isin(*CONCEPTS) & F.col("scale").isin(*SCALES) & (F.col("scope") == "consolidated") & (F.col("end") == F.col("period_end")) & (F.col("money") == F.upper("currency")) & F.col("statement").isin(*STATEMENTS)
    good = told.filter(asked & F.col("number").isNotNull() & (F.col("raw_text") != "")).join(pages, ["document_id", "page"])
    facts = good.select("document_id", "position", "concept", (F.col("number") * F.col("scale")).alias("value"), "statement", "page", "content_hash", dates.statement_start(F.to_date("period_end"), F.col("period"), F.col("statement")).alias("period_start"))
    counted = facts.groupBy("document_id").agg(F.count("*").alias("n"))
    status = F.when(listed.isNull(), "structured_json_required").when(F.col("n").isNull(), "no_candidates").otherwise("candidates_only")
    return facts, answers.join(counted, "document_id", "left").select("document_id", status.alias("status"))


def markdown_facts(text: Column) -> Column:
    """(concept, value, raw_text) of the first line of each label, in the scale that the text names anywhere."""
    low = F.lower(text)
    scale = F.when(low.contains("million") | text.contains("百万"), 1e6).when(low.contains("thousand") | text.contains("千元"), 1e3).otherwise(1.0)
    entries = []
    for concept, label in LINES.items():
        pattern = f"(?im)^({label}{LINE_VALUE})"
        token = F.regexp_replace(F.regexp_extract(text, pattern, 2), ",", "")
        size = F.regexp_replace(token, "[()]", "").try_cast("double") * scale
        entries.append(F.struct(F.lit(concept).alias("concept"), F.when(token.startswith("(") & token.endswith(")"), -size).otherwise(size).alias("value"), F.btrim(F.regexp_extract(text, pattern, 1)).alias("raw_text")))
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def with_results(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages that were sent with what came back under their data_id; one without a result is a provenance error."""
    back = results.select("data_id", F.col("text").alias("result"))
    return pages.join(back, "data_id", "left").withColumn("error", F.when(F.col("result").isNull(), "provenance_missing").otherwise(""))


def page_budget(pages: DataFrame, key: str, order: str, most_pages: int, most_bytes: int) -> DataFrame:
    """The first pages of each key within a number of pages and of bytes, with the bytes so far; the limits are the feature."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return pages.withColumns({"place": F.count("*").over(w), "bytes_so_far": F.sum("bytes").over(w)}).filter((F.col("place") <= most_pages) & (F.col("bytes_so_far") <= most_bytes))
