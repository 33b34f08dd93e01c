"""Which filings to use: revisions, annual before interim, companions of the year before, sources in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .latest import best_per_key

PERIODIC = ["QUARTERLY_REPORT", "INTERIM_REPORT"]
LISTING = ["PROSPECTUS", "LISTING_REPORT"]


def revision_rank() -> list[Column]:
    """Corrected versions first, then the latest filed."""
    return [F.when(F.lower("revision").isin("", "original", "orig"), 0).otherwise(1), F.col("filed_at")]


def best_revisions(filings: DataFrame) -> DataFrame:
    """One filing for each company, year and period."""
    return best_per_key(filings, ["company", "year", "fiscal_period"], revision_rank(), "input_pos")


def select_filings(filings: DataFrame, annual_limit: int = 5, listing_limit: int = 2) -> DataFrame:
    """The filings to work on, with the reason: annual, periodic (years without an annual), companion, listing.

    All annual years count against interim filings, also those beyond the limit. Listing documents come in
    only where a company has no annual report at all.
    """
    best = best_revisions(filings)
    by_year = W.partitionBy("company", "year")
    by_company = W.partitionBy("company")
    annual = F.col("form_type") == "ANNUAL_REPORT"
    marked = best.withColumns({"year_has_annual": F.max(annual.cast("int")).over(by_year) == 1, "has_annual": F.max(annual.cast("int")).over(by_company) == 1})
    annuals = marked.filter(annual).withColumn("_rank", F.dense_rank().over(by_company.orderBy(F.col("year").desc()))).filter(F.col("_rank") <= annual_limit).drop("_rank").withColumn("reason", F.lit("annual"))
    periodic = marked.filter(F.col("form_type").isin(*PERIODIC) & ~F.col("year_has_annual")).withColumn("reason", F.lit("periodic"))
    chosen = annuals.unionByName(periodic)
    wanted = periodic.select("company", (F.col("year") - 1).alias("year"), "fiscal_period")
    companions = marked.join(wanted, ["company", "year", "fiscal_period"], "left_semi").join(chosen.select("document_id"), "document_id", "left_anti").withColumn("reason", F.lit("companion"))
    newest = by_company.orderBy(F.col("period_end").desc(), F.col("filed_at").desc(), F.col("input_pos"))
    listing = marked.filter(F.col("form_type").isin(*LISTING) & ~F.col("has_annual")).withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= listing_limit).drop("_rank").withColumn("reason", F.lit("listing"))
    return chosen.unionByName(companions).unionByName(listing).drop("year_has_annual", "has_annual")


def interim_without_annual(filings: DataFrame) -> DataFrame:
    """Interim filings of years for which the company has no annual report."""
    annual = filings.filter("form_type = 'ANNUAL_REPORT'").select("company", "year").distinct()
    return filings.filter(F.col("form_type").isin(*PERIODIC)).join(annual, ["company", "year"], "left_anti")


def first_source(candidates: DataFrame, keys: list[str], precedence: list[str], position: str) -> DataFrame:
    """For each key the valid candidate of the first source in order; the first by position within a source."""
    rank = F.lit(len(precedence))
    for i, s in enumerate(precedence):
        rank = F.when(F.col("source") == s, i).otherwise(rank)
    return best_per_key(candidates.filter("valid"), keys, [-rank], position)


def filing_sort() -> list[Column]:
    """Newest period first, then annual before quarterly before interim before listing, native documents, latest filed."""
    kind = F.lit(-1)
    for form, rank in (("ANNUAL_REPORT", 4), ("QUARTERLY_REPORT", 3), ("INTERIM_REPORT", 2), ("PROSPECTUS", 1), ("LISTING_REPORT", 0)):
        kind = F.when(F.col("form_type") == form, rank).otherwise(kind)
    end = F.coalesce(F.substring("period_end", 1, 10).try_cast("date"), F.lit("0001-01-01").cast("date"))
    return [end.desc(), kind.desc(), F.col("authority").desc(), F.col("filed_at").desc()]


def search(companies: DataFrame, wanted: str, limit: int) -> DataFrame:
    """companies (ticker, name) that hold the wanted text, best first; equal scores by ticker."""
    w, ticker, name = wanted.strip().lower(), F.lower("ticker"), F.lower("name")
    found = companies.filter(ticker.contains(w) | name.contains(w) | F.replace(ticker, F.lit("."), F.lit("")).contains(w))
    points = [(ticker == w, 100), (name == w, 80), (ticker.startswith(w), 40), (name.startswith(w), 20)]
    score = sum((hit.cast("int") * n for hit, n in points), F.lit(0))
    return found.withColumn("score", score).orderBy(F.col("score").desc(), "ticker").limit(max(1, limit))
