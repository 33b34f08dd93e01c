"""Facts to wide rows, and the metrics of annual and interim periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import growth_rate, safe_divide

# Period tokens that stand for a full year, and the order of interim periods within one.
ANNUAL = ["", "FY", "CY", "ANNUAL"]
INTERIM_ORDER = {"Q1": 1, "H1": 2, "Q2": 2, "Q3": 3, "9M": 3, "Q": 3}


def is_annual(period: str = "period") -> Column:
    """Whether a period token means a full year; null and blank do."""
    return F.upper(F.trim(F.coalesce(F.col(period), F.lit("")))).isin(*ANNUAL)


def interim_order(period: str = "period") -> Column:
    out = F.lit(0)
    for p, n in INTERIM_ORDER.items():
        out = F.when(F.col(period) == p, n).otherwise(out)
    return out


def matrix(facts: DataFrame, keys: list[str], concepts: list[str], *more: Column) -> DataFrame:
    """One row for each key with the latest filed value of each concept (an absent concept stays null) and more aggregates, by one aggregation."""
    newest = lambda c: F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.struct("filed_at", "input_pos")))
    return facts.groupBy(*keys).agg(*[newest(c).alias(c) for c in concepts], *more)


def ratios(revenue: str = "revenue") -> dict[str, Column]:
    return {
        "operating_margin": safe_divide("operating_income", revenue),
        "net_margin": safe_divide("net_income", revenue),
        "cash_conversion": safe_divide("operating_cash_flow", "net_income"),
        "free_cash_flow": F.col("operating_cash_flow") - F.col("capital_expenditure"),
        "debt_to_assets": safe_divide("liabilities", "assets"),
        "return_on_equity": safe_divide("net_income", "total_equity"),
    }


def annual_growth(annual: DataFrame) -> DataFrame:
    """Growth against the year before in the table, which need not be year - 1."""
    w = W.partitionBy("company").orderBy("year")
    return annual.withColumn("previous_revenue", F.lag("revenue").over(w)).withColumn("revenue_growth", growth_rate("revenue", "previous_revenue"))


def annual_metrics(annual: DataFrame) -> DataFrame:
    return annual_growth(annual).drop("previous_revenue").withColumns(ratios())


def interim_comparison(interim: DataFrame) -> DataFrame:
    """Each period beside the same period of year - 1 exactly, and why there is no growth where there is none."""
    before = interim.select("company", (F.col("year") + 1).alias("year"), "period", F.col("revenue").alias("prior_revenue"), F.lit(True).alias("found"))
    both = interim.join(before, ["company", "year", "period"], "left")
    label = F.when(F.col("found"), F.concat((F.col("year") - 1).cast("string"), F.lit(" "), F.col("period")))
    gap = F.when(F.col("prior_revenue").isNotNull(), F.lit(None)).when(F.col("found"), "prior_revenue_unavailable").otherwise("prior_period_unavailable")
    return both.withColumns({"comparison_period": label, "comparison_gap": gap.cast("string"), "revenue_growth": growth_rate("revenue", "prior_revenue")}).drop("found")


def interim_metrics(interim: DataFrame) -> DataFrame:
    return interim_comparison(interim).drop("prior_revenue").withColumns(ratios())


def covered_columns(df: DataFrame, key: str, order: str, names: list[str], most: int) -> DataFrame:
    """The newest `most` rows of each key: how many there are, and the names of the columns with a value in any of them, joined by |."""
    newest = df.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter(F.col("_rank") <= most)
    present = F.concat_ws("|", *[F.when(F.count(n) > 0, F.lit(n)) for n in names])
    return newest.groupBy(key).agg(F.count("*").alias("rows"), present.alias("columns"))
