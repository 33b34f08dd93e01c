"""Validation gates: rules over one wide row of a group; a group with an issue is quarantined, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CORE = ["revenue", "net_income", "assets", "liabilities", "total_equity", "operating_cash_flow"]

# The concepts of which a dataset has at least one.
USEFUL = ["revenue", "net_income", "assets", "operating_cash_flow"]


def _missing(*names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n).isNull()
    return out


def balance_rules() -> dict[str, Column]:
    """Plausibility of one balance sheet; a rule without its inputs does not fire."""
    assets, liabilities, equity = F.col("assets"), F.col("liabilities"), F.col("total_equity")
    ratio = F.try_divide(liabilities, assets)
    return {
        "negative_revenue": F.col("revenue") < 0,
        "implausible_liabilities_to_assets": (ratio < 0.01) | (ratio > 1.5),
        "implausible_total_equity": F.try_divide(F.abs(equity), F.abs(assets)) < 0.01,
        "balance_sheet_imbalance": F.when(assets != 0, F.abs(assets - liabilities - equity) / F.greatest(F.abs(assets), F.lit(1.0)) > 0.08),
    }


def coverage_rules() -> dict[str, Column]:
    """The strict gate: all of the core must be there."""
    return {
        "income_statement_core_missing": _missing("revenue", "net_income"),
        "cash_flow_core_missing": _missing("operating_cash_flow"),
        "balance_sheet_core_missing": _missing("assets", "liabilities", "total_equity"),
        "core_coverage_insufficient": _missing(*CORE),
        "group_identity_inconsistent": F.col("blank_currency"),
        "provenance_missing": F.col("blank_accession"),
    }


def lenient_rules() -> dict[str, Column]:
    """The earlier gate: half of the core is enough."""
    covered = sum((F.col(c).isNotNull().cast("int") for c in CORE), F.lit(0))
    return {"core_coverage_insufficient": covered < 3}


def validate(groups: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """groups with issues (sorted, distinct, joined by |), and status VERIFIED or REJECTED."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]))
    return groups.withColumn("_issues", found).withColumn("issues", F.array_join("_issues", "|")).withColumn("status", F.when(F.size("_issues") == 0, "VERIFIED").otherwise("REJECTED")).drop("_issues")


def group_flags(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a group has a fact without its accession or currency."""
    return facts.groupBy(*keys).agg(F.bool_or(F.col("accession") == "").alias("blank_accession"), F.bool_or(F.col("currency") == "").alias("blank_currency"))


def dataset_presence(datasets: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """datasets (key) with the issue that ends all other checks: no_financial_facts, no_core_financial_facts (no fact of USEFUL at all) or none (empty)."""
    had = facts.groupBy(key).agg(F.bool_or(F.col("concept").isin(USEFUL)).alias("core"))
    told = F.when(F.col("core").isNull(), "no_financial_facts").when(~F.col("core"), "no_core_financial_facts").otherwise("")
    return datasets.join(had, key, "left").withColumn("issue", told).drop("core")


def dataset_status(groups: DataFrame, key: str) -> DataFrame:
    """REJECTED if nothing passed, READY_WITH_WARNINGS if something did not, else VERIFIED."""
    passed = F.col("status") == "VERIFIED"
    status = F.when(~F.bool_or(passed), "REJECTED").when(F.bool_and(passed), "VERIFIED").otherwise("READY_WITH_WARNINGS")
    return groups.groupBy(key).agg(F.count_if(passed).alias("accepted"), F.count_if(~passed).alias("rejected"), status.alias("status"))


def latest_or_nothing(groups: DataFrame, key: str, order: str) -> DataFrame:
    """The latest group of each key if it passed; an older one does not stand in for it."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    return groups.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1 and status = 'VERIFIED'").drop("_rank")


def consecutive_jumps(annual: DataFrame, limit: float = 20.0) -> DataFrame:
    """Years whose revenue is over `limit` times that of the year before, or under 1 / limit; only where the years follow each other."""
    w = W.partitionBy("company").orderBy("year")
    seen = annual.filter("revenue > 0").withColumns({"previous_year": F.lag("year").over(w), "previous_revenue": F.lag("revenue").over(w)})
    ratio = F.greatest("revenue", "previous_revenue") / F.greatest(F.least("revenue", "previous_revenue"), F.lit(1.0))
    return seen.filter("year - previous_year = 1").select("company", "year", F.round(ratio, 6).alias("ratio"), (ratio > limit).alias("implausible"))


def continuity(selected: DataFrame, manifests: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each accession that any side knows; later sides overrule, and an absent group shows as no_facts."""
    s, m, g = (df.alias(n) for df, n in ((selected, "s"), (manifests, "m"), (groups, "g")))
    both = s.join(m, "accession", "full_outer").join(g, "accession", "full_outer")
    status = F.when(F.col("g.status").isNull(), "no_facts").when(F.col("g.status") == "REJECTED", "rejected").otherwise("accepted")
    return both.select("accession", F.coalesce("g.period_end", "m.period_end", "s.period_end").alias("period_end"), F.coalesce("m.form_type", "s.form_type", F.lit("")).alias("form_type"), status.alias("status"), F.coalesce("g.issues", F.lit("")).alias("issues"))
