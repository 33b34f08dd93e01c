"""Groups of facts by their whole identity (accession, end, period, scope, currency): gate, acceptance, promotion, reconciliation of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import best_per_key
from .statements import STATEMENT_OF

IDENTITY = ["accession", "end_date", "period", "scope", "currency"]
NEEDED = ["revenue", "net_income", "operating_cash_flow", "assets", "liabilities"]
EQUITY = ["total_equity", "equity"]
GOOD = ["VERIFIED", "READY_WITH_WARNINGS"]
#: Concepts of a document whose sources may be reconciled by trying all choices.
MOST_CONCEPTS = 7


def normal_identity() -> dict[str, Column]:
    """A fact's identity: FY and an unknown scope stand for what is not told."""
    return {"period": F.upper(F.coalesce(F.nullif("period", F.lit("")), F.lit("FY"))), "scope": F.coalesce(F.nullif("scope", F.lit("")), F.lit("unknown")), "currency": F.coalesce("currency", F.lit(""))}


def gate(value) -> dict[str, Column]:
    """Rules over the values of one group. value: from a concept to its column."""
    assets, liabilities, equity, roe = value("assets"), value("liabilities"), F.coalesce(value("total_equity"), value("equity")), value("reported_roe")
    lacks = lambda *names: F.greatest(*[value(n).isNull() for n in names])
    ratio = F.try_divide(liabilities, F.nullif(assets, F.lit(0.0)))
    return {
        "income_statement_core_missing": lacks("revenue", "net_income"),
        "cash_flow_core_missing": value("operating_cash_flow").isNull(),
        "balance_sheet_core_missing": lacks("assets", "liabilities") | equity.isNull(),
        "core_coverage_insufficient": lacks(*NEEDED) | equity.isNull(),
        "negative_revenue": value("revenue") < 0,
        "implausible_liabilities_to_assets": (ratio < 0.01) | (ratio > 1.5),
        "implausible_total_equity": F.try_divide(F.abs(equity), F.abs(F.nullif(assets, F.lit(0.0)))) < 0.01,
        "balance_sheet_imbalance": F.when(assets != 0, F.abs(assets - liabilities - equity) / F.greatest(F.abs(assets), F.lit(1.0)) > 0.08),
        "implausible_reported_roe": ~roe.between(-5, 5),
    }


def fact_rules() -> dict[str, Column]:
    """Rules over one fact of a group, with the group's identity beside it (g_...) and its evidence (e_...)."""
    own = F.lit(False)
    for name in IDENTITY[1:]:
        own = own | (F.col(name) != F.col(f"g_{name}"))
    expected = F.when(F.col("concept").isin(*STATEMENT_OF), F.when(F.col("concept").isin("operating_cash_flow", "capital_expenditure"), "cash_flow").otherwise("balance_sheet")).when(F.col("concept").isin("revenue", "net_income", "operating_income"), "income_statement")
    by_vision = F.col("parser").startswith("vision-")
    traced = (F.coalesce("e_content_hash", F.lit("")) != "") & (F.col("e_locator") == F.concat(F.lit("page:"), F.col("page").cast("string")))
    return {
        "group_identity_inconsistent": own,
        "provenance_missing": (F.col("accession") == "") | (F.col("source_url") == "") | (F.col("raw_text") == ""),
        "statement_mismatch": F.col("statement") != expected,
        "pdf_evidence_bbox_missing": F.col("parser").startswith("financial-ingestion-ast") & F.col("e_bbox").isNull(),
        "vision_evidence_provenance_missing": by_vision & ~F.coalesce(traced, F.lit(False)),
    }


def with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """facts with the evidence that is named after them (fact:<fact_id>)."""
    own = evidence.select(F.regexp_replace("evidence_id", "^fact:", "").alias("e_fact_id"), *[F.col(c).alias(f"e_{c}") for c in ("locator", "content_hash", "bbox")])
    return facts.join(own, F.col("fact_id") == F.col("e_fact_id"), "left").drop("e_fact_id")


def validate_groups(groups: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """groups (IDENTITY) with their issues, sorted and once each, covered concepts and status; one shuffle of the facts."""
    named = groups.select(*[F.col(c).alias(f"g_{c}") for c in IDENTITY])
    traced = with_evidence(facts.withColumns(normal_identity()), evidence)
    joined = named.join(traced, F.col("g_accession") == F.col("accession"), "left")
    rules = fact_rules()
    concepts = [*NEEDED, *EQUITY, "reported_roe"]
    wide = joined.groupBy(*[f"g_{c}" for c in IDENTITY]).agg(
        *[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(f"v_{c}") for c in concepts], *[F.bool_or(F.coalesce(r, F.lit(False)) & F.col("fact_id").isNotNull()).alias(n) for n, r in rules.items()],
        F.array_join(F.array_sort(F.collect_set("concept")), "|").alias("covered"), F.count("fact_id").alias("n_facts"),
    )
    found = gate(lambda c: F.col(f"v_{c}")) | {n: F.col(n) for n in rules} | {"no_financial_facts": F.col("n_facts") == 0}
    issues = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(found.items())]))
    made = wide.withColumn("issues", F.array_join(issues, "|"))
    return made.select(*[F.col(f"g_{c}").alias(c) for c in IDENTITY], "covered", "issues", F.when(F.col("issues") == "", "VERIFIED").otherwise("REJECTED").alias("status"))


def accepted_facts(groups: DataFrame, facts: DataFrame, reporting: str) -> DataFrame:
    """Facts whose whole identity is that of a good, consolidated group in the reporting currency."""
    good = groups.filter(F.col("status").isin(*GOOD) & (F.lower(F.trim("scope")) == "consolidated") & (F.upper(F.trim("currency")) == reporting.upper()))
    return facts.withColumns(normal_identity()).join(good.select(*IDENTITY), IDENTITY, "left_semi")


def promoted_currency(groups: DataFrame, key: str) -> DataFrame:
    """For each key the one currency of its latest good consolidated annual groups: promoted, ambiguous (several) or kept (none)."""
    good = groups.filter(F.col("status").isin(*GOOD) & (F.col("scope") == "consolidated") & (F.col("period") == "FY") & (F.col("currency") != ""))
    annual = groups.filter("period = 'FY'").groupBy(key).agg(F.max("end_date").alias("latest"))
    of = good.select(key, "end_date", F.upper("currency").alias("currency"))
    found = annual.join(of, key, "left").groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("end_date") == F.col("latest"), F.col("currency")))).alias("c"))
    return found.select(key, F.when(F.size("c") == 1, F.get("c", 0)).alias("currency"), F.when(F.size("c") > 1, "ambiguous").when(F.size("c") == 1, "promoted").otherwise("kept").alias("status"))


def reconcile(local: DataFrame, vision: DataFrame, key: str) -> DataFrame:
    """For each key which concepts take the value of vision.

    Every choice of sources for at most MOST_CONCEPTS concepts is tried against the gate; the choice with
    the fewest replacements counts if there is one such choice only. Otherwise the local values stay.
    """
    both = local.select(key, "concept", F.col("value").alias("local")).join(vision.select(key, "concept", F.col("value").alias("vision")), [key, "concept"], "full_outer")
    listed = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("concept", "local", "vision"))).alias("c")).filter(F.size("c") <= MOST_CONCEPTS)
    tried = listed.withColumn("mask", F.explode(F.expr("sequence(0, shiftleft(1, size(c)) - 1)")))
    chosen = F.expr("transform(c, (x, i) -> struct(x.concept as concept, if((shiftright(mask, i) & 1) = 1, x.vision, x.local) as value))")
    tried = tried.withColumn("chosen", chosen).filter(F.forall("chosen", lambda x: x["value"].isNotNull()))
    values = F.map_from_entries("chosen")
    bad = F.lit(False)
    for rule in gate(lambda c: F.element_at(F.col("values"), c)).values():
        bad = bad | F.coalesce(rule, F.lit(False))
    passed = tried.withColumn("values", values).filter(~bad).withColumn("replaced", F.bit_count("mask"))
    least = passed.groupBy(key).agg(F.min(F.struct("replaced", "mask")).alias("best"), F.max_by(F.struct("replaced", "mask"), F.struct(-F.col("replaced"), "mask")).alias("other"), F.first("c").alias("c"))
    winner = F.when(F.col("best") == F.col("other"), F.col("best.mask")).otherwise(0)
    took = F.transform(F.filter(F.transform("c", lambda x, i: F.struct(x["concept"].alias("concept"), i.alias("i"))), lambda x: F.getbit(F.col("mask").cast("long"), x["i"]) == 1), lambda x: x["concept"])
    told = least.select(key, "c", winner.alias("mask")).select(key, F.array_join(took, "|").alias("from_vision"))
    return local.select(key).union(vision.select(key)).distinct().join(told, key, "left").select(key, F.coalesce("from_vision", F.lit("")).alias("from_vision"))


def ranked_candidates(candidates: DataFrame, key: str, position: str) -> DataFrame:
    """The fact of each key and concept: formal consolidated statements before others before summaries (ratios the other way round), equity nearest to assets less liabilities, the first of equals."""
    scope = (F.col("scope") == "consolidated").cast("int")
    summary = F.col("statement") == "summary"
    formal = F.col("statement").isin("income_statement", "balance_sheet", "cash_flow")
    rank = F.when(F.col("concept") == "reported_roe", F.when(summary, 10 + scope).otherwise(2 + scope)).when(formal, 10 + scope).when(summary, 1).otherwise(0)
    ranked = candidates.withColumn("rank", rank)
    sums = best_per_key(ranked.filter(F.col("concept").isin("assets", "liabilities")), [key, "concept"], [F.col("rank")], position)
    target = sums.groupBy(key).agg(F.max(F.when(F.col("concept") == "assets", F.col("value"))).alias("a"), F.max(F.when(F.col("concept") == "liabilities", F.col("value"))).alias("l"))
    near = F.when(F.col("concept").isin(*EQUITY), -F.abs(F.col("value") - (F.col("a") - F.col("l"))))
    joined = ranked.join(target, key, "left").withColumn("near", F.coalesce(near, F.lit(0.0)))
    return best_per_key(joined, [key, "concept"], [F.col("rank"), F.col("near")], position).drop("a", "l", "near")


def annual_by_tag(rows: DataFrame, reporting: str) -> DataFrame:
    """rows (company, concept, tag, priority, unit, unit_pos, form, fp, fy, end, filed, value) to one value for each company, concept and year.

    Annual forms only; the preferred unit of each tag (shares, reporting currency, USD, the first); per tag and
    year the latest end, then the latest filed; the first tag in order; the ten newest years.
    """
    from pyspark.sql import Window as W

    shares = F.col("concept") == "shares_outstanding"
    rank = F.when(shares & (F.col("unit") == "shares"), 0).when(F.col("unit") == reporting.upper(), 1).when(~shares & (F.col("unit") == "USD"), 2).otherwise(3)
    tag = ["company", "concept", "tag"]
    units = rows.groupBy(*tag).agg(F.min_by("unit", F.struct(rank.alias("r"), F.col("unit_pos"))).alias("preferred"))
    annual = rows.withColumn("year", F.col("fy").try_cast("int")).filter(F.col("form").isin("10-K", "20-F", "40-F") & (F.col("fp") == "FY") & F.col("year").isNotNull())
    own = annual.join(units, tag).filter("unit = preferred")
    one = own.groupBy(*tag, "priority", "year").agg(F.max_by(F.struct("value", "end", "filed"), F.struct("end", "filed")).alias("f"))
    best = one.groupBy("company", "concept", "year").agg(F.min_by(F.struct("tag", "f"), F.col("priority")).alias("b"))
    recency = F.row_number().over(W.partitionBy("company", "concept").orderBy(F.col("year").desc()))
    return best.withColumn("n", recency).filter("n <= 10").select("company", "concept", "year", "b.tag", F.col("b.f.value").alias("value"), F.col("b.f.end").alias("end_date"))


def dual_listed(filings: DataFrame, issuers: DataFrame, facts: DataFrame) -> DataFrame:
    """(document_id, status, n_facts) of filings served by the facts of a second listing: same end, period and currency; not_mapped or period_not_found where there are none. issuers is a small fixed list."""
    mapped = filings.join(F.broadcast(issuers), "ticker", "left")
    own = facts.select(F.col("issuer").alias("f_issuer"), F.col("end_date").alias("f_end"), F.upper("period").alias("f_period"), F.upper("currency").alias("f_currency"))
    counted = own.groupBy("f_issuer", "f_end", "f_period", "f_currency").agg(F.count("*").alias("n"))
    same = (F.col("issuer") == F.col("f_issuer")) & (F.col("period_end") == F.col("f_end")) & (F.upper("fiscal_period") == F.col("f_period")) & (F.col("currency") == F.col("f_currency"))
    status = F.when(F.col("issuer").isNull(), "not_mapped").when(F.col("n").isNull(), "period_not_found").otherwise("ok")
    return mapped.join(counted, same, "left").select("document_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_facts"))
