"""Comparison of result sets, citations against evidence, and required parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claims_of(df: DataFrame, text: str) -> DataFrame:
    """Distinct trimmed texts that are not empty."""
    return df.select(F.trim(text).alias("claim")).filter("claim <> ''").distinct()


def common(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def only_left(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def section_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """For each key of either side whether the values are equal (null equals null, absence does not)."""
    both = left.select(key, F.col(value).alias("left_value"), F.lit(True).alias("l")).join(right.select(key, F.col(value).alias("right_value"), F.lit(True).alias("r")), key, "full_outer")
    kind = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").when(F.col("left_value").eqNullSafe(F.col("right_value")), "equal").otherwise("changed")
    return both.select(key, "left_value", "right_value", kind.alias("change"))


def missing_required(df: DataFrame, key: str, present: str, required: list[str]) -> DataFrame:
    """For each key the required parts that it lacks, sorted and joined."""
    have = df.groupBy(key).agg(F.collect_set(F.when(F.col(present).isin(*required), F.col(present))).alias("have"))  # at most the required ones
    lack = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("have")))
    return have.select(key, F.array_join(lack, "|").alias("missing"), F.size(lack).alias("n_missing"))


def unknown_citations(claims: DataFrame, evidence: DataFrame, cited: str, evidence_id: str) -> DataFrame:
    return claims.join(evidence.select(F.col(evidence_id).alias(cited)).distinct(), cited, "left_anti")


def known_citations(claims: DataFrame, evidence: DataFrame, cited: str, evidence_id: str) -> DataFrame:
    return claims.join(evidence.select(F.col(evidence_id).alias(cited)), cited, "left_semi")


def verify_claims(claims: DataFrame, evidence: DataFrame, key: str, cited: str, evidence_id: str, fact: str) -> DataFrame:
    """Counters for each key: claims, verified ones, facts without any citation, and issues (unknown citations)."""
    known = evidence.select(F.col(evidence_id).alias(cited), F.lit(True).alias("known")).distinct()
    told = claims.join(known, cited, "left")
    unknown = F.col(cited).isNotNull() & F.col("known").isNull()
    unsupported = F.col(fact) & F.col(cited).isNull()
    return told.groupBy(key).agg(
        F.count("*").alias("claim_count"), F.count_if(~unknown & ~unsupported).alias("verified_count"),
        F.count_if(unsupported).alias("unsupported_count"), F.count_if(unknown).alias("issue_count"),
    )
