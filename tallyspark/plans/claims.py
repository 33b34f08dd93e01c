"""Queries over claims and their citations, and comparisons of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CLAIMS_SQL, claims, table
from ..functions.numbers import confidence, confidence_tier
from ..operators import latest, sets
from .registry import query


@query(f"with {CLAIMS_SQL} select conv_id, turn, cited_id from claims where cited_id not in (select doc_id from labels)")
def unknown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.unknown_citations(claims(spark, sf_dir), table(spark, sf_dir, "labels"), "cited_id", "doc_id").select("conv_id", "turn", "cited_id")


@query(f"with {CLAIMS_SQL} select conv_id, turn, cited_id from claims where cited_id in (select doc_id from labels)")
def known_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.known_citations(claims(spark, sf_dir), table(spark, sf_dir, "labels"), "cited_id", "doc_id").select("conv_id", "turn", "cited_id")


@query(
    f"with {CLAIMS_SQL}, c as (select conv_id, role = 'assistant' as is_fact, case when turn % 3 <> 0 then cited_id end as cited_id from claims), "
    "t as (select c.*, l.doc_id is not null as known from c left join (select distinct doc_id from labels) l on l.doc_id = cited_id) "
    "select conv_id, count(*) as claim_count, count(*) filter (not (cited_id is not null and not known) and not (is_fact and cited_id is null)) as verified_count, "
    "count(*) filter (is_fact and cited_id is null) as unsupported_count, count(*) filter (cited_id is not null and not known) as issue_count from t group by conv_id"
)
def claim_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = claims(spark, sf_dir).select("conv_id", (F.col("role") == "assistant").alias("is_fact"), F.when(F.col("turn") % 3 != 0, F.col("cited_id")).alias("cited_id"))
    return sets.verify_claims(told, table(spark, sf_dir, "labels"), "conv_id", "cited_id", "doc_id", "is_fact")


SURE_SQL = "(l_discount * 12 - 0.1)"


def sureness() -> Column:
    return F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount") * 12 - 0.1)


@query(
    f"with c as (select l_orderkey, l_linenumber, case when l_linenumber % 5 <> 0 then greatest(0, least(1, {SURE_SQL})) end as v from lineitem) "
    "select l_orderkey, l_linenumber, round(v, 6) + 0 as confidence, case when v is null then 'unknown' when v >= 0.8 then 'high' when v >= 0.55 then 'medium' else 'low' end as tier from c"
)
def confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    clamped = F.when(sureness().isNotNull(), confidence(sureness()))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.round(clamped, 6) + 0).alias("confidence"), confidence_tier(clamped).alias("tier"))


@query("with c as (select case when l_linenumber % 5 <> 0 then round(l_discount, 2) + 0 end as confidence from lineitem) select confidence, count(*) as n from c group by confidence")
def confidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by confidence, the surest first, unknown last. Adding 0 makes one group of 0 and -0."""
    sure = F.when(F.col("l_linenumber") % 5 != 0, F.round("l_discount", 2) + 0)
    return table(spark, sf_dir, "lineitem").groupBy(sure.alias("confidence")).agg(F.count("*").alias("n")).orderBy(F.col("confidence").desc_nulls_last())


SIDES_SQL = "l as (select distinct event_type || '-' || (user_id % 40) as claim from events where user_id % 3 = 0 and user_id % 40 < 30), r as (select distinct event_type || '-' || (user_id % 40) as claim from events where user_id % 3 <> 0 and user_id % 40 > 9)"


def compared_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    text = F.concat(F.lit("  "), F.col("event_type"), F.lit("-"), (F.col("user_id") % 40).cast("string"), F.lit(" "))
    left = events.filter("user_id % 3 = 0 and user_id % 40 < 30")
    right = events.filter("user_id % 3 <> 0 and user_id % 40 > 9")
    return sets.claims_of(left.select(text.alias("t")), "t"), sets.claims_of(right.select(text.alias("t")), "t")


@query(f"with {SIDES_SQL} select claim from l intersect select claim from r")
def claims_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.common(*compared_sides(spark, sf_dir))


@query(f"with {SIDES_SQL} select claim from l except select claim from r")
def claims_left_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.only_left(*compared_sides(spark, sf_dir))


@query(f"with {SIDES_SQL} select claim from r except select claim from l")
def claims_right_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.only_left(*reversed(compared_sides(spark, sf_dir)))


@query(
    "with a as (select s_nationkey as section, count(*) as v from supplier group by 1), b as (select c_nationkey as section, count(*) // 10 as v from customer where c_nationkey % 4 <> 0 group by 1) "
    "select section, a.v as left_value, b.v as right_value, case when a.section is null then 'right_only' when b.section is null then 'left_only' when a.v = b.v then 'equal' else 'changed' end as change from a full join b using (section)"
)
def section_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("section")).agg(F.count("*").alias("v"))
    right = table(spark, sf_dir, "customer").filter("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("section")).agg(F.expr("count(*) div 10").alias("v"))
    return sets.section_diff(left, right, "section", "v")


@query(
    "with r as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as t), h as (select distinct user_id, event_type from events where event_id % 4 = 0), "
    "m as (select u.user_id, t, h.event_type is null as lacks from (select distinct user_id from h) u cross join r left join h on h.user_id = u.user_id and h.event_type = t) "
    "select user_id, coalesce(string_agg(t, '|' order by t) filter (lacks), '') as missing, cast(count(*) filter (lacks) as int) as n_missing from m group by user_id"
)
def missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("event_id % 4 = 0")
    return sets.missing_required(events, "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("select p_brand, p_type, p_partkey, p_name from part qualify row_number() over (partition by lower(p_brand), p_type order by p_partkey) = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("key", F.lower("p_brand"))
    return latest.first_per_key(part, ["key", "p_type"], "p_partkey").select("p_brand", "p_type", "p_partkey", "p_name")
