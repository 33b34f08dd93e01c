"""Queries with order: latest facts, nearest columns, carried context, monotone progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import money, table
from ..operators import latest, series
from .registry import query


@query("select user_id, event_type, event_id, date_trunc('day', ts) as day, value from events qualify row_number() over (partition by user_id, event_type order by date_trunc('day', ts) desc, event_id desc) = 1")
def latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days have ties; the later row counts."""
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    return latest.latest_per_key(events, ["user_id", "event_type"], "day", "event_id").select("user_id", "event_type", "event_id", "day", "value")


@query(
    'with cols as (select n_nationkey as page, i as column_id, i * 400.0::double + n_nationkey as center from nation, range(-3, 26) r(i)) select c_nationkey as page, c_custkey, c_acctbal, column_id, center from customer join cols on c_nationkey = page and c_acctbal between center - 300 and center + 300 '
    "qualify row_number() over (partition by c_custkey order by abs(c_acctbal - center), column_id) = 1"
)
def interval_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points and columns of one page each: a nation is a page."""
    columns = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), F.explode(F.expr("sequence(-3L, 25L)")).alias("column_id")).withColumn("center", F.col("column_id") * 400.0 + F.col("page"))
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), "c_custkey", "c_acctbal")
    return series.interval_nearest(points, columns.withColumns({"left": F.col("center") - 300, "right": F.col("center") + 300}), ["page"], "c_custkey", "c_acctbal", 400.0)


@query('select s_suppkey, s_nationkey, s_acctbal, coalesce((lag(s_acctbal) over w + s_acctbal) / 2, s_acctbal - 90) as "left", coalesce((lead(s_acctbal) over w + s_acctbal) / 2, s_acctbal + 90) as "right" from supplier window w as (partition by s_nationkey order by s_acctbal)')
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL leaves the order of equal balances open, and DuckDB's own answers differ from run to run there; here the supplier's key decides."""
    return series.column_bounds(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal", ties=("s_suppkey",))


@query("select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by event_id rows between 3 preceding and current row) as context from events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("user_id", "event_id", series.carry_forward(events, "user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), 3).alias("context"))


@query("select user_id, event_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as progress from events")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", series.running_max("user_id", ["ts", "event_id"], "value").alias("progress"))


@query(
    "with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(l_quantity as decimal(18,2)) as q, sum((l_returnflag = 'R')::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as block from lineitem) "
    "select l_orderkey, l_linenumber, cast(block as bigint) as block, cast(sum(q) over (partition by l_orderkey, block order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding) as double) as running from b"
)
def block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", money("l_quantity").alias("q"))
    return series.block_sums(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag") == "R", F.col("q")).select("l_orderkey", "l_linenumber", "block", F.col("running").cast("double").alias("running"))


@query(
    "with s as (select event_id, user_id, p_name as label, 2 * length(p_name) + case when starts_with(lower(p_name), left(event_type, 1)) then 60 else 0 end + case when event_type = 'view' then 35 else 0 end - case when event_type = 'error' then 80 else 0 end as score from events join part on p_partkey = event_id % 50) "
    "select user_id, event_id, label, cast(score as int) as score from s where score >= 40 qualify row_number() over (partition by user_id order by score desc, event_id) = 1"
)
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored candidate of each key; the first of equals; none under 40."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("label"))
    met = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 50).join(part, "k")
    score = F.length("label") * 2 + F.when(F.startswith(F.lower("label"), F.substring("event_type", 1, 1)), 60).otherwise(0) + F.when(F.col("event_type") == "view", 35).otherwise(0) - F.when(F.col("event_type") == "error", 80).otherwise(0)
    return latest.best_per_key(met.withColumn("score", score).filter("score >= 40"), ["user_id"], [F.col("score")], "event_id").select("user_id", "event_id", "label", "score")
