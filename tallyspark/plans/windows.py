"""Windows over the event table; streams run the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..sinks.store import scratch
from ..streaming import jobs, windows
from .registry import query


@query(
    "select event_type, time_bucket(interval '1 day', ts) as window_start, time_bucket(interval '1 day', ts) + interval '1 day' as window_end, count(*) as n_events, "
    "cast(sum(cast(value as decimal(28,6))) as double) as total from events group by all"
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of each kind of event."""
    return windows.totals(table(spark, sf_dir, "events"), ["event_type"], "value", "1 day")


@query(
    "with marked as (select user_id, ts, coalesce(ts >= lag(ts) over w + interval '6 hours', true)::int as opens from events window w as (partition by user_id order by ts)), "
    "numbered as (select user_id, ts, sum(opens) over (partition by user_id order by ts) as s from marked) "
    "select user_id, min(ts) as session_start, max(ts) + interval '6 hours' as session_end, count(*) as n_events from numbered group by user_id, s"
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events less than six hours apart."""
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "6 hours")


@query(
    "with e as (select user_id as job_id, ts, (event_id * 7 % 101)::double as percent, event_type as stage from events), "
    "o as (select *, coalesce(lag(percent) over w >= 100 or ts > lag(ts) over w + interval '12 hours', true)::int as opens, lead(ts) over w as next from e window w as (partition by job_id order by ts)), "
    "n as (select *, sum(opens) over (partition by job_id order by ts) as run from o), "
    "r as (select *, max(percent) over w as progress, count(distinct stage) over w as stages from n window w as (partition by job_id, run order by ts)) "
    'select job_id, ts as "at", progress, stages::int as stages, case when percent >= 100 then \'done\' else \'running\' end as status from r '
    "union all select job_id, ts + interval '12 hours', progress, stages::int, 'timed_out' from r where percent < 100 and ts + interval '12 hours' < coalesce(next, (select max(ts) from e))"
)
def watched_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports of jobs on a stream with state: highest percentage and stages of each run, and the runs that fell silent for twelve hours."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    reports = stream.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), (F.col("event_id") * 7 % 101).cast("double").alias("percent"), F.col("event_type").alias("stage"))
    return jobs.watched_once(reports, 12 * 3600, scratch(spark, "jobs"))
