"""Order-dependent operators with window forms: nearest in an interval, bounds, carry-forward, running maximum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_nearest(points: DataFrame, columns: DataFrame, keys: list[str], point: str, x: str, width: float) -> DataFrame:
    """For each point the column (center, left, right) of its own page (keys) that holds it and has the nearest centre; points are told apart by `point`.

    A range join as an equi-join: an interval is dealt to the cells of `width` that it touches, and a point
    looks only into its own.
    """
    cells = columns.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("left") / width), F.floor(F.col("right") / width))))
    met = points.withColumn("_cell", F.floor(F.col(x) / width)).join(cells, [*keys, "_cell"]).filter(F.col(x).between(F.col("left"), F.col("right")))
    best = met.groupBy(*keys, point).agg(F.min_by(F.struct(x, "column_id", "center"), F.struct(F.abs(F.col(x) - F.col("center")), F.col("column_id"))).alias("c"))
    return best.select(*keys, point, "c.*")


def column_bounds(centers: DataFrame, partition: str, center: str, edge: float = 90.0, ties: tuple[str, ...] = ()) -> DataFrame:
    """Boundaries half-way between neighbouring centres, `edge` beyond the outer ones; of equal centres, `ties` tell which comes first."""
    w = W.partitionBy(partition).orderBy(center, *ties)
    left = F.coalesce((F.lag(center).over(w) + F.col(center)) / 2, F.col(center) - edge)
    right = F.coalesce((F.lead(center).over(w) + F.col(center)) / 2, F.col(center) + edge)
    return centers.withColumns({"left": left, "right": right})


def carry_forward(df: DataFrame, partition: str, order: str, value: Column, reach: int) -> Column:
    """The value, or the last one of at most `reach` rows before."""
    w = W.partitionBy(partition).orderBy(order).rowsBetween(-reach, 0)
    return F.last(value, ignorenulls=True).over(w)


def running_max(partition: str, order: list[str], value: str) -> Column:
    return F.max(value).over(W.partitionBy(partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def block_sums(df: DataFrame, partition: str, order: list[str], heading: Column, value: Column) -> DataFrame:
    """Rows with the number of the heading above them, and the sum since it."""
    w = W.partitionBy(partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    blocked = df.withColumn("block", F.sum(heading.cast("long")).over(w))
    return blocked.withColumn("running", F.sum(value).over(W.partitionBy(partition, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def job_snapshot(reports: DataFrame, job: str, position: str, stage: str, percent: str) -> DataFrame:
    """(job, stage, percent, in_stage) of jobs: the last stage, the highest percentage (0 to 100), and the reports since the stage began."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(percent)))
    ends = reports.groupBy(job, stage).agg(F.max(position).alias("last"), F.max(held).alias("best"))
    jobs = ends.groupBy(job).agg(F.max_by(stage, "last").alias("now"), F.max("best").alias("percent"), F.sort_array(F.collect_list("last"), asc=False).alias("ends"))
    began = jobs.select(F.col(job).alias("_job"), "now", "percent", F.coalesce(F.get("ends", 1), F.lit(-1)).alias("before"))  # one entry for each stage
    since = reports.join(began, F.col(job) == F.col("_job")).groupBy(job, F.col("now").alias("stage"), "percent").agg(F.count_if(F.col(position) > F.col("before")).alias("in_stage"))
    return since
