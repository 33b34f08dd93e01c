"""Which record of a key counts: the latest, the first, the best, the top k.

Order among equals is always given by a position column, because a table has no order of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: str, position: str) -> DataFrame:
    """The row with the highest order in each key; of equals, the one that came last."""
    rest = [c for c in df.columns if c not in keys]
    # an aggregation: a key with very many rows is reduced before the exchange
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, position)).alias("_row"))
    return latest.select(*keys, "_row.*").select(*df.columns)


def best_per_key(df: DataFrame, keys: list[str], rank: list[Column], position: str) -> DataFrame:
    """The row with the highest rank in each key; of equals, the one that came first."""
    w = W.partitionBy(*keys).orderBy(*[r.desc_nulls_last() for r in rank], F.col(position).asc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """De-duplication that keeps the first row of each key, whatever the layout of the table."""
    return best_per_key(df, keys, [], position)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most k rows of each key, by the order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def latest_value(df: DataFrame, keys: list[str], value: str, order: str, position: str) -> DataFrame:
    """Like latest_per_key where one column is wanted: an aggregation without a sort of the rows."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(order, position)).alias(value))
