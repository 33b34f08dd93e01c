"""Windows over events: the same definitions run on a stream and on a table.

On a stream the watermark bounds the state: a window leaves it once no event of it can still arrive. On
a table the watermark has no effect and each window is one group of an ordinary aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(events: DataFrame, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events and sum of value for each key in tumbling (or, with slide, sliding) windows. Events later than `late` are ignored on a stream."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = events.withWatermark(ts, late).groupBy(span.alias("span"), *keys)
    found = grouped.agg(F.count("*").alias("n_events"), F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("total"))
    return found.select(*keys, F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "n_events", "total")


def sessions(events: DataFrame, keys: list[str], gap: str, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Runs of events of a key with less than `gap` between neighbours. A session ends `gap` after its last event."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("span"), *keys)
    return grouped.agg(F.count("*").alias("n_events")).select(*keys, F.col("span.start").alias("session_start"), F.col("span.end").alias("session_end"), "n_events")


def first_of_key(events: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """The first event of each key to arrive; repeats within `late` are dropped, and keys leave the state after that. Streams only."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
