"""Jobs that report their progress, with a deadline: a job that falls silent is closed.

The state of a running job is one value: its highest percentage, the time of its last report and a map of the stages that
it has seen; an event-time timer stands at last report + patience. When the watermark passes it, the job is
told as timed out and leaves the state, so that state is held only for jobs that are alive. A job that reaches
100 is told as done and leaves at once; a later report begins a new run.

Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass), as transformWithState does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = 100.0


class Watch(StatefulProcessor):
    """Rows: job_id, at, percent, stage. Each report is told with the state of its job after it; a silence with a row of its own, at the deadline."""

    def __init__(self, patience_us: int) -> None:
        self.patience = patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value, as each call to the store is a round trip: one to read a job, one to write or clear it, one for its timer
        self.job = handle.getValueState("job", "best double, last bigint, stages map<string,bigint>")

    def _due(self, last: int) -> int:
        """The deadline in whole milliseconds, as timers count them."""
        return -(-(last + self.patience) // 1000)

    def _rows(self, key: tuple, told: list[tuple]) -> pd.DataFrame:
        us, best, stages, status = zip(*told, strict=True) if told else ((), (), (), ())
        return pd.DataFrame({"job_id": [key[0]] * len(told), "us": np.array(us, np.int64), "progress": np.array(best, np.float64), "stages": np.array(stages, np.int32), "status": status})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        got, told = [], []
        for part in rows:
            for us, percent, stage in zip(part["us"].tolist(), part["percent"].tolist(), part["stage"].tolist(), strict=True):
                if us is not None and us == us:
                    known = percent is not None and percent == percent
                    got.append((int(us), known, percent if known else 0.0, isinstance(stage, str), stage if isinstance(stage, str) else ""))
        got.sort()
        held = self.job.get()
        best, last, seen = (held[0], held[1], dict(held[2])) if held else (0.0, None, {})
        timer = None if last is None else self._due(last)
        for us, _, percent, _, stage in got:
            if last is not None and us > last + self.patience:
                told.append((last + self.patience, best, len(seen), "timed_out"))
                best, last, seen = 0.0, None, {}
            best = max(best, min(DONE, max(0.0, float(percent))))
            seen[stage] = seen.get(stage, 0) + 1
            last = us if last is None else max(last, us)
            told.append((us, best, len(seen), "done" if best >= DONE else "running"))
            if best >= DONE:
                best, last, seen = 0.0, None, {}
        due = None if last is None else self._due(last)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if last is not None:
            self.job.update((best, last, seen))
            if timer != due:
                self.handle.registerTimer(due)
        elif held:
            self.job.clear()
        yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.job.get()
        if held:
            self.job.clear()
            yield self._rows(key, [(held[1] + self.patience, held[0], len(held[2]), "timed_out")])

    def close(self) -> None:
        pass


def watched(stream: DataFrame, patience_s: int, lateness: str = "0 seconds") -> DataFrame:
    """stream: job_id, at (timestamp), percent, stage. Rows job_id, at, progress, stages (seen in this run), status: running, done or timed_out."""
    kind = stream.schema["job_id"].dataType.simpleString()
    timed = stream.select("job_id", F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("percent").cast("double").alias("percent"), F.col("stage").cast("string").alias("stage")).withWatermark("at", lateness)
    told = timed.groupBy("job_id").transformWithStateInPandas(Watch(patience_s * 1_000_000), f"job_id {kind}, us bigint, progress double, stages int, status string", "Append", "EventTime")
    return told.select("job_id", F.timestamp_micros("us").alias("at"), "progress", "stages", "status")


def watched_once(stream: DataFrame, patience_s: int, folder: str) -> DataFrame:
    """All that a stream has now, watched to its end and written below a folder that all executors share; the rows told so far. A second call on the folder goes on from the state of the first."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        run = watched(stream, patience_s).writeStream.format("parquet").option("path", f"{folder}/told").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{folder}/told")
