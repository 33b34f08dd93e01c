"""State of jobs that report their progress: the percentage of a job never goes back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DONE = 100.0


def monotone(stream: DataFrame) -> DataFrame:
    """stream: job_id, position, percent. Each report with the highest percentage of its job so far, held between 0 and 100.

    The state is one number for each running job. A job that reaches 100 leaves the state, and a later
    report of it begins a new run. A missing percentage counts as no progress.
    """

    def step(key: tuple, reports: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else 0.0
        got = pd.concat(list(reports)).sort_values("position", kind="stable")
        told = []
        for percent in got["percent"].fillna(0.0).clip(0.0, DONE).tolist():
            best = max(0.0 if best >= DONE else best, percent)
            told.append(best)
        if best >= DONE:
            if state.exists:
                state.remove()
        else:
            state.update((best,))
        yield pd.DataFrame({"job_id": got["job_id"], "position": got["position"], "progress": told})

    kind = stream.schema["job_id"].dataType.simpleString()
    return stream.groupBy("job_id").applyInPandasWithState(step, f"job_id {kind}, position bigint, progress double", "best double", "append", GroupStateTimeout.NoTimeout)
