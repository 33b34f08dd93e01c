"""Stages whose results are kept by content: a run that broke is taken up where it broke, in another session too.

The id of a stage's result is a hash of its name, the source text of its function, its parameters and the ids of its inputs; a table
that is read has the id of its files (path, size, time). A result is a Parquet folder under its id; Spark's own mark
of a whole write (_SUCCESS) tells that it is there. So an unchanged stage is never run twice, a changed one takes
all that stand on it with it, and what a lost session left half-written is written anew. Nothing is deleted.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MADE, REUSED, FAILED, SKIPPED = "made", "reused", "failed", "skipped"


@dataclass
class Stage:
    """make(**inputs, **params) -> DataFrame; needs: names of earlier stages or of tables."""

    name: str
    make: Callable[..., DataFrame]
    needs: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)


@dataclass
class Result:
    """How a stage ended; its id and folder where it has one, else what went wrong."""

    state: str
    id: str = ""
    folder: str = ""
    error: str = ""


def hashed(*parts: str) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


class Artifacts:
    """Results of stages below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def table_id(self, df: DataFrame) -> str:
        """The id of a table by its files. A frame that reads none has the id of its plan's text."""
        told = []
        for name in sorted(df.inputFiles()):
            files, path = self._path(name)
            status = files.getFileStatus(path)
            told.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
        return hashed("files", *told) if told else hashed("plan", df._jdf.queryExecution().analyzed().canonicalized().toString(), df.schema.json())

    def complete(self, folder: str) -> bool:
        files, path = self._path(f"{folder}/_SUCCESS")
        return files.exists(path)

    def run(self, stages: list[Stage], tables: dict[str, DataFrame]) -> dict[str, Result]:
        """Run stages in order. One that fails does not stop those that do not need it; those that do are skipped."""
        ids = {name: self.table_id(df) for name, df in tables.items()}
        frames, told = dict(tables), {}
        for stage in stages:
            if any(n not in frames for n in stage.needs):
                told[stage.name] = Result(SKIPPED, error="needs " + ", ".join(n for n in stage.needs if n not in frames))
                continue
            own = hashed(stage.name, inspect.getsource(stage.make), json.dumps(stage.params, sort_keys=True), *[ids[n] for n in stage.needs])
            folder = f"{self.root}/{stage.name}/{own}"
            state = REUSED
            try:
                if not self.complete(folder):
                    state = MADE
                    stage.make(**{n: frames[n] for n in stage.needs}, **stage.params).write.mode("overwrite").parquet(folder)
            except Exception as e:  # the stage's own failure is its result, whatever it is
                told[stage.name] = Result(FAILED, own, error=f"{type(e).__name__}: {e}"[:2000])
                continue
            ids[stage.name], frames[stage.name] = own, self.spark.read.parquet(folder)
            told[stage.name] = Result(state, own, folder)
        return told

    def read(self, result: Result) -> DataFrame:
        return self.spark.read.parquet(result.folder)
