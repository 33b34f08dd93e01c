"""A store of tables with transactions over several of them: staged Parquet folders, and one manifest that names what counts.

A table is dealt by a hash of its bucket columns to a fixed number of buckets. A transaction writes new folders
for the buckets that it touches (dynamic partition overwrite: other buckets keep their folders unread) and at its
end one manifest with the next version number, for all tables at once. The manifest is written aside and
renamed to a name that must not exist yet: of two writers from one version the second gets Conflict and may
run again on the new state (this needs a file system that renames atomically and refuses a name that exists,
as HDFS does; an object store without it allows one writer at a time). Readers follow the newest manifest, so that they see all of a transaction
or nothing, whatever was lost on the way; folders that no manifest names are invisible. Older versions stay readable.

What goes through the driver is bounded by the number of buckets: folder names, never rows.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dml

BUCKET = "bucket_"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir; a temporary one where a session on one machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='tally-')}/{name}-{uuid.uuid4().hex}"


class Conflict(RuntimeError):
    """Another transaction committed first."""


@dataclass
class Layout:
    """Bucket columns, number of buckets, schema, and the folders of each bucket."""

    by: list[str]
    buckets: int
    schema: str
    folders: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """Tables below a folder that all executors share (any file system that Spark reads)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path("manifests")
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The newest version; 0 before the first transaction."""
        names = [s.getPath().getName() for s in self.files.listStatus(self._path("manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Layout]:
        at = self.version() if version is None else version
        if not at:
            return {}
        rows = self.spark.read.text(f"{self.root}/manifests/{at:020}.json", wholetext=True).collect()  # one small file
        return {name: Layout(**told) for name, told in json.loads(rows[0][0])["tables"].items()}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)[name])

    def _rows(self, layout: Layout, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.root}/{f}" for b, own in sorted(layout.folders.items()) for f in own if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(json.loads(layout.schema))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self, self.version())

    def run(self, work: Callable[[Transaction], None], attempts: int = 5) -> int:
        """Commit what work() does to a transaction, again on the newest state if another came first. Returns the version."""
        for left in reversed(range(attempts)):
            t = self.begin()
            work(t)
            try:
                return t.commit()
            except Conflict:
                if not left:
                    raise
        raise ValueError("attempts must be positive")


class Transaction:
    """Changes from one version; nothing of them is visible before commit(). Reads within it see its own changes."""

    def __init__(self, store: Store, base: int) -> None:
        self.store, self.base, self.id = store, base, uuid.uuid4().hex
        self.tables, self.steps = store.manifest(base), 0

    def create(self, name: str, schema: StructType, by: list[str], buckets: int = 64) -> None:
        """A table that is dealt by the columns `by`; nothing happens if it exists."""
        self.tables.setdefault(name, Layout(by, buckets, schema.json()))

    def read(self, name: str) -> DataFrame:
        return self.store._rows(self.tables[name])

    def _bucket(self, layout: Layout) -> Column:
        return F.pmod(F.xxhash64(*layout.by), F.lit(layout.buckets)).cast("int")

    def _touched(self, layout: Layout, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket(layout)).distinct().collect()]  # at most the number of buckets

    def _put(self, name: str, rows: DataFrame, replaced: list[int] | None) -> None:
        """Stage rows; their folders replace those of the buckets in `replaced`, or stand beside all that is there."""
        layout = self.tables[name]
        schema = StructType.fromJson(json.loads(layout.schema))
        self.steps += 1
        folder = f"data/{name}/{self.id}-{self.steps}"
        exact = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn(BUCKET, self._bucket(layout))
        exact.write.partitionBy(BUCKET).parquet(f"{self.store.root}/{folder}")
        found = [s.getPath().getName() for s in self.store.files.listStatus(self.store._path(folder)) if s.isDirectory()]
        folders = dict(layout.folders)
        for b in replaced or []:
            folders.pop(str(b), None)
        for f in found:
            if f.startswith(f"{BUCKET}="):
                b = f.partition("=")[2]
                folders[b] = [*folders.get(b, []), f"{folder}/{f}"]
        self.tables[name] = Layout(layout.by, layout.buckets, layout.schema, folders)

    def append(self, name: str, rows: DataFrame) -> None:
        self._put(name, rows, None)

    def upsert(self, name: str, new: DataFrame, keys: list[str], order: str) -> None:
        """Insert or replace by key; of rows of a batch with one key the last by `order` counts. keys must hold the bucket columns. Reads and writes touched buckets only."""
        layout = self.tables[name]
        self._within(layout, keys)
        touched = self._touched(layout, new)
        schema = StructType.fromJson(json.loads(layout.schema))
        last = new.withColumn("n_", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))).filter("n_ = 1").select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        self._put(name, self._without(self.store._rows(layout, touched), last, keys).unionByName(last), touched)

    def replace_scope(self, name: str, new: DataFrame, scope: DataFrame) -> None:
        """Delete the rows whose key is in scope, then insert new; the columns of scope are the key and hold the bucket columns."""
        layout = self.tables[name]
        self._within(layout, scope.columns)
        touched = self._touched(layout, scope.select(*scope.columns).unionByName(new.select(*scope.columns)))
        schema = StructType.fromJson(json.loads(layout.schema))
        fresh = new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        self._put(name, self._without(self.store._rows(layout, touched), scope, scope.columns).unionByName(fresh), touched)

    def append_versions(self, name: str, new: DataFrame, key: str, order: str) -> None:
        """Append rows numbered on (column `version`) from the highest version of their key; a writer that numbered from the same state at the same time meets Conflict."""
        layout = self.tables[name]
        self._within(layout, [key])
        old = self.store._rows(layout, self._touched(layout, new)).select(key, "version")
        self._put(name, dml.append_versions(old, new, key, order), None)

    def commit(self) -> int:
        """Make all changes visible at once, as the version after the base."""
        store, version = self.store, self.base + 1
        told = json.dumps({"version": version, "id": self.id, "tables": {n: vars(t) for n, t in self.tables.items()}})
        if store.version() != self.base:
            raise Conflict(f"version {version} is there already")
        aside, at = store._path("manifests", f".{self.id}"), store._path("manifests", f"{version:020}.json")
        out = store.files.create(aside, True)
        out.write(bytearray(told.encode()))
        out.close()
        jvm = store.spark._jvm
        refusing = store.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), store.spark._jsc.hadoopConfiguration()).rename(aside, at, refusing)
        except Exception as e:
            raise Conflict(f"version {version} is there already") from e
        return version

    @staticmethod
    def _within(layout: Layout, keys: list[str]) -> None:
        if not set(layout.by) <= set(keys):
            raise ValueError(f"the key {keys} must hold the bucket columns {layout.by}")

    @staticmethod
    def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
        """rows whose key is not among those of gone; null keys are equal to each other."""
        other = gone.select(*[F.col(k).alias(f"{k}_gone_") for k in keys]).distinct()
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(other[f"{k}_gone_"])
        return rows.join(other, same, "left_anti")
