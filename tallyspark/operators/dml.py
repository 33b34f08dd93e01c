"""Changes to tables as new tables (copy on write): each takes the old rows and the change and gives the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .latest import latest_per_key


def upsert(old: DataFrame, batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Insert or replace whole rows by key; of equal keys in the batch the last one counts."""
    new = latest_per_key(batch, keys, position, position)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def replace_scope(old: DataFrame, new: DataFrame, scope: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the rows of the scope, then insert. Rows outside the scope stay as they are."""
    return old.join(scope.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_versions(old: DataFrame, incoming: DataFrame, key: str, position: str) -> DataFrame:
    """Incoming rows with the next version numbers of their key. A single writer is assumed."""
    last = old.groupBy(key).agg(F.max("version").alias("last"))
    n = F.row_number().over(W.partitionBy(key).orderBy(position))
    return incoming.join(last, key, "left").withColumn("version", (F.coalesce("last", F.lit(0)) + n).cast("long")).drop("last")


def delete_cascade(parents: DataFrame, children: DataFrame, keep_child: Column, doomed: Column, active: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children after deleting the doomed, except active ones. Children to be kept lose their parent's key instead."""
    gone = parents.filter(doomed & ~active).select(F.col(key).alias("gone"))
    left = parents.join(gone, parents[key] == gone["gone"], "left_anti")
    told = children.join(gone, children[key] == gone["gone"], "left")
    kept = told.filter(F.col("gone").isNull() | keep_child).withColumn(key, F.when(F.col("gone").isNull(), F.col(key))).drop("gone")
    return left, kept


def interrupt_running(runs: DataFrame, reason: str) -> DataFrame:
    """Running rows become cancelled, with the reason once in their errors."""
    running = F.col("status") == "running"
    return runs.withColumn("errors", F.when(running, F.array_union("errors", F.array(F.lit(reason)))).otherwise(F.col("errors"))).withColumn("status", F.when(running, "cancelled").otherwise(F.col("status")))


def add_missing_columns(old: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Additive migration: columns that are missing come with their defaults, nothing is dropped."""
    return old.withColumns({n: c for n, c in defaults.items() if n not in old.columns})


def replace_evidence(evidence: DataFrame, incoming: DataFrame, documents: DataFrame, accessions: DataFrame) -> DataFrame:
    """evidence without that of the accessions' documents and of every document in incoming, and incoming."""
    replaced = documents.join(accessions.distinct(), "accession", "left_semi").select("document").union(incoming.select("document")).distinct()
    return evidence.join(replaced, "document", "left_anti").unionByName(incoming)
