"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
#: The same set as a regular-expression class, for Java and Python alike.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the session names in spark.checkpoint.dir.

    A session on one machine that names none (a test) gets a temporary folder; a cluster must name a shared one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tally-"))
    return df.checkpoint(eager=True)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts: the folds of the query contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(parts)


def has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0
