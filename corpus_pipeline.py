"""A cleaning pipeline over documents: toxicity, quality rules, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of
documents; the last gives digests of the token ids of what is left. Stages decide on all rows of their
input and on nothing else.

Nulls, empty texts, repeated rows and empty tables have the results that the operators define. Rows are told
apart by their texts: those without a doc_id, or with a doc_id that others have too, are judged each by its
own text. The quality stage takes frequent lines out of the texts that it keeps, and n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontaminate, near_duplicates, quality, toxicity
from tallyspark.llm.common import checkpoint, table

#: Bytes of text identities that may be broadcast to drop documents; more are joined by a shuffle.
BROADCAST = 32_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under their language's threshold."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.flag(toxicity.score(docs, model, out="score"), model)
    return scored.filter(~F.col("flagged")).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and are not depleted by frequent lines, without these lines."""
    kept = quality.kept(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return near_duplicates.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    identity = near_duplicates.raw_hash()
    found = decontaminate.leaks(docs.select(identity.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaking = checkpoint(found.select(F.col("doc_id").alias("leaking_text_")).distinct())
    leaking = F.broadcast(leaking) if leaking.count() * 64 <= BROADCAST else leaking
    return docs.join(leaking, identity == F.col("leaking_text_"), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", tokenize),
]

#: SQL cannot express the trained stages; tests hold each operator against brute force and the whole against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written once and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
