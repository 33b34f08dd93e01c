"""Evidence from text: first hits of topics, all hits without overlap, labelled values, model-style records."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

GRADES = ["A", "B", "C", "D", "E", "U"]


def first_hits(df: DataFrame, key: str, text: str, topics: dict[str, str], before: int, size: int, least: int) -> DataFrame:
    """For each row and topic the place of the pattern's first hit (in lower case) and the text around it, `least` characters or more."""
    low = F.lower(text)
    tries = F.inline(F.array(*[F.struct(F.lit(t).alias("topic"), F.regexp_instr(low, F.lit(p)).alias("place")) for t, p in topics.items()]))
    found = df.select(key, text, tries).filter("place > 0")
    excerpt = F.expr(f"substring({text}, greatest(place - {before}, 1), {size})")
    return found.select(key, "topic", "place", excerpt.alias("excerpt")).filter(F.length("excerpt") >= least)


def topic_evidence(df: DataFrame, text: str, topics: dict[str, list[str]], radius: int = 850, most: int = 2, least: int = 120) -> DataFrame:
    """df with an array of (topic, start, end, excerpt): hits in the order of patterns and places, none overlapping an earlier one of its topic, `most` for each topic."""
    kinds = [(t, [re.compile(p, re.I) for p in ps]) for t, ps in topics.items()]

    def scan(page: str | None) -> list[dict]:
        out = []
        for topic, patterns in kinds:
            taken: list[tuple[int, int]] = []
            for p in patterns:
                for m in p.finditer(page or ""):
                    start, end = max(0, m.start() - radius // 4), min(len(page), m.end() + radius)
                    excerpt = " ".join(page[start:end].split())
                    if len(taken) < most and len(excerpt) >= least and all(end <= a or start >= b for a, b in taken):
                        taken.append((start, end))
                        out.append({"topic": topic, "start": start, "end": end, "excerpt": excerpt})
        return out

    @pandas_udf("array<struct<topic:string,start:int,end:int,excerpt:string>>")
    def scanned(pages: pd.Series) -> pd.Series:
        return pages.map(scan)

    return df.withColumn("evidence", scanned(F.col(text)))


def normalize_opportunity(df: DataFrame, column: str) -> DataFrame:
    """Grade (U where it is none), and the issues of a record (grade, horizon, low, high)."""
    o = F.col(column)
    issues = F.array_compact(
        F.array(
            F.when(~o["grade"].isin(*GRADES), F.lit("grade_invalid")),
            F.when(~o["horizon"].between(1, 20), F.lit("horizon_invalid")),
            F.when(~((o["low"] >= 0) & (o["low"] <= o["high"]) & (o["high"] <= 1)), F.lit("probability_invalid")),
        )
    )
    return df.withColumns({"grade": F.when(o["grade"].isin(*GRADES), o["grade"]).otherwise("U"), "issues": F.array_join(issues, "|")})


def candidate_score(label: Column, line: Column, in_statement: Column, has_unit: Column, summary: Column) -> Column:
    """How well a line fits a label: longer labels, labels at the front, formal statements and units count; summaries and narrative do not."""
    narrative = line.rlike("约占|激励|比例为|同比|说明：")
    points = F.length(label) * 2 + F.when(F.startswith(F.lower(line), F.lower(label)), 60).otherwise(0)
    return points + F.when(in_statement, 35).otherwise(0) + F.when(has_unit, 10).otherwise(0) - F.when(summary, 90).otherwise(0) - F.when(narrative, 80).otherwise(0)


def fact_evidence(facts: DataFrame) -> DataFrame:
    """Facts as evidence records."""
    return facts.select(
        F.concat(F.lit("fact:"), "fact_id").alias("evidence_id"), F.lit("financial_fact").alias("kind"), "concept", "value", F.col("currency").alias("unit"),
        F.col("year").alias("fiscal_year"), F.col("period").alias("fiscal_period"), "end_date", "filed_at",
    )


def bounded_context(facts: DataFrame, years: int, interim: int, evidence: int) -> DataFrame:
    """For each company its newest annual years, interim periods and the number of facts that go along; sets are sliced, never the facts of a company collected."""
    place = F.when(F.col("period") == "Q3", 3).when(F.col("period") == "H1", 2).otherwise(1)
    annual = F.collect_set(F.when(F.col("period") == "FY", F.col("year")))
    partial = F.collect_set(F.when(F.col("period") != "FY", F.struct("year", place.alias("place"), F.col("period").alias("period"))))
    newest = lambda found, n: F.slice(F.sort_array(found, asc=False), 1, n)
    told = F.transform(newest(partial, interim), lambda p: F.concat_ws("-", p["year"], p["period"]))
    return facts.groupBy("company").agg(F.array_join(newest(annual, years).cast("array<string>"), "|").alias("years"), F.array_join(F.reverse(F.array_sort(told)), "|").alias("interim"), F.least(F.count("*"), F.lit(evidence)).alias("evidence"))


def topic_pages(pages: DataFrame, topics: dict[str, list[str]], before: int, after: int, least: int) -> DataFrame:
    """For each document and topic the first page that holds a label: the first label in the topic's order, and the text from `before` characters ahead of it."""
    low = F.lower("text")
    label = lambda names: F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n)), 0)
    told = F.inline(F.filter(F.array(*[F.struct(F.lit(t).alias("topic"), label(names).alias("label")) for t, names in topics.items()]), lambda m: m["label"].isNotNull()))
    found = pages.select("document_id", "page", "text", told)
    start = F.greatest(F.position(F.col("label"), F.lower("text")) - before, F.lit(1))
    excerpt = F.btrim(F.regexp_replace(F.substring("text", start, F.position(F.col("label"), F.lower("text")) - start + after), r"\s+", " "))
    told = found.withColumn("excerpt", excerpt).filter(F.length("excerpt") >= least)
    first = told.groupBy("document_id", "topic").agg(F.min_by(F.struct("page", "label", "excerpt"), "page").alias("f"))
    return first.select("document_id", "topic", "f.*")
