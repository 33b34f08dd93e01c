"""Readers of disclosure files as agencies and exchanges publish them: nested JSON to flat tables.

Each reader takes a frame with one JSON document per row in the column `raw` (spark.read.text with
wholetext gives `value`; rename it). Parsing, unnesting and typing are Spark functions, so many files
are read in parallel; the company is taken from the document. Documents that are not valid JSON give no
rows, except in title_results, where the failure is a status of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNUAL_FORMS = ["10-K", "20-F", "40-F"]
RECENT = ["form", "accessionNumber", "primaryDocument", "reportDate", "filingDate"]
FACT = "struct<start:string,`end`:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: raw and path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.input_file_name().alias("path"))


def tickers(raw: DataFrame) -> DataFrame:
    """The catalogue {"0": {cik_str, ticker, title}, ...}: cik (ten digits), ticker (upper case), name."""
    parsed = F.from_json("raw", "map<string,struct<cik_str:string,ticker:string,title:string>>")
    rows = raw.select(F.explode(F.map_values(parsed)).alias("r")).filter("r.cik_str is not null")
    return rows.select(F.lpad("r.cik_str", 10, "0").alias("cik"), F.upper(F.coalesce("r.ticker", F.lit(""))).alias("ticker"), F.coalesce("r.title", F.lit("")).alias("name"))


def filings(raw: DataFrame, forms: list[str] | None = ANNUAL_FORMS, newest: int | None = None) -> DataFrame:
    """The parallel arrays filings.recent as rows, in their order: cik, position, form, accession, primary document and dates.

    An array that is missing or shorter gives nulls. forms: those to keep (None: all). newest: the first so many kept rows of each company.
    """
    arrays = ",".join(f"{n}:array<string>" for n in RECENT)
    parsed = raw.select(F.from_json("raw", f"struct<cik:string,filings:struct<recent:struct<{arrays}>>>").alias("d"))
    zipped = parsed.select(F.lpad("d.cik", 10, "0").alias("cik"), F.posexplode(F.arrays_zip(*[F.coalesce(F.col(f"d.filings.recent.{n}"), F.array().cast("array<string>")).alias(n) for n in RECENT])).alias("position", "r"))
    rows = zipped.select(
        "cik", "position", F.col("r.form").alias("form_type"), F.col("r.accessionNumber").alias("accession_number"), F.col("r.primaryDocument").alias("primary_document"),
        F.coalesce("r.reportDate", F.lit("")).alias("period_end"), F.coalesce("r.filingDate", F.lit("")).alias("filed_at"),
    )
    rows = rows.filter(F.col("form_type").isin(forms)) if forms is not None else rows
    if newest is not None:
        first = rows.groupBy("cik").agg(F.slice(F.array_sort(F.collect_list("position")), 1, newest).alias("kept"))
        rows = rows.join(first, "cik").filter(F.array_contains("kept", F.col("position"))).drop("kept")
    return rows


def company_facts(raw: DataFrame) -> DataFrame:
    """facts.<namespace>.<tag>.units.<unit>[] as a long table: one row per reported value."""
    tag = f"map<string,struct<units:map<string,array<{FACT}>>>>"
    d = raw.select(F.from_json("raw", f"struct<cik:string,entityName:string,facts:map<string,{tag}>>").alias("d"))
    by_space = d.select(F.lpad("d.cik", 10, "0").alias("cik"), F.col("d.entityName").alias("entity"), F.explode("d.facts").alias("namespace", "tags"))
    by_tag = by_space.select("cik", "entity", "namespace", F.explode("tags").alias("tag", "t"))
    by_unit = by_tag.select("cik", "entity", "namespace", "tag", F.explode("t.units").alias("unit", "values"))
    return by_unit.select("cik", "entity", "namespace", "tag", "unit", F.inline("values")).withColumnsRenamed({"start": "start_date", "end": "end_date", "val": "value", "accn": "accession_number", "filed": "filed_at"})


def stocks(raw: DataFrame) -> DataFrame:
    """An exchange's list under any of its key names: code (five digits), name, stock_id. Rows without one of them are left out."""
    names = {"code": ["code", "stockCode", "stock_code", "c"], "name": ["name", "stockName", "stock_name", "cName", "n"], "stock_id": ["stockId", "stock_id", "id", "s"]}
    item = "map<string,string>"
    listed = F.from_json("raw", f"array<{item}>")
    inside = F.from_json("raw", f"map<string,array<{item}>>")
    rows = raw.select(F.explode(F.coalesce(F.when(F.ltrim("raw").startswith("["), listed), F.flatten(F.map_values(inside)))).alias("r"))

    def first(keys: list[str]):
        return F.coalesce(*[F.nullif(F.trim(F.col("r")[k]), F.lit("")) for k in keys], F.lit(""))

    found = rows.select(F.lpad(first(names["code"]), 5, "0").alias("code"), first(names["name"]).alias("name"), first(names["stock_id"]).alias("stock_id"))
    return found.filter(F.col("code").rlike(r"^\d{5}$") & (F.col("name") != "") & (F.col("stock_id") != ""))


def title_results(raw: DataFrame) -> DataFrame:
    """raw and status ("failed", "empty" or "found") and rows (JSON objects) of a title search.

    The result is a list, an object that holds one under data, rows or result, or either as a JSON
    string. No such list, or one with other things than objects, is a failure; an empty one is an answer.
    """
    answer = F.get_json_object("raw", "$.result")
    inner = F.coalesce(*[F.get_json_object("answer_", f"$.{k}") for k in ("data", "rows", "result")])
    told = raw.withColumn("answer_", answer).withColumn("list_", F.when(F.ltrim("answer_").startswith("{"), inner).otherwise(F.col("answer_")))
    items = F.when(F.ltrim("list_").startswith("["), F.from_json("list_", "array<string>"))
    told = told.withColumn("items_", items)
    good = F.col("items_").isNotNull() & F.forall("items_", lambda x: F.coalesce(F.ltrim(x).startswith("{"), F.lit(False)))
    status = F.when(F.coalesce(good, F.lit(False)), F.when(F.size("items_") == 0, "empty").otherwise("found")).otherwise("failed")
    return told.withColumn("status", status).withColumn("rows", F.when(F.col("status") != "failed", F.col("items_"))).drop("answer_", "list_", "items_")
