"""Queries over text, markup, titles, symbols and semi-structured values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..functions import dates, numbers, texts
from ..operators import extraction
from ..sources import markup
from .registry import query


@query(r"select doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) as text from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", texts.clean_text(F.col("text")).alias("text"))


@query(
    r"select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[\x20\x09-\x0D]+', ' ', 'g')) as text from pages".replace('\\"', '"')
)
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", texts.strip_markup(F.col("html")).alias("text"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable text of every page, with a line for each block."""
    return markup.readable_text(table(spark, sf_dir, "pages"), "html", "text").select("page_id", "text")


@query(
    r"select conv_id, turn, trim(regexp_replace(regexp_replace(t, '(?i)(fact|evidence|filing|artifact|run):[A-Za-z0-9_.:/-]+', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) as text from (select conv_id, turn, text || ' see fact:' || conv_id || '-x and Run:' || turn || '/y end' as t from conversations)"
)
def strip_internal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat("text", F.lit(" see fact:"), F.col("conv_id").cast("string"), F.lit("-x and Run:"), F.col("turn").cast("string"), F.lit("/y end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.strip_internal_ids(told).alias("text"))


@query(
    "with h as (select doc_id, topic, length(string_split_regex(lower(text), pattern)[1]) + 1 as place, text from documents cross join (values "
    + ", ".join(f"('{t}', '{w}')" for t, w in (("first", " th[a-z]+on[ ,.]"), ("second", " er[a-z]*ing[ ,.]"), ("third", " des [a-z]+[ ,.]")))
    + ") as p(topic, pattern) where regexp_matches(lower(text), pattern)) "
    "select doc_id, topic, cast(place as int) as place, substr(text, greatest(place - 200, 1), 600) as excerpt from h where length(substr(text, greatest(place - 200, 1), 600)) >= 120"
)
def topic_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each topic's pattern in each document, with the text around it."""
    topics = {"first": " th[a-z]+on[ ,.]", "second": " er[a-z]*ing[ ,.]", "third": " des [a-z]+[ ,.]"}
    return extraction.first_hits(table(spark, sf_dir, "documents"), "doc_id", "text", topics, before=200, size=600, least=120)


@query("select event_id, cast(json_extract(props, '$.k') as int) as k, event_type || '=' || value || '|k=' || cast(json_extract(props, '$.k') as int) as snapshot from events where false union all select event_id, cast(json_extract(props, '$.k') as int), 'k=' || cast(json_extract(props, '$.k') as int) || '|user=' || user_id from events")
def kv_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of key=value pairs, read back."""
    k = F.get_json_object("props", "$.k")
    made = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k="), k, F.lit("|user="), F.col("user_id").cast("string")).alias("snapshot"))
    return made.select("event_id", F.element_at(texts.key_values(F.col("snapshot")), "k").cast("int").alias("k"), "snapshot")


NUMBERS_SQL = """case o_orderkey % 5 when 0 then o_custkey || ',000' when 1 then '(' || o_custkey || '.5)' when 2 then '−' || o_custkey when 3 then o_custkey || '％' else 'n/a' end"""


@query(
    f"select o_orderkey, {NUMBERS_SQL} as shown, cast(case o_orderkey % 5 when 0 then o_custkey * 1000.0 when 1 then -(o_custkey + 0.5) when 2 then case when o_custkey = 0 then -0.0 else -o_custkey end when 3 then o_custkey / 100.0 end as double) + 0 as value from orders"
)
def parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    shown = F.when(kind == 0, F.concat(c, F.lit(",000"))).when(kind == 1, F.concat(F.lit("("), c, F.lit(".5)"))).when(kind == 2, F.concat(F.lit("−"), c)).when(kind == 3, F.concat(c, F.lit("％"))).otherwise("n/a")
    return table(spark, sf_dir, "orders").select("o_orderkey", shown.alias("shown"), (numbers.parse_number(shown) + 0).alias("value"))


HEADS = ["in RMB million", "RMB'000", "HK$ in thousands", "单位：百万元", "单位：万元", "US$ ten-thousand", "no unit"]


@query(
    "with h as (select p_partkey, [" + ", ".join("'" + h.replace("'", "''") + "'" for h in HEADS) + "][p_partkey % 7 + 1] as heading from part) select p_partkey, heading, "
    "cast([1e6, 1e3, 1e3, 1e6, 1e4, 1e4, 1][p_partkey % 7 + 1] as double) as scale, ['CNY', 'CNY', 'HKD', 'CNY', 'CNY', 'USD', ''][p_partkey % 7 + 1] as currency from h"
)
def unit_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", heading.alias("heading"), numbers.unit_scale(heading).alias("scale"), numbers.unit_currency(heading).alias("currency"))


@query("select event_id, make_timestamp(cast(floor(epoch(ts)) as bigint) * 1000000) as normal from events")
def epoch_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch numbers in seconds or milliseconds as timestamps."""
    seconds = F.floor(F.unix_timestamp("ts")).cast("long")
    number = F.when(F.col("event_id") % 2 == 0, seconds).otherwise(seconds * 1000)
    return table(spark, sf_dir, "events").select("event_id", dates.from_epoch(number).alias("normal"))


@query(
    "with s as (select c_custkey, case c_custkey % 4 when 0 then ' 6' || lpad(c_custkey::varchar, 5, '0') || '.sh' when 1 then lpad((c_custkey % 9000 + 1000)::varchar, 4, '0') when 2 then '3' || lpad(c_custkey::varchar, 5, '0') else 'brk.' || chr(65 + c_custkey::int % 26) end as symbol from customer) "
    "select c_custkey, case c_custkey % 4 when 0 then '6' || lpad(c_custkey::varchar, 5, '0') when 1 then '0' || symbol when 2 then symbol else upper(symbol) end as code, ['SSE', 'HKEX', 'SZSE', 'NASDAQ'][c_custkey % 4 + 1] as exchange, ['CN_A', 'HK', 'CN_A', 'US'][c_custkey % 4 + 1] as market from s"
)
def normalize_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    five = F.lpad(key.cast("string"), 5, "0")
    symbol = F.when(kind == 0, F.concat(F.lit(" 6"), five, F.lit(".sh"))).when(kind == 1, (key % 9000 + 1000).cast("string")).when(kind == 2, F.concat(F.lit("3"), five)).otherwise(F.concat(F.lit("brk."), F.char(65 + key % 26)))
    named = table(spark, sf_dir, "customer").select("c_custkey", texts.normalize_symbol(symbol).alias("s"))
    return named.select("c_custkey", "s.code", "s.exchange", "s.market")


@query("select doc_id, case when doc_id % 3 = 0 then 'zh-Hant' when lang = 'en' then 'en' else 'zh-CN' end as language from documents")
def lang_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("doc_id") % 3 == 0, "zh_TW").otherwise(F.upper("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.normalize_language(tag).alias("language"))


@query("select event_id, coalesce(cast(json_extract(props, '$.missing') as bigint), cast(json_extract(props, '$.k') as bigint)) as k from events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first path that is there."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.missing", "bigint"), F.try_variant_get(v, "$.k", "bigint")).alias("k"))


TITLED = ["Annual Report 2024", "Interim Report", "First Quarterly Report", "3rd quarter financial report", "Prospectus", "2024年半年度报告", "2024年年度报告", "第三季度报告", "notice"]


@query(
    "select p_partkey, ['ANNUAL_REPORT', 'INTERIM_REPORT', 'QUARTERLY_REPORT', 'QUARTERLY_REPORT', 'PROSPECTUS', 'INTERIM_REPORT', 'ANNUAL_REPORT', 'QUARTERLY_REPORT', ''][p_partkey % 9 + 1] as form, "
    "['FY', 'H1', 'Q1', 'Q3', 'IPO', 'H1', 'FY', 'Q3', ''][p_partkey % 9 + 1] as period from part"
)
def classify_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" "), F.element_at(F.array(*[F.lit(t) for t in TITLED]), (F.col("p_partkey") % 9 + 1).cast("int")))
    form, period = texts.classify_title(title)
    return table(spark, sf_dir, "part").select("p_partkey", form.alias("form"), period.alias("period"))


@query(
    "with p as (select event_id, value / 1000 as low, value / 1000 + (event_id % 5) / 10.0 as high, ['A', 'B', 'C', 'D', 'E', 'U', 'X'][event_id % 7 + 1] as grade, event_id % 25 as horizon from events) "
    "select event_id, case when grade = 'X' then 'U' else grade end as grade, concat_ws('|', case when grade = 'X' then 'grade_invalid' end, case when horizon not between 1 and 20 then 'horizon_invalid' end, case when not (0 <= low and low <= high and high <= 1) then 'probability_invalid' end) as issues from p"
)
def growth_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.col("value") / 1000, F.col("value") / 1000 + (F.col("event_id") % 5) / 10.0
    grade = F.element_at(F.array(*[F.lit(g) for g in "ABCDEUX"]), (F.col("event_id") % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(grade.alias("grade"), (F.col("event_id") % 25).alias("horizon"), low.alias("low"), high.alias("high")).alias("o"))
    return extraction.normalize_opportunity(rows, "o").select("event_id", "grade", "issues")
