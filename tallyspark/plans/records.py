"""Queries over semi-structured records: model answers, requests, trees of any depth, evidence records. Oracles work from the rows that the records are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import FACTS_SQL, facts, table
from ..functions import records, reports, trees
from .registry import query
from .scalars import pick


def events(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *columns)


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys dealt to all cores, for rows that cost far more than their exchange: a file's row groups may be fewer than the cores."""
    return events(spark, sf_dir, "user_id").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")


def said(*parts) -> F.Column:
    """Text from literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def keys() -> tuple[F.Column, F.Column]:
    return F.col("event_id"), F.col("user_id")


@query(
    "select event_id, case when event_id % 6 in (0, 1, 2) then event_id end as id, ['valid', 'valid', 'valid', 'invalid_shape', 'invalid_json', 'empty_content'][event_id % 6 + 1] as status from events"
)
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are whole, fenced, within prose, a list, broken or empty."""
    ID, _ = keys()
    body = said('{"id": ', ID, ', "ok": true}')
    text = pick(ID % 6, body, said("```json\n", body, "\n```"), said("Here it is: ", body, " as asked."), "[1, 2]", said("broken {", ID), "  \n ")
    made = events(spark, sf_dir, records.model_json(text).alias("r"))
    return made.select("event_id", F.get_json_object("r.body", "$.id").cast("long").alias("id"), "r.status")


@query(
    "select event_id, event_id % 4 as kept, case event_id % 4 when 0 then '' when 1 then 'a' when 2 then 'a|b' else 'a|b|a' end as texts, case event_id % 4 when 0 then '' when 1 then 'a' else 'a|b' end as once, "
    "event_id % 4 = 3 as overlaps, event_id % 4 <> 2 and event_id % 4 <> 3 as within from events"
)
def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed texts, in order and once each; overlap with and inclusion in other sets."""
    ID, _ = keys()
    found = records.string_list(F.try_parse_json(pick(ID % 4, '{"no": "list"}', '[" a ", "", "  "]', '["a", " b"]', '["a", "b ", " a"]')))
    made = events(spark, sf_dir, found.alias("found"))
    once = F.array_distinct("found")
    within = F.forall("found", lambda x: F.array_contains(F.array(F.lit("a"), F.lit("c")), x))
    overlaps = F.arrays_overlap("found", F.array(F.lit("a"))) & (F.size("found") > 2)
    return made.select("event_id", F.size("found").cast("long").alias("kept"), F.array_join("found", "|").alias("texts"), F.array_join(once, "|").alias("once"), overlaps.alias("overlaps"), within.alias("within"))


@query("select event_id, [2, 1, 1, 0, 0, 0][event_id % 6 + 1]::bigint as n, case event_id % 6 when 0 then 't' || event_id when 1 then 'l' || event_id when 2 then 's' || event_id end as first from events")
def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ID, _ = keys()
    told = pick(ID % 6, said('{"opportunities": [{"title": "t', ID, '"}, {"title": "u"}]}'), said('[{"title": "l', ID, '"}]'), said('{"title": "s', ID, '", "grade": "A"}'), '{"other": 1}', '"text"', '{"opportunities": []}')
    made = events(spark, sf_dir, records.opportunity_list(F.try_parse_json(told)).alias("o"))
    return made.select("event_id", F.size("o").cast("long").alias("n"), F.try_variant_get(F.get("o", 0), "$.title", "string").alias("first"))


@query("select event_id, case when event_id % 2 = 0 then 'own' when event_id % 3 = 0 then 'stage' end as source from events")
def growth_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities of the synthesis, or of the stage where it has none."""
    ID, _ = keys()
    own = F.when(ID % 2 == 0, '{"opportunities": [{"title": "own"}]}').otherwise('{"opportunities": []}')
    stage = F.when(ID % 3 == 0, '[{"title": "stage"}]').otherwise("{}")
    return events(spark, sf_dir, F.try_variant_get(F.get(records.growth_or_stage(F.try_parse_json(own), F.try_parse_json(stage)), 0), "$.title", "string").alias("source"))


@query(
    "select event_id, case event_id % 5 when 0 then 'stop' when 1 then 'length' end as finish_reason, case event_id % 5 when 0 then user_id else 0 end::int as content_length, "
    "[NULL, 'invalid_json', 'unknown_parse_error', 'unknown_parse_error', 'invalid_payload'][event_id % 5 + 1] as parse_error_class from events"
)
def response_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ID, USER = keys()
    told = pick(
        ID % 5, said('{"_response_meta": {"finish_reason": "stop", "content_length": ', USER, "}}"), '{"_response_meta": {"finish_reason": "length", "content_length": "many"}, "_response_error": "invalid_json"}',
        '{"_response_error": "secret host"}', '{"structured_output_valid": false}', "[1]",
    )
    made = events(spark, sf_dir, records.diagnostics(F.try_parse_json(told)).alias("d"))
    return made.select("event_id", "d.*")


@query(
    "with v as (select *, event_id % 40 / 10.0::double as cap, user_id % 12 / 1.0::double as rate from events) select event_id, case when cap > 0 then round(cap * 1e9, 2) end as market_cap, case when cap > 0 then round(rate / 100, 6) end as discount_rate, case when cap > 0 then case when rate / 100 <= 0.03 then 'discount rate must exceed terminal growth' else '' end end as issue from v"
)
def valuation_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    ID, USER = keys()
    told = said('{"market_cap_billions": ', (ID % 40 / 10.0), ', "discount_rate_percent": ', (USER % 12 / 1.0), "}")
    made = events(spark, sf_dir, "user_id", records.valuation_request(F.try_parse_json(told)).alias("v"))
    return made.select("event_id", F.round("v.market_cap", 2).alias("market_cap"), F.round("v.discount_rate", 6).alias("discount_rate"), "v.issue")


@query(
    "with v as (select event_id, event_id % 7 - 1 as price, event_id % 5 as kind from events) select event_id, case when price <> 0 then price / 1.0::double end as price, case when price <> 0 then case when kind = 3 then 'X1' when kind = 4 then 'EUR' else 'HKD' end end as currency, "
    "case when price <> 0 then case when price < 0 then 'negative value' when kind = 1 then 'no date' when kind = 2 then 'bad date' when kind = 3 then 'bad currency' else '' end end as issue from v"
)
def market_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ID, _ = keys()
    day = pick(ID % 5, "2024-02-29", "", "2024-02-30", "2024-01-01", "2024-01-01")
    money = pick(ID % 5, "", "", "", "x1", " eur ")
    told = said('{"price": ', ID % 7 - 1, ', "as_of": "', day, '", "currency": "', money, '"}')
    made = events(spark, sf_dir, records.market_snapshot(F.try_parse_json(told), F.lit("HKD")).alias("m"))
    return made.select("event_id", "m.price", "m.currency", "m.issue")


@query(
    "select c_custkey, case c_custkey % 3 when 0 then c_custkey::varchar else '' end as cik, case c_custkey % 3 when 0 then 'HK' else 'US' end as market, ['', 'company is incomplete', 'company is required'][c_custkey % 3 + 1] as issue from customer"
)
def company_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    told = pick(key % 3, said('{"cik": " ', key, ' ", "ticker": "T", "name": "', F.col("c_name"), '", "market": "HK"}'), '{"cik": "", "ticker": "T", "name": "n"}', "[]")
    made = table(spark, sf_dir, "customer").select("c_custkey", records.company_request(F.try_parse_json(told)).alias("c"))
    return made.select("c_custkey", "c.cik", "c.market", "c.issue")


@query(
    "select o_orderkey as run_id, c_name as company, case o_orderkey % 3 when 0 then 'HK' else 'US' end as market, case o_orderkey % 3 when 0 then 'HKD' else 'USD' end as listing_currency, case o_orderkey % 3 when 0 then case when o_orderkey % 2 = 0 then 'CNY' else 'HKD' end else 'USD' end as reporting_currency, "
    "case o_orderkey % 3 when 2 then 'en' else 'zh-CN' end as report_language from orders join customer on o_custkey = c_custkey order by o_orderdate desc, o_orderkey desc limit 200"
)
def run_summaries(spark: SparkSession, sf_dir: str, limit: int = 200) -> DataFrame:
    """The newest runs with fields of their payloads; the limit, 1 to 200, is the feature."""
    key = F.col("o_orderkey")
    company = F.when(key % 2 == 0, '{"market": "HK", "listing_currency": "HKD", "reporting_currency": "CNY"}').otherwise('{"market": "HK", "listing_currency": "HKD"}')
    payload = pick(key % 3, said('{"company": ', company, "}"), "broken", '{"report_language": "en", "company": 3}')
    runs = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), key.desc()).limit(max(1, min(200, limit)))
    named = runs.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    made = named.select(key.alias("run_id"), F.col("c_name").alias("company"), records.run_summary(F.try_parse_json(payload)).alias("s"))
    return made.select("run_id", "company", "s.market", "s.listing_currency", "s.reporting_currency", "s.report_language")


@query(
    "select event_id, case event_id % 3 when 0 then 's' || event_id when 1 then 'a' || event_id else 'No conclusion was delivered.' end as summary, case when event_id % 3 = 0 then 'c' else 'No conclusion was delivered.' end as counter, 'No conclusion was delivered.' as forecast, 'staged-fallback' as mode from events"
)
def staged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ID, _ = keys()
    told = pick(ID % 3, said('{"dossier": {"summary": "s', ID, '"}, "skeptic": {"counterargument": " c "}}'), said('{"dossier": {"summary": " ", "analysis": "a', ID, '"}}'), "{}")
    return events(spark, sf_dir, records.staged_report(F.try_parse_json(told)).alias("r")).select("event_id", "r.*")


EN = {n: t[1] for n, t in reports.STANDING.items()}
ZH = {n: t[0] for n, t in reports.STANDING.items()}


def _standing(name: str) -> str:
    return f"case when event_id % 2 = 0 then '\"{EN[name]}\"' else '\"{ZH[name]}\"' end"


@query(
    f"""select event_id, {_standing("executive_summary")} as executive_summary,
  case event_id % 3 when 0 then '{{"possible_moats":["m' || user_id || '"],"unknowns":["u' || event_id || '"]}}' when 1 then '{{"possible_moats":[],"summary":"b"}}' else '{{}}' end as business_model,
  '{{"accounting_risk":{{}},"financial_analysis":{{"margin":' || user_id || '}}}}' as financial_quality,
  case when event_id % 3 = 0 then '["m' || user_id || '"]' else {_standing("competitive_position")} end as competitive_position,
  case when event_id % 4 = 0 then '[{{"title":"g' || event_id || '"}}]' else '{{"leading_indicators":["i' || user_id || '","j","j"]}}' end as growth_opportunities,
  case when event_id % 5 = 0 then '["no run"]' else '{{}}' end as counterarguments, '{{"base":1}}' as scenarios, {_standing("thesis")} as thesis,
  case when event_id % 5 = 0 then '["no run"]' else {_standing("invalidation_conditions")} end as invalidation_conditions,
  case when event_id % 4 = 0 then {_standing("leading_indicators")} else '["i' || user_id || '","j"]' end as leading_indicators,
  case when event_id % 3 = 0 then '["u' || event_id || '","m' || user_id || '"' || case when event_id % 5 = 0 then ',"no run"' else '' end || ']' when event_id % 5 = 0 then '["no run"]' else {_standing("unresolved_questions")} end as unresolved_questions,
  '[{{"kind":"fact","text":"c' || event_id || '"}}' || case when user_id <> event_id then ',{{"text":"c' || user_id || '"}}' else '' end || ']' as claims from events"""
)
def fallback_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve sections from the stages that are there; standing texts where a stage left nothing."""
    ID, USER = keys()
    business = pick(ID % 3, said('{"unknowns": ["u', ID, '"], "possible_moats": ["m', USER, '"], "_x": 1}'), '{"summary": "b", "possible_moats": []}', "no json")
    financial = said('{"margin": ', USER, ', "claims": [{"text": "c', ID, '", "kind": "fact", "_y": 2}, {"text": " c', ID, '"}], "structured_output_valid": true}')
    growth = F.when(ID % 4 == 0, said('{"opportunities": [{"title": "g', ID, '"}]}')).otherwise(said('{"leading_indicators": ["i', USER, '", "j", "j"]}'))
    skeptic = F.when(ID % 5 == 0, F.lit('{"strongest_counterarguments": ["no run"]}'))
    forecast = said('{"scenarios": {"base": 1}, "claims": [{"text": "c', USER, '"}]}')
    made = reports.fallback_report(business, financial, F.lit(None).cast("string"), growth, skeptic, forecast, F.when(ID % 2 == 0, "en").otherwise("zh-CN"))
    return spread(spark, sf_dir).select("event_id", made.alias("r")).select("event_id", "r.*")


# Trees of any depth.

def tree_text():
    ID, USER = keys()
    return said('{"z": {"_hidden": 1, "claims": [{"text": "c', ID, '", "_x": 2, "kind": "fact"}, {"conclusion": "again"}, {"text": "again"}], "summary": "run:', ID, '/a says b"}, "a": [{"odd": [1, {"kind": "guess", "code": "', USER, '"}]}], "structured_output_valid": true}')


@query(
    """select event_id, '{"a":[{"odd":[1,{"code":"' || user_id || '","kind":"guess"}]}],"structured_output_valid":true,"z":{"_hidden":1,"claims":[{"_x":2,"kind":"fact","text":"c' || event_id || '"},{"conclusion":"again"},{"text":"again"}],"summary":"run:' || event_id || '/a says b"}}' as canonical,
  '{"a":[{"odd":[1,{"code":"' || user_id || '","kind":"guess"}]}],"z":{"summary":"run:' || event_id || '/a says b"}}' as presented,
  '{"a":[{}],"z":{"claims":[{"kind":"fact","text":"c' || event_id || '"},{"conclusion":"again"},{"text":"again"}],"summary":"says b"}}' as projected,
  'a[0].odd|a[0].odd[1].code' as unknown, '{"code":"' || user_id || '","kind":"guess"}' as rows,
  'c' || event_id || '|again' as claims, 'says b' as strings from events"""
)
def json_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree as canonical text, as readers see it, projected on known fields; its unknown paths, rows, claims and texts."""
    known = {"z", "a", "claims", "summary", "text", "conclusion", "kind", "structured_output_valid"}
    made = spread(spark, sf_dir).select("event_id", tree_text().alias("tree"))
    names = F.transform(trees.stage_claims(F.col("tree")), lambda c: F.coalesce(F.get_json_object(c, "$.text"), F.get_json_object(c, "$.conclusion")))
    shown = trees.projected(known - {"structured_output_valid"})(F.col("tree"))
    return made.select(
        "event_id", trees.canonical(F.col("tree")).alias("canonical"), trees.presentation()(F.col("tree")).alias("presented"), shown.alias("projected"), F.array_join(trees.unknown_paths(known)(F.col("tree")), "|").alias("unknown"),
        F.array_join(trees.objects_with("code", "secCode")(F.col("tree")), "|").alias("rows"), F.array_join(names, "|").alias("claims"), F.array_join(trees.strings_under("summary")(F.col("tree")), "|").alias("strings"),
    )


@query("select event_id, event_id % 3 <> 1 as equal from events")
def canonical_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two texts of JSON are equal when their canonical forms are."""
    ID, _ = keys()
    other = pick(ID % 3, '{"a": 1, "b": [1, 2]}', '{"a": 1, "b": [2, 1]}', '{ "b" : [1,2] , "a":1}')
    return events(spark, sf_dir, (trees.canonical(F.lit('{"b": [1, 2], "a": 1}')) == trees.canonical(other)).alias("equal"))


# Evidence records of facts.


@query(
    f"with {FACTS_SQL} select 'fact:' || company || '-' || year || '-' || period || '-' || concept || '-' || input_pos as evidence_id, 'financial_fact' as kind, concept, value, currency as unit, year as fiscal_year, period as fiscal_period, end_date, filed_at from facts"
)
def fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as evidence records, by their ids."""
    from ..operators.extraction import fact_evidence as evidence_of

    own = facts(spark, sf_dir).withColumn("fact_id", F.concat_ws("-", "company", "year", "period", "concept", "input_pos"))
    return evidence_of(own)


@query(
    f"with {FACTS_SQL}, r as (select *, row_number() over (partition by company order by year desc, period, concept, filed_at, input_pos) as n, dense_rank() over (partition by company order by case when period = 'FY' then year end desc nulls last) as y, "
    "dense_rank() over (partition by company order by case when period <> 'FY' then year * 10 + case period when 'Q3' then 3 when 'H1' then 2 else 1 end end desc nulls last) as q from facts) "
    "select company, string_agg(distinct case when period = 'FY' and y <= 5 then year::varchar end, '|' order by case when period = 'FY' and y <= 5 then year::varchar end desc) as years, "
    "string_agg(distinct case when period <> 'FY' and q <= 3 then year || '-' || period end, '|' order by case when period <> 'FY' and q <= 3 then year || '-' || period end desc) as interim, count(*) filter (n <= 30) as evidence from r group by company"
)
def bounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits into one prompt: five annual years, three interim periods, thirty pieces of evidence of each company."""
    from ..operators.extraction import bounded_context as context_of

    return context_of(facts(spark, sf_dir), years=5, interim=3, evidence=30)
