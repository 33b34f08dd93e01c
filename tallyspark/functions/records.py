"""Semi-structured records as variants: model answers, diagnostics, requests, lists of texts and opportunities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of answer errors that may be told.
ERRORS = ["empty_content", "invalid_json", "invalid_shape", "provider_error"]
#: What stands for a section that no stage delivered.
NO_TEXT = "No conclusion was delivered."


def model_json(text: Column) -> Column:
    """(body, status) of a model's answer: the whole, or what is in a fence, or from the first { to the last }; status valid, empty_content, invalid_json or invalid_shape."""

    def read(t: Column) -> Column:
        whole = F.try_parse_json(t)
        begin, end = F.locate("{", t), F.length(t) - F.locate("}", F.reverse(t)) + 1
        inner = F.try_parse_json(F.when((begin > 0) & (F.locate("}", t) > 0) & (end > begin), F.substring(t, begin, end - begin + 1)))
        body = F.coalesce(whole, inner)
        shape = F.schema_of_variant(body)
        status = F.when(t == "", "empty_content").when(body.isNull(), "invalid_json").when(~shape.startswith("OBJECT"), "invalid_shape").otherwise("valid")
        return F.struct(F.when(status == "valid", F.to_json(body)).alias("body"), status.alias("status"))

    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    fenced = F.btrim(F.regexp_replace(F.regexp_replace(plain, "^```[^\n]*\n?", ""), "```$", ""), F.lit(" \t\r\n"))
    return F.get(F.transform(F.array(F.when(plain.startswith("```"), fenced).otherwise(plain)), read), 0)


def string_list(value: Column) -> Column:
    """The trimmed texts of a list, empty ones left out; none of what is no list."""
    listed = F.try_variant_get(value, "$", "array<string>")
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.btrim(x)), lambda x: x != "")


def opportunity_list(value: Column) -> Column:
    """Opportunities of {"opportunities": [...]}, of a list, or of one that stands alone."""
    some = lambda path: F.try_variant_get(value, path, "array<variant>")
    alone = F.try_variant_get(value, "$.title", "variant").isNotNull() | F.try_variant_get(value, "$.mechanism", "variant").isNotNull()
    return F.coalesce(some("$.opportunities"), some("$"), F.when(alone, F.array(value)), F.array().cast("array<variant>"))


def diagnostics(value: Column) -> Column:
    """(finish_reason, content_length, parse_error_class) of an answer's private members."""
    error, valid = F.try_variant_get(value, "$._response_error", "string"), F.try_variant_get(value, "$.structured_output_valid", "boolean")
    is_object = F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT")
    told = F.when(error.isin(*ERRORS), error).when((F.coalesce(error, F.lit("")) != "") | ~F.coalesce(valid, F.lit(True)), "unknown_parse_error")
    return F.struct(
        F.when(is_object, F.try_variant_get(value, "$._response_meta.finish_reason", "string")).alias("finish_reason"),
        F.when(is_object, F.coalesce(F.try_variant_get(value, "$._response_meta.content_length", "int"), F.lit(0))).otherwise(0).alias("content_length"),
        F.when(is_object, told).otherwise("invalid_payload").alias("parse_error_class"),
    )


def valuation_request(value: Column) -> Column:
    """(market_cap, discount_rate, terminal_growth, issue) of a request in billions and per cent; null without a positive value."""
    number = lambda name, default: F.coalesce(F.try_variant_get(value, f"$.{name}", "double"), F.lit(float(default)))
    cap, rate, growth = number("market_cap_billions", 0), number("discount_rate_percent", 10) / 100, number("terminal_growth_percent", 3) / 100
    issue = F.when(rate <= growth, "discount rate must exceed terminal growth").otherwise("")
    return F.when(cap > 0, F.struct((cap * 1e9).alias("market_cap"), rate.alias("discount_rate"), growth.alias("terminal_growth"), issue.alias("issue")))


def market_snapshot(value: Column, listing_currency: Column) -> Column:
    """(price, market_cap, currency, as_of, issue) of values that a user typed; null where none was given."""
    number = lambda name: F.coalesce(F.try_variant_get(value, f"$.{name}", "double"), F.lit(0.0))
    text = lambda name: F.coalesce(F.btrim(F.try_variant_get(value, f"$.{name}", "string")), F.lit(""))
    price, cap, day = number("price"), number("market_cap_billions"), text("as_of")
    money = F.coalesce(F.nullif(F.upper(text("currency")), F.lit("")), listing_currency)
    issue = (
        F.when((price < 0) | (cap < 0), "negative value").when(day == "", "no date").when(~day.rlike(r"^\d{4}-\d{2}-\d{2}$") | day.try_cast("date").isNull(), "bad date").when(~money.rlike("^[A-Z]{3}$"), "bad currency").otherwise("")
    )
    made = F.struct(F.nullif(price, F.lit(0.0)).alias("price"), F.nullif(cap * 1e9, F.lit(0.0)).alias("market_cap"), money.alias("currency"), day.alias("as_of"), issue.alias("issue"))
    return F.when((price != 0) | (cap != 0), made)


def company_request(value: Column) -> Column:
    """(cik, ticker, name, market, issue) of a request; the first three must be there."""
    text = lambda name: F.coalesce(F.btrim(F.try_variant_get(value, f"$.{name}", "string")), F.lit(""))
    lacks = (text("cik") == "") | (text("ticker") == "") | (text("name") == "")
    is_object = F.coalesce(F.schema_of_variant(value), F.lit("")).startswith("OBJECT")
    issue = F.when(~is_object, "company is required").when(lacks, "company is incomplete").otherwise("")
    return F.struct(text("cik").alias("cik"), text("ticker").alias("ticker"), text("name").alias("name"), F.coalesce(F.nullif(text("market"), F.lit("")), F.lit("US")).alias("market"), issue.alias("issue"))


def run_summary(payload: Column) -> Column:
    """Fields of a run's payload with their defaults; the listing currency stands in for the reporting one."""
    text = lambda path: F.try_variant_get(payload, path, "string")
    listing = F.coalesce(text("$.company.listing_currency"), F.lit("USD"))
    return F.struct(
        F.coalesce(text("$.company.market"), F.lit("US")).alias("market"), F.coalesce(text("$.company.exchange"), F.lit("")).alias("exchange"), listing.alias("listing_currency"),
        F.coalesce(text("$.company.reporting_currency"), listing).alias("reporting_currency"), F.coalesce(text("$.company.industry_support"), F.lit("standard")).alias("industry_support"), F.coalesce(text("$.report_language"), F.lit("zh-CN")).alias("report_language"),
    )


def staged_report(stages: Column, none: str = NO_TEXT) -> Column:
    """A report from what stages left behind: the first text of a stage, else a standing one."""
    text = lambda *paths: F.coalesce(*[F.nullif(F.btrim(F.try_variant_get(stages, p, "string")), F.lit("")) for p in paths], F.lit(none))
    return F.struct(text("$.dossier.summary", "$.dossier.analysis").alias("summary"), text("$.skeptic.counterargument", "$.skeptic.summary").alias("counter"), text("$.forecast.summary").alias("forecast"), F.lit("staged-fallback").alias("mode"))


def growth_or_stage(synthesis: Column, stage: Column) -> Column:
    """The opportunities of the synthesis, or those of the stage where it has none."""
    own = opportunity_list(synthesis)
    return F.when(F.size(own) > 0, own).otherwise(opportunity_list(stage))
