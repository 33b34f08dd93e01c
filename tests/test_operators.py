"""Operators on small frames with known results."""

import html
import math
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, numbers, texts
from tallyspark.operators import dml, extraction, gates, latest, metrics, selection, series, sets, valuation
from tallyspark.queries import QUERIES
from tallyspark.sources import markup


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_latest_takes_the_later_of_ties_and_best_the_earlier(spark):
    df = spark.createDataFrame([("a", "2024", 1, 10.0), ("a", "2024", 2, 20.0), ("a", "2023", 3, 30.0), ("b", None, 1, 5.0)], "k string, filed_at string, pos int, value double")
    assert rows(latest.latest_per_key(df, ["k"], "filed_at", "pos").select("k", "value"), "k") == [("a", 20.0), ("b", 5.0)]
    assert rows(latest.best_per_key(df, ["k"], [F.col("filed_at")], "pos").select("k", "value"), "k") == [("a", 10.0), ("b", 5.0)]
    assert rows(latest.latest_value(df, ["k"], "value", "filed_at", "pos"), "k") == [("a", 20.0), ("b", 5.0)]


def facts(spark, values):
    return spark.createDataFrame([(1, y, p, c, v, f"{y + 1}-02-01", i) for i, (y, p, c, v) in enumerate(values)], "company int, year int, period string, concept string, value double, filed_at string, input_pos int")


def test_annual_growth_skips_gaps_and_null_stays_null(spark):
    known = facts(spark, [(2020, "FY", "revenue", 100.0), (2022, "FY", "revenue", 150.0), (2022, "FY", "assets", 0.0), (2022, "FY", "liabilities", 5.0)])
    wide = metrics.matrix(known, ["company", "year"], ["revenue", "net_income", "operating_income", "operating_cash_flow", "capital_expenditure", "assets", "liabilities", "total_equity"])
    got = {r.year: r for r in metrics.annual_metrics(wide).collect()}
    assert got[2020].revenue_growth is None and got[2022].revenue_growth == 0.5
    assert got[2022].debt_to_assets is None and got[2020].assets is None


def test_interim_growth_needs_the_same_period_a_year_before(spark):
    known = facts(spark, [(2025, "Q1", "revenue", 100.0), (2026, "Q1", "revenue", 120.0), (2028, "Q1", "revenue", 1.0), (2027, "Q3", "assets", 1.0), (2028, "Q3", "revenue", 3.0)])
    wide = metrics.matrix(known, ["company", "year", "period"], ["revenue", "net_income", "operating_income", "operating_cash_flow", "capital_expenditure", "assets", "liabilities", "total_equity"])
    got = {(r.year, r.period): r for r in metrics.interim_comparison(wide).collect()}
    assert got[2026, "Q1"].revenue_growth == pytest.approx(0.2) and got[2026, "Q1"].comparison_period == "2025 Q1"
    assert got[2028, "Q1"].comparison_gap == "prior_period_unavailable"
    assert got[2028, "Q3"].comparison_gap == "prior_revenue_unavailable"


def test_implied_growth_finds_the_growth_of_a_value(spark):
    df = spark.createDataFrame([(100.0, 0.12), (7.0, -0.3), (1.0, 1.2)], "base double, growth double")
    value = valuation.dcf_value(F.col("base"), F.col("growth"))
    for r in df.select("growth", valuation.implied_growth(value, F.col("base")).alias("found")).collect():
        assert r.found == pytest.approx(r.growth, abs=1e-6)
    bad = spark.createDataFrame([(0.0, 5.0), (-1.0, 5.0), (1.0, 1e9)], "base double, cap double").select(valuation.implied_growth(F.col("cap"), F.col("base")).alias("g"))
    assert [r.g for r in bad.collect()] == [None, None, None]
    with pytest.raises(ValueError):
        valuation.dcf_value(F.lit(1.0), F.lit(0.1), rate=0.02)


def group(spark, **over):
    base = dict(revenue=1000.0, net_income=100.0, operating_cash_flow=150.0, assets=1000.0, liabilities=600.0, total_equity=400.0, blank_accession=False, blank_currency=False) | over
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'boolean' if k.startswith('blank') else 'double'}" for k in base))


@pytest.mark.parametrize(
    ("over", "issues"),
    [
        ({}, ""),
        ({"revenue": None}, "core_coverage_insufficient|income_statement_core_missing"),
        ({"operating_cash_flow": None}, "cash_flow_core_missing|core_coverage_insufficient"),
        ({"total_equity": None}, "balance_sheet_core_missing|core_coverage_insufficient"),
        ({"revenue": -1.0}, "negative_revenue"),
        ({"liabilities": 1.0, "total_equity": 999.0}, "implausible_liabilities_to_assets"),
        ({"liabilities": 995.0, "total_equity": 5.0}, "implausible_total_equity"),
        ({"total_equity": 200.0}, "balance_sheet_imbalance"),
        ({"blank_accession": True}, "provenance_missing"),
        ({"blank_currency": True}, "group_identity_inconsistent"),
    ],
)
def test_each_rule_fires_alone(spark, over, issues):
    got = gates.validate(group(spark, **over), gates.balance_rules() | gates.coverage_rules()).first()
    assert (got.issues, got.status) == (issues, "REJECTED" if issues else "VERIFIED")


def test_the_latest_group_is_not_replaced_by_an_older_one(spark):
    df = spark.createDataFrame([(1, 2024, "VERIFIED"), (1, 2025, "REJECTED"), (2, 2025, "VERIFIED")], "company int, year int, status string")
    assert rows(gates.latest_or_nothing(df, "company", "year")) == [(2, 2025, "VERIFIED")]
    assert rows(gates.dataset_status(df, "company"), "company") == [(1, 1, 1, "READY_WITH_WARNINGS"), (2, 1, 0, "VERIFIED")]


def filings(spark, *items):
    form = {"A": "ANNUAL_REPORT", "Q": "QUARTERLY_REPORT", "I": "INTERIM_REPORT", "P": "PROSPECTUS"}
    told = [(d, 1, form[f], p, e, int(e[:4]), e, rev, i) for i, (d, f, p, e, rev) in enumerate(items)]
    return spark.createDataFrame(told, "document_id string, company int, form_type string, fiscal_period string, period_end string, year int, filed_at string, revision string, input_pos int")


@pytest.mark.parametrize(
    ("items", "wanted"),
    [
        ([("a25", "A", "FY", "2025-12-31", "original"), ("q25", "Q", "Q3", "2025-09-30", "original"), ("h24", "I", "H1", "2024-06-30", "original")], {"a25", "h24"}),
        ([("q1-26", "Q", "Q1", "2026-03-31", "original"), ("fy-25", "A", "FY", "2025-12-31", "original"), ("q1-25", "Q", "Q1", "2025-03-31", "original"), ("q3-25", "Q", "Q3", "2025-09-30", "original")], {"q1-26", "fy-25", "q1-25"}),
        ([("q1", "Q", "Q1", "2025-03-31", "original"), ("h1", "I", "H1", "2025-06-30", "original"), ("ipo", "P", "IPO", "2025-01-15", "original")], {"q1", "h1", "ipo"}),
        ([("a", "A", "FY", "2024-12-31", "original"), ("ipo", "P", "IPO", "2024-05-01", "original")], {"a"}),
        ([("old", "A", "FY", "2024-12-31", "original"), ("new", "A", "FY", "2024-12-31", "corrected")], {"new"}),
    ],
)
def test_filing_selection(spark, items, wanted):
    assert {r.document_id for r in selection.select_filings(filings(spark, *items)).collect()} == wanted


def test_changes_to_tables(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "k int, v string, pos int")
    assert rows(dml.upsert(old.withColumn("pos", F.lit(0)), batch, ["k"], "pos").select("k", "v"), "k") == [(1, "a"), (2, "d"), (3, "e")]
    versions = spark.createDataFrame([("x", 1), ("x", 2)], "k string, version int")
    got = dml.append_versions(versions, spark.createDataFrame([("x", 9), ("y", 1), ("y", 2)], "k string, pos int"), "k", "pos")
    assert rows(got.select("k", "version"), "k", "version") == [("x", 3), ("y", 1), ("y", 2)]
    runs = spark.createDataFrame([("r1", "running", ["x"]), ("r2", "done", [])], "id string, status string, errors array<string>")
    assert rows(dml.interrupt_running(dml.interrupt_running(runs, "stop"), "stop"), "id") == [("r1", "cancelled", ["x", "stop"]), ("r2", "done", [])]
    assert dml.add_missing_columns(old, {"v": F.lit("z"), "w": F.lit(0)}).columns == ["k", "v", "w"]


def test_parse_number(spark):
    shown = ["1,234.5", "(12)", "−3", "5%", "５％", "-", "", None, "1.2.3", "abc", "(0.5)"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(shown)], "i int, s string").select("i", numbers.parse_number(F.col("s")).alias("v"))
    assert [r.v for r in df.orderBy("i").collect()] == [1234.5, -12.0, -3.0, 0.05, None, None, None, None, None, None, -0.5]


def test_units_money_and_tiers(spark):
    one = spark.range(1)
    assert one.select(numbers.unit_scale(F.lit("单位：百万元"))).first()[0] == 1e6
    assert one.select(numbers.unit_scale(F.lit("RMB ten-thousand"))).first()[0] == 1e4
    assert one.select(numbers.format_money(F.lit(1234567890.0), F.lit("USD"))).first()[0] == "$1.23B"
    assert one.select(numbers.format_money(F.lit(None).cast("double"), F.lit("USD"))).first()[0] == "—"
    assert one.select(numbers.confidence_tier(F.lit(0.55))).first()[0] == "medium"


def test_period_start_of_a_leap_day(spark):
    df = spark.createDataFrame([("2024-02-29", "FY"), ("2025-12-31", "FY"), ("2025-06-30", "H1"), ("2025-06-30", "IPO")], "e string, p string")
    got = [str(r[0]) for r in df.select(dates.period_start(F.to_date("e"), F.col("p"))).collect()]
    assert got == ["2024-01-01", "2025-01-01", "2025-01-01", "None"]


def test_symbols_titles_and_languages(spark):
    df = spark.createDataFrame([("600519.sh",), ("700",), ("0700",), ("430047",), ("AAPL",), ("%%",)], "s string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(texts.normalize_symbol(F.col("s"))).collect()]
    assert got == [("600519", "SSE", "CN_A"), None, ("00700", "HKEX", "HK"), ("430047", "BSE", "CN_A"), ("AAPL", "NASDAQ", "US"), None]
    form, period = texts.classify_title(F.lit("2024年半年度报告"))
    assert tuple(spark.range(1).select(form, period).first()) == ("INTERIM_REPORT", "H1")
    tags = spark.createDataFrame([("zh_TW",), ("EN-gb",), (None,), ("fr",)], "t string").select(texts.normalize_language(F.col("t")))
    assert [r[0] for r in tags.collect()] == ["zh-Hant", "en", "zh-CN", "zh-CN"]


def test_tables_and_text_of_pages(spark):
    page = "<p>Intro &amp; more</p><table><tr><td>x</td></tr></table><table><tr><th>a</th><th>2024</th></tr><tr><td>b<table><tr><td>in</td></tr></table></td><td>5</td></tr><tr><td></td></tr></table><script>no</script>"
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert rows(markup.table_rows(df, "id", "html"), "row_no") == [(1, 2, 0, ["a", "2024"]), (1, 2, 1, ["bin", "5"])]
    got = {r.id: r.text for r in markup.readable_text(df, "html", "text").collect()}
    assert got[2] == "" and got[1].startswith("Intro & more\n") and "no" not in got[1]


def test_topic_evidence_does_not_overlap(spark):
    text = "Item 1. Business " + "x " * 500 + "our business " + "y " * 700 + "business overview " + "z " * 100
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = {r.id: [(e.topic, e.start) for e in r.evidence] for r in extraction.topic_evidence(df, "text", {"business": texts.TOPICS["business"]}).collect()}
    assert got[2] == [] and len(got[1]) == 2


def test_interval_and_bounds(spark):
    columns = spark.createDataFrame([(1, 0.0, -10.0, 60.0), (2, 100.0, 40.0, 160.0)], "column_id int, center double, left double, right double")
    points = spark.createDataFrame([(1, 1, 45.0), (1, 2, 55.0), (1, 3, 500.0), (2, 4, 45.0), (1, 5, 45.0)], "page int, id int, x double")
    found = series.interval_nearest(points, columns.withColumn("page", F.lit(1)), ["page"], "id", "x", 50.0)
    assert rows(found.select("id", "column_id"), "id") == [(1, 1), (2, 2), (5, 1)]  # a column of another page holds nothing, equal points stay two
    bounds = series.column_bounds(columns.withColumn("p", F.lit(1)).select("p", "center"), "p", "center")
    assert rows(bounds, "center") == [(1, 0.0, -90.0, 50.0), (1, 100.0, 50.0, 190.0)]


def test_bounds_of_equal_centres_follow_the_key(spark):
    """In whatever order the rows come, so that two runs over the same rows agree."""
    rows_ = [(1, k, 10.0) for k in range(1, 5)] + [(1, 9, 30.0)]
    want = [(1, 1, 10.0, -80.0, 10.0), *[(1, k, 10.0, 10.0, 10.0) for k in (2, 3)], (1, 4, 10.0, 10.0, 20.0), (1, 9, 30.0, 20.0, 120.0)]
    for some in (rows_, rows_[::-1], rows_[2:] + rows_[:2]):
        df = spark.createDataFrame(some, "p int, k int, center double")
        assert rows(series.column_bounds(df, "p", "center", ties=("k",)), "k") == want


def test_equal_balances_of_suppliers_are_bounded_in_the_order_of_their_keys(spark, tmp_path):
    """The query itself, over tables whose rows lie in another order than their keys."""
    spark.createDataFrame([(k, 1, 5.0) for k in (3, 1, 4, 2)], "s_suppkey bigint, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert [(r.s_suppkey, r.left, r.right) for r in QUERIES["column_bounds"](spark, str(tmp_path)).orderBy("s_suppkey").collect()] == [(1, -85.0, 5.0), (2, 5.0, 5.0), (3, 5.0, 5.0), (4, 5.0, 95.0)]


def test_set_comparison(spark):
    left, right = spark.createDataFrame([(" a ",), ("b",), ("",)], "t string"), spark.createDataFrame([("b",), ("c",)], "t string")
    a, b = sets.claims_of(left, "t"), sets.claims_of(right, "t")
    assert rows(sets.common(a, b)) == [("b",)] and rows(sets.only_left(a, b)) == [("a",)] and rows(sets.only_left(b, a)) == [("c",)]
    diff = sets.section_diff(spark.createDataFrame([(1, 5), (2, None), (3, 1)], "k int, v int"), spark.createDataFrame([(1, 6), (2, None), (4, 1)], "k int, v int"), "k", "v")
    assert {r.k: r.change for r in diff.collect()} == {1: "changed", 2: "equal", 3: "left_only", 4: "right_only"}
    assert math.isclose(1.0, 1.0)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001/pages.parquet").exists(), reason="test tables are absent")
def test_readable_text_equals_a_plain_reading_of_all_pages(spark):
    """Every page against regular expressions: silent elements and comments out, a line for each block, entities decoded."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    def plain(page):
        shown = re.sub(r"(?is)<(script|style|ix:hidden)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", "", page or "")
        lined = re.sub(r"(?i)<(p|div|br|tr|li|h[1-4]|table)\b[^>]*>", "\n", shown)
        lines = [" ".join(x.split()) for x in html.unescape(re.sub(r"<[^>]*>", "", lined)).split("\n")]
        return "\n".join(x for x in lines if x)

    got = {r.page_id: (r.text, r.html) for r in markup.readable_text(pages, "html", "text").collect()}
    assert len(got) > 0 and all(text == plain(page) for text, page in got.values())
