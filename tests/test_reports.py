"""The fallback report: each stage is read once, values have one form, rows are dealt to all cores."""

from pyspark.sql import functions as F

from tallyspark.functions import reports
from tallyspark.queries import QUERIES

STAGES = ["business", "financial", "accounting", "growth", "skeptic", "forecast"]


def reported(spark, *rows):
    df = spark.createDataFrame([(*row, "en") for row in rows], ", ".join(f"{c} string" for c in [*STAGES, "language"]))
    return df.select(reports.fallback_report(*map(F.col, [*STAGES, "language"])).alias("r")).select("r.*")


def test_all_sections_come_of_one_pass_over_rows_dealt_to_all_cores(spark):
    report = QUERIES["fallback_report"](spark, "/root/testdata/sf0.001")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert report.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_trees_are_dealt_to_all_cores(spark):
    found = QUERIES["json_trees"](spark, "/root/testdata/sf0.001")
    assert found.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_values_have_the_canonical_form_in_every_section(spark):
    long = "1" + "0" * 44 + "7"
    moats = f'{{"z": [{long}, 1e-9, 2.50], "a": "\\u001f x"}}'
    got = reported(spark, (f'{{"possible_moats": {moats}}}', None, None, f'{{"opportunities": {moats}}}', f'{{"strongest_counterarguments": {moats}}}', f'{{"scenarios": {moats}}}')).first()
    form = f'{{"a":"\\u001f x","z":[{long},1e-09,2.5]}}'
    assert got.business_model == f'{{"possible_moats":{form}}}'
    assert [got.competitive_position, got.growth_opportunities, got.counterarguments, got.scenarios] == [form] * 4


def test_odd_stages(spark):
    claims = '{"z": {"claims": [{"text": {"b": 1, "a": 2, "_c": 3}}]}, "claims": [{"text": {"_c": 0}, "conclusion": " k ", "_y": 1}, {"argument": "k"}, 5], "_p": {"claims": [{"text": "hidden"}]}}'
    nested = '{"unknowns": ' * 40 + '["run:1/a deep", "deep"]' + "}" * 40
    got = reported(spark, ("no json", "[1]", "null", '{"opportunities": null}', nested, claims), (None,) * 6).collect()
    assert got[0].business_model == "{}" and got[0].financial_quality == '{"accounting_risk":null,"financial_analysis":[1]}'
    assert got[0].growth_opportunities == "null" and got[0].unresolved_questions == '["deep"]' and got[0].counterarguments == nested.replace(": ", ":").replace(", ", ",")
    assert got[0].claims == '[{"conclusion":" k ","text":{}},{"text":{"a":2,"b":1}}]'
    assert got[1].claims == "[]" and got[1].business_model == "{}" and got[1].competitive_position == f'"{reports.STANDING["competitive_position"][1]}"'
