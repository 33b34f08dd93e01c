"""The data source of fact files: rows as the reader of whole texts gives them, files pruned by path, rows by pushed filters."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import disclosures, fact_files


def document(cik, form="10-K", entity="E"):
    value = lambda fy, fp, f: {"start": "s", "end": "e", "val": cik * fy, "accn": f"a{cik}", "fy": fy, "fp": fp, "form": f, "filed": "d"}
    return {"cik": cik, "entityName": entity, "facts": {"us-gaap": {"Revenues": {"units": {"USD": [value(2023, "FY", form), value(2022, "FY", "10-Q"), value(2023, "Q1", form)], "EUR": [value(2021, "FY", form)]}}}, "dei": {"Shares": {"units": {"shares": [value(2023, "FY", form)]}}}}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("facts")
    for cik in range(1, 9):
        (top / f"CIK{cik:010}.json").write_text(json.dumps(document(cik, "10-K" if cik % 2 else "20-F"), indent=cik % 3 or None))
    for form in ("10-K", "20-F"):
        (top / f"form={form}").mkdir()
        (top / f"form={form}" / "many.json").write_text("\n".join(json.dumps(document(cik, form)) for cik in (11, 12)) + "\nnot json\n")
    (top / "broken.json").write_text("{")
    (top / "odd.json").write_text('{"cik": 77, "facts": {"x": [1], "y": {"t": {"units": {"u": [3, {"val": "text", "fy": "2023"}]}}}}}')
    (top / ".hidden").write_text("{}")
    return f"file://{top}"


def told(df):
    return sorted((tuple(r) for r in df.drop("path").collect()), key=str)


def test_rows_are_those_of_the_text_reader(spark, folder):
    got = fact_files.company_fact_files(spark, folder)
    whole = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.explode(F.when(F.col("value").contains("not json"), F.split("value", "\n")).otherwise(F.array("value"))).alias("raw"))
    want = disclosures.company_facts(whole.filter("raw not like '%77%'")).select(*[c for c in got.columns if c != "path"])
    assert told(got.filter("cik <> '0000000077'")) == told(want) and want.count() == 12 * 5
    assert told(got.filter("cik = '0000000077'").select("cik", "unit", "value", "fy", "path")) == [("0000000077", "u", None, None)]


def partitions(df):
    return df.rdd.getNumPartitions()


def test_filters_prune_files_and_rows(spark, folder):
    read = lambda: fact_files.company_fact_files(spark, folder, bytes_per_partition="1")
    assert partitions(read()) == 12
    # a file's name, a folder's name, and neither tell the value; the two open files may hold any company
    one = read().filter("cik = '0000000003'")
    assert partitions(one) == 5 and one.count() == 5
    some = read().filter("form = '20-F' and cik in ('0000000002', '0000000011', '0000000012')")
    assert partitions(some) == 4 and {r.form for r in some.collect()} == {"20-F"} and some.count() == 4 * 3
    assert read().filter("cik = '0000000003' and cik = '0000000004'").count() == 0
    plan = read().filter("fp = 'FY' and tag = 'Revenues' and value > 0")._jdf.queryExecution().executedPlan().toString()
    # what is pushed is not filtered again; what is not stays with Spark
    assert "value" in plan and "FY" not in plan.split("Filter")[-1].split("\n")[0]
    assert read().filter("fp = 'FY' and tag = 'Revenues' and unit = 'USD' and fy = 2023 and value > 0").count() == 12


def test_no_files(spark, tmp_path):
    assert fact_files.company_fact_files(spark, str(tmp_path)).count() == 0


def test_paths_tell_values():
    assert fact_files.told_by("/a/cik=0000000001/form=10%2DK/x.json") == {"cik": "0000000001", "form": "10-K"}
    assert fact_files.told_by("/CIK0000000012.json") == {"cik": "0000000012"} and fact_files.told_by("/form=x") == {}


def test_files_of_lines_are_read_line_by_line():
    """The first document comes before the second line is asked for; what is one document over several lines, or broken, reads as before."""
    import io

    class Lines(io.StringIO):
        def __next__(self):
            asked.append(1)
            return super().__next__()

    asked = []
    found = fact_files.documents(Lines('{"a": 1}\n{"a": 2}\n\n[3]\nbroken\n{"a": 4}'))
    assert next(found) == {"a": 1} and len(asked) == 1
    assert list(found) == [{"a": 2}, {"a": 4}]
    texts = {'{\n"a":\n1}\n': [{"a": 1}], 'broken\n{"a": 1}\n': [{"a": 1}], "": [], "\n\n": [], "[1]": [], '\n{"a": "\u2028"}\n\n': [{"a": "\u2028"}], 'null\n{"a": 1}': [{"a": 1}]}
    for text, want in texts.items():
        assert list(fact_files.documents(io.StringIO(text))) == want
