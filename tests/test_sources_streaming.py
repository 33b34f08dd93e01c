"""Readers of disclosure files, and the streaming forms."""

import json

from pyspark.sql import functions as F

from tallyspark.sources import disclosures
from tallyspark.streaming import jobs, progress, windows


def raw(spark, *documents):
    return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in documents], "raw string")


def test_tickers_and_filings(spark):
    got = disclosures.tickers(raw(spark, {"0": {"cik_str": 320, "ticker": "abc", "title": "A B C"}, "1": {"cik_str": 7, "ticker": None, "title": None}}, "no json")).orderBy("cik").collect()
    assert [tuple(r) for r in got] == [("0000000007", "", ""), ("0000000320", "ABC", "A B C")]
    recent = {"form": ["8-K", "10-K", "10-Q", "20-F", "10-K"], "accessionNumber": list("abcde"), "primaryDocument": list("vwxyz"), "reportDate": ["1", "2", "3", "4", "5"], "filingDate": ["6", "7", "8", "9"]}
    one = raw(spark, {"cik": "12", "filings": {"recent": recent}})
    got = [(r.position, r.form_type, r.accession_number, r.filed_at) for r in disclosures.filings(one).orderBy("position").collect()]
    assert got == [(1, "10-K", "b", "7"), (3, "20-F", "d", "9"), (4, "10-K", "e", "")]
    assert [r.position for r in disclosures.filings(one, newest=2).orderBy("position").collect()] == [1, 3]
    assert disclosures.filings(one, forms=None).count() == 5


def test_company_facts_are_unnested(spark):
    value = {"start": "2023-01-01", "end": "2023-12-31", "val": 5, "accn": "x", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-02-01"}
    doc = {"cik": 9, "entityName": "N", "facts": {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": [value, value | {"fy": 2022}], "EUR": [value]}}}, "dei": {"Shares": {"units": {"shares": [value]}}}}}
    got = disclosures.company_facts(raw(spark, doc, "{}", "broken"))
    assert sorted((r.namespace, r.tag, r.unit, r.fy, r.value) for r in got.collect()) == [("dei", "Shares", "shares", 2023, 5.0), ("us-gaap", "Revenues", "EUR", 2023, 5.0), ("us-gaap", "Revenues", "USD", 2022, 5.0), ("us-gaap", "Revenues", "USD", 2023, 5.0)]
    assert {r.cik for r in got.collect()} == {"0000000009"}


def test_stocks_and_title_results(spark):
    got = disclosures.stocks(raw(spark, [{"c": "5", "n": "Five", "s": "1"}, {"code": "700", "name": "", "stockName": "Seven", "id": "2"}, {"code": "x"}], {"list": [{"stockCode": "00011", "cName": "E", "stockId": "3"}]}))
    assert sorted(tuple(r) for r in got.collect()) == [("00005", "Five", "1"), ("00011", "E", "3"), ("00700", "Seven", "2")]
    cases = [({"result": [{"a": 1}]}, "found"), ({"result": "[]"}, "empty"), ({"result": '{"rows": [{"b": 2}, {"b": 3}]}'}, "found"), ({"result": {"data": []}}, "empty"), ({"result": [1]}, "failed"), ({"other": 1}, "failed"), ("nonsense", "failed"), ({"result": {"x": 1}}, "failed")]
    got = {r.raw: (r.status, r.rows) for r in disclosures.title_results(raw(spark, *[c for c, _ in cases])).collect()}
    for case, status in cases:
        assert got[case if isinstance(case, str) else json.dumps(case)][0] == status, case
    assert [json.loads(x) for x in got[json.dumps(cases[2][0])][1]] == [{"b": 2}, {"b": 3}]


def streamed(spark, tmp_path, df, apply, name, mode="append"):
    """The rows of a stream that reads df's files, one in each batch."""
    for i, part in enumerate(df):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
    source = spark.readStream.schema(df[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}/in")
    run = apply(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    return spark.table(name).collect()


def test_progress_never_goes_back(spark, tmp_path):
    schema = "job_id long, position long, percent double"
    parts = [spark.createDataFrame([(1, 1, 10.0), (1, 2, 5.0), (2, 1, 150.0)], schema), spark.createDataFrame([(1, 3, 8.0), (1, 4, None), (1, 5, 40.0), (2, 2, 3.0)], schema)]
    got = {(r.job_id, r.position): r.progress for r in streamed(spark, tmp_path, parts, progress.monotone, "progress_rows")}
    assert got == {(1, 1): 10.0, (1, 2): 10.0, (1, 3): 10.0, (1, 4): 10.0, (1, 5): 40.0, (2, 1): 100.0, (2, 2): 3.0}


def test_stream_windows_equal_the_table(spark, tmp_path):
    df = spark.sql("select id % 3 as k, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) as ts, cast(id as double) as v from range(100)")
    want = {tuple(r) for r in windows.totals(df, ["k"], "v", "1 day").collect()}
    got = {tuple(r) for r in streamed(spark, tmp_path, [df], lambda s: windows.totals(s, ["k"], "v", "1 day"), "window_rows", "complete")}
    assert got == want and sum(r[3] for r in got) == 100
    once = streamed(spark, tmp_path, [df.limit(10), df.limit(10)], lambda s: windows.first_of_key(s, ["k", "v"], "2 days"), "first_rows")
    assert len(once) == 10


def test_silent_jobs_time_out(spark, tmp_path):
    """Timers close jobs over several batches; the state goes on from one call to the next."""
    schema = "job_id long, at timestamp, percent double, stage string"
    minute = lambda m: f"2024-01-01 00:{m:02}:00" if m < 60 else f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    rows = lambda *found: spark.createDataFrame([(j, minute(m), p, s) for j, m, p, s in found], schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at"))
    told = lambda: jobs.watched_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 600, f"{tmp_path}/out")
    rows((1, 0, 10.0, "a"), (1, 5, 5.0, "b"), (2, 0, None, None), (2, 3, 120.0, "c")).coalesce(1).write.parquet(f"{tmp_path}/in")
    first = {(r.job_id, str(r.at)[11:16], r.progress, r.stages, r.status) for r in told().collect()}
    assert first == {(1, "00:00", 10.0, 1, "running"), (1, "00:05", 10.0, 2, "running"), (2, "00:00", 0.0, 1, "running"), (2, "00:03", 100.0, 2, "done")}
    rows((3, 40, 1.0, "a"), (2, 39, 2.0, "a")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows((1, 41, 7.0, "a"), (3, 55, 3.0, "a")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    after = {(r.job_id, str(r.at)[11:16], r.progress, r.stages, r.status) for r in told().collect()} - first
    # job 1 fell silent at 00:05 and begins anew; 2 is closed by its timer, 3 by its own late report
    assert after == {(1, "00:15", 10.0, 2, "timed_out"), (2, "00:39", 2.0, 1, "running"), (3, "00:40", 1.0, 1, "running"), (1, "00:41", 7.0, 1, "running"), (2, "00:49", 2.0, 1, "timed_out"), (3, "00:50", 1.0, 1, "timed_out"), (3, "00:55", 3.0, 1, "running"), (1, "00:51", 7.0, 1, "timed_out")}


def test_a_job_takes_three_calls_to_the_state_store():
    """Each call is a round trip between Python and the JVM, and there are as many as jobs: one to read, one to write, one for the timer."""
    import pandas as pd

    class Handle:
        def __init__(self):
            self.calls, self.value = [], None

        def getValueState(self, *_):  # noqa: N802
            return self

        def __getattr__(self, name):
            def call(*args):
                self.calls.append(name)
                if name in ("update", "clear"):
                    self.value = args[0] if args else None
                return self.value if name == "get" else None

            return call

    handle, watch = Handle(), jobs.Watch(10)
    watch.init(handle)
    rows = pd.DataFrame({"us": [30, 5, 1, None], "percent": [20.0, None, 40.0, 1.0], "stage": ["b", "a", "a", "c"]})
    out = pd.concat(watch.handleInputRows(("j",), iter([rows]), None))
    assert list(out.itertuples(index=False, name=None)) == [("j", 1, 40.0, 1, "running"), ("j", 5, 40.0, 1, "running"), ("j", 15, 40.0, 1, "timed_out"), ("j", 30, 20.0, 1, "running")]
    assert handle.calls == ["get", "update", "registerTimer"] and handle.value == (20.0, 30, {"b": 1})
    out = pd.concat(watch.handleExpiredTimer(("j",), None, None))
    assert list(out.itertuples(index=False, name=None)) == [("j", 40, 20.0, 1, "timed_out")] and handle.calls[3:] == ["get", "clear"]
