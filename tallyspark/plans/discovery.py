"""Queries over answers of disclosure services, made from suppliers. Oracles know which answer each supplier was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..functions import texts
from ..sources import discovery
from .records import said
from .registry import query
from .scalars import pick

ROW = '{"adjunctUrl": "%s", "announcementTitle": "%s", "announcementTime": 1600000000000, "announcementId": "%s"}'


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company"))


def announcement_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of answers: several pages, nothing, contradictory, listing only, unsupported, failed."""
    k = F.col("company")
    row = lambda url, title, name="": said(ROW.split("%s")[0], *url, ROW.split("%s")[1], title, ROW.split("%s")[2], name, ROW.split("%s")[3])
    some = lambda *rows, total=1: said('{"totalAnnouncement": ', str(total), ', "announcements": [', *[x for i, r in enumerate(rows) for x in ([", "] if i else []) + [r]], "]}")
    kind = k % 6
    first = pick(
        kind, some(row(("/a", k, ".pdf"), "<em>2020年</em>年度报告", "n1"), row(("s", k, ".pdf"), "2020年年度报告摘要"), total=200), '{"announcements": null, "totalAnnouncement": 0}', '{"announcements": null, "totalAnnouncement": 5}',
        some(row(("s", k, ".pdf"), "2020年年度报告摘要")), some(row(("n", k, ".pdf"), "notice"), row(("x", k, ".zip"), "2020年年度报告")), "timeout",
    )
    listing = F.when(kind.isin(0, 3), some(row(("l", k, ".html"), "招股说明书", "p1"))).otherwise('{"announcements": []}')
    periodic = F.when(kind == 0, some(row(("h", k, ".pdf"), "2021年半年度报告", "h1"))).otherwise(F.lit(None).cast("string"))
    pages = [("annual", 1, first), ("annual", 2, F.when(kind == 0, some(row(("b", k, ".htm"), "2019年年度报告", "n2")))), ("annual", 3, F.when(kind == 0, '{"announcements": "no"}')), ("annual", 4, F.when(kind == 0, some(row(("c", k, ".pdf"), "2018年年度报告", "n3")))), ("periodic", 1, periodic), ("listing", 1, listing)]
    entries = F.explode(F.array(*[F.struct(F.lit(q).alias("query"), F.lit(p).alias("page"), t.alias("payload")) for q, p, t in pages])).alias("e")
    return suppliers(spark, sf_dir).select("company", entries).select("company", "e.*")


@query(
    "with f(kind, id, form_type, fiscal_period, period_end, link, tail) as (values (0, 'n1', 'ANNUAL_REPORT', 'FY', '2020-12-31', 'a', '.pdf'), (0, 'n2', 'ANNUAL_REPORT', 'FY', '2019-12-31', 'b', '.htm'), (0, 'h1', 'INTERIM_REPORT', 'H1', '2021-06-30', 'h', '.pdf'), (3, 'p1', 'PROSPECTUS', 'IPO', '2020-09-13', 'l', '.html')) "
    "select s_suppkey as company, 'cninfo:' || id as document_id, form_type, fiscal_period, period_end, 'https://static.cninfo.com.cn/' || link || s_suppkey || tail as source_url from supplier join f on s_suppkey % 6 = kind"
)
def announcement_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = discovery.announcements(announcement_payloads(spark, sf_dir))
    return found.select("company", "document_id", "form_type", "fiscal_period", "period_end", "source_url")


@query("select s_suppkey as company, ['ok', 'empty', 'unverified', 'ok', 'unsupported', 'unverified'][s_suppkey % 6 + 1] as status from supplier")
def announcement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.announcements(announcement_payloads(spark, sf_dir))[1]


def search_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five kinds: lists and lists as text, empty, failed with a page, failed with an empty page, foreign hosts."""
    k, kind = F.col("company"), F.col("company") % 5
    path = said("/listedco/listconews/sehk/2021/0401/d", k)
    one = said('[{"FILE_LINK": "', path, '.pdf", "TITLE": "Annual &amp; <b>Report</b> | Annual Report 2020", "DATE_TIME": "01/04/2021 16:30"}, {"FILE_LINK": "', path, '.doc", "TITLE": "Annual Report 2020"}]')
    two = said('"[{\\"fileLink\\": \\"https://www1.hkexnews.hk', path, '.PDF\\", \\"title\\": \\"Annual Report 2020\\"}, {\\"fileLink\\": \\"', path, 'q.pdf\\", \\"title\\": \\"First Quarterly Report\\", \\"dateTime\\": \\"2021-04-30 10:00:00\\"}]"')
    foreign = said('[{"FILE_LINK": "https://example.org', path, '.pdf", "TITLE": "Annual Report 2020"}]')
    first = said('{"result": ', pick(kind, one, "[]", '"broken"', '"broken"', foreign), "}")
    second = said('{"result": ', pick(kind, two, '{"data": []}', "7", "7", "[]"), "}")
    payloads = suppliers(spark, sf_dir).select("company", F.posexplode(F.array(first, second)).alias("position", "payload"))
    page = F.when(kind == 2, said('<a href="', path, '.pdf"><b>Interim Report</b> 2020</a><a href="', path, '.pdf">Annual Report</a><a href="/other">Annual Report 2019</a>')).otherwise("<p>No  records\nfound</p>")
    return payloads, suppliers(spark, sf_dir).select("company", page.alias("page"))


@query(
    "with f(kind, tail, form_type, fiscal_period, period_end, ending) as (values (0, '', 'ANNUAL_REPORT', 'FY', '2020-12-31', '.pdf'), (0, 'q', 'QUARTERLY_REPORT', 'Q1', '2021-03-31', '.pdf'), (2, '', 'INTERIM_REPORT', 'H1', '2020-06-30', '.pdf')) "
    "select s_suppkey as company, 'hkex:d' || s_suppkey || tail as document_id, form_type, fiscal_period, period_end, 'https://www1.hkexnews.hk/listedco/listconews/sehk/2021/0401/d' || s_suppkey || tail || ending as source_url from supplier join f on s_suppkey % 5 = kind"
)
def search_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = discovery.title_search(*search_answers(spark, sf_dir))
    return found.select("company", "document_id", "form_type", "fiscal_period", "period_end", "source_url")


@query("select s_suppkey as company, ['ok', 'empty', 'ok', 'empty', 'unsupported'][s_suppkey % 5 + 1] as status from supplier")
def search_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.title_search(*search_answers(spark, sf_dir))[1]


@query("select c_custkey, case when c_custkey % 4 in (0, 1) then 'https://www1.hkexnews.hk/listedco/listconews/sehk/' || c_custkey || '.pdf' end as url from customer")
def file_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own hosts and relative paths count; other hosts, folders and kinds do not."""
    k = F.col("c_custkey")
    link = pick(k % 4, said("\\/listedco\\/listconews/sehk/", k, ".pdf"), said("https://WWW1.hkexnews.hk/listedco/listconews/sehk/", k, ".pdf?x=1"), said("https://hkexnews.hk/listedco/listconews/sehk/", k, ".pdf"), said("/other/", k, ".pdf"))
    made = table(spark, sf_dir, "customer").select("c_custkey", discovery.file_url(link).alias("f"))
    return made.select("c_custkey", "f.url")


@query("select c_nationkey::bigint as query, lpad((c_custkey % 1000)::varchar, 6, '0') as code, min_by(c_name, c_custkey) as name, case when min(c_custkey) % 2 = 0 then 'o' || min(c_custkey) end as org_id from customer where c_custkey % 5 <> 0 group by 1, 2")
def company_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of search answers that stand at different depths."""
    k = F.col("c_custkey")
    code = F.lpad((k % 1000).cast("string"), 6, "0")
    row = F.when(k % 2 == 0, said('{"code": "', code, '", "zwjc": "', F.col("c_name"), '", "orgId": "o', k, '"}')).otherwise(said('{"x": {"secCode": "', code, '", "name": "', F.col("c_name"), '"}}'))
    row = F.when(k % 5 == 0, said('{"title": "', k, '"}')).otherwise(row)
    lists = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("query")).agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("row")))), lambda r: r["row"]).alias("rows"))
    payload = F.concat(F.lit('{"answer": {"list": ['), F.array_join("rows", ", "), F.lit("]}}"))
    return discovery.company_rows(lists.select("query", payload.alias("payload")))


@query(
    "select p_partkey::varchar as symbol, case when p_partkey % 3 = 0 then 'catalogue ' || p_partkey when p_partkey % 5 = 0 then 'known ' || p_partkey else 'built ' || p_partkey end as name, case when p_partkey % 3 = 0 then 'catalogue' when p_partkey % 5 = 0 then 'known' else 'built' end as found_in from part where p_partkey % 3 = 0 or p_partkey % 5 = 0 or p_partkey % 2 = 0"
)
def company_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(key.cast("string").alias("symbol"), "p_partkey")
    named = lambda kind, n: part.filter(key % n == 0).select("symbol", said(kind, " ", key).alias("name"))
    return discovery.resolve(part.select("symbol"), named("catalogue", 3), named("known", 5), F.when(F.col("symbol").cast("long") % 2 == 0, F.concat(F.lit("built "), "symbol")))


@query("select s_suppkey as company, s_suppkey % 6 as wanted, least(s_suppkey % 6, 3)::bigint as taken from supplier")
def early_exit(spark: SparkSession, sf_dir: str, limit: int = 3) -> DataFrame:
    """A source is read no further than its limit: at most three documents of each company, the first ones. The limit is the feature."""
    from ..operators.latest import top_k_per_key

    listed = suppliers(spark, sf_dir).withColumn("wanted", F.col("company") % 6)
    rows = listed.select("company", "wanted", F.explode(F.sequence(F.lit(0), F.col("wanted"))).alias("place")).filter("place < wanted")
    taken = top_k_per_key(rows, ["company"], [F.col("place")], limit).groupBy("company").agg(F.count("*").alias("taken"))
    return listed.join(taken, "company", "left").select("company", "wanted", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
