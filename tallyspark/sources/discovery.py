"""Filings from the answers of disclosure services, as tables of payload texts: announcement lists, title searches, result pages.

A payload table has one row for each answer; null stands for a request that failed. Every company gets a
status: ok, empty (the service says that there is nothing), unsupported (nothing of a known kind) or
unverified (no answer that can be trusted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dates, texts
from ..operators.latest import first_per_key

# Hosts and paths of documents, page sizes, and what a result page says when nothing matches.
HOSTS = ["www1.hkexnews.hk", "www.hkexnews.hk"]
FOLDER = "/listedco/listconews/"
PAGE_ROWS, MOST_PAGES = 30, 10
NOTHING = ["no matching record", "no matching result", "no records found", "沒有符合條件的紀錄", "沒有符合條件的記錄"]
LINKED = r"""(?is)<a\b[^>]*?href\s*=\s*["'][^"']*?(/listedco/listconews/(?:sehk|gem)/\d{4}/\d{4}/[A-Za-z0-9_.-]+\.pdf)[^"']*["'][^>]*>(.*?)</a>"""


def field(row: Column, *names: str) -> Column:
    """The first of some members that is there and not empty, as text."""
    return F.coalesce(*[F.nullif(F.btrim(F.try_variant_get(row, f"$.{n}", "string")), F.lit("")) for n in names])


def file_url(link: Column) -> Column:
    """(path, url) of a document on the service's own hosts; null for others."""

    def of(raw: Column) -> Column:
        host, path = F.nullif(F.lower(F.regexp_extract(raw, r"^https?://([^/:?#]+)", 1)), F.lit("")), F.regexp_extract(raw, r"^(?:https?://[^/?#]+)?([^?#]*)", 1)
        good = F.lower(path).startswith(FOLDER) & F.lower(path).endswith(".pdf") & F.coalesce(host, F.lit(HOSTS[0])).isin(*HOSTS)
        return F.when(good, F.struct(path.alias("path"), F.concat(F.lit("https://"), F.coalesce(host, F.lit(HOSTS[0])), path).alias("url")))

    return F.get(F.transform(F.array(F.btrim(F.replace(texts.strip_markup(link), F.lit("\\/"), F.lit("/")))), of), 0)


def described(title: Column, filed_at: Column) -> dict[str, Column]:
    """Form, period and period end of a titled document; the year is the title's, else that of filing."""
    form, period = texts.classify_title(title)
    year = F.coalesce(F.nullif(F.regexp_extract(title, r"(20\d{2})", 1), F.lit("")).cast("int"), F.year(filed_at))
    return {"form_type": form, "fiscal_period": period, "period_end": dates.period_end(year, period, F.date_format(filed_at, "yyyy-MM-dd"))}


def announcement_filings(rows: DataFrame) -> DataFrame:
    """rows (company, position, row: variant) as filings: documents of a known kind, no summaries; an id from the link where there is none."""
    link, title = F.regexp_replace(field(F.col("row"), "adjunctUrl"), "^/+", ""), F.regexp_replace(F.coalesce(field(F.col("row"), "announcementTitle"), F.lit("")), "<[^>]+>", "")
    filed = dates.from_epoch(F.try_variant_get("row", "$.announcementTime", "double"))
    told = rows.select("company", "position", link.alias("link"), title.alias("title"), field(F.col("row"), "announcementId").alias("given"), filed.alias("filed_at"))
    told = told.filter(F.lower("link").rlike(r"\.(pdf|html?)$") & ~texts.holds(F.lower("title"), ["摘要", "summary"]))
    own = F.coalesce("given", texts.content_id(F.col("link"), length=20))
    made = told.withColumns({"accession": own, **described(F.col("title"), F.col("filed_at"))}).filter("form_type <> ''")
    return made.select("company", "position", F.concat(F.lit("cninfo:"), "accession").alias("document_id"), "form_type", "fiscal_period", "period_end", "filed_at", F.concat(F.lit("https://static.cninfo.com.cn/"), "link").alias("source_url"))


def announcements(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filings, status) of payloads (company, query: annual, periodic or listing, page, payload).

    The annual list counts page by page, up to the first that is no list and as far as its total says;
    listing documents come in only where no annual report was found.
    """
    tree = payloads.withColumn("tree", F.try_parse_json("payload"))
    listed = F.try_variant_get("tree", "$.announcements", "array<variant>")
    total = F.try_variant_get("tree", "$.totalAnnouncement", "int")
    read = tree.select("company", "query", "page", listed.alias("rows"), total.alias("total"), F.schema_of_variant(F.try_variant_get("tree", "$.announcements", "variant")).alias("shape"), F.coalesce(F.schema_of_variant("tree"), F.lit("")).startswith("OBJECT").alias("answered"))
    w = W.partitionBy("company", "query").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    first_total = F.max(F.when(F.col("page") == 1, F.col("total"))).over(W.partitionBy("company", "query"))
    pages = F.least(F.lit(MOST_PAGES), F.ceil(first_total / PAGE_ROWS))
    more = (F.col("page") == 1) | ((F.col("query") == "annual") & (F.col("page") <= pages))
    usable = read.withColumns({"unbroken": F.min(F.col("rows").isNotNull().cast("int")).over(w) == 1, "more": F.coalesce(more, F.lit(False))}).filter("unbroken and more")
    order = F.when(F.col("query") == "annual", 0).when(F.col("query") == "periodic", 1).otherwise(2)
    rows = usable.select("company", "query", "page", F.posexplode("rows").alias("place", "row"))
    filings = announcement_filings(rows.withColumn("position", (order * 100 + F.col("page")).cast("long") * 1000 + F.col("place")))
    annual = filings.filter("form_type = 'ANNUAL_REPORT' and position < 200000").select("company").distinct()
    kept = filings.filter("position < 200000").unionByName(filings.filter("position >= 200000").join(annual, "company", "left_anti"))
    head = read.filter("query = 'annual' and page = 1")
    none = (F.col("rows").isNull() & F.coalesce(F.col("shape"), F.lit("VOID")).isin("VOID") & (F.col("total") == 0)) | ((F.size("rows") == 0) & F.coalesce(F.col("total") == 0, F.lit(True)))
    found = kept.groupBy("company").agg(F.count("*").alias("n"))
    trusted = F.col("answered") & (F.coalesce(none, F.lit(False)) | (F.coalesce(F.size("rows"), F.lit(0)) > 0))
    status = F.when(~trusted, "unverified").when(F.col("n").isNotNull(), "ok").when(F.coalesce(none, F.lit(False)), "empty").otherwise("unsupported")
    told = head.join(found, "company", "left").select("company", status.alias("status"))
    return kept.join(told.filter("status = 'ok'").select("company"), "company", "left_semi"), told


def search_rows(payload: Column) -> Column:
    """Rows of a title search: a list, a list within an object, or either as text; null for anything else (a failure), empty for nothing found."""
    some = lambda v: F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.rows", "$.result")])

    def of(tree: Column) -> Column:
        rows = F.coalesce(some(F.try_variant_get(tree, "$.result", "variant")), some(F.try_parse_json(F.try_variant_get(tree, "$.result", "string"))))
        return F.when(F.forall(rows, lambda r: F.coalesce(F.schema_of_variant(r), F.lit("")).startswith("OBJECT")), rows)

    return F.get(F.transform(F.array(F.try_parse_json(payload)), of), 0)


def search_filings(rows: DataFrame) -> DataFrame:
    """rows (company, position, row: variant) of title searches as filings, the first of each address."""
    title = texts.strip_markup(F.coalesce(field(F.col("row"), "TITLE", "title", "LONG_TEXT"), F.lit("")))
    year = F.nullif(F.regexp_extract(title, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    told = rows.select("company", "position", file_url(field(F.col("row"), "FILE_LINK", "fileLink", "FILELINK")).alias("file"), title.alias("title"), dates.printed_date(field(F.col("row"), "DATE_TIME", "dateTime"), year).alias("filed_at"))
    return documents(told.filter("file is not null").select("company", "position", "file.path", "file.url", "title", "filed_at"))


def documents(told: DataFrame) -> DataFrame:
    """(company, position, path, url, title, filed_at) as filings, the first of each address."""
    made = told.withColumns({"accession": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1), **described(F.col("title"), F.col("filed_at")), "address": F.lower("url")}).filter("form_type <> ''")
    return first_per_key(made, ["company", "address"], "position").select("company", "position", F.concat(F.lit("hkex:"), "accession").alias("document_id"), "form_type", "fiscal_period", "period_end", "filed_at", F.col("url").alias("source_url"))


def page_filings(pages: DataFrame) -> DataFrame:
    """pages (company, page: HTML) as filings: a link counts with the title of its own anchor only."""
    plain = F.replace(F.replace(F.replace("page", F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    paths, titles = F.regexp_extract_all(plain, F.lit(LINKED), 1), F.regexp_extract_all(plain, F.lit(LINKED), 2)
    found = pages.select("company", F.posexplode(F.arrays_zip(paths.alias("path"), titles.alias("title"))).alias("position", "a")).select("company", "position", "a.path", texts.strip_markup(F.col("a.title")).alias("title"))
    day = F.to_timestamp(F.regexp_extract("path", r"/(\d{4}/\d{4})/", 1), "yyyy/MMdd")
    return documents(found.select("company", F.col("position").cast("long").alias("position"), "path", F.concat(F.lit(f"https://{HOSTS[0]}"), "path").alias("url"), "title", day.alias("filed_at")))


def title_search(payloads: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filings, status) of payloads (company, position, payload) and result pages (company, page).

    The page counts only where a search failed and none gave a filing; an empty answer is final.
    """
    read = payloads.select("company", "position", search_rows(F.col("payload")).alias("rows"))
    state = read.groupBy("company").agg(F.count("rows").alias("answered"), F.count_if(F.col("rows").isNull()).alias("failed"), F.count_if(F.size("rows") == 0).alias("empty"))
    rows = read.select("company", "position", F.posexplode("rows").alias("place", "row")).withColumn("position", F.col("position").cast("long") * 1000 + F.col("place"))
    by_search = search_filings(rows)
    has = by_search.select("company").distinct().withColumn("searched", F.lit(True))
    told = state.join(has, "company", "left").withColumn("fallback", F.col("searched").isNull() & (F.col("failed") > 0))
    by_page = page_filings(pages.join(told.filter("fallback").select("company"), "company", "left_semi"))
    on_page = by_page.select("company").distinct().withColumn("paged", F.lit(True))
    says_none = pages.select("company", texts.holds(F.lower(F.regexp_replace("page", r"\s+", " ")), NOTHING).alias("says_none"))
    told = told.join(on_page, "company", "left").join(says_none, "company", "left")
    status = F.when(F.col("searched") | F.col("paged"), "ok").when((F.col("failed") == 0) & (F.col("empty") == F.col("answered")), "empty").when(F.col("failed") == 0, "unsupported").when(F.col("says_none"), "empty").otherwise("unverified")
    return by_search.unionByName(by_page), told.select("company", status.alias("status"))


def company_rows(payloads: DataFrame, key: str = "query") -> DataFrame:
    """Companies of search answers (key, payload), wherever in the tree they stand: code, name, org_id; five digits or more, each code once."""
    from ..functions import trees

    rows = payloads.select(key, F.posexplode(trees.objects_with("code", "stockCode", "secCode", "c")(F.col("payload"))).alias("position", "text")).withColumn("row", F.try_parse_json("text"))
    told = rows.select(key, "position", field(F.col("row"), "code", "stockCode", "secCode", "c").alias("code"), field(F.col("row"), "zwjc", "name", "stockName", "n").alias("name"), field(F.col("row"), "orgId", "org_id", "stockId").alias("org_id"))
    return first_per_key(told.filter("code is not null and name is not null"), [key, "code"], "position").drop("position")


def resolve(wanted: DataFrame, catalogue: DataFrame, known: DataFrame, built: Column) -> DataFrame:
    """(symbol, name, found_in) for wanted symbols: the catalogue, else the known list, else a company built from the symbol; none where it cannot be built."""
    c, k = catalogue.select("symbol", F.col("name").alias("c_name")), known.select("symbol", F.col("name").alias("k_name"))
    joined = wanted.join(c, "symbol", "left").join(k, "symbol", "left")
    name, source = F.coalesce("c_name", "k_name", built), F.when(F.col("c_name").isNotNull(), "catalogue").when(F.col("k_name").isNotNull(), "known").otherwise("built")
    return joined.select("symbol", name.alias("name"), source.alias("found_in")).filter("name is not null")
