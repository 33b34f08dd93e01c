"""Queries that write the given tables through transactions and read what was committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..adapters import table
from ..sinks.artifacts import Artifacts, Stage
from ..sinks.store import Conflict, Store, Transaction, scratch
from .registry import query


@query(
    "select c_custkey as company, case when c_custkey % 2 = 0 then upper(c_name) || ' v1' else c_name end as name, c_acctbal as balance, 'X' || c_custkey as symbol, case when c_custkey % 2 = 0 then 'later' else 'first' end as source "
    "from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0"
)
def committed_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables written in one transaction, changed in a second (of two rows of a key the last counts), and left alone by a third that is not committed."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    store = Store(spark, scratch(spark, "companies"))

    def save(t: Transaction, rows: DataFrame, source: str) -> None:
        parts = {"company": rows.select("company", "name", "pos"), "issuer": rows.select("company", "balance", "pos"), "listing": rows.select("company", F.concat(F.lit("X"), "company").alias("symbol"), F.lit(source).alias("source"), "pos")}
        for name, part in parts.items():
            t.create(name, part.schema, ["company"], 8)
            t.upsert(name, part, ["company"], "pos")

    store.run(lambda t: save(t, customer.filter("company % 3 <> 0").withColumn("pos", F.lit(0)), "first"))
    twice = customer.filter("company % 2 = 0").withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("name", F.concat(F.upper("name"), F.lit(" v"), F.col("pos").cast("string")))
    store.run(lambda t: save(t, twice, "later"))
    save(store.begin(), customer.withColumns({"name": F.lit("lost"), "pos": F.lit(9)}), "lost")
    return store.read("company").drop("pos").join(store.read("issuer").drop("pos"), "company").join(store.read("listing").drop("pos"), "company").select("company", "name", "balance", "symbol", "source")


@query(
    "select o_custkey as company, o_orderkey as accession, case when o_custkey % 5 = 0 and o_orderkey % 2 = 0 then 0 else o_totalprice end as value from orders where not (o_custkey % 5 = 0 and o_orderkey % 2 = 0 and o_orderkey % 3 = 0)"
)
def replaced_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a scope of filings replaced in the committed table: those of the scope go, even where nothing takes their place."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderkey").alias("accession"), F.col("o_totalprice").alias("value"))
    store = Store(spark, scratch(spark, "values"))

    def first(t: Transaction) -> None:
        t.create("facts", orders.schema, ["company"], 16)
        t.append("facts", orders)

    store.run(first)
    doomed = orders.filter("company % 5 = 0 and accession % 2 = 0")
    store.run(lambda t: t.replace_scope("facts", doomed.filter("accession % 3 <> 0").withColumn("value", F.lit(0.0)), doomed.select("company", "accession")))
    return store.read("facts")


@query(
    "select user_id, event_id, row_number() over (partition by user_id order by part, event_id) as version from (select *, case when event_id % 3 = 0 then 0 else 1 end as part from events where event_id % 3 <> 2)"
)
def committed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version numbers by two writers that began on one state: the second meets a conflict and numbers anew."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    store = Store(spark, scratch(spark, "versions"))

    def add(rest: int):
        def work(t: Transaction) -> None:
            t.create("theses", events.withColumn("version", F.lit(0).cast("long")).schema, ["user_id"], 8)
            t.append_versions("theses", events.filter(F.col("event_id") % 3 == rest), "user_id", "event_id")

        return work

    late = store.begin()
    add(1)(late)  # numbered from nothing
    store.run(add(0))
    try:
        late.commit()
    except Conflict:
        store.run(add(1))
    return store.read("theses")


def _priced(orders: DataFrame, customer: DataFrame) -> DataFrame:
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _summed(priced: DataFrame, broken: bool) -> DataFrame:
    if broken:
        priced = priced.withColumn("price", F.when(F.col("o_orderkey") > 0, F.raise_error(F.lit("lost")).cast("decimal(18,2)")))
    return priced.groupBy("c_nationkey").agg(F.sum("price").cast("double").alias("total"))


def _ranked(summed: DataFrame) -> DataFrame:
    return summed.withColumn("rank", F.rank().over(Window.orderBy(F.col("total").desc())))  # one row for each of 25 nations


@query(
    "with s as (select c_nationkey, sum(cast(o_totalprice as decimal(18,2)))::double as total from orders join customer on o_custkey = c_custkey group by 1) "
    "select c_nationkey, total, rank() over (order by total desc)::int as rank, 'made,failed,skipped' as first_run, 'reused,made,made' as second_run, 'reused,reused,reused' as third_run from s"
)
def resumed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stages of which the second breaks; taken up again, the first is not run twice, and a third run runs nothing."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    kept = Artifacts(spark, scratch(spark, "stages"))
    plan = lambda broken: [Stage("priced", _priced, ["orders", "customer"]), Stage("summed", _summed, ["priced"], {"broken": broken}), Stage("ranked", _ranked, ["summed"])]
    runs = [kept.run(plan(broken), tables) for broken in (True, False, False)]
    told = [F.lit(",".join(r.state for r in run.values())).alias(name) for run, name in zip(runs, ("first_run", "second_run", "third_run"), strict=True)]
    return kept.read(runs[-1]["ranked"]).select("c_nationkey", "total", "rank", *told)
