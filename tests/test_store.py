"""Transactions over several tables: all or nothing, conflicts, touched folders, older versions."""

import pytest
from pyspark.sql import functions as F

from tallyspark.sinks.store import Conflict, Store

ROWS = "key long, name string, pos int"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(spark, *found):
    return spark.createDataFrame(list(found), ROWS)


def both(t, new):
    for name in ("a", "b", "c"):
        t.create(name, new.schema, ["key"], 4)
        t.upsert(name, new, ["key"], "pos")


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_break_between_two_tables_leaves_the_old_state(spark, store):
    store.run(lambda t: both(t, rows(spark, (1, "x", 0), (2, "y", 0))))
    t = store.begin()
    t.upsert("a", rows(spark, (1, "new", 0)), ["key"], "pos")
    with pytest.raises(Exception, match="nothing"):
        t.upsert("b", spark.createDataFrame([(1,)], "key long").withColumn("name", F.lit("z")).withColumn("pos", F.lit(0)).filter(F.raise_error(F.lit("nothing")).isNull()), ["key"], "pos")
    # the writer dies here: what it staged is there, and nobody sees it
    again = Store(spark, store.root)
    assert again.version() == 1
    assert [told(again.read(n)) for n in "abc"] == [[(1, "x", 0), (2, "y", 0)]] * 3


def test_commit_shows_all_tables_at_once_and_old_versions_stay(spark, store):
    store.run(lambda t: both(t, rows(spark, (1, "x", 0), (2, "y", 0), (None, "n", 0))))
    store.run(lambda t: both(t, rows(spark, (1, "first", 0), (1, "last", 1), (3, "z", 0), (None, "m", 1))))
    for n in "abc":
        assert told(store.read(n)) == sorted([(1, "last", 1), (2, "y", 0), (3, "z", 0), (None, "m", 1)], key=str)
        assert told(store.read(n, 1)) == sorted([(1, "x", 0), (2, "y", 0), (None, "n", 0)], key=str)


def test_of_two_writers_the_second_meets_a_conflict(spark, store):
    store.run(lambda t: both(t, rows(spark, (1, "x", 0))))
    one, two = store.begin(), store.begin()
    one.upsert("a", rows(spark, (1, "one", 0)), ["key"], "pos")
    two.upsert("a", rows(spark, (1, "two", 0)), ["key"], "pos")
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert told(store.read("a")) == [(1, "one", 0)]
    # a writer that looked before the first committed, and comes to the rename after it
    three, store.version = store.begin(), lambda: 2
    three.base = 1
    store.version = lambda: 1
    with pytest.raises(Conflict):
        three.commit()
    del store.version
    assert store.run(lambda t: t.upsert("a", rows(spark, (1, "two", 0)), ["key"], "pos")) == 3 and told(store.read("a")) == [(1, "two", 0)]


def test_untouched_buckets_keep_their_folders(spark, store):
    def many(t):
        t.create("a", rows(spark, (0, "", 0)).schema, ["key"], 16)
        t.append("a", spark.range(400).select(F.col("id").alias("key"), F.lit("x").alias("name"), F.lit(0).alias("pos")))

    store.run(many)
    before = store.manifest()["a"].folders
    store.run(lambda t: t.upsert("a", rows(spark, (7, "y", 0)), ["key"], "pos"))
    after = store.manifest()["a"].folders
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert store.read("a").count() == 400 and store.read("a").filter("name = 'y'").count() == 1


def test_scoped_replace_and_own_changes(spark, store):
    def work(t):
        both(t, rows(spark, (1, "x", 0), (2, "y", 0), (3, "z", 0)))
        t.replace_scope("a", rows(spark, (2, "w", 5)), spark.createDataFrame([(2,), (3,), (9,)], "key long"))
        assert told(t.read("a")) == [(1, "x", 0), (2, "w", 5)]

    store.run(work)
    assert told(store.read("a")) == [(1, "x", 0), (2, "w", 5)] and store.read("b").count() == 3
    store.run(lambda t: t.replace_scope("a", rows(spark, (0, "", 0)).limit(0), spark.createDataFrame([(1,), (2,)], "key long")))
    assert store.read("a").count() == 0 and store.read("a").columns == ["key", "name", "pos"]
    with pytest.raises(ValueError, match="bucket columns"):
        store.begin().upsert("b", rows(spark, (1, "x", 0)), ["name"], "pos")


def test_versions_follow_each_other(spark, store):
    new = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "key long, at int")

    def add(t):
        t.create("v", new.withColumn("version", F.lit(0).cast("long")).schema, ["key"], 2)
        t.append_versions("v", new, "key", "at")

    store.run(add)
    store.run(add)
    assert told(store.read("v").select("key", "version")) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
