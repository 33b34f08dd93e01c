"""Stages kept by content: what is reused, what a change takes with it, what is taken up after a break."""

from pyspark.sql import functions as F

from tallyspark.sinks.artifacts import Artifacts, Stage


def double(source):
    return source.withColumn("v", F.col("v") * 2)


def breaks(double, after):
    return double.withColumn("v", F.when(F.col("v") >= after, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))


def side(source, add=1):
    return source.withColumn("v", F.col("v") + add)


def total(double, side):
    return double.unionByName(side).agg(F.sum("v").alias("v"))


def states(told):
    return {k: r.state for k, r in told.items()}


def test_a_broken_run_is_taken_up(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("v")).write.parquet(f"{tmp_path}/source")
    tables = {"source": spark.read.parquet(f"{tmp_path}/source")}
    kept = Artifacts(spark, f"{tmp_path}/kept")
    plan = lambda after=100, add=1: [Stage("double", double, ["source"]), Stage("checked", breaks, ["double"], {"after": after}), Stage("side", side, ["source"], {"add": add}), Stage("total", total, ["double", "side"]), Stage("last", side, ["checked"])]
    plan_of = lambda **k: [s if s.name != "last" else Stage("last", lambda checked: checked.limit(3), ["checked"]) for s in plan(**k)]
    first = kept.run(plan_of(after=4), tables)
    assert states(first) == {"double": "made", "checked": "failed", "side": "made", "total": "made", "last": "skipped"} and "lost" in first["checked"].error
    # another session, the same folder: what is whole is reused, what broke is run again
    again = Artifacts(spark, f"{tmp_path}/kept").run(plan_of(), tables)
    assert states(again) == {"double": "reused", "checked": "made", "side": "reused", "total": "reused", "last": "made"}
    assert kept.read(again["total"]).first()[0] == 90 + 55
    # a changed parameter takes with it what stands on the stage, and nothing else
    changed = kept.run(plan_of(add=2), tables)
    assert states(changed) == {"double": "reused", "checked": "reused", "side": "made", "total": "made", "last": "reused"} and kept.read(changed["total"]).first()[0] == 90 + 65
    # a half-written folder does not count
    files, path = kept._path(f"{changed['total'].folder}/_SUCCESS")
    files.delete(path, False)
    assert states(kept.run(plan_of(add=2), tables))["total"] == "made"
    # new files of a table run all again
    spark.range(1).select(F.col("id").alias("v")).write.mode("append").parquet(f"{tmp_path}/source")
    new = kept.run(plan_of(), {"source": spark.read.parquet(f"{tmp_path}/source")})
    assert set(states(new).values()) == {"made"}
