"""Joins and batches in which one key holds two thirds of the rows, with broadcasts out of the way."""

import pytest
from pyspark.sql import functions as F

from tandem.functions.grouping import fits, lookup_join
from tandem.operators import freshness as fr
from tandem.operators import replicate as rep


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def hot(spark, n=9000):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).alias("k"), "id")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_gives_the_same_rows_either_way(spark, no_broadcast, how):
    lookup = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(1, 7)], "k BIGINT, v BIGINT"))
    facts = hot(spark)
    small = lookup_join(facts, lookup, on=["k"], spread_by=["id"], how=how)
    large = lookup_join(facts, lookup, on=["k"], spread_by=["id"], how=how, max_rows=10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small) and "Exchange hashpartitioning" not in plan(small)
    assert "_salt" in plan(large) and "Broadcast" not in plan(large)
    assert small.exceptAll(large).isEmpty() and small.count() == large.count() == facts.join(lookup, "k", how).count()


def test_salted_rows_of_a_hot_key_are_shared_out(spark, no_broadcast):
    lookup = spark.createDataFrame([(1, 7)], "k BIGINT, v BIGINT")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = lookup_join(hot(spark), lookup, on=["k"], spread_by=["id"], max_rows=0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 6000 and max(sizes) < 4500


def test_fits_counts_no_further_than_it_must(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)


def test_a_table_with_most_of_the_history(spark, no_broadcast):
    log = lambda lag: spark.range(6000).select(
        F.lit(1).cast("bigint").alias("pair_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise("hot").alias("table_key"),
        F.col("id").alias("version"), F.timestamp_seconds(F.col("id") * 3600).alias("commit_ts"), F.lit(True).alias("has_ict")).filter(F.col("id") < 6000 - lag)
    rows = {r["table_key"]: r for r in fr.freshness(log(0), log(30)).filter("table_key = 'hot'").collect()}
    assert (rows["hot"]["primary_version"], rows["hot"]["secondary_version"], rows["hot"]["behind_hours"]) == (5999, 5969, 30.0)


def test_a_key_with_most_of_the_changes(spark, no_broadcast):
    feed = hot(spark).select("k", F.col("id").alias("v"), F.lit("update_postimage").alias("_change_type"), F.col("id").alias("_commit_version"),
                             F.lit(None).cast("timestamp").alias("_commit_timestamp"))
    out = rep.cdf_merge(spark.createDataFrame([(1, -1), (2, -1)], "k BIGINT, v BIGINT"), feed, keys=["k"])
    assert out.count() == 3002 and {r["k"]: r["v"] for r in out.filter("k IN (1, 2)").collect()} == {1: 8999, 2: -1}


def test_wide_lookups_are_not_broadcast(spark):
    from tandem.functions import grouping as g

    wide = spark.range(200).selectExpr("id AS k", "repeat('x', 100000) AS v", "array(id) AS a")
    assert not g.fits(wide, max_bytes=1 << 20) and g.fits(wide.select("k"), max_bytes=1 << 20) and not g.fits(wide.select("k"), max_rows=100)
    facts = spark.range(1000).selectExpr("id % 7 AS k", "id AS n")
    joined = g.lookup_join(facts, wide, on=["k"], spread_by=["n"], max_bytes=1 << 20)
    assert "_salt" in joined._jdf.queryExecution().analyzed().toString() and joined.count() == 1000
