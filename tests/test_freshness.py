"""Freshness states, lag and the RPO roll-up on literal commit histories."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tandem.functions.text import http_date
from tandem.operators import freshness as fr

T0 = dt.datetime(2026, 1, 1, 8)
SCHEMA = "pair_id BIGINT, table_key STRING, version BIGINT, commit_ts TIMESTAMP, has_ict BOOLEAN"


def history(spark, tables):
    return spark.createDataFrame([(1, name, v, t, True) for name, commits in tables.items() for v, t in commits.items()], SCHEMA)


def compare(spark, p, s):
    out = fr.freshness(history(spark, p), history(spark, s)).collect()
    return {r["table_key"]: r for r in out}


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_equal_version_is_in_sync_whatever_the_times(spark):
    got = compare(spark, {"a": {3: hours(0)}, "b": {3: None}}, {"a": {3: hours(500)}, "b": {3: None}})
    assert got["a"]["state"] == "in_sync" and got["a"]["behind_hours"] == 0.0
    assert got["b"]["state"] == "in_sync" and got["b"]["behind_hours"] == 0.0


def test_lag_uses_the_primary_history_not_the_copy_time(spark):
    # The copy was made long after; measured by copy times the replica would look current.
    got = compare(spark, {"a": {1: hours(0), 2: hours(1), 3: hours(30)}}, {"a": {1: hours(29.9)}})["a"]
    assert (got["state"], got["behind_hours"], got["lag_is_lower_bound"]) == ("behind", 30.0, False)


def test_a_trimmed_log_gives_a_lower_bound(spark):
    got = compare(spark, {"a": {8: hours(10), 9: hours(12)}}, {"a": {2: hours(50)}})["a"]
    assert (got["state"], got["behind_hours"], got["lag_is_lower_bound"]) == ("behind", 2.0, True)


def test_within_tolerance_is_in_sync(spark):
    got = compare(spark, {"a": {1: hours(0), 2: hours(0.05)}}, {"a": {1: hours(0)}})["a"]
    assert (got["state"], got["behind_hours"]) == ("in_sync", 0.05)


def test_presence_and_divergence_come_first(spark):
    got = compare(spark, {"gone": {1: hours(0)}, "ahead": {1: hours(0)}, "blind": {1: None, 2: None}},
                  {"new": {1: hours(0)}, "ahead": {2: None}, "blind": {1: None}})
    assert {k: v["state"] for k, v in got.items()} == {
        "gone": "missing_in_secondary", "new": "extra_in_secondary", "ahead": "diverged", "blind": "unknown"}


def test_latest_commit_is_the_highest_version_not_the_newest_file(spark):
    out = fr.latest_commit(history(spark, {"a": {10: hours(0), 9: hours(99)}})).first()
    assert (out["version"], out["commit_ts"]) == (10, hours(0))


def test_summary_takes_the_upper_median_and_is_incomplete_when_unknown(spark):
    lags = [("in_sync", 0.0), ("behind", 2.0), ("behind", 4.0), ("behind", 8.0), ("unknown", None)]
    fresh = spark.createDataFrame([(1, s, v, False, True) for s, v in lags] + [(2, "in_sync", 0.0, True, False)],
                                  "pair_id BIGINT, state STRING, behind_hours DOUBLE, lag_is_lower_bound BOOLEAN, in_commit_timestamps BOOLEAN")
    got = {r["pair_id"]: r for r in fr.rpo_summary(fresh).collect()}
    assert (got[1]["measured_rpo_hours"], got[1]["median_lag_hours"], got[1]["complete"], got[1]["tables_compared"]) == (8.0, 4.0, False, 5)
    assert (got[2]["rpo_is_lower_bound"], got[2]["tables_without_in_commit_timestamps"], got[2]["complete"]) == (True, 1, True)


def test_a_failed_listing_makes_the_summary_incomplete(spark):
    fresh = spark.createDataFrame([(1, "in_sync", 0.0, False, True)], "pair_id BIGINT, state STRING, behind_hours DOUBLE, lag_is_lower_bound BOOLEAN, in_commit_timestamps BOOLEAN")
    errors = spark.createDataFrame([(1,)], "pair_id BIGINT")
    assert fr.rpo_summary(fresh, errors).first()["complete"] is False


@pytest.mark.parametrize("text,expected", [
    ("Thu, 01 Jan 2026 08:00:00 GMT", T0), ("Mon, 01 Jan 2026 08:00:00 GMT", T0), ("garbage", None), ("", None), (None, None)])
def test_http_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v STRING").select(http_date("v").alias("t"))
    assert df.first()["t"] == expected


def test_integrity_levels(spark):
    p = spark.createDataFrame([("same", 100, 3), ("version", 100, 3), ("near", 1000, 3), ("far", 100, 3), ("p_bad", None, 3), ("s_bad", 5, 3)],
                              "t STRING, row_count BIGINT, version BIGINT")
    s = spark.createDataFrame([("same", 100, 3), ("version", 100, 2), ("near", 991, 3), ("far", 90, 3), ("p_bad", 1, 3), ("s_bad", None, 3)],
                              "t STRING, row_count BIGINT, version BIGINT")
    checks = fr.row_integrity(p, s, keys=["t"])
    assert {r["t"]: r["status"] for r in checks.collect()} == {
        "same": "pass", "version": "info", "near": "info", "far": "fail", "p_bad": "primary_read_error", "s_bad": "secondary_read_error"}
    roll = fr.integrity_rollup(checks.withColumn("pair_id", F.lit(1)), by=["pair_id"]).first()
    assert (roll["tables_checked"], roll["tables_passed"], roll["tables_failed"], roll["integrity_status"]) == (6, 3, 3, "fail")
