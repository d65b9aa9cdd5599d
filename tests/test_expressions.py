"""Column expressions on literal values."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tandem.functions import rights as rt
from tandem.functions import text as tx
from tandem.functions.grouping import bag_digest, row_digest
from tandem.operators import documents as doc
from tandem.operators import security as sec
from tandem.operators import status as st


def one(spark, value, expression, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("x")).first()["x"]


def test_times(spark):
    noon = dt.datetime(2026, 3, 1, 12)
    assert one(spark, "2026-03-01T12:00:00Z", tx.iso_time("v")) == noon == one(spark, "2026-03-01T12:00:00", tx.iso_time("v"))
    assert one(spark, "garbage", tx.iso_time("v")) is None
    assert one(spark, noon, tx.epoch_ms("v"), "TIMESTAMP") == int(noon.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("text,host", [
    ("Server=tcp:AbC-1.datawarehouse.fabric.microsoft.com,1433;", "abc-1.datawarehouse.fabric.microsoft.com"),
    ("x.dr-database.fabric.microsoft.com", "x.dr-database.fabric.microsoft.com"), ("other.example.com", ""), ("", ""), (None, "")])
def test_sql_hosts(spark, text, host):
    assert one(spark, text, tx.sql_host("v")) == host


def test_service_addresses_map_by_host(spark):
    rows = [("https://A.z1.example.com/q", "https://b.z2.example.com"), ("https://same.example.com", "https://same.example.com"), ("not a uri", "https://x.example.com"), (None, None)]
    uris = spark.createDataFrame(rows, "p_uri STRING, s_uri STRING")
    assert [tuple(r) for r in doc.uri_mapping(uris).collect()] == [("a.z1.example.com", "b.z2.example.com")]


def test_principals(spark):
    df = spark.createDataFrame([("ID", None, "Me@Example.com", "id")], "a STRING, b STRING, c STRING, d STRING")
    assert df.select(rt.principal_keys("a", "b", "c", "d")).first()[0] == ["id", "me@example.com"]
    entries = spark.createDataFrame(
        [("o", "g", None, None, None, None, None, None, None, 1), ("o", None, "a", None, None, None, None, None, None, 1), ("o", None, None, True, "u", None, None, None, None, 1),
         ("o", None, None, False, "u", None, None, None, None, 1), ("o", None, None, None, None, 0, None, None, None, 1), ("o", None, None, None, None, None, "e", None, None, None),
         ("o", None, None, None, None, 7, None, None, None, 1), ("o", None, None, None, "u", None, None, 0, None, 1), ("", None, None, None, "u", None, None, None, None, 1)],
        "object_id STRING, group_id STRING, app_id STRING, is_app BOOLEAN, upn STRING, user_type INT, email STRING, folder_role_id INT, folder_role STRING, permissions INT")
    got = [(r["kind"], r["status"]) for r in sec.direct_shares(entries).collect()]
    assert got == [("Group", "direct"), ("ServicePrincipal", "direct"), ("ServicePrincipal", "direct"), ("User", "direct"), ("User", "direct"), ("User", "unparsed"),
                   ("", "unparsed"), ("User", "inherited"), ("User", "unparsed")]


def test_group_names_are_stable(spark):
    df = spark.createDataFrame([("AAAAAAAA-1111-2222-3333-bbbbbbbbbbbb", "Read", "Build")], "i STRING, r STRING, a STRING")
    want = "bcdr-ia-aaaaaaaa1111-" + hashlib.sha1(b"Read|Build").hexdigest()[:6]
    assert df.select(rt.group_nickname("i", "r", "a")).first()[0] == want


def test_tags_of_the_tracker_are_dropped(spark):
    assert one(spark, {"mlflow.user": "x", "team": "y"}, doc.user_tags(F.col("v")), "MAP<STRING, STRING>") == {"team": "y"}


def test_digests_tell_columns_and_nulls_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("abc", ""), ("abc", None), (None, "abc")], "a STRING, b STRING")
    assert df.select(row_digest("a", "b").alias("d")).distinct().count() == 5
    bag = lambda rows: spark.createDataFrame([(r,) for r in rows], "a STRING").select(row_digest("a").alias("d")).agg(bag_digest(F.col("d"))).first()[0]
    assert bag("abc") == bag("cab") != bag("abcc") and bag("aab") != bag("abb")


def test_ties_between_lag_sources_go_to_the_first(spark):
    at = dt.datetime(2026, 1, 1)
    events = spark.createDataFrame([(1, "notebook_job", at), (1, "autosync", at), (1, "schedule", at - dt.timedelta(1)), (2, "unheard_of", at)], "pair_id INT, source STRING, ts TIMESTAMP")
    got = st.replication_lag(events, now=at + dt.timedelta(minutes=90)).collect()
    assert [(r["pair_id"], r["lag_source"], r["lag_minutes"]) for r in got] == [(1, "autosync", 90.0)]


def test_last_n_and_parity(spark):
    events = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    assert {(r["g"], r["position"]): r["id"] for r in st.recent(events, by=["g"], order=["id"], n=2).collect()} == {(0, 1): 98, (0, 2): 96, (1, 1): 99, (1, 2): 97}
    item = lambda n: spark.range(n).select(F.lit(1).alias("pair_id"), F.lit("Report").alias("item_type"), F.col("id").cast("string").alias("display_name"))
    assert [st.parity_check(item(30), item(n)).first()["current"] for n in (30, 20, 19)] == [True, True, False]
    assert [st.failover_simulation(item(30), item(n)).first()["status"] for n in (24, 23)] == ["DRY_RUN_PASS", "DRY_RUN_FAIL"]
