"""Shares, grants, roles, policies, schedules, gateways and readiness on literal rows."""

import pytest
from pyspark.sql import functions as F

from tandem.functions import rights as rt
from tandem.functions.grouping import ordinal, spread
from tandem.operators import grants as gr
from tandem.operators import schedules as sch
from tandem.operators import security as sec
from tandem.operators import status as st

SHARE = "share_id STRING, item_no INT, item_type STRING, principal STRING, principal_type STRING, rights INT, additional STRING, keys ARRAY<STRING>"


def share(n, principal, rights, *, item_type="SemanticModel", kind="User", additional="", keys=None):
    return (f"{n}", 1, item_type, principal, kind, rights, additional, keys or [principal])


def plan(spark, p, s, roles=(), members=None):
    frame = lambda rows: spark.createDataFrame(list(rows), SHARE)
    keys = spark.createDataFrame([(k,) for k in roles], "principal_key STRING")
    out = sec.share_plan(frame(p), frame(s), keys, item=["item_no"], members=members)
    return {r["share_id"]: (r["action"], r["rights_text"], r["note"]) for r in out.collect()}


def test_share_actions(spark):
    p = [share(1, "a", 1), share(2, "b", 5), share(3, "c", 1), share(4, "d", 3), share(5, "e", 1, item_type="Lakehouse"), share(6, "f", 1, kind="App"),
         share(7, "g", 1, keys=["oid", "g@example.com"]), share(8, "h", 1), share(9, "i", 1, additional="Build")]
    s = [share(1, "a", 1), share(2, "b", 9), share(7, "x", 1, keys=["g@example.com"]), share(9, "i", 1)]
    got = plan(spark, p, s, roles=["h"])
    assert got == {"1": ("already_present", "Read", ""), "2": ("upgrade_dataset_user", "ReadReshareExplore", ""), "3": ("grant_dataset_user", "Read", ""),
                   "4": ("grant_dataset_user", "Read", "write_not_grantable"), "5": ("manual_portal_share", "Read", "no_api"),
                   "6": ("manual_portal_share", "Read", "service_principal"), "7": ("already_present", "Read", ""), "8": ("already_present", "Read", "role"),
                   "9": ("upgrade_dataset_user", "Read", "")}


def test_members_of_a_shared_group_are_covered_whatever_its_size(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b")], "group_id STRING, member_id STRING")
    p, s = [share(1, "a", 1), share(2, "z", 1)], [share(1, "g", 1, kind="Group")]
    assert [v[0] for _, v in sorted(plan(spark, p, s, members=members).items())] == ["already_present", "grant_dataset_user"]
    frame = lambda rows: spark.createDataFrame(rows, SHARE)
    assert sec.expand_groups(frame(s), members, item=["item_no"]).count() == 3
    large = spark.range(30000).selectExpr("'g' AS group_id", "cast(id AS STRING) AS member_id")
    assert sec.expand_groups(frame(s), large, item=["item_no"]).count() == 30001
    assert sec.expand_groups(frame(s), members, item=["item_no"], max_members=1).count() == 1


def test_rights_text_and_bits(spark):
    df = spark.createDataFrame([("ReadWriteReshareExplore",), ("ReadReshare",), ("None",), (None,)], "r STRING")
    assert [r[0] for r in df.select(rt.rights_mask("r")).collect()] == [15, 5, 0, 0]
    bits = spark.createDataFrame([(15,), (4,), (0,)], "m INT")
    assert [r[0] for r in bits.select(rt.rights_text("m")).collect()] == ["ReadWriteReshareExplore", "ReadReshare", "None"]


def test_bitmask_upgrade_keeps_what_is_held(spark):
    schema = "principal STRING, permissions BIGINT, artifact_permissions BIGINT"
    p = spark.createDataFrame([("a", 3, 1), ("b", 4, 0), ("c", 1, 1)], schema)
    s = spark.createDataFrame([("a", 7, 1), ("b", 3, 8)], schema)
    got = {r["principal"]: (r["action"], r["permissions"], r["artifact_permissions"]) for r in sec.bitmask_share_plan(p, s, keys=["principal"]).collect()}
    assert got == {"a": ("present", 3, 1), "b": ("upgrade", 7, 8), "c": ("grant", 1, 1)}


def test_access_groups_by_item_and_rights(spark):
    rows = [("i-1", "Lakehouse", p, t, "Read", a, "manual_portal_share") for p, t, a in
            (("u1", "User", ""), ("u1", "User", ""), ("app", "App", ""), ("u2", "User", "Build"), ("G", "Group", ""), ("all", "EntireTenant", ""))] + [("i-1", "Lakehouse", "x", "User", "Read", "", "already_present")]
    df = spark.createDataFrame(rows, "item_id STRING, item_type STRING, principal STRING, principal_type STRING, rights_text STRING, additional STRING, action STRING")
    got = sorted((r["kind"], r["additional"], r["members"], r["share_mode"]) for r in sec.access_groups(df, item_id="item_id").collect())
    assert got == [("existing_group", "", 0, "portal_once"), ("managed_group", "", 2, "portal_once"), ("managed_group", "Build", 1, "portal_once"), ("unsupported", "", 0, "portal_once")]


def test_role_order_does_not_matter_but_constraints_do(spark):
    rules = "lakehouse STRING, role_name STRING, effect STRING, path STRING, columns STRING"
    members = spark.createDataFrame([("l", "r", "m1"), ("l", "r", "m2")], "lakehouse STRING, role_name STRING, member STRING")
    side = lambda rows: sec.normalize_role(spark.createDataFrame([("l", "r", *x) for x in rows], rules), members, by=["lakehouse", "role_name"])
    a, b, c = side([("Permit", "/a", ""), ("Permit", "/b", "")]), side([("Permit", "/b", ""), ("Permit", "/a", "")]), side([("Permit", "/a", "x"), ("Permit", "/b", "")])
    assert sec.role_delta(a, b).first()["action"] == "unchanged" and sec.role_delta(a, c).first()["action"] == "update"


ROLES = ("role_name STRING, decision_rules ARRAY<STRUCT<effect: STRING, permission: ARRAY<STRUCT<attribute_name: STRING, values: ARRAY<STRING>>>, "
         "columns: ARRAY<STRUCT<table_path: STRING, column_names: ARRAY<STRING>, effect: STRING, action: ARRAY<STRING>>>>>")


def test_policy_view(spark):
    path = lambda *p: [("Path", list(p)), ("Action", ["Read"])]
    rows = [("r", [(None, path("/t"), [("/t", ["a", "b"], "Permit", ["Read"])])]), ("missing", [("Permit", path("/t"), [("/t", ["masked"], None, None)])]),
            ("every", [("Permit", path("*"), [])]), ("deny", [("Permit", path("/t"), []), ("Deny", path("/t"), [])]), ("deny_all", [("Permit", path("/t"), []), ("Deny", path("*"), [])]),
            ("hide", [("Permit", path("/t"), [("/t", ["secret"], "Deny", ["Read"])])]), ("both", [("Permit", path("/t"), [("/t", ["a", "secret"], "Permit", None), ("/t", ["secret"], "Deny", None)])]),
            ("columns_only", [("Permit", path("/u"), [("/t", ["a"], "Permit", None)])])]
    policies = sec.parse_policy(spark.createDataFrame(rows, ROLES))
    assert {tuple(r) for r in policies.filter("role_name = 'r'").collect()} == {
        ("r", "/t", None, "table", "Permit", None), ("r", "/t", "a", "column", "Permit", "Read"), ("r", "/t", "b", "column", "Permit", "Read")}
    table = spark.createDataFrame([(1, 2, 3)], "a INT, secret INT, b INT")
    see = lambda role, where="/t": sec.permitted_columns(policies, role=role, table_path=where, columns=table.columns)
    assert see("r") == ["a", "b"] and see("r", "/u") is None and see("nobody") is None
    assert see("missing") == [] and see("every") == ["a", "secret", "b"] and see("every", "/any") == ["a", "secret", "b"]
    assert see("deny") is None and see("deny_all") is None and see("hide") == ["a", "b"] and see("both") == ["a"] and see("columns_only") is None
    assert sec.policy_view(table, policies, role="r", table_path="/t").columns == ["a", "b"]
    assert sec.policy_view(table, policies, role="deny", table_path="/t").isEmpty()
    hidden = sec.policy_view(table, policies, role="missing", table_path="/t")
    assert hidden.columns == [] and hidden.count() == 0


GRANT = "database_name STRING, state STRING, permission STRING, class STRING, schema_name STRING, object_name STRING, column_name STRING, principal STRING"


def test_grants_run_in_scope_order(spark):
    rows = [("d", "DENY", "SELECT", "OBJECT_OR_COLUMN", "s", "t", "c]", "u"), ("d", "GRANT", "SELECT", "OBJECT_OR_COLUMN", "s", "t", "", "u"),
            ("d", "GRANT_WITH_GRANT_OPTION", "EXECUTE", "SCHEMA", "s", "", "", "u"), ("d", "GRANT", "CREATE TABLE", "DATABASE", "", "", "", "r"),
            ("d", "GRANT", "SELECT", "OBJECT_OR_COLUMN", "s", "absent", "", "u"), ("d", "GRANT", "SELECT", "SCHEMA", "nope", "", "", "u")]
    p, s = spark.createDataFrame(rows, GRANT), spark.createDataFrame([("d", "GRANT", "SELECT", "DATABASE", "", "", "", "old")], GRANT)
    members = spark.createDataFrame([("d", "r", "m")], "database_name STRING, role_name STRING, member_name STRING")
    args = dict(s_objects=spark.createDataFrame([("d", "s", "t")], "database_name STRING, schema_name STRING, object_name STRING"),
                s_schemas=spark.createDataFrame([("d", "s")], "database_name STRING, schema_name STRING"), p_members=members, s_members=members.limit(0))
    out = gr.grant_plan(p, s, **args).collect()
    assert [r["statement"] for r in sorted((r for r in out if r["seq"]), key=lambda r: r["seq"])] == [
        "CREATE ROLE [r];", "ALTER ROLE [r] ADD MEMBER [m];", "GRANT CREATE TABLE TO [r];", "GRANT EXECUTE ON SCHEMA::[s] TO [u] WITH GRANT OPTION;",
        "GRANT SELECT ON [s].[t] TO [u];", "DENY SELECT ON [s].[t] ([c]]]) TO [u];"]
    assert sorted(r["statement"] for r in out if r["kind"] == "skipped") == ["GRANT SELECT ON SCHEMA::[nope] TO [u];", "GRANT SELECT ON [s].[absent] TO [u];"]
    assert [r["statement"] for r in gr.grant_extra(p, s, members, members).collect()] == ["GRANT SELECT TO [old];"]


def test_ordinals_of_a_hot_group_follow_the_whole_order(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"), (F.col("id") % 4).alias("a"), (F.col("id") % 7).alias("b"), "id")
    from pyspark.sql import Window

    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("a", "b", "id")).cast("bigint"))
    got = ordinal(df, group=["g"], levels=[["a"], ["b"]], rest=["id"], out="n")
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and got.count() == 5000


SCHED = "schedule_id BIGINT, item_type STRING, item_name STRING, job_type STRING, config STRING, enabled BOOLEAN"


def test_schedules_match_one_to_one(spark):
    p = spark.createDataFrame([(1, "N", "a", "j", "x", True), (2, "N", "a", "j", "x", True), (3, "N", "a", "j", "y", False), (4, "N", "gone", "j", "x", True)], SCHED)
    s = spark.createDataFrame([(11, "N", "a", "j", "x", False), (12, "N", "a", "j", "z", False)], SCHED)
    items = spark.createDataFrame([("N", "a", "i1")], "item_type STRING, item_name STRING, item_id STRING")
    out = sch.schedule_plan(p, s, items)
    actions = sorted(r["action"] for r in out.collect())
    assert actions == ["create_paused", "create_paused", "missing_item_in_secondary", "present"]
    assert [r["schedule_id"] for r in sch.schedule_extras(out, s).collect()] == [12]
    got = {(r["item_name"], r["config"]): (r["action"], r["already_enabled_after"]) for r in sch.schedule_activate(p, s, items).collect()}
    assert got == {("a", "x"): ("enable", 1), ("gone", "x"): ("missing_item", 0)}


def test_config_ignores_nulls_empties_and_order(spark):
    df = spark.createDataFrame([({"days": ["Tue", "Mon"], "none": None, "empty": []},), ({"days": ["Mon", "Tue"]},)], "c MAP<STRING, ARRAY<STRING>>")
    assert {r[0] for r in df.select(sch.normalize_config("c")).collect()} == {'days=["Mon","Tue"]'}
    assert spark.range(20000).select(spread("id").alias("s")).distinct().count() == 256


@pytest.mark.parametrize("gateway,regions,expected", [
    (("VirtualNetwork", "west", 0), ("west", "east"), "bad"), (("VirtualNetwork", "west", 0), ("west", "west"), "warn"),
    (("VirtualNetwork", "east", 0), ("west", "east"), "ok"), (("VirtualNetwork", None, 0), ("west", "east"), "warn"),
    (("VirtualNetwork", "north", 0), ("west", "east"), "warn"), (("VirtualNetwork", "west", 0), (None, "east"), "bad"),
    (("OnPremises", None, 1), ("west", "east"), "warn"), (("OnPremises", None, 2), ("west", "east"), "ok")])
def test_gateways(spark, gateway, regions, expected):
    g = spark.createDataFrame([(1, 1, *gateway, 3)], "gateway_id INT, pair_id INT, gateway_type STRING, region STRING, member_count INT, connection_count INT")
    r = spark.createDataFrame([(1, *regions)], "pair_id INT, primary_region STRING, secondary_region STRING")
    assert st.gateway_verdict(g, r).first()["level"] == expected


def test_verdicts(spark):
    rows = [(1, "region", "ok"), (1, "capacity", "ok"), (2, "region", "ok"), (2, "capacity", "unknown"), (3, "rpo", "unknown"), (3, "items", "warn"), (4, "rpo", "unknown"), (4, "refs", "bad")]
    got = {r["pair_id"]: r["verdict"] for r in st.readiness(spark.createDataFrame(rows, "pair_id INT, check_id STRING, level STRING")).collect()}
    assert got == {1: "GO", 2: "GO WITH RISK", 3: "CAN'T ASSESS", 4: "NO-GO"}


def test_a_worse_level_never_improves_the_verdict(spark):
    order = ["GO", "GO WITH RISK", "CAN'T ASSESS", "NO-GO"]
    rows = [(f"{a}{b}", c, lvl) for a in ("ok", "warn", "unknown", "bad") for b in ("ok", "warn", "unknown", "bad") for c, lvl in (("rpo", a), ("gateways", b))]
    got = {r["pair_id"]: order.index(r["verdict"]) for r in st.readiness(spark.createDataFrame(rows, "pair_id STRING, check_id STRING, level STRING")).collect()}
    for other in ("ok", "warn", "unknown", "bad"):
        for better, worse in (("ok", "warn"), ("ok", "unknown"), ("warn", "bad"), ("unknown", "bad")):
            assert got[better + other] <= got[worse + other] and got[other + better] <= got[other + worse]


def test_checks_without_a_source_are_unknown(spark):
    pairs = spark.createDataFrame([(1, "west", "east", "Active"), (2, "west", "west", None)], "pair_id INT, primary_region STRING, secondary_region STRING, secondary_capacity_state STRING")
    rpo = spark.createDataFrame([(1, 0.5, 0)], "pair_id INT, measured_rpo_hours DOUBLE, diverged BIGINT")
    got = {(r["pair_id"], r["check_id"]): r["level"] for r in st.readiness_checks(pairs, rpo=rpo).collect()}
    assert len(got) == 18 and got[1, "region"] == "ok" and got[2, "region"] == "bad" and got[1, "rpo"] == "ok" and got[2, "rpo"] == "unknown"
    assert got[1, "capacity"] == "ok" and got[2, "capacity"] == "unknown" and got[1, "models"] == "unknown"


def test_health_and_lag(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "BCDR_sync"), (4, "a"), (5, "a")], "pair_id INT, display_name STRING")
    cap = spark.createDataFrame([(1, "Active", False), (2, "Paused", False), (3, "Active", False), (4, "", False), (5, "Active", True)], "pair_id INT, capacity_state STRING, read_error BOOLEAN")
    assert {r["pair_id"]: (r["health"], r["status"]) for r in st.health_score(items, cap).collect()} == {
        1: (100, "HEALTHY"), 2: (25, "CAPACITY_PAUSED"), 3: (50, "EMPTY"), 4: (75, "CAPACITY_UNKNOWN"), 5: (0, "ERROR")}
    lags = spark.createDataFrame([(True, 15.0, 0), (True, 15.0, 1), (True, 60.0, 0), (True, 60.1, 0), (True, None, 0), (False, 1.0, 0)], "has_secondary BOOLEAN, lag_minutes DOUBLE, artifact_drift INT")
    assert [r["status"] for r in st.lag_status(lags).collect()] == ["HEALTHY", "NEEDS_SYNC", "NEEDS_SYNC", "STALE", "NEEDS_SYNC", "NO_DR"]


def test_every_verdict_occurs_in_the_query(spark):
    import pathlib

    from tandem.plans.all_queries import QUERIES

    if pathlib.Path("/root/testdata/sf0.001").exists():
        verdicts = {r["verdict"] for r in QUERIES["readiness"](spark, "/root/testdata/sf0.001").select("verdict").distinct().collect()}
        assert verdicts == {"GO", "GO WITH RISK", "CAN'T ASSESS", "NO-GO"}
