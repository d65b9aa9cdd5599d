"""Reconcile and its specialisations: laws, null and duplicate keys, and hot keys."""

import collections

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.operators import reconcile as rec

ROW = "k BIGINT, v STRING"


def frame(spark, rows, schema=ROW):
    return spark.createDataFrame(list(rows), schema)


def states(df):
    return {r["k"]: r["state"] for r in df.collect()}


def test_states_and_values(spark):
    p, s = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (None, "n")]), frame(spark, [(1, "a"), (2, "x"), (4, "d"), (None, "n")])
    for unique in (True, False):
        got = rec.reconcile(p, s, keys=["k"], compare=["v"], partition=(), unique=unique)
        assert states(got) == {1: "in_sync", 2: "mismatch", 3: "missing_in_secondary", 4: "extra_in_secondary", None: "in_sync"}
        assert tuple(got.filter("k = 2").select("p_v", "s_v").first()) == ("b", "x")


def test_a_null_value_on_one_side_is_a_mismatch(spark):
    got = rec.reconcile(frame(spark, [(1, None), (2, None)]), frame(spark, [(1, "a"), (2, None)]), keys=["k"], compare=["v"], partition=())
    assert states(got) == {1: "mismatch", 2: "in_sync"}


def test_a_side_equals_itself(spark):
    p = frame(spark, [(i % 7, str(i)) for i in range(50)])
    got = rec.reconcile(p, p, keys=["k"], compare=["v"], partition=())
    assert set(states(got).values()) == {"in_sync"} and got.count() == 7
    assert rec.missing(p, p, keys=["k"], partition=()).isEmpty()


def test_one_hot_key_collapses_before_the_shuffle(spark):
    hot = spark.range(30000).select(F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.lit("a").alias("v"))
    got = rec.reconcile(hot, hot, keys=["k"], compare=["v"], partition=())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Join" not in plan
    assert got.count() == 10000 and got.filter("state <> 'in_sync'").isEmpty()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=st.lists(st.tuples(st.integers(0, 5), st.sampled_from("ab")), max_size=8), s=st.lists(st.tuples(st.integers(0, 5), st.sampled_from("ab")), max_size=8))
def test_against_a_dictionary(spark, p, s):
    def greatest(rows):
        out = collections.defaultdict(str)
        for k, v in rows:
            out[k] = max(out[k], v)
        return out

    left, right = greatest(p), greatest(s)
    want = {k: "missing_in_secondary" if k not in right else "extra_in_secondary" if k not in left else "in_sync" if left[k] == right[k] else "mismatch"
            for k in {*left, *right}}
    assert states(rec.reconcile(frame(spark, p), frame(spark, s), keys=["k"], compare=["v"], partition=())) == want


ITEM = "pair_id BIGINT, item_type STRING, display_name STRING, item_id STRING"


def test_type_mismatch_only_after_exact_matches(spark):
    # A store and its endpoint share a name; both match exactly, so neither is a mismatch.
    p = frame(spark, [(1, "Lakehouse", "x", "p1"), (1, "SQLEndpoint", "x", "p2"), (1, "Report", "y", "p3"), (1, "Notebook", "z", "p4")], ITEM)
    s = frame(spark, [(1, "Lakehouse", "x", "s1"), (1, "SQLEndpoint", "x", "s2"), (1, "Dashboard", "y", "s3"), (1, "Notebook", "w", "s4")], ITEM)
    got = {(r["item_type"], r["display_name"]): (r["state"], r["secondary_type"]) for r in rec.catalog_drift(p, s).collect()}
    assert got == {("Lakehouse", "x"): ("in_sync", "Lakehouse"), ("SQLEndpoint", "x"): ("in_sync", "SQLEndpoint"),
                   ("Report", "y"): ("type_mismatch", "Dashboard"), ("Notebook", "z"): ("missing_in_secondary", None),
                   ("Notebook", "w"): ("extra_in_secondary", "Notebook")}


def test_applying_a_plan_leaves_nothing_to_plan(spark):
    schema = "pair_id BIGINT, principal STRING, role STRING"
    p = frame(spark, [(1, "a", "Admin"), (1, "b", "Viewer"), (1, "c", "Member")], schema)
    s = frame(spark, [(1, "a", "Admin"), (1, "b", "Admin"), (1, "z", "Viewer")], schema)
    plan = rec.assignment_delta(p, s)
    assert {r["principal"]: r["action"] for r in plan.collect()} == {"a": "unchanged", "b": "change", "c": "add", "z": "removed_detected"}
    applied = plan.select("pair_id", "principal", F.coalesce("primary_role", "secondary_role").alias("role"))
    assert {r["action"] for r in rec.assignment_delta(p, applied).collect()} == {"unchanged", "removed_detected"}


def test_schema_merge_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "k INT, a STRING"), spark.createDataFrame([(2, 5)], "k INT, b INT")
    assert sorted(map(tuple, rec.merge_schema(a, b).collect())) == [(1, "x", None), (2, None, 5)]


def test_rebind_falls_back_to_the_name_of_the_report(spark):
    reports = frame(spark, [(1, "r1", "Sales", "m1"), (1, "r2", "Ops", "unknown"), (1, "r3", "Old", "m3")], "pair_id BIGINT, report_id STRING, report_name STRING, model_id STRING")
    p = frame(spark, [(1, "SemanticModel", "Sales model", "m1"), (1, "SemanticModel", "Gone", "m3")], ITEM)
    s = frame(spark, [(1, "SemanticModel", "Sales model", "s1"), (1, "SemanticModel", "Ops", "s2"), (1, "Report", "Sales", "sr1"), (1, "Report", "Ops", "sr2"), (1, "Report", "Old", "sr3")], ITEM)
    got = {r["report_id"]: (r["s_model_id"], r["fallback"], r["action"]) for r in rec.rebind_plan(reports, p, s).collect()}
    assert got == {"r1": ("s1", False, "rebind"), "r2": ("s2", True, "rebind"), "r3": (None, False, "model_missing")}
