"""Commit logs replayed to file sets and copy plans, against a plain replay."""

from __future__ import annotations

import random

import pytest

from tandem.sources import commit_log

ACTION = "pair_id string, table_key string, version bigint, op string, path string, size bigint"
STATE = "pair_id string, table_key string, last_version bigint, last_sync timestamp"


def _log(seed):
    rng, rows = random.Random(seed), []
    for table in ("t.a", "t.b", "hot"):
        for version in range(12):
            for path in rng.sample(range(9), rng.randrange(0, 5)):
                rows.append(("p1", table, version, rng.choice(["add", "remove"]), f"f{path}", version * 10 + path))
    rows += [("p1", "both", 3, "remove", "x", None), ("p1", "both", 3, "add", "x", 7), ("p2", "t.a", 0, "add", "y", 1), ("p2", "gone", 0, "add", "z", 1), ("p2", "gone", 1, "remove", "z", None)]
    return rows


def _files(rows, at):
    held = {}
    for pair, table, version, op, path, size in sorted(rows, key=lambda r: (r[2], r[3] == "add")):
        if (pair, table) in at and version <= at[pair, table]:
            held.setdefault((pair, table), {})
            if op == "add":
                held[pair, table][path] = size
            else:
                held[pair, table].pop(path, None)
    return {(*k, path, size) for k, v in held.items() for path, size in v.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_with_and_without_checkpoints(spark, tmp_path, seed):
    rows = _log(seed)
    commit_log.write_export(spark.createDataFrame(rows, ACTION), f"{tmp_path}/log")
    actions = commit_log.read_export(spark, f"{tmp_path}/log")
    tables = sorted({r[:2] for r in rows})
    version = lambda of: spark.createDataFrame([(*t, of(i)) for i, t in enumerate(tables)], "pair_id string, table_key string, version bigint")
    at = version(lambda i: 9 + i % 2)
    want = _files(rows, {t: 9 + i % 2 for i, t in enumerate(tables)})
    found = lambda *a: {tuple(r) for r in commit_log.active_files(*a).select("pair_id", "table_key", "path", "size").collect()}
    assert found(actions, at) == want
    for name, of in (("early", lambda i: 2 + i), ("late", lambda i: 11)):
        commit_log.write_checkpoint(commit_log.active_files(actions, version(of)), version(of), f"{tmp_path}/{name}")
    saved = [commit_log.read_checkpoint(spark, f"{tmp_path}/{name}") for name in ("early", "late")]
    assert found(actions, at, saved[0].unionByName(saved[1])) == want
    # What a checkpoint covers may be gone from the log.
    left = actions.join(version(lambda i: 2 + i).withColumnRenamed("version", "cut"), ["pair_id", "table_key"]).filter("version > cut").drop("cut")
    assert found(left, at, saved[0]) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_copy_plan_brings_the_copy_to_the_newest_version(spark, seed):
    rows = [r for r in _log(seed) if r[1] != "both"]
    state = [("p1", "t.a", 4, None), ("p1", "t.b", 11, None), ("p1", "hot", 0, None), ("p2", "gone", 0, None)]
    failed = spark.createDataFrame([("p1", "hot")], "pair_id string, table_key string")
    listing = spark.createDataFrame([("p1", "hot", "h1"), ("p2", "t.a", "y"), ("p1", "t.a", "f1")], "pair_id string, table_key string, path string").selectExpr("*", "timestamp'2024-01-01' AS mtime")
    plan = commit_log.copy_plan(spark.createDataFrame(rows, ACTION), spark.createDataFrame(state, STATE), listing, failed=failed).collect()
    assert len(plan) == len(set(plan))
    assert {r for r in plan if r.method == "file_listing"} == {("p1", "hot", "file_listing", "copy", "h1"), ("p2", "t.a", "file_listing", "copy", "y")}
    for pair, table, last, _ in state:
        if table != "hot":
            names = lambda at: {f[2] for f in _files(rows, {(pair, table): at})}
            mine = [r for r in plan if r[:2] == (pair, table)]
            copies, deletes = {r.path for r in mine if r.action == "copy"}, {r.path for r in mine if r.action == "delete"}
            assert (names(last) - deletes) | copies == names(99) and copies <= names(99) and deletes == names(last) - names(99)
            again = {r[4] for r in rows if r[:2] == (pair, table) and r[2] > last and r[3] == "add"}
            assert copies == again & names(99)


def test_empty_log_and_lines_that_are_no_actions(spark, tmp_path):
    spark.createDataFrame([("p1", "{broken"), ("p1", '{"protocol": 1}')], "pair_id string, value string").write.partitionBy("pair_id").text(f"{tmp_path}/log")
    actions = commit_log.read_export(spark, f"{tmp_path}/log")
    assert [r.op for r in actions.collect()] == [None, None]
    at = spark.createDataFrame([("p1", "t", 1)], "pair_id string, table_key string, version bigint")
    assert commit_log.active_files(actions, at).count() == 0
    assert commit_log.copy_plan(actions, spark.createDataFrame([], STATE), spark.createDataFrame([], "pair_id string, table_key string, path string, mtime timestamp")).count() == 0
