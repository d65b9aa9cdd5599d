"""Change feeds, commit logs, watermarks and state."""

import datetime as dt
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.operators import replicate as rep
from tandem.session import materialize
from tandem.sources import commit_log, listing
from tandem.sources.delimited import from_delimited, to_delimited

FEED = "k BIGINT, v STRING, _change_type STRING, _commit_version BIGINT, _commit_timestamp TIMESTAMP"
T0 = dt.datetime(2026, 1, 1)


def test_delete_then_insert_survives_and_the_latest_change_wins(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old"), (3, "keep")], "k BIGINT, v STRING")
    feed = spark.createDataFrame([(1, "old", "delete", 5, T0), (1, "again", "insert", 6, T0), (2, "a", "update_postimage", 5, T0), (2, "b", "update_postimage", 7, T0),
                                  (2, "x", "update_preimage", 8, T0), (4, "n", "insert", 5, T0), (4, "n", "delete", 9, T0)], FEED)
    assert sorted(map(tuple, rep.cdf_merge(target, feed, keys=["k"]).collect())) == [(1, "again"), (2, "b"), (3, "keep")]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(old=st.dictionaries(st.integers(0, 6), st.one_of(st.none(), st.text("ab", max_size=2)), max_size=6),
       new=st.dictionaries(st.integers(0, 6), st.one_of(st.none(), st.text("ab", max_size=2)), max_size=6))
def test_merging_the_extracted_feed_gives_the_new_table(spark, old, new):
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "k BIGINT, v STRING")
    feed = rep.cdf_extract(frame(old), frame(new), keys=["k"], version=3)
    assert {r["k"] for r in feed.collect()} == {k for k in {*old, *new} if (k in old, old.get(k)) != (k in new, new.get(k))}
    stamped = feed.withColumn("_commit_timestamp", F.lit(None).cast("timestamp"))
    assert {r["k"]: r["v"] for r in rep.cdf_merge(frame(old), stamped, keys=["k"]).collect()} == new


def test_swapped_null_and_value_columns_are_a_change(spark):
    schema = "k INT, a STRING, b STRING"
    feed = rep.cdf_extract(spark.createDataFrame([(1, "x", None)], schema), spark.createDataFrame([(1, None, "x")], schema), keys=["k"], version=1)
    assert feed.count() == 1


def write_log(root, table, commits):
    folder = root / "Tables" / table / "_delta_log"
    folder.mkdir(parents=True)
    for version, lines in commits.items():
        (folder / f"{version:020d}.json").write_text("\n".join(lines))
    (folder / "00000000000000000002.checkpoint.parquet").write_text("not json")
    (folder / "_last_checkpoint").write_text("{}")


def test_commit_files_are_read_and_checkpoints_left_out(spark, tmp_path):
    add = lambda p: json.dumps({"add": {"path": p, "size": 3}})
    info = json.dumps({"commitInfo": {"operation": "WRITE", "inCommitTimestamp": 5, "parameters": {"mode": "Append"}}})
    write_log(tmp_path, "dbo/a", {0: [add("f0")], 1: [info, add("f1"), add("f2"), ""], 2: ["{broken"]})
    write_log(tmp_path, "b", {0: [json.dumps({"commitInfo": {"operation": "WRITE"}}), json.dumps({"remove": {"path": "gone"}})]})
    got = commit_log.read_commit_log(spark, str(tmp_path)).collect()
    assert {(r["table_key"], r["version"], r["add_path"]) for r in got if r["add_path"]} == {("dbo/a", 0, "f0"), ("dbo/a", 1, "f1"), ("dbo/a", 1, "f2")}
    assert {(r["table_key"], r["version"]) for r in got if r["unparsed"]} == {("dbo/a", 2)}
    assert {(r["table_key"], r["version"]) for r in got if r["has_ict"]} == {("dbo/a", 1)}
    assert all(r["commit_ts"] is not None for r in got) and {r["table_key"] for r in got} == {"dbo/a", "b"}


def test_increment_falls_back_when_there_is_no_state_or_a_commit_does_not_parse(spark):
    log = spark.createDataFrame([(1, "a", v, f"f{v}", True, False) for v in range(4)] + [(1, "b", 0, "g", True, False), (1, "c", 0, "h", True, False), (1, "c", 1, None, True, True)],
                                "pair_id BIGINT, table_key STRING, version BIGINT, add_path STRING, is_commit BOOLEAN, unparsed BOOLEAN")
    state = spark.createDataFrame([(1, "a", 1), (1, "c", 0)], "pair_id BIGINT, table_key STRING, last_version BIGINT")
    got = {r["table_key"]: (r["method"], r["new_version"], r["new_commits"], r["new_files"]) for r in rep.log_incremental(log, state).collect()}
    assert got == {"a": ("commit_log", 3, 2, 2), "b": ("file_listing_fallback", 0, -1, -1), "c": ("file_listing_fallback", 1, -1, -1)}
    assert {r["add_path"] for r in rep.new_files(log, state).filter("table_key = 'a'").collect()} == {"f2", "f3"}


def test_sync_modes_and_the_gate(spark):
    versions = spark.createDataFrame([(1, "new", 4), (1, "same", 4), (1, "moved", 6), (2, "moved", 6)], "pair_id BIGINT, table_key STRING, version BIGINT")
    state = spark.createDataFrame([(1, "same", 4), (1, "moved", 4), (2, "moved", 4)], "pair_id BIGINT, table_key STRING, last_version BIGINT")
    gate = spark.createDataFrame([(1, "pass"), (2, "fail")], "pair_id BIGINT, integrity_status STRING")
    modes = lambda mode: {(r["pair_id"], r["table_key"]): r["sync_mode"] for r in rep.sync_mode(versions, state, gate, mode=mode).collect()}
    assert modes("auto") == {(1, "new"): "full", (1, "same"): "up_to_date", (1, "moved"): "incremental", (2, "moved"): "blocked_integrity"}
    assert set(modes("full").values()) == {"full"}


def test_state_does_not_advance_on_errors(spark):
    state = spark.createDataFrame([("a", 1), ("b", 1)], "t STRING, v INT")
    run = spark.createDataFrame([("a", 5, 0), ("b", 5, 2), ("c", 5, 0)], "t STRING, v INT, errors INT")
    assert sorted(map(tuple, rep.advance_state(state, run, keys=["t"]).collect())) == [("a", 5), ("b", 1), ("c", 5)]


EVENT = "table_key STRING, event_id BIGINT, ts TIMESTAMP"


def drain(events, state, cap):
    taken = []
    while True:
        batch, state = rep.watermark_replicate(events, state, cap=cap)
        state = materialize(state)
        got = [r["event_id"] for r in batch.collect()]
        if not got:
            return taken
        taken.append(got)


def test_capped_batches_lose_nothing_at_ties(spark):
    at = lambda s: T0 + dt.timedelta(milliseconds=s)
    events = spark.createDataFrame([("a", i, at(i // 4)) for i in range(16)] + [("b", 100 + i, at(i * 4000000)) for i in range(5)], EVENT)
    batches = drain(events, spark.createDataFrame([], "table_key STRING, last_ts TIMESTAMP"), cap=6)
    assert sorted(e for b in batches for e in b) == [*range(16), *range(100, 105)]
    assert len([e for e in batches[0] if e < 100]) == 8  # six rows, and the two that share the time of the sixth


def test_cut_points_agree_with_a_rank_when_one_table_holds_most_rows(spark):
    events = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("table_key"), F.col("id").alias("event_id"),
                                      F.timestamp_micros((F.col("id") * 7919 % 5000) * 977777).alias("ts"))
    from pyspark.sql import Window

    rank = F.rank().over(Window.partitionBy("table_key").orderBy("ts"))
    for cap in (1, 1999, 2001, 9000):
        want = {tuple(r) for r in events.withColumn("r", rank).filter(F.col("r") <= cap).select("table_key", "event_id").collect()}
        batch, _ = rep.watermark_replicate(events, spark.createDataFrame([], "table_key STRING, last_ts TIMESTAMP"), cap=cap)
        assert {tuple(r) for r in batch.select("table_key", "event_id").collect()} == want


def test_first_run_and_watermark(spark):
    events = spark.createDataFrame([("a", 1, T0), ("a", 2, T0 + dt.timedelta(1)), ("b", 3, T0)], EVENT)
    state = spark.createDataFrame([("a", T0)], "table_key STRING, last_ts TIMESTAMP")
    batch, after = rep.watermark_replicate(events, state)
    assert sorted((r["event_id"], r["first_run"]) for r in batch.collect()) == [(2, False), (3, True)]
    assert {r["table_key"]: r["last_ts"] for r in after.collect()} == {"a": T0 + dt.timedelta(1), "b": T0}


def test_time_column_and_key_rules(spark):
    columns = spark.createDataFrame([("a", "x", "string", 1), ("a", "UpdatedAt", "datetime", 2), ("a", "EventTime", " DateTime ", 3), ("b", "t1", "datetime", 2), ("b", "t0", "datetime", 1),
                                     ("c", "Timestamp", "string", 1), ("c", "ID", "long", 2), ("c", "pk", "long", 3)], "t STRING, column_name STRING, column_type STRING, pos INT")
    assert {r["t"]: r["ts_col"] for r in rep.detect_time_column(columns, by=["t"]).collect()} == {"a": "EventTime", "b": "t0", "c": None}
    assert {(r["t"], r["column_name"]) for r in rep.infer_keys(columns, by=["t"]).collect()} == {("a", "x"), ("b", "t0"), ("c", "ID"), ("c", "pk")}
    assert rep.time_column(spark.createDataFrame([], "a TIMESTAMP, CreatedAt TIMESTAMP_NTZ, n INT")) == "CreatedAt"


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts")).write.parquet(str(tmp_path / "t"))
    out = rep.incremental_filter(spark.read.parquet(str(tmp_path / "t")), ts_col="ts", watermark=dt.datetime(1970, 1, 1, 0, 1))
    assert out.count() == 39 and "PushedFilters: [IsNotNull(ts), GreaterThan(ts" in out._jdf.queryExecution().executedPlan().toString()
    assert rep.incremental_filter(out, ts_col="ts", watermark=None) is out


def test_full_sync_copies_schema_and_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a", [1, 2])], "k INT, v STRING, l ARRAY<INT>").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(9,)], "other INT").write.parquet(str(tmp_path / "d"))
    copy = rep.full_sync(spark, str(tmp_path / "s"), str(tmp_path / "d"))
    assert copy.columns == ["k", "v", "l"] and [tuple(r) for r in copy.collect()] == [(1, "a", [1, 2])]


def test_delimited_text_keeps_every_value(spark):
    rows = [(1, 'a,b;"c"'), (2, ""), (3, None), (4, " lead\\ and trail "), (5, "two\nlines"), (6, "\\N!")]
    df = spark.createDataFrame(rows, "k INT, v STRING")
    assert sorted(map(tuple, from_delimited(to_delimited(df), df.schema).collect())) == rows


def test_listing_of_real_folders(spark, tmp_path):
    for p in ("Tables/a/_delta_log/0.json", "Tables/a/part-0.parquet", "Tables/s/b/_delta_log/0.json", "Tables/_x/_delta_log/0.json", "Files/raw/f.bin"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = listing.read_listing(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"((?:Tables|Files)/.*)$", 1)).withColumn("lakehouse", F.lit("lh"))
    assert "content" not in found.columns
    got = {(r["table_path"], r["table_key"], r["layout"]) for r in listing.discover_tables(found).collect()}
    assert got >= {("a", "a", "flat"), ("s/b", "s.b", "schema")} and all(not t.startswith("_") for t, _, _ in got)


def test_rows_without_a_time_are_not_lost(spark, rows):
    schema = "table_key STRING, k INT, ts TIMESTAMP"
    at = lambda d: dt.datetime(2024, 1, d)
    events = spark.createDataFrame([("t", 1, at(1)), ("t", 2, None), ("t", 3, at(2)), ("t", 4, at(3)), ("n", 5, None)], schema)
    none = spark.createDataFrame([], "table_key STRING, last_ts TIMESTAMP")
    for cap in (None, 2):
        batch, state = rep.watermark_replicate(events, none, cap=cap)
        assert rows(batch, "k") == [(k,) for k in ((1, 2, 3, 4, 5) if cap is None else (1, 2, 3, 5))]
        assert dict(rows(state)) == {"t": at(3) if cap is None else at(2), "n": None}
    late = events.unionByName(spark.createDataFrame([("t", 6, None), ("n", 7, None)], schema))
    batch, after = rep.watermark_replicate(late, spark.createDataFrame(state.collect(), state.schema), target=events, keys=["k"], cap=2)
    assert rows(batch, "k") == [(4,), (6,), (7,)] and dict(rows(after)) == {"t": at(3), "n": None}


def test_state_keeps_one_row_and_does_not_go_back(spark, rows):
    schema = "k INT, last_version INT, note STRING"
    state = spark.createDataFrame([(1, 5, "old"), (2, 5, "old"), (None, 1, "old")], schema)
    new = spark.createDataFrame([(1, 3, "new"), (2, 6, "new"), (2, 7, "newer"), (3, None, "new"), (None, 1, "new")], schema)
    assert rows(rep.state_upsert(state, new, keys=["k"])) == sorted([(1, 5, "old"), (2, 7, "newer"), (3, None, "new"), (None, 1, "new")], key=repr)
    assert (1, 3, "new") in rows(rep.state_upsert(state, new, keys=["k"], may_go_back=True))


def test_failback_finds_deletions(spark, rows):
    schema = "k INT, v STRING, ts TIMESTAMP"
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    p = spark.createDataFrame([(1, "a", old), (2, "b", old), (3, "c", old)], schema)
    s = spark.createDataFrame([(1, "a2", new), (4, "d", new)], schema)
    held = spark.createDataFrame([(1,), (2,)], "k INT")
    feed = rep.reverse_sync(p, s, keys=["k"], ts_col="ts", since=dt.datetime(2024, 1, 15), before=held)
    assert rows(feed, "k", "_change_type") == [(1, "update_postimage"), (2, "delete"), (4, "insert")]


def test_late_increment_takes_the_same_row_each_time(spark, rows):
    events = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k INT, v STRING")
    target = spark.createDataFrame([(2, "c")], "k INT, v STRING")
    once = [rows(rep.late_safe_increment(events.repartition(n), target, keys=["k"])) for n in (1, 3)]
    assert once[0] == once[1] and len(once[0]) == 1
