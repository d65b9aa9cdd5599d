"""Streams: idempotent batches, late rows, compaction, catalog watch; files and catalog."""

import datetime as dt

from pyspark.sql import functions as F

from tandem.sources import mappings, reports
from tandem.streaming import jobs, log

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "k BIGINT, v STRING, ts TIMESTAMP"


def drop(spark, path, rows):
    spark.createDataFrame([(k, v, T0 + dt.timedelta(minutes=m)) for k, v, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_replica_takes_the_latest_row_and_restarts(spark, tmp_path):
    src, dst, check = tmp_path / "src", str(tmp_path / "dst"), str(tmp_path / "check")
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: jobs.stream_replicate(spark, str(src), dst, check, schema=schema, keys=["k"], ts_col="ts").awaitTermination()
    read = lambda where: {r["k"]: r["v"] for r in jobs.read_replica(spark, where, schema=schema, keys=["k"], ts_col="ts").collect()}
    drop(spark, src, [(1, "a", 0), (1, "b", 5), (2, "a", 1)])
    run()
    drop(spark, src, [(1, "old", 2), (2, "new", 9), (3, "a", 3)])
    run()
    run()
    assert read(dst) == {1: "b", 2: "new", 3: "a"}
    assert [(r["batch_id"], r["rows"]) for r in log.read_runs(spark, dst).orderBy("batch_id").collect()] == [(0, 2), (1, 3)]
    jobs.compact(spark, dst, str(tmp_path / "compact"), schema=schema, keys=["k"], ts_col="ts")
    assert read(str(tmp_path / "compact")) == read(dst)


def test_a_repeated_batch_changes_nothing_and_an_unlogged_one_is_not_read(spark, tmp_path):
    root = str(tmp_path / "log")
    batch = spark.createDataFrame([(1, "a", T0)], SCHEMA)
    assert log.read_batches(spark, root, SCHEMA).isEmpty()
    log.write_batch(batch, root, 0, ts_col="ts")
    log.write_batch(batch, root, 0, ts_col="ts")
    batch.write.parquet(f"{root}/data/batch_id=1")
    assert log.read_batches(spark, root, SCHEMA).count() == 1
    run = log.read_runs(spark, root).first()
    assert (run["rows"], run["late_rows"], run["status"]) == (1, 0, "ok") and run["max_ts"].startswith("2026-01-01")


def test_late_rows_are_kept_and_repeats_are_not(spark, tmp_path):
    src, dst, check = tmp_path / "src", str(tmp_path / "dst"), str(tmp_path / "check")
    schema = spark.createDataFrame([], SCHEMA).schema
    run = lambda: jobs.stream_late(spark, str(src), dst, check, schema=schema, keys=["k"], ts_col="ts").awaitTermination()
    drop(spark, src, [(1, "a", 100), (2, "a", 200)])
    run()
    drop(spark, src, [(3, "late", 5), (2, "a", 200), (4, "a", 300), (4, "a", 300)])
    run()
    rows = log.read_batches(spark, dst, SCHEMA + ", late BOOLEAN").collect()
    assert sorted((r["k"], r["late"]) for r in rows) == [(1, False), (2, False), (3, True), (4, False)]
    assert log.read_runs(spark, dst).agg(F.sum("late_rows")).first()[0] == 1


def test_mapping_files_and_precedence(spark, tmp_path):
    (tmp_path / "reference.csv").write_text("primary_reference,secondary_reference,reference_type\na,ref,WorkspaceId\nb,ref,Uri\n")
    (tmp_path / "artifact.csv").write_text("primary_artifact_id,secondary_artifact_id,artifact_type,primary_name,secondary_name\nb,art,Report,n,n\n")
    (tmp_path / "connection.csv").write_text("primary_connection_name,secondary_connection_name,connection_type\nc,\"con, quoted\",SQL\n")
    hosts = spark.createDataFrame([("a", "host"), ("h", "host")], "primary_ref STRING, secondary_ref STRING")
    got = mappings.read_mappings(spark, discovered=hosts, **{k: str(tmp_path / f"{k}.csv") for k in mappings.FILES})
    assert {r["primary_ref"]: (r["secondary_ref"], r["kind"]) for r in got.collect()} == {
        "a": ("ref", "reference"), "b": ("art", "artifact"), "c": ("con, quoted", "connection"), "h": ("host", "host")}


def test_tables_are_registered_and_errors_reported(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    tables = [("dr.t", str(tmp_path / "t")), ("dr.bad", str(tmp_path / "t"))]
    assert [r["status"] for r in reports.register_tables(spark, tables[:1]).collect()] == ["registered"]
    assert [r["status"] for r in reports.register_tables(spark, tables[:1]).collect()] == ["exists"]
    assert spark.table("dr.t").count() == 3
    assert [r["status"] for r in reports.register_tables(spark, tables[1:], source="nosuchformat").collect()] == ["error"]
    spark.sql("DROP SCHEMA dr CASCADE")
