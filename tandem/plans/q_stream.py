"""Queries that run a stream to its end and read what it wrote, and the file and catalog sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tandem.operators import reconcile as rec
from tandem.plans.registry import query
from tandem.session import new_folder
from tandem.sources import reports
from tandem.streaming import jobs, log


def _drain(stream) -> None:
    stream.awaitTermination()


@query("stream_replicate", "SELECT event_id, cast(ts AS VARCHAR) AS ts, user_id, event_type, value, props FROM events")
def stream_replicate(f):
    schema, dst, check = f.table("events").schema, new_folder(f.spark, "replica"), new_folder(f.spark, "check")
    _drain(jobs.stream_replicate(f.spark, f.sf_dir, dst, check, schema=schema, keys=["event_id"], ts_col="ts", glob="events.parquet"))
    return jobs.read_replica(f.spark, dst, schema=schema, keys=["event_id"], ts_col="ts").withColumn("ts", F.col("ts").cast("string"))


@query("stream_late", """
SELECT event_id, cast(ts AS VARCHAR) AS ts, value, ts < TIMESTAMP '2024-01-12 00:00:00' AS late FROM events""")
def stream_late(f):
    events = f.table("events")
    src, dst, check = (new_folder(f.spark, n) for n in ("late-source", "late-target", "check"))
    recent = F.col("ts") >= F.lit("2024-01-12").cast("timestamp_ntz")
    run = lambda: _drain(jobs.stream_late(f.spark, src, dst, check, schema=events.schema, keys=["event_id"], ts_col="ts"))
    events.filter(recent).write.parquet(f"{src}/", mode="append")
    run()
    # The second drop brings the older rows late, and rows that are there already.
    events.filter(~recent | (F.col("event_type") == "view")).write.parquet(f"{src}/", mode="append")
    run()
    return log.read_batches(f.spark, dst, log.schema_text(events) + ", late BOOLEAN").select("event_id", F.col("ts").cast("string").alias("ts"), "value", "late")


_WATCH = """
SELECT p.pair_id, p.item_type, p.display_name, CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 9 = 1 THEN 'changed' ELSE 'unchanged' END AS change,
  CASE WHEN e.n IS NOT NULL THEN 'in_sync' WHEN t.n IS NOT NULL THEN 'type_mismatch' ELSE 'missing_in_secondary' END AS state
FROM (SELECT * FROM f2_p WHERE k % 23 <> 4) p
LEFT JOIN (SELECT pair_id, item_type, display_name, count(*) AS n FROM f2_s GROUP BY 1, 2, 3) e USING (pair_id, item_type, display_name)
LEFT JOIN (SELECT pair_id, display_name, count(*) AS n FROM f2_s GROUP BY 1, 2) t ON t.pair_id = p.pair_id AND t.display_name = p.display_name
UNION ALL SELECT pair_id, item_type, display_name, 'removed', NULL FROM f2_p WHERE k % 23 = 4 AND k % 5 <> 0"""


@query("stream_drift", _WATCH)
def stream_drift(f):
    src, dst, check = (new_folder(f.spark, n) for n in ("snapshots", "drift", "check"))
    row = lambda df, n: df.select("pair_id", "item_type", "display_name", "item_id",
                                  F.md5(F.concat("item_id", F.when((F.lit(n) == 2) & (F.col("k") % 9 == 1), "2").otherwise("1"))).alias("definition_hash"),
                                  F.lit(n).cast("bigint").alias("snapshot_id"))
    first, second = row(f["f2_p"].filter("k % 5 <> 0"), 1), row(f["f2_p"].filter("k % 23 <> 4"), 2)
    run = lambda: _drain(jobs.stream_drift_watch(f.spark, src, dst, check, schema=first.schema, secondary=f["f2_s"]))
    first.write.parquet(src, mode="append")
    run()
    second.write.parquet(src, mode="append")
    run()
    return jobs.read_drift_watch(f.spark, dst).select("pair_id", "item_type", "display_name", "change", "state")


@query("run_history", """
SELECT pair_id, count(*) AS run_count, cast(sum(run_id) AS BIGINT) AS rows, cast(max(ended) AS VARCHAR) AS last_run, arg_max(status, (ended, run_id)) AS last_status,
  cast(max(ended) + INTERVAL 30 MINUTES AS VARCHAR) AS next_run FROM f13_runs GROUP BY 1""")
def run_history(f):
    runs = f["f13_runs"].select("pair_id", "run_id", "status", F.col("ended").alias("finished"), F.col("run_id").alias("rows"))
    rows = jobs.run_history(runs, by=["pair_id"], interval_minutes=30)
    return rows.withColumn("last_run", F.col("last_run").cast("string")).withColumn("next_run", F.col("next_run").cast("string"))


@query("report_files", """
SELECT fmt, state, count(*) AS rows, count(DISTINCT o_orderkey) AS keys FROM (
  SELECT coalesce(p.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'missing_in_secondary' WHEN p.o_orderkey IS NULL THEN 'extra_in_secondary'
    WHEN p.o_totalprice = s.o_totalprice THEN 'in_sync' ELSE 'mismatch' END AS state FROM f1_p p FULL OUTER JOIN f1_s s ON p.o_orderkey = s.o_orderkey), (VALUES ('csv'), ('json')) x(fmt)
GROUP BY 1, 2""")
def report_files(f):
    rows = rec.reconcile(f["f1_p"], f["f1_s"], keys=["o_orderkey"], compare=["o_totalprice"], partition=(), unique=True)
    parts = []
    for fmt in ("json", "csv"):
        path = new_folder(f.spark, f"report-{fmt}")
        reports.write_report(rows, path, source=fmt)
        reader = f.spark.read.schema(rows.schema)
        back = reader.option("header", "true").csv(path) if fmt == "csv" else reader.json(path)
        parts.append(back.withColumn("fmt", F.lit(fmt)))
    both = parts[0].unionByName(parts[1])
    return both.groupBy("fmt", "state").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("keys"))


@query("register_tables", """
SELECT 'f1_p' AS table_name, 'registered' AS status, count(*) AS rows FROM f1_p UNION ALL SELECT 'f1_s', 'registered', count(*) FROM f1_s""")
def register_tables(f):
    suffix = uuid.uuid4().hex
    tables = []
    for view in ("f1_p", "f1_s"):
        path = new_folder(f.spark, view)
        f[view].write.parquet(path)
        tables.append((f"{view}_{suffix}", path))
    done = reports.register_tables(f.spark, tables)
    counts = [f.spark.table(name).agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(name)) for name, _ in tables]
    return (done.join(counts[0].unionByName(counts[1]), "table_name")
            .select(F.replace("table_name", F.lit(f"_{suffix}"), F.lit("")).alias("table_name"), "status", "rows"))
