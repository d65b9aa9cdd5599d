"""Queries on the keyed table pair: reconcile, presence, schema merge."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tandem.operators import freshness as fr
from tandem.operators import reconcile as rec
from tandem.operators import replicate as rep
from tandem.plans.registry import query
from tandem.session import new_folder
from tandem.sources.delimited import from_delimited, to_delimited

COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("drift_items", """
SELECT coalesce(p.o_orderkey, s.o_orderkey) AS o_orderkey,
  CASE WHEN s.o_orderkey IS NULL THEN 'missing_in_secondary' WHEN p.o_orderkey IS NULL THEN 'extra_in_secondary'
       WHEN p.o_custkey IS NOT DISTINCT FROM s.o_custkey AND p.o_orderstatus IS NOT DISTINCT FROM s.o_orderstatus
        AND p.o_totalprice IS NOT DISTINCT FROM s.o_totalprice AND p.o_orderdate IS NOT DISTINCT FROM s.o_orderdate
        AND p.o_orderpriority IS NOT DISTINCT FROM s.o_orderpriority THEN 'in_sync' ELSE 'mismatch' END AS state,
  p.o_totalprice AS p_o_totalprice, s.o_totalprice AS s_o_totalprice, p.o_custkey AS p_o_custkey, s.o_custkey AS s_o_custkey
FROM f1_p p FULL OUTER JOIN f1_s s ON p.o_orderkey = s.o_orderkey""")
def drift_items(f):
    rows = rec.reconcile(f["f1_p"], f["f1_s"], keys=["o_orderkey"], compare=COLUMNS, partition=(), unique=True)
    return rows.select("o_orderkey", "state", "p_o_totalprice", "s_o_totalprice", "p_o_custkey", "s_o_custkey")


@query("table_presence", """
SELECT o_custkey, cast(sum(p) AS BIGINT) AS primary_rows, cast(sum(s) AS BIGINT) AS secondary_rows,
  sum(p) > 0 AS in_primary, sum(s) > 0 AS in_secondary
FROM (SELECT o_custkey, 1 AS p, 0 AS s FROM f1_p UNION ALL SELECT o_custkey, 0 AS p, 1 AS s FROM f1_s) GROUP BY o_custkey""")
def table_presence(f):
    return rec.presence(f["f1_p"], f["f1_s"], keys=["o_custkey"])


@query("schema_merge", """
SELECT o_orderkey, o_custkey, o_orderstatus, NULL::DOUBLE AS o_totalprice, cast(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM f1_p
UNION ALL SELECT o_orderkey, o_custkey, NULL AS o_orderstatus, o_totalprice, cast(o_orderdate AS VARCHAR), o_orderpriority FROM f1_s""")
def schema_merge(f):
    merged = rec.merge_schema(f["f1_p"].drop("o_totalprice"), f["f1_s"].drop("o_orderstatus"))
    return merged.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("incremental_filter", """
SELECT o_orderkey, o_totalprice, cast(o_orderdate AS VARCHAR) AS o_orderdate FROM f1_p WHERE o_orderdate > TIMESTAMP '1998-06-01 00:00:00'""")
def incremental_filter(f):
    rows = rep.incremental_filter(f["f1_p"], ts_col="o_orderdate", watermark=dt.datetime(1998, 6, 1))
    return rows.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"))


@query("full_sync", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM f1_s")
def full_sync(f):
    source = new_folder(f.spark, "full-source")
    rep.write_table(f["f1_s"], source)
    return rep.full_sync(f.spark, source, new_folder(f.spark, "full-target")).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


_CHANGED = " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in COLUMNS)


@query("cdf_extract", f"""
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_custkey, o.o_custkey) AS o_custkey,
  CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END AS o_totalprice,
  CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update_postimage' END AS _change_type,
  7::BIGINT AS _commit_version
FROM f1_s o FULL OUTER JOIN f1_p n ON n.o_orderkey = o.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR {_CHANGED}""")
def cdf_extract(f):
    feed = rep.cdf_extract(f["f1_s"], f["f1_p"], keys=["o_orderkey"], version=7)
    return feed.select("o_orderkey", "o_custkey", "o_totalprice", "_change_type", "_commit_version")


@query("cdf_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM f1_p")
def cdf_round_trip(f):
    old, new = f["f1_s"], f["f1_p"]
    feed = rep.cdf_extract(old, new, keys=["o_orderkey"], version=1).withColumn("_commit_timestamp", F.lit(None).cast("timestamp"))
    return rep.cdf_merge(old, feed, keys=["o_orderkey"]).withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("reverse_sync", f"""
SELECT n.o_orderkey, n.o_totalprice, CASE WHEN o.o_orderkey IS NULL THEN 'insert' ELSE 'update_postimage' END AS _change_type
FROM f1_s n LEFT JOIN f1_p o ON n.o_orderkey = o.o_orderkey
WHERE n.o_orderdate > TIMESTAMP '1999-01-01 00:00:00' AND (o.o_orderkey IS NULL OR {_CHANGED})
UNION ALL SELECT o_orderkey, o_totalprice, 'delete' FROM f1_p WHERE o_custkey % 5 <> 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM f1_s)""")
def reverse_sync(f):
    held = f["f1_p"].filter("o_custkey % 5 <> 0").select("o_orderkey")
    feed = rep.reverse_sync(f["f1_p"], f["f1_s"], keys=["o_orderkey"], ts_col="o_orderdate", since=dt.datetime(1999, 1, 1), before=held)
    return feed.select("o_orderkey", "o_totalprice", "_change_type")


def _counts(f, side):
    version = F.max("o_orderdate").cast("date") if side == "p" else F.max(F.when(F.col("o_custkey") % 50 != 0, F.col("o_orderdate"))).cast("date")
    rows = f[f"f1_{side}"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("row_count"), F.datediff(version, F.lit("1990-01-01")).cast("bigint").alias("version"))
    return rows.withColumn("row_count", F.when(F.col("o_custkey") % 70 != (1 if side == "p" else 2), F.col("row_count")))


_INTEGRITY = """
  (SELECT o_custkey, p.n AS primary_rows, p.v AS primary_version, s.n AS secondary_rows, s.v AS secondary_version, abs(p.n - s.n) AS variance,
    CASE WHEN p.n IS NULL THEN 'primary_read_error' WHEN s.n IS NULL THEN 'secondary_read_error'
         WHEN p.n = s.n AND p.v IS NOT DISTINCT FROM s.v THEN 'pass' WHEN p.n = s.n THEN 'info'
         WHEN abs(p.n - s.n) * 100.0 / greatest(p.n, 1) <= 10 THEN 'info' ELSE 'fail' END AS status
   FROM (SELECT o_custkey, CASE WHEN o_custkey % 70 <> 1 THEN count(*) END AS n,
           date_diff('day', DATE '1990-01-01', cast(max(o_orderdate) AS DATE)) AS v FROM f1_p GROUP BY o_custkey) p
   LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 70 <> 2 THEN count(*) END AS n,
           date_diff('day', DATE '1990-01-01', cast(max(CASE WHEN o_custkey % 50 <> 0 THEN o_orderdate END) AS DATE)) AS v FROM f1_s GROUP BY o_custkey) s
   USING (o_custkey))"""


@query("row_integrity", f"SELECT * FROM {_INTEGRITY}")
def row_integrity(f):
    return fr.row_integrity(_counts(f, "p"), _counts(f, "s"), keys=["o_custkey"], tolerance_pct=10.0)


@query("integrity_rollup", f"""
SELECT o_custkey % 8 AS pair_id, count(*) AS tables_checked, count(*) FILTER (status IN ('pass', 'info')) AS tables_passed,
  count(*) FILTER (status NOT IN ('pass', 'info', 'unknown')) AS tables_failed,
  CASE WHEN count(*) FILTER (status NOT IN ('pass', 'info', 'unknown')) > 0 THEN 'fail' ELSE 'pass' END AS integrity_status
FROM {_INTEGRITY} GROUP BY 1""")
def integrity_rollup(f):
    checks = fr.row_integrity(_counts(f, "p"), _counts(f, "s"), keys=["o_custkey"], tolerance_pct=10.0)
    return fr.integrity_rollup(checks.withColumn("pair_id", F.col("o_custkey") % 8), by=["pair_id"])


@query("table_checksum", """
SELECT o_custkey, coalesce(p.n = s.n AND p.h IS NOT DISTINCT FROM s.h, false) AS same, p.n AS p_rows, s.n AS s_rows
FROM (SELECT o_custkey, count(*) AS n, md5(string_agg(concat_ws('|', o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority), ';' ORDER BY o_orderkey)) AS h FROM f1_p WHERE o_custkey % 31 <> 4 GROUP BY o_custkey) p
FULL JOIN (SELECT o_custkey, count(*) AS n, md5(string_agg(concat_ws('|', o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority), ';' ORDER BY o_orderkey)) AS h FROM f1_s WHERE o_custkey % 31 <> 7 GROUP BY o_custkey) s USING (o_custkey)""")
def table_checksum(f):
    part = {"p": f["f1_p"].filter("o_custkey % 31 <> 4"), "s": f["f1_s"].filter("o_custkey % 31 <> 7")}
    side = lambda name: rep.table_checksum(part[name], by=["o_custkey"]).select(
        "o_custkey", F.col("row_count").alias(f"{name}_rows"), F.col("checksum").alias(f"{name}_sum"))
    return side("p").join(side("s"), "o_custkey", "full").select("o_custkey", F.coalesce(F.col("p_sum") == F.col("s_sum"), F.lit(False)).alias("same"), "p_rows", "s_rows")


_LATEST = """
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _commit_version DESC, _commit_timestamp DESC) AS rn
   FROM f4_feed WHERE _change_type IN ('insert', 'update_postimage', 'delete')) WHERE rn = 1)"""


@query("cdf_latest", f"SELECT user_id, value, _commit_version, _change_type FROM {_LATEST}")
def cdf_latest(f):
    return rep.cdf_latest(f["f4_feed"], keys=["user_id"]).select("user_id", "value", "_commit_version", "_change_type")


@query("cdf_merge", f"""
SELECT user_id, value FROM {_LATEST} WHERE _change_type <> 'delete'
UNION ALL SELECT user_id, value FROM f4_target t WHERE NOT EXISTS (SELECT 1 FROM {_LATEST} l WHERE l.user_id = t.user_id)""")
def cdf_merge(f):
    return rep.cdf_merge(f["f4_target"], f["f4_feed"], keys=["user_id"])


_PENDING = """
  (SELECT e.*, st.last_ts IS NULL AS first_run FROM f5_p e LEFT JOIN f5_state st USING (table_key)
   WHERE st.last_ts IS NULL OR e.ts > st.last_ts OR (e.ts IS NULL AND e.event_id % 2 = 1))"""


def _loaded(f):
    """What the target holds of the rows without a time."""
    return f["f5_p"].filter("ts IS NULL AND event_id % 2 = 0").select("table_key", "event_id", "ts")


def _next_batch(f, **limits):
    return rep.watermark_replicate(f["f5_p"], f["f5_state"], target=_loaded(f), keys=["event_id"], **limits)



@query("watermark_replicate", f"""
SELECT table_key, event_id, user_id, value, props, cast(ts AS VARCHAR) AS ts, first_run FROM {_PENDING}""")
def watermark_replicate(f):
    batch, _ = _next_batch(f)
    return batch.withColumn("ts", F.col("ts").cast("string"))


@query("watermark_state", f"""
SELECT table_key, cast(greatest(max(last_ts), coalesce(max(ts), max(last_ts))) AS VARCHAR) AS last_ts FROM (
  SELECT table_key, last_ts, NULL::TIMESTAMP AS ts FROM f5_state UNION ALL SELECT table_key, NULL, ts FROM {_PENDING}) GROUP BY table_key""")
def watermark_state(f):
    _, state = _next_batch(f)
    return state.withColumn("last_ts", F.col("last_ts").cast("string"))


@query("capped_batch", f"""
SELECT table_key, event_id, cast(ts AS VARCHAR) AS ts FROM (
  SELECT *, rank() OVER (PARTITION BY table_key ORDER BY ts NULLS LAST) AS r FROM {_PENDING}) WHERE r <= 300 OR ts IS NULL""")
def capped_batch(f):
    batch, _ = _next_batch(f, cap=300)
    return batch.select("table_key", "event_id", F.col("ts").cast("string").alias("ts"))


@query("csv_roundtrip", "SELECT event_id, table_key, props, value, user_id, cast(ts AS VARCHAR) AS ts FROM f5_p")
def csv_roundtrip(f):
    rows = f["f5_p"].select("event_id", "table_key", "props", "value", "user_id", "ts")
    return from_delimited(to_delimited(rows), rows.schema).withColumn("ts", F.col("ts").cast("string"))


@query("detect_ts_column", """
SELECT table_no, coalesce(min(CASE WHEN t AND column_name = 'Timestamp' THEN column_name END), min(CASE WHEN t AND column_name = 'CreatedAt' THEN column_name END),
  min_by(column_name, pos) FILTER (t)) AS ts_col
FROM (SELECT *, lower(column_type) = 'datetime' AS t FROM f13_columns) GROUP BY table_no""")
def detect_ts_column(f):
    return rep.detect_time_column(f["f13_columns"], by=["table_no"])


@query("infer_keys", """
SELECT table_no, column_name, CASE WHEN named THEN 'name' ELSE 'first_column' END AS rule FROM (
  SELECT *, lower(column_name) IN ('id', 'key', 'pk', 'row_id', 'claim_id', 'policy_id') AS named,
    bool_or(lower(column_name) IN ('id', 'key', 'pk', 'row_id', 'claim_id', 'policy_id')) OVER (PARTITION BY table_no) AS any_named,
    min(pos) OVER (PARTITION BY table_no) AS first_pos FROM f13_columns)
WHERE named OR (NOT any_named AND pos = first_pos)""")
def infer_keys(f):
    return rep.infer_keys(f["f13_columns"], by=["table_no"])


@query("event_sync_mode", """
SELECT table_key, ts_col, cast(last_ts AS VARCHAR) AS last_ts, CASE WHEN ts_col IS NULL THEN 'full' WHEN last_ts IS NULL THEN 'initial' ELSE 'incremental' END AS sync_mode,
  ts_col IS NULL OR last_ts IS NULL AS clears_target
FROM (SELECT table_no AS table_key, coalesce(min(CASE WHEN t AND column_name = 'Timestamp' THEN column_name END), min(CASE WHEN t AND column_name = 'CreatedAt' THEN column_name END),
    min_by(column_name, pos) FILTER (t)) AS ts_col FROM (SELECT *, lower(column_type) = 'datetime' AS t FROM f13_columns) GROUP BY table_no)
LEFT JOIN (SELECT o_custkey AS table_key, max(o_orderdate) AS last_ts FROM f1_p WHERE o_custkey % 4 <> 1 GROUP BY 1) USING (table_key)""")
def event_sync_mode(f):
    columns = f["f13_columns"].withColumnRenamed("table_no", "table_key")
    state = f["f1_p"].filter("o_custkey % 4 <> 1").groupBy(F.col("o_custkey").alias("table_key")).agg(F.max("o_orderdate").alias("last_ts"))
    return rep.event_sync_plan(columns, state).withColumn("last_ts", F.col("last_ts").cast("string"))
