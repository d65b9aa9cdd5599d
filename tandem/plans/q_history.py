"""Queries on commit histories and listings: freshness, RPO, log increments, run history, readiness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tandem.operators import freshness as fr
from tandem.operators import replicate as rep
from tandem.operators import status as st
from tandem.plans.registry import query
from tandem.session import new_folder
from tandem.sources import commit_log, listing

_FRESH = """
  (SELECT *, CASE WHEN secondary_version IS NULL THEN 'missing_in_secondary' WHEN primary_version IS NULL THEN 'extra_in_secondary'
      WHEN secondary_version > primary_version THEN 'diverged' WHEN behind_hours IS NULL THEN 'unknown'
      WHEN behind_hours > 0.1 THEN 'behind' ELSE 'in_sync' END AS state
   FROM (SELECT coalesce(p.pair_id, s.pair_id) AS pair_id, coalesce(p.table_key, s.table_key) AS table_key, p.v AS primary_version, s.v AS secondary_version, p.ict AS in_commit_timestamps,
      CASE WHEN p.v = s.v THEN 0.0 WHEN s.v < p.v THEN round(greatest(epoch_us(p.t) - epoch_us(coalesce(b.commit_ts, p.first)), 0) / 3600000000.0::DOUBLE, 2) END AS behind_hours,
      coalesce(s.v < p.v AND b.commit_ts IS NULL, false) AS lag_is_lower_bound
    FROM (SELECT pair_id, table_key, max(version) AS v, max_by(commit_ts, version) AS t, max_by(has_ict, version) AS ict, min(commit_ts) AS first FROM f3_p GROUP BY 1, 2) p
    FULL OUTER JOIN (SELECT pair_id, table_key, max(version) AS v FROM f3_s GROUP BY 1, 2) s ON p.pair_id = s.pair_id AND p.table_key = s.table_key
    LEFT JOIN f3_p b ON b.pair_id = p.pair_id AND b.table_key = p.table_key AND b.version = s.v))"""
_RPO = f"""
  (SELECT pair_id, count(*) AS tables_compared, max(behind_hours) AS measured_rpo_hours, bool_or(lag_is_lower_bound) AS rpo_is_lower_bound,
    count(*) FILTER (NOT in_commit_timestamps) AS tables_without_in_commit_timestamps, count(*) FILTER (state = 'in_sync') AS in_sync,
    count(*) FILTER (state = 'behind') AS behind, count(*) FILTER (state = 'diverged') AS diverged, count(*) FILTER (state = 'missing_in_secondary') AS missing,
    count(*) FILTER (state = 'extra_in_secondary') AS extra, count(*) FILTER (state = 'unknown') AS unknown,
    percentile_disc(0.5) WITHIN GROUP (ORDER BY behind_hours DESC) AS median_lag_hours, count(*) FILTER (state = 'unknown') = 0 AS complete
   FROM {_FRESH} GROUP BY pair_id)"""


def _fresh(f):
    return fr.freshness(f["f3_p"], f["f3_s"])


@query("commit_log_scan", """
SELECT pair_id, table_key, version, 'part-' || cast(file_id AS VARCHAR) || '.parquet' AS add_path, has_ict, cast(commit_ts AS VARCHAR) AS commit_ts FROM f3_p""")
def commit_log_scan(f):
    commits = f["f3_p"]
    path = F.concat(F.lit("file:/lake/Tables/"), "table_key", F.lit("/_delta_log/"), F.lpad(F.col("version").cast("string"), 20, "0"), F.lit(".json"))
    info = F.to_json(F.struct(F.struct(F.lit("WRITE").alias("operation"), F.when(F.col("has_ict"), F.lit(1)).alias("inCommitTimestamp")).alias("commitInfo")))
    add = F.to_json(F.struct(F.struct(F.concat(F.lit("part-"), F.col("file_id").cast("string"), F.lit(".parquet")).alias("path"), F.lit(1).alias("size")).alias("add")))
    lines = commits.select("pair_id", "commit_ts", path.alias("file_path"), F.explode(F.array(info, add)).alias("line"))
    actions = commit_log.parse_commits(lines)
    return actions.groupBy("pair_id", "table_key", "version").agg(
        F.max("add_path").alias("add_path"), F.bool_or("has_ict").alias("has_ict"), F.max("commit_ts").cast("string").alias("commit_ts"))


@query("latest_commit", """
SELECT pair_id, table_key, max(version) AS version, cast(max_by(commit_ts, version) AS VARCHAR) AS commit_ts, max_by(has_ict, version) AS has_ict,
  cast(min(commit_ts) AS VARCHAR) AS first_ts FROM f3_p GROUP BY 1, 2""")
def latest_commit(f):
    rows = fr.latest_commit(f["f3_p"])
    return rows.withColumn("commit_ts", F.col("commit_ts").cast("string")).withColumn("first_ts", F.col("first_ts").cast("string"))


@query("freshness", f"SELECT * FROM {_FRESH}")
def freshness(f):
    return _fresh(f)


@query("rpo_summary", f"SELECT * FROM {_RPO}")
def rpo_summary(f):
    return fr.rpo_summary(_fresh(f))


def _log(f):
    return f["f3_p"].select("pair_id", "table_key", "version", F.concat(F.lit("part-"), F.col("file_id").cast("string")).alias("add_path"),
                            F.lit(True).alias("is_commit"), (F.col("file_id") % 997 == 5).alias("unparsed"))


@query("log_incremental", """
SELECT pair_id, table_key, method, new_version, CASE WHEN method = 'commit_log' THEN n ELSE -1 END AS new_commits,
  CASE WHEN method = 'commit_log' THEN nf ELSE -1 END AS new_files
FROM (SELECT pair_id, table_key, max(version) AS new_version, count(DISTINCT version) FILTER (version > last_version) AS n, count(DISTINCT file_id) FILTER (version > last_version) AS nf,
  CASE WHEN max(last_version) IS NULL OR bool_or(version > last_version AND file_id % 997 = 5) THEN 'file_listing_fallback' ELSE 'commit_log' END AS method
  FROM f3_p LEFT JOIN f3_state USING (pair_id, table_key) GROUP BY pair_id, table_key)""")
def log_incremental(f):
    return rep.log_incremental(_log(f), f["f3_state"])


@query("log_new_files", """
SELECT DISTINCT pair_id, table_key, 'part-' || cast(file_id AS VARCHAR) AS add_path FROM f3_p JOIN f3_state USING (pair_id, table_key) WHERE version > last_version""")
def log_new_files(f):
    return rep.new_files(_log(f), f["f3_state"])


#: Actions of the logs: every fourth file is removed three versions after it was added, every ninth comes back two versions later.
_ACTIONS = """
acts AS (SELECT pair_id, table_key, version, 'add' AS op, 'part-' || cast(file_id AS VARCHAR) AS path FROM f3_p
  UNION ALL SELECT pair_id, table_key, version + 3, 'remove', 'part-' || cast(file_id AS VARCHAR) FROM f3_p WHERE file_id % 4 = 0
  UNION ALL SELECT pair_id, table_key, version + 5, 'add', 'part-' || cast(file_id AS VARCHAR) FROM f3_p WHERE file_id % 36 = 0)"""


def _actions(f):
    rows = f["f3_p"].select("pair_id", "table_key", F.col("version").cast("bigint").alias("version"), "file_id",
                            F.concat(F.lit("part-"), F.col("file_id").cast("string")).alias("path"), F.lit(1).cast("bigint").alias("size"))
    later = lambda every, by, op: rows.filter(F.col("file_id") % every == 0).select("pair_id", "table_key", (F.col("version") + by).alias("version"), F.lit(op).alias("op"), "path", "size")
    return rows.select("pair_id", "table_key", "version", F.lit("add").alias("op"), "path", "size").unionByName(later(4, 3, "remove")).unionByName(later(36, 5, "add"))


def _exported(f):
    """The actions, written to the shared folder and read back."""
    actions, root = _actions(f), new_folder(f.spark, "commit-logs")
    commit_log.write_export(actions, root)
    return commit_log.read_export(f.spark, root, pair_type=actions.schema["pair_id"].dataType.simpleString())


@query("log_replay", f"""
WITH {_ACTIONS}, top_of AS (SELECT pair_id, table_key, max(version) - 2 AS v FROM f3_p GROUP BY 1, 2)
SELECT pair_id, table_key, path FROM acts JOIN top_of USING (pair_id, table_key) WHERE version <= v
GROUP BY 1, 2, 3 HAVING max_by(op, version * 2 + (op = 'add')::INT) = 'add'""")
def log_replay(f):
    actions = _exported(f)
    top = f["f3_p"].groupBy("pair_id", "table_key").agg(F.max("version").cast("bigint").alias("top"))
    half = top.select("pair_id", "table_key", F.floor(F.col("top") / 2).cast("bigint").alias("version"))
    # A checkpoint half way, and one beyond the version that is asked for.
    root = new_folder(f.spark, "checkpoints")
    kind = actions.schema["pair_id"].dataType.simpleString()
    commit_log.write_checkpoint(commit_log.active_files(actions, half), half, f"{root}/half")
    late = top.select("pair_id", "table_key", F.col("top").alias("version"))
    commit_log.write_checkpoint(commit_log.active_files(actions, late), late, f"{root}/late")
    saved = commit_log.read_checkpoint(f.spark, f"{root}/half", pair_type=kind).unionByName(commit_log.read_checkpoint(f.spark, f"{root}/late", pair_type=kind))
    at = top.select("pair_id", "table_key", (F.col("top") - 2).alias("version"))
    return commit_log.active_files(actions, at, saved).select("pair_id", "table_key", "path")


@query("log_copy_plan", f"""
WITH {_ACTIONS}, bad AS (SELECT DISTINCT pair_id, table_key FROM f3_p JOIN f3_state USING (pair_id, table_key) WHERE version > last_version AND file_id % 997 = 5),
st AS (SELECT s.pair_id, s.table_key, CASE WHEN b.pair_id IS NULL THEN last_version END AS last_version, last_sync FROM f3_state s LEFT JOIN bad b ON b.pair_id = s.pair_id AND b.table_key = s.table_key),
p AS (SELECT pair_id, table_key, path, max_by(op, version * 2 + (op = 'add')::INT) FILTER (version <= last_version) AS before,
  max_by(op, version * 2 + (op = 'add')::INT) AS now, bool_or(op = 'add' AND version > last_version) AS fresh
  FROM acts JOIN st USING (pair_id, table_key) WHERE last_version IS NOT NULL GROUP BY 1, 2, 3)
SELECT pair_id, table_key, 'commit_log' AS method, CASE WHEN now = 'add' THEN 'copy' ELSE 'delete' END AS action, path FROM p WHERE (now = 'add' AND fresh) OR (now = 'remove' AND before = 'add')
UNION ALL SELECT l.pair_id, l.table_key, 'file_listing', 'copy', 'part-' || cast(file_id AS VARCHAR) FROM f3_p l LEFT JOIN st ON st.pair_id = l.pair_id AND st.table_key = l.table_key
WHERE last_version IS NULL AND (last_sync IS NULL OR commit_ts > last_sync)""")
def log_copy_plan(f):
    state = f["f3_state"]
    bad = f["f3_p"].join(state.select("pair_id", "table_key", "last_version"), ["pair_id", "table_key"]).filter("version > last_version AND file_id % 997 = 5")
    files = f["f3_p"].select("pair_id", "table_key", F.concat(F.lit("part-"), F.col("file_id").cast("string")).alias("path"), F.col("commit_ts").alias("mtime"))
    return commit_log.copy_plan(_exported(f), state, files, failed=bad)


_MODE = """
SELECT v.pair_id, v.table_key, version, last_version, CASE WHEN g.integrity_status = 'fail' THEN 'blocked_integrity' WHEN last_version IS NULL OR last_version < 0 THEN 'full'
  WHEN version <= last_version THEN 'up_to_date' ELSE 'incremental' END AS sync_mode
FROM (SELECT pair_id, table_key, max(version) AS version FROM f3_p GROUP BY 1, 2) v LEFT JOIN f3_state USING (pair_id, table_key) LEFT JOIN f3_gate g USING (pair_id)"""


@query("sync_mode", _MODE)
def sync_mode(f):
    return rep.sync_mode(fr.latest_commit(f["f3_p"]), f["f3_state"], f["f3_gate"])


@query("state_upsert", """
SELECT pair_id, table_key, CASE WHEN n.v IS NULL OR o.last_version > n.v THEN o.last_version ELSE n.v END AS last_version,
  cast(CASE WHEN n.v IS NULL OR o.last_version > n.v THEN o.last_sync ELSE n.t END AS VARCHAR) AS last_sync
FROM f3_state o FULL OUTER JOIN (SELECT pair_id, table_key, max(version) AS v, max_by(commit_ts, version) AS t FROM f3_p GROUP BY 1, 2) n USING (pair_id, table_key)""")
def state_upsert(f):
    new = fr.latest_commit(f["f3_p"]).select("pair_id", "table_key", F.col("version").alias("last_version"), F.col("commit_ts").alias("last_sync"))
    return rep.state_upsert(f["f3_state"], new, keys=["pair_id", "table_key"]).withColumn("last_sync", F.col("last_sync").cast("string"))


NOW = "2001-08-02 00:30:00"
_LAG = f"""
  (SELECT pair_id, source AS lag_source, ended AS last_sync_ts, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ended)) / 60000000.0::DOUBLE, 1) AS lag_minutes
   FROM (SELECT pair_id, source, ended, row_number() OVER (PARTITION BY pair_id ORDER BY ended DESC,
           CASE source WHEN 'schedule' THEN 1 WHEN 'autosync' THEN 2 WHEN 'azcopy' THEN 3 ELSE 5 END) AS rn
         FROM f13_runs WHERE status = 'Completed') WHERE rn = 1)"""


def _lag(f):
    done = f["f13_runs"].filter("status = 'Completed'").select("pair_id", "source", F.col("ended").alias("ts"))
    return st.replication_lag(done, now=dt.datetime.fromisoformat(NOW))


@query("replication_lag", f"SELECT pair_id, lag_source, cast(last_sync_ts AS VARCHAR) AS last_sync_ts, lag_minutes FROM {_LAG}")
def replication_lag(f):
    return _lag(f).withColumn("last_sync_ts", F.col("last_sync_ts").cast("string"))


@query("lag_status", f"""
SELECT pair_id, pair_id <> 7 AS has_secondary, lag_minutes, artifact_drift, CASE WHEN pair_id = 7 THEN 'NO_DR' WHEN lag_minutes IS NULL THEN 'NEEDS_SYNC'
  WHEN lag_minutes <= 15 AND artifact_drift = 0 THEN 'HEALTHY' WHEN lag_minutes <= 60 THEN 'NEEDS_SYNC' ELSE 'STALE' END AS status
FROM (SELECT pair_id, CASE WHEN pair_id % 4 = 2 THEN NULL ELSE lag_minutes END AS lag_minutes, missing AS artifact_drift FROM {_LAG} JOIN {_RPO} USING (pair_id))""")
def lag_status(f):
    lags = _lag(f).join(fr.rpo_summary(_fresh(f)), "pair_id").select(
        "pair_id", (F.col("pair_id") != 7).alias("has_secondary"), F.when(F.col("pair_id") % 4 != 2, F.col("lag_minutes")).alias("lag_minutes"),
        F.col("missing").alias("artifact_drift"))
    return st.lag_status(lags)


_PAIRS = """
  (SELECT r.pair_id, primary_region, secondary_region, capacity_state AS secondary_capacity_state FROM f12_regions r JOIN f13_capacity USING (pair_id))"""
_CHECKS = f"""
  (SELECT pair_id, 'region' AS check_id, CASE WHEN primary_region = secondary_region THEN 'bad' ELSE 'ok' END AS level FROM {_PAIRS}
   UNION ALL SELECT pair_id, 'capacity', CASE WHEN secondary_capacity_state = '' THEN 'unknown' WHEN lower(secondary_capacity_state) = 'active' THEN 'ok' ELSE 'warn' END FROM {_PAIRS}
   UNION ALL SELECT pair_id, 'rpo', CASE WHEN measured_rpo_hours IS NULL THEN 'unknown' WHEN diverged > 0 THEN 'bad' WHEN measured_rpo_hours <= 1 THEN 'ok'
     WHEN measured_rpo_hours <= 24 THEN 'warn' ELSE 'bad' END FROM {_PAIRS} JOIN {_RPO} USING (pair_id)
   UNION ALL SELECT pair_id, 'items', CASE WHEN count(*) FILTER (s.k IS NULL AND p.item_type <> 'Warehouse') > 0 THEN 'warn' ELSE 'ok' END
     FROM f2_p p LEFT JOIN f2_s s USING (pair_id, item_type, display_name) GROUP BY pair_id
   UNION ALL SELECT pair_id, x.c, 'unknown' FROM {_PAIRS}, (VALUES ('models'), ('schedules'), ('perms'), ('refs'), ('gateways')) x(c))"""


def _checks(f):
    pairs = f["f12_regions"].join(f["f13_capacity"], "pair_id").withColumnRenamed("capacity_state", "secondary_capacity_state")
    return st.readiness_checks(pairs, rpo=fr.rpo_summary(_fresh(f)), coverage_rows=st.coverage(f["f2_p"], f["f2_s"]))


@query("readiness_checks", f"SELECT * FROM {_CHECKS}")
def readiness_checks(f):
    return _checks(f)


_NINE = """
  (SELECT pair_id, 'region' AS check_id, CASE WHEN primary_region = secondary_region THEN 'bad' ELSE 'ok' END AS level FROM f14_pairs
   UNION ALL SELECT pair_id, 'capacity', CASE secondary_capacity_state WHEN '' THEN 'unknown' WHEN 'Active' THEN 'ok' ELSE 'warn' END FROM f14_pairs
   UNION ALL SELECT pair_id, x.check_id, x.level FROM (
     SELECT pair_id, max(measured_rpo_hours) AS h, max(diverged) AS d, sum(CASE WHEN supported THEN primary_count - mirrored_count END) AS gap, count(*) FILTER (NOT ready) AS idle,
       count(*) FILTER (schedule_action <> 'present' OR enabled_on_secondary) AS todo, count(*) FILTER (share_action <> 'already_present') AS shares, count(*) FILTER (status = 'stale') AS stale,
       count(*) FILTER (level = 'bad') AS n_bad, count(*) FILTER (level <> 'ok') AS n_open FROM f14_facts GROUP BY pair_id) f,
     LATERAL (VALUES ('rpo', CASE WHEN h IS NULL THEN 'unknown' WHEN d > 0 THEN 'bad' WHEN h <= 1 THEN 'ok' WHEN h <= 24 THEN 'warn' ELSE 'bad' END),
       ('items', CASE WHEN gap IS NULL THEN 'unknown' WHEN gap > 0 THEN 'warn' ELSE 'ok' END), ('models', CASE WHEN idle > 0 THEN 'bad' ELSE 'ok' END),
       ('schedules', CASE WHEN todo > 0 THEN 'warn' ELSE 'ok' END), ('perms', CASE WHEN shares > 0 THEN 'warn' ELSE 'ok' END), ('refs', CASE WHEN stale > 0 THEN 'bad' ELSE 'ok' END),
       ('gateways', CASE WHEN n_bad > 0 THEN 'bad' WHEN n_open > 0 THEN 'warn' ELSE 'ok' END)) x(check_id, level))"""


@query("readiness", f"""
SELECT v.*, h.hours AS expected_data_loss_hours FROM (
  SELECT pair_id, ok, warn, bad, unknown, CASE WHEN bad > 0 THEN 'NO-GO' WHEN blind > 0 THEN 'CAN''T ASSESS' WHEN warn > 0 OR unknown > 0 THEN 'GO WITH RISK' ELSE 'GO' END AS verdict FROM (
    SELECT pair_id, count(*) FILTER (level = 'ok') AS ok, count(*) FILTER (level = 'warn') AS warn, count(*) FILTER (level = 'bad') AS bad,
      count(*) FILTER (level = 'unknown') AS unknown, count(*) FILTER (level = 'unknown' AND check_id IN ('region', 'rpo', 'items', 'models', 'refs')) AS blind
    FROM {_NINE} GROUP BY pair_id)) v
LEFT JOIN (SELECT pair_id, max(measured_rpo_hours) AS hours FROM f14_facts GROUP BY pair_id) h USING (pair_id)""")
def readiness(f):
    facts = f["f14_facts"]
    checks = st.readiness_checks(
        f["f14_pairs"], rpo=facts, coverage_rows=facts, models=facts, schedules=facts.withColumn("action", F.col("schedule_action")),
        shares=facts.withColumn("action", F.col("share_action")), lineage=facts, gateways=facts)
    return st.readiness(checks, rpo=facts)


@query("sync_totals", """
SELECT pair_id, count(*) AS tables, cast(sum(n) AS BIGINT) AS rows, cast(sum(files) AS BIGINT) AS files, cast(sum(e) AS BIGINT) AS errors FROM (
  SELECT pair_id, table_key, count(*) AS n, count(DISTINCT file_id) AS files, count(*) FILTER (NOT has_ict) AS e FROM f3_p GROUP BY 1, 2) GROUP BY pair_id""")
def sync_totals(f):
    results = (f["f3_p"].groupBy("pair_id", "table_key", "file_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_ict")).alias("e"))
               .groupBy("pair_id", "table_key").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("e").alias("errors"))
               .withColumn("tables", F.lit(1)))
    return st.sync_totals(results, by=["pair_id"], measures=["tables", "rows", "files", "errors"])


@query("recent_events", """
SELECT pair_id, run_id, source, status, cast(started AS VARCHAR) AS started, position FROM (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY started DESC, run_id DESC) AS position FROM f13_runs) WHERE position <= 50""")
def recent_events(f):
    rows = st.recent(f["f13_runs"], by=["pair_id"], order=["started", "run_id"], n=50)
    return rows.select("pair_id", "run_id", "source", "status", F.col("started").cast("string").alias("started"), "position")


@query("rto_metrics", """
SELECT pair_id, source, count(*) AS runs, count(*) FILTER (status = 'Completed') AS succeeded,
  round(avg((epoch_us(ended) - epoch_us(started)) / 1000000.0::DOUBLE), 3) AS avg_rto_seconds,
  max_by((epoch_us(ended) - epoch_us(started)) / 1000000.0::DOUBLE, (started, run_id)) AS last_rto_seconds, max_by(status = 'Completed', (started, run_id)) AS last_success
FROM f13_runs GROUP BY 1, 2""")
def rto_metrics(f):
    return st.dr_event_metrics(f["f13_runs"])


@query("last_job", """
SELECT item_id, run_id, status, cast(ended AS VARCHAR) AS ended FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ended DESC, run_id DESC) AS rn FROM f13_runs WHERE status = 'Completed') WHERE rn = 1""")
def last_job(f):
    rows = st.latest_per(f["f13_runs"].filter("status = 'Completed'"), by=["item_id"], order=["ended", "run_id"], keep=["run_id", "status", "ended"])
    return rows.withColumn("ended", F.col("ended").cast("string"))


_TABLE_OF = "regexp_extract(path, '^Tables/([^/_][^/]*(?:/[^/_][^/]*)?)/_delta_log/', 1)"


@query("discover_tables", f"""
SELECT DISTINCT lakehouse, t AS table_path, replace(t, '/', '.') AS table_key, CASE WHEN t LIKE '%/%' THEN 'schema' ELSE 'flat' END AS layout
FROM (SELECT lakehouse, {_TABLE_OF} AS t FROM f11_p) WHERE t <> ''""")
def discover_tables(f):
    return listing.discover_tables(f["f11_p"])


@query("dir_summary", """
SELECT lakehouse, side, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes
FROM (SELECT *, 'primary' AS side FROM f11_p UNION ALL SELECT *, 'secondary' AS side FROM f11_s) GROUP BY 1, 2""")
def dir_summary(f):
    return listing.dir_summary(f["f11_p"].withColumn("side", F.lit("primary")).unionByName(f["f11_s"].withColumn("side", F.lit("secondary"))))


@query("mtime_plan", """
SELECT lakehouse, path, CASE WHEN last_sync IS NULL OR mtime > last_sync THEN 'copy' ELSE 'skip' END AS action FROM f11_p LEFT JOIN f11_state USING (lakehouse)""")
def mtime_plan(f):
    return listing.mtime_plan(f["f11_p"], f["f11_state"]).select("lakehouse", "path", "action")


@query("cleanup_plan", f"""
SELECT lakehouse, table_path, 'would_delete' AS status FROM (
  SELECT lakehouse, {_TABLE_OF} AS table_path FROM f11_s EXCEPT SELECT lakehouse, {_TABLE_OF} AS table_path FROM f11_p) WHERE table_path <> ''""")
def cleanup_plan(f):
    from tandem.operators.reconcile import cleanup_plan as plan

    return plan(listing.discover_tables(f["f11_p"]), listing.discover_tables(f["f11_s"]), keys=["lakehouse", "table_path"])


@query("gateway_verdict", """
SELECT gateway_id, pair_id, gateway_type, region, coalesce(n, 0) AS connection_count,
  CASE WHEN v AND r <> '' AND s <> '' AND r <> s AND (r = p OR p = '') THEN 'bad' WHEN v AND r <> '' AND r = s AND p = s THEN 'warn' WHEN v AND r <> '' AND r = s THEN 'ok'
       WHEN v THEN 'warn' WHEN member_count < 2 THEN 'warn' ELSE 'ok' END AS level,
  CASE WHEN v AND r <> '' AND s <> '' AND r <> s AND (r = p OR p = '') THEN 'bound_to_lost_region' WHEN v AND r <> '' AND r = s AND p = s THEN 'same_region_as_both'
       WHEN v AND r <> '' AND r = s THEN 'in_dr_region' WHEN v AND r = '' THEN 'region_unknown' WHEN v THEN 'region_bound' WHEN member_count < 2 THEN 'single_member' ELSE 'clustered' END AS reason
FROM (SELECT g.*, c.region, coalesce(c.region, '') AS r, coalesce(primary_region, '') AS p, coalesce(secondary_region, '') AS s, gateway_type = 'VirtualNetwork' AS v, n
  FROM f12_gateways g LEFT JOIN f12_capacities c USING (capacity_id) LEFT JOIN f12_regions USING (pair_id)
  LEFT JOIN (SELECT gateway_id, count(DISTINCT connection_id) AS n FROM f12_connections GROUP BY 1) USING (gateway_id))""")
def gateway_verdict(f):
    return st.gateway_verdict(st.gateway_enrich(f["f12_gateways"], f["f12_capacities"], f["f12_connections"]), f["f12_regions"])


@query("distinct_connections", "SELECT connection_id, count(DISTINCT item_id) AS item_count FROM f12_connections GROUP BY 1")
def distinct_connections(f):
    return st.distinct_connections(f["f12_connections"])


@query("connection_grants", """
SELECT connection_id, principal, count(*) AS used_by FROM f12_connections JOIN f12_principals USING (item_id)
WHERE NOT EXISTS (SELECT 1 FROM f12_connection_roles r WHERE r.connection_id = f12_connections.connection_id AND r.principal = f12_principals.principal) GROUP BY 1, 2""")
def connection_grants(f):
    return st.connection_grants(f["f12_connections"], f["f12_principals"], f["f12_connection_roles"])
