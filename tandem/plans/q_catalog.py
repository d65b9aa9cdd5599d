"""Queries on the item catalog: match, drift, coverage, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import reconcile as rec
from tandem.operators import status as st
from tandem.plans.registry import query

_BUSINESS_P = "(SELECT * FROM f2_p WHERE display_name NOT LIKE 'BCDR\\_%' ESCAPE '\\')"
_BUSINESS_S = "(SELECT * FROM f2_s WHERE display_name NOT LIKE 'BCDR\\_%' ESCAPE '\\')"
_STATES = f"""
  (SELECT coalesce(p.pair_id, s.pair_id) AS pair_id, coalesce(p.item_type, s.item_type) AS item_type,
          coalesce(p.display_name, s.display_name) AS display_name, p.item_id AS p_item_id, s.item_id AS s_item_id,
          CASE WHEN s.k IS NULL THEN 'missing_in_secondary' WHEN p.k IS NULL THEN 'extra_in_secondary' ELSE 'in_sync' END AS state
   FROM {_BUSINESS_P} p FULL OUTER JOIN {_BUSINESS_S} s
     ON p.pair_id = s.pair_id AND p.item_type = s.item_type AND p.display_name = s.display_name)"""
_DRIFT = f"""
  (SELECT a.pair_id, a.item_type, a.display_name, a.p_item_id,
          CASE WHEN a.state = 'in_sync' THEN a.s_item_id WHEN a.state = 'missing_in_secondary' THEN b.s_item_id ELSE a.s_item_id END AS s_item_id,
          CASE WHEN a.state = 'missing_in_secondary' AND b.display_name IS NOT NULL THEN 'type_mismatch' ELSE a.state END AS state,
          CASE WHEN a.state = 'missing_in_secondary' THEN b.item_type ELSE a.item_type END AS secondary_type
   FROM {_STATES} a LEFT JOIN {_STATES} b ON a.state = 'missing_in_secondary' AND b.state = 'extra_in_secondary'
     AND a.pair_id = b.pair_id AND a.display_name = b.display_name
   WHERE NOT (a.state = 'extra_in_secondary' AND EXISTS (SELECT 1 FROM {_STATES} c WHERE c.state = 'missing_in_secondary'
     AND c.pair_id = a.pair_id AND c.display_name = a.display_name)))"""


def _items(f):
    return st.business_items(f["f2_p"]), st.business_items(f["f2_s"])


@query("business_items", """
SELECT side, pair_id, kind, count(*) AS items FROM (
  SELECT 'primary' AS side, pair_id, CASE WHEN substr(display_name, 1, 5) = 'BCDR_' THEN 'system' ELSE 'business' END AS kind FROM f2_p
  UNION ALL SELECT 'secondary', pair_id, CASE WHEN substr(display_name, 1, 5) = 'BCDR_' THEN 'system' ELSE 'business' END FROM f2_s)
GROUP BY side, pair_id, kind""")
def business_items(f):
    parts = []
    for side, view in (("primary", "f2_p"), ("secondary", "f2_s")):
        for kind, rows in (("business", st.business_items(f[view])), ("system", st.system_items(f[view]))):
            parts.append(rows.select(F.lit(side).alias("side"), "pair_id", F.lit(kind).alias("kind")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("side", "pair_id", "kind").agg(F.count(F.lit(1)).alias("items"))


@query("match_items", f"""
SELECT p.pair_id, p.item_type, p.display_name, p.item_id AS p_item_id, s.item_id AS s_item_id
FROM {_BUSINESS_P} p JOIN {_BUSINESS_S} s ON p.pair_id = s.pair_id AND p.item_type = s.item_type AND p.display_name = s.display_name""")
def match_items(f):
    p, s = _items(f)
    return rec.matched(p, s, keys=["item_type", "display_name"], value="item_id")


@query("missing_items", f"SELECT pair_id, item_type, display_name FROM {_STATES} WHERE state = 'missing_in_secondary'")
def missing_items(f):
    p, s = _items(f)
    return rec.missing(p, s, keys=["item_type", "display_name"]).select("pair_id", "item_type", "display_name")


@query("extra_items", f"SELECT pair_id, item_type, display_name FROM {_STATES} WHERE state = 'extra_in_secondary'")
def extra_items(f):
    p, s = _items(f)
    return rec.extra(p, s, keys=["item_type", "display_name"]).select("pair_id", "item_type", "display_name")


@query("catalog_drift", f"SELECT * FROM {_DRIFT}")
def catalog_drift(f):
    return rec.catalog_drift(*_items(f))


@query("drift_counts", f"""
SELECT pair_id, item_type, count(*) FILTER (state = 'in_sync') AS synced, count(*) FILTER (state = 'type_mismatch') AS mismatch,
  count(*) FILTER (state = 'missing_in_secondary') AS missing, count(*) FILTER (state = 'extra_in_secondary') AS extra,
  cast(CASE WHEN count(*) FILTER (state = 'missing_in_secondary') > 0 THEN 0 WHEN count(*) FILTER (state = 'type_mismatch') > 0 THEN 1
       WHEN count(*) FILTER (state = 'extra_in_secondary') > 0 THEN 2 ELSE 3 END AS BIGINT) AS severity
FROM {_DRIFT} GROUP BY pair_id, item_type""")
def drift_counts(f):
    return st.drift_counts(rec.catalog_drift(*_items(f)))


@query("label_drift", f"""
SELECT p.pair_id, p.item_type, p.display_name,
  CASE WHEN coalesce(p.label, '') = coalesce(s.label, '') THEN 'LABEL_IN_SYNC' ELSE 'LABEL_MISMATCH' END AS state,
  coalesce(p.label, 'none') AS primary_label, coalesce(s.label, 'none') AS secondary_label
FROM {_BUSINESS_P} p JOIN {_BUSINESS_S} s ON p.pair_id = s.pair_id AND p.item_type = s.item_type AND p.display_name = s.display_name
WHERE p.label IS NOT NULL OR s.label IS NOT NULL""")
def label_drift(f):
    return rec.label_drift(*_items(f))


_COUNTS = """
SELECT {by}, count(*) FILTER (side = 'p') AS primary_count, count(*) FILTER (side = 's') AS secondary_count
FROM (SELECT pair_id, item_type, 'p' AS side FROM {p} UNION ALL SELECT pair_id, item_type, 's' FROM {s}) GROUP BY {by}"""
_TYPE_COUNTS = _COUNTS.format(by="pair_id, item_type", p=_BUSINESS_P, s=_BUSINESS_S)
_PAIR_COUNTS = _COUNTS.format(by="pair_id", p=_BUSINESS_P, s=_BUSINESS_S)


@query("inventory", f"""
SELECT *, round(CASE WHEN primary_count = 0 THEN 0 ELSE 100.0::DOUBLE * least(primary_count, secondary_count) / primary_count END, 4) AS sync_pct
FROM ({_TYPE_COUNTS})""")
def inventory(f):
    return st.inventory(*_items(f))


@query("coverage", f"""
SELECT *, cast(CASE WHEN primary_count > 0 THEN round_even(100.0::DOUBLE * mirrored_count / primary_count, 0) ELSE 0 END AS BIGINT) AS percentage,
  CASE WHEN item_type IN ('Lakehouse', 'Warehouse', 'SQLEndpoint', 'KQLDatabase', 'Eventhouse') THEN 'data_storage' ELSE 'components' END AS category,
  item_type NOT IN ('Warehouse', 'SQLEndpoint') AS supported
FROM (SELECT pair_id, item_type, count(*) FILTER (state <> 'extra_in_secondary') AS primary_count,
  count(*) FILTER (state <> 'missing_in_secondary') AS secondary_count, count(*) FILTER (state = 'in_sync') AS mirrored_count
  FROM {_STATES} GROUP BY pair_id, item_type)""")
def coverage(f):
    return st.coverage(*_items(f))


@query("coverage_gaps", f"""
SELECT pair_id, item_type, count(*) OVER (PARTITION BY pair_id, item_type) AS gap_count, state AS gap, display_name
FROM {_STATES} WHERE state <> 'in_sync'""")
def coverage_gaps(f):
    return st.coverage_gaps(*_items(f))


def _store_tables(f, side):
    return f[f"f2_{side}"].select("pair_id", F.concat("folder", F.lit("-"), "item_type").alias("store"), F.col("display_name").alias("table_key"))


@query("count_checks", f"""
SELECT pair_id, item_type AS artifact, 'Item Count' AS "check", primary_count AS primary_value, secondary_count AS secondary_value,
  abs(primary_count - secondary_count) AS variance, CASE WHEN primary_count = secondary_count THEN 'pass' ELSE 'warning' END AS status
FROM ({_TYPE_COUNTS}) WHERE item_type NOT IN ('Lakehouse', 'Warehouse')
UNION ALL
SELECT pair_id, 'Store: ' || store, CASE WHEN s = 0 THEN 'Existence' ELSE 'Table Count' END, p, s, CASE WHEN s > 0 THEN abs(p - s) END,
  CASE WHEN s = 0 THEN 'fail' WHEN p = s THEN 'pass' ELSE 'warning' END
FROM (SELECT pair_id, store, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 's') AS s FROM (
  SELECT pair_id, folder || '-' || item_type AS store, 'p' AS side FROM f2_p UNION ALL SELECT pair_id, folder || '-' || item_type, 's' FROM f2_s) GROUP BY 1, 2)
WHERE p > 0
UNION ALL
SELECT pair_id, 'orders -> ' || o_orderpriority, 'Row Count', p, s, abs(p - s), CASE WHEN p = s THEN 'pass' ELSE 'warning' END
FROM (SELECT o_custkey % 8 AS pair_id, o_orderpriority, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 's') AS s FROM (
  SELECT o_custkey, o_orderpriority, 'p' AS side FROM f1_p UNION ALL SELECT o_custkey, o_orderpriority, 's' FROM f1_s) GROUP BY 1, 2) WHERE p > 0""")
def count_checks(f):
    p, s = _items(f)
    rows = lambda side: f[f"f1_{side}"].select((F.col("o_custkey") % 8).alias("pair_id"), F.lit("orders").alias("store"), F.col("o_orderpriority").alias("table_key"))
    return st.count_checks(p, s, p_tables=_store_tables(f, "p"), s_tables=_store_tables(f, "s"), p_rows=rows("p"), s_rows=rows("s"))


@query("mirrored_names", f"""
SELECT DISTINCT p.pair_id, p.item_type, p.display_name FROM {_BUSINESS_P} p
JOIN {_BUSINESS_S} s ON p.pair_id = s.pair_id AND p.item_type = s.item_type AND p.display_name = s.display_name""")
def mirrored_names(f):
    p, s = _items(f)
    return rec.mirrored(p, s, keys=["pair_id", "item_type", "display_name"])


@query("folder_map", """
SELECT p.pair_id, p.folder_name, p.folder_id AS primary_folder_id, s.folder_id AS secondary_folder_id,
  CASE WHEN s.folder_id IS NULL THEN 'create' ELSE 'mapped' END AS action
FROM f2_folders_p p LEFT JOIN f2_folders_s s ON p.pair_id = s.pair_id AND p.folder_name = s.folder_name""")
def folder_map(f):
    return rec.folder_map(f["f2_folders_p"], f["f2_folders_s"])


@query("health_score", f"""
SELECT c.pair_id, coalesce(n, 0) AS item_count,
  cast(CASE WHEN read_error THEN 0 WHEN lower(capacity_state) NOT IN ('', 'active') THEN 25 WHEN n IS NULL THEN 50
    WHEN capacity_state = '' THEN 75 ELSE 100 END AS BIGINT) AS health,
  CASE WHEN read_error THEN 'ERROR' WHEN lower(capacity_state) NOT IN ('', 'active') THEN 'CAPACITY_' || upper(capacity_state)
    WHEN n IS NULL THEN 'EMPTY' WHEN capacity_state = '' THEN 'CAPACITY_UNKNOWN' ELSE 'HEALTHY' END AS status
FROM f13_capacity c LEFT JOIN (SELECT pair_id, count(*) AS n FROM {_BUSINESS_P} GROUP BY pair_id) USING (pair_id)""")
def health_score(f):
    return st.health_score(f["f2_p"], f["f13_capacity"])


@query("parity_check", f"""
SELECT a.pair_id, missing, primary_count, secondary_count, parity_issues, NOT (missing > 10 OR primary_count - secondary_count > 20) AS current
FROM (SELECT pair_id, count(*) FILTER (state = 'missing_in_secondary') AS missing FROM {_STATES} GROUP BY pair_id) a
JOIN (SELECT pair_id, cast(sum(primary_count) AS BIGINT) AS primary_count, cast(sum(secondary_count) AS BIGINT) AS secondary_count,
  count(*) FILTER (primary_count > secondary_count) AS parity_issues FROM ({_TYPE_COUNTS}) GROUP BY pair_id) b USING (pair_id)""")
def parity_check(f):
    return st.parity_check(*_items(f))


@query("failover_sim", f"""
SELECT *, primary_count > 0 AS primary_ok, secondary_count > 0 AS secondary_ok, sync_pct >= 80 AS coverage_ok,
  CASE WHEN primary_count > 0 AND secondary_count > 0 AND sync_pct >= 80 THEN 'DRY_RUN_PASS' ELSE 'DRY_RUN_FAIL' END AS status
FROM (SELECT *, cast(round_even(100.0::DOUBLE * least(primary_count, secondary_count) / greatest(primary_count, 1), 0) AS BIGINT) AS sync_pct
  FROM ({_PAIR_COUNTS}))""")
def failover_sim(f):
    return st.failover_simulation(*_items(f))


@query("rebind_plan", """
SELECT pair_id, report_name, report_id, model_name, fallback, sr.item_id AS s_report_id, sm.item_id AS s_model_id,
  CASE WHEN sr.item_id IS NULL THEN 'report_missing' WHEN sm.item_id IS NULL THEN 'model_missing' ELSE 'rebind' END AS action
FROM (SELECT r.pair_id, r.report_id, r.report_name, coalesce(m.display_name, r.report_name) AS model_name, m.display_name IS NULL AS fallback
      FROM f2_reports r LEFT JOIN f2_p m ON m.pair_id = r.pair_id AND m.item_id = r.model_id AND m.item_type = 'SemanticModel') w
LEFT JOIN (SELECT pair_id, display_name AS report_name, item_id FROM f2_s WHERE item_type = 'Report') sr USING (pair_id, report_name)
LEFT JOIN (SELECT pair_id, display_name AS model_name, item_id FROM f2_s WHERE item_type = 'SemanticModel') sm USING (pair_id, model_name)""")
def rebind_plan(f):
    return rec.rebind_plan(f["f2_reports"], f["f2_p"], f["f2_s"])


@query("required_present", """
SELECT pair_id, count(s.k) AS present, count(*) - count(s.k) AS missing, count(*) = count(s.k) AS ready
FROM f2_p p LEFT JOIN f2_s s USING (pair_id, display_name) GROUP BY pair_id""")
def required_present(f):
    return rec.required_present(f["f2_p"], f["f2_s"], keys=["display_name"])
