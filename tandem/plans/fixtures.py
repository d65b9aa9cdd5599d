"""Replica pairs derived from the given tables, as SQL that Spark and DuckDB both run.

``*_p`` is the primary side, ``*_s`` the secondary. The arithmetic in the views is what makes the
two sides differ; every view reads its whole table and whole texts, and grows with it.
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def _guid(expr: str) -> str:
    digest = f"md5({expr})"
    return "||'-'||".join(f"substr({digest},{start},{length})" for start, length in
                          ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _p_id(k: str) -> str:
    return _guid(f"'p' || cast({k} AS string)")


def _s_id(k: str) -> str:
    return _guid(f"'s' || cast({k} AS string)")


def _mapped(k: str) -> str:
    return f"{k} % 13 <> 5"


def _moved(k: str) -> str:
    return f"CASE WHEN {_mapped(k)} THEN {_s_id(k)} ELSE {_p_id(k)} END"


# The two items a document cites.
_B, _C = "cast(floor(doc_id / 2) AS bigint)", "cast(floor(doc_id / 3) AS bigint)"


PRIMARY_WS = _guid("'primary workspace'")
SECONDARY_WS = _guid("'secondary workspace'")

VIEWS: dict[str, str] = {}

# one keyed table on both sides.
VIEWS["f1_p"] = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"""
VIEWS["f1_s"] = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderkey % 101 = 5 THEN round(o_totalprice + 1, 2) ELSE o_totalprice END AS o_totalprice,
       o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 3
UNION ALL
SELECT -1 - o_orderkey AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey % 89 = 7"""

# item catalog of eight workspace pairs.
VIEWS["f2_p"] = """
SELECT p_partkey % 8 AS pair_id, p_partkey AS k,
  CASE p_partkey % 7 WHEN 0 THEN 'Lakehouse' WHEN 1 THEN 'Warehouse' WHEN 2 THEN 'Notebook' WHEN 3 THEN 'DataPipeline'
       WHEN 4 THEN 'SemanticModel' WHEN 5 THEN 'Report' ELSE 'Eventstream' END AS item_type,
  CASE WHEN p_partkey % 50 = 0 THEN 'BCDR_' ELSE '' END || p_name || '-' || cast(p_partkey AS string) AS display_name,
  md5('p' || cast(p_partkey AS string)) AS item_id,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS label, p_type AS folder FROM part"""
VIEWS["f2_s"] = """
SELECT pair_id, k, CASE WHEN k % 13 = 6 THEN 'Dashboard' ELSE item_type END AS item_type, display_name,
  md5('s' || cast(k AS string)) AS item_id, CASE WHEN k % 19 = 1 THEN 'Brand#0' ELSE label END AS label, folder
FROM f2_p WHERE k % 11 <> 4
UNION ALL
SELECT pair_id, -1 - k AS k, item_type, display_name || '-x' AS display_name, md5('x' || cast(k AS string)) AS item_id,
  label, folder FROM f2_p WHERE k % 17 = 2"""
VIEWS["f2_folders_p"] = """
SELECT DISTINCT pair_id, folder AS folder_name, md5('pf' || cast(pair_id AS string) || folder) AS folder_id FROM f2_p"""
VIEWS["f2_folders_s"] = """
SELECT DISTINCT pair_id, folder AS folder_name, md5('sf' || cast(pair_id AS string) || folder) AS folder_id FROM f2_s
WHERE NOT (pair_id % 3 = 1 AND folder = 'ECONOMY')"""
VIEWS["f2_reports"] = """
SELECT r.pair_id, r.item_id AS report_id, r.display_name AS report_name,
  CASE WHEN r.k % 4 = 3 THEN 'gone' ELSE m.item_id END AS model_id
FROM f2_p r JOIN f2_p m ON m.k = r.k - 1 WHERE r.item_type = 'Report' AND m.item_type = 'SemanticModel'"""

# commit history, one replicated table per customer.
VIEWS["f3_all"] = """
SELECT o_custkey % 8 AS pair_id, o_custkey AS c, 'tbl_' || cast(o_custkey AS string) AS table_key,
  cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS bigint) AS version,
  cast(count(*) OVER (PARTITION BY o_custkey) - 1 AS bigint) AS max_version,
  o_orderdate AS commit_ts, o_orderkey AS file_id, o_custkey % 5 <> 0 AS has_ict FROM orders"""
VIEWS["f3_p"] = """
SELECT pair_id, table_key, version, commit_ts, file_id, has_ict FROM f3_all
WHERE c % 37 <> 4 AND (c % 31 <> 2 OR version >= 8 OR version = max_version)"""
VIEWS["f3_s"] = """
SELECT pair_id, table_key, CASE WHEN c % 29 = 3 THEN version + 1 ELSE version END AS version,
  commit_ts + INTERVAL 30 DAYS AS commit_ts, file_id, has_ict FROM f3_all
WHERE c % 23 <> 5 AND (c % 29 = 3 OR version <= greatest(max_version - c % 4, 0))"""
VIEWS["f3_state"] = """
SELECT pair_id, table_key, cast(max(version) AS bigint) AS last_version, max(commit_ts) AS last_sync FROM f3_s
GROUP BY pair_id, table_key"""
VIEWS["f3_gate"] = """
SELECT cast(n_nationkey % 8 AS bigint) AS pair_id,
  max(CASE WHEN n_nationkey % 8 = 6 THEN 'fail' ELSE 'pass' END) AS integrity_status
FROM nation GROUP BY n_nationkey % 8"""

# change feed over a keyed target.
VIEWS["f4_feed"] = """
SELECT user_id, value, event_id AS _commit_version, ts AS _commit_timestamp,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'update_preimage'
       ELSE 'update_postimage' END AS _change_type FROM events"""
VIEWS["f4_target"] = """
SELECT user_id, max(value) AS value FROM events WHERE user_id % 3 <> 1 GROUP BY user_id"""

# event tables with a watermark; 'signup' has no state row (first run).
VIEWS["f5_p"] = """
SELECT event_type AS table_key, event_id, CASE WHEN event_id % 37 <> 5 THEN ts END AS ts, user_id, value, props FROM events"""
VIEWS["f5_state"] = """
SELECT event_type AS table_key, max(ts) AS last_ts FROM events
WHERE ts < TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'signup' GROUP BY event_type"""

# definition documents. Item k cites items k/2 and k/3 (a DAG with a self-loop at 0).
VIEWS["f6_ids"] = f"""
SELECT doc_id AS k, {_p_id('doc_id')} AS p_id, {_s_id('doc_id')} AS s_id,
  CASE doc_id % 4 WHEN 0 THEN 'Lakehouse' WHEN 1 THEN 'Notebook' WHEN 2 THEN 'SemanticModel' ELSE 'Report' END AS item_type,
  'item-' || cast(doc_id AS string) AS display_name, {_mapped('doc_id')} AS mapped FROM documents"""
VIEWS["f6_map"] = f"""
SELECT p_id AS primary_ref, s_id AS secondary_ref FROM f6_ids WHERE mapped
UNION ALL SELECT {PRIMARY_WS} AS primary_ref, {SECONDARY_WS} AS secondary_ref FROM region WHERE r_regionkey = 0"""
VIEWS["f6_items"] = f"""
SELECT p_id AS item_id, 'primary' AS side, item_type, display_name FROM f6_ids
UNION ALL SELECT s_id AS item_id, 'secondary' AS side, item_type, display_name FROM f6_ids
UNION ALL SELECT {PRIMARY_WS} AS item_id, 'primary' AS side, 'WorkspaceId' AS item_type, 'primary workspace' AS display_name
  FROM region WHERE r_regionkey = 0
UNION ALL SELECT {SECONDARY_WS} AS item_id, 'secondary' AS side, 'WorkspaceId' AS item_type, 'secondary workspace' AS display_name
  FROM region WHERE r_regionkey = 0"""
_PATH = "CASE WHEN doc_id % 10 = 9 THEN '.platform' ELSE 'part' || cast(doc_id % 3 AS string) END"
_ON_PRIMARY = f"text || ' ref=' || {_p_id(_B)} || ' ref=' || {_p_id(_C)} || CASE WHEN doc_id % 3 = 0 THEN ' ws=' || {PRIMARY_WS} ELSE '' END"
_ON_SECONDARY = f"text || ' ref=' || {_moved(_B)} || ' ref=' || {_moved(_C)} || CASE WHEN doc_id % 3 = 0 THEN ' ws=' || {SECONDARY_WS} ELSE '' END"
VIEWS["f6_parts_p"] = f"""
SELECT doc_id AS k, {_p_id('doc_id')} AS item_id, {_PATH} AS path, {_ON_PRIMARY} AS payload FROM documents
UNION ALL
SELECT doc_id AS k, {_p_id('doc_id')} AS item_id, 'meta.json' AS path,
  '{{"source":"' || source || '","lang":"' || lang || '"}}' AS payload FROM documents"""
VIEWS["f6_parts_s"] = f"""
SELECT doc_id AS k, {_s_id('doc_id')} AS item_id, {_PATH} AS path,
  CASE WHEN doc_id % 7 = 3 THEN {_ON_PRIMARY} ELSE {_ON_SECONDARY} END AS payload FROM documents WHERE doc_id % 17 <> 11
UNION ALL
SELECT doc_id AS k, {_s_id('doc_id')} AS item_id, 'meta.json' AS path,
  '{{"source":"' || source || '","lang":"' || CASE WHEN doc_id % 11 = 2 THEN 'xx' ELSE lang END || '"}}' AS payload
FROM documents WHERE doc_id % 17 <> 11"""
VIEWS["f6_parts_r"] = f"""
SELECT doc_id AS k, {_PATH} AS path, {_ON_SECONDARY} AS payload FROM documents WHERE doc_id % 10 <> 9
UNION ALL
SELECT doc_id AS k, 'meta.json' AS path, '{{"source":"' || source || '","lang":"' || lang || '"}}' AS payload FROM documents"""
VIEWS["f6_edges"] = """
SELECT cast(floor(doc_id / 2) AS bigint) AS upstream, doc_id AS downstream FROM documents
UNION ALL SELECT cast(floor(doc_id / 3) AS bigint) AS upstream, doc_id AS downstream FROM documents"""
VIEWS["f6_hosts"] = """
SELECT k, item_type, display_name,
  'Server=tcp:P' || cast(k AS string) || '-x.datawarehouse.fabric.microsoft.com,1433;Database=' || display_name AS p_conn,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'Server=tcp:s' || cast(k AS string) || '-x.datawarehouse.fabric.microsoft.com;Database=' || display_name END AS s_conn
FROM f6_ids WHERE item_type = 'Lakehouse'"""

# item shares (rights bitmask 1 Read, 2 Write, 4 Reshare, 8 Explore), workspace roles, groups.
VIEWS["f7_p"] = """
SELECT DISTINCT o_orderkey % 400 AS item_no, CASE o_orderkey % 3 WHEN 0 THEN 'SemanticModel' ELSE 'Lakehouse' END AS item_type,
  o_custkey AS principal, CASE o_custkey % 10 WHEN 0 THEN 'App' WHEN 1 THEN 'Group' ELSE 'User' END AS principal_type,
  'U' || cast(o_custkey AS string) AS identifier,
  CASE WHEN o_custkey % 2 = 0 THEN 'U' || cast(o_custkey AS string) || '@Example.com' ELSE NULL END AS email,
  CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 5 WHEN '5-LOW' THEN 9 ELSE 1 END AS rights,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Build' ELSE '' END AS additional
FROM orders"""
VIEWS["f7_s"] = """
SELECT item_no, item_type, principal, principal_type,
  CASE WHEN principal % 2 = 0 THEN 'u' || cast(principal AS string) || '@example.com' ELSE 'u' || cast(principal AS string) END AS identifier,
  CASE WHEN principal % 4 = 0 THEN 1 ELSE rights END AS rights, CASE WHEN principal % 7 = 0 THEN '' ELSE additional END AS additional
FROM f7_p WHERE principal % 6 <> 5"""
VIEWS["f7_roles_p"] = """
SELECT c_nationkey AS pair_id, c_custkey AS principal, c_mktsegment AS role FROM customer"""
VIEWS["f7_roles_s"] = """
SELECT c_nationkey AS pair_id, CASE WHEN c_custkey % 14 = 1 THEN -1 - c_custkey ELSE c_custkey END AS principal,
  CASE WHEN c_custkey % 9 = 2 THEN 'BUILDING' ELSE c_mktsegment END AS role FROM customer WHERE c_custkey % 12 <> 6"""
VIEWS["f7_role_keys_s"] = """
SELECT 'u' || cast(c_custkey AS string) AS principal_key FROM customer WHERE c_custkey % 40 = 3"""
VIEWS["f7_entries"] = """
SELECT c_nationkey AS item_no, CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'O' || cast(c_custkey AS string) END AS object_id,
  CASE WHEN c_custkey % 10 = 1 THEN 'g' || cast(c_custkey AS string) ELSE NULL END AS group_id,
  CASE WHEN c_custkey % 10 = 2 THEN 'a' || cast(c_custkey AS string) ELSE NULL END AS app_id, c_custkey % 10 = 3 AS is_app,
  CASE WHEN c_custkey % 10 > 5 THEN c_name ELSE NULL END AS upn, CASE WHEN c_custkey % 10 = 4 THEN 0 ELSE NULL END AS user_type,
  CAST(NULL AS string) AS email, CASE WHEN c_custkey % 17 = 0 THEN 5 ELSE NULL END AS folder_role_id,
  CASE WHEN c_custkey % 19 = 0 THEN 'Admin' ELSE NULL END AS folder_role, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_custkey % 16 END AS permissions FROM customer"""
VIEWS["f7_members"] = """
SELECT c_custkey - c_custkey % 10 + 1 AS group_id, cast(floor(c_custkey / 2) AS bigint) AS member_id FROM customer"""

# F8: SQL catalog and grants, one database per supplier.
VIEWS["f8_cat_permissions"] = """
SELECT DISTINCT l_suppkey AS database_no,
  CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1 END AS class,
  CASE l_linenumber % 3 WHEN 0 THEN 'DATABASE' WHEN 1 THEN 'SCHEMA' ELSE 'OBJECT_OR_COLUMN' END AS class_desc,
  CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN l_partkey % 5 ELSE l_partkey END AS major_id,
  CASE WHEN l_linenumber % 3 <> 2 OR l_partkey % 2 = 0 THEN 0 ELSE l_partkey % 4 END AS minor_id,
  CASE l_returnflag WHEN 'R' THEN 'DENY' WHEN 'A' THEN 'GRANT_WITH_GRANT_OPTION' ELSE 'GRANT' END AS state_desc,
  CASE WHEN l_linenumber % 3 = 0 AND l_linestatus = 'O' THEN 'CONNECT' WHEN l_linestatus = 'O' THEN 'SELECT' ELSE 'INSERT' END AS permission_name,
  cast(floor(l_orderkey / 40) AS bigint) AS grantee_id FROM lineitem"""
VIEWS["f8_cat_principals"] = """
SELECT DISTINCT l_suppkey AS database_no, cast(floor(l_orderkey / 40) AS bigint) AS principal_id,
  CASE WHEN floor(l_orderkey / 40) % 11 = 0 THEN 'dbo' WHEN floor(l_orderkey / 40) % 13 = 0 THEN '##ms_' || cast(cast(floor(l_orderkey / 40) AS bigint) AS string)
       ELSE 'user]' || cast(cast(floor(l_orderkey / 40) AS bigint) AS string) END AS principal_name FROM lineitem"""
VIEWS["f8_cat_objects"] = """
SELECT DISTINCT l_suppkey AS database_no, l_partkey AS object_id, 'obj' || cast(l_partkey AS string) AS object_name,
  l_partkey % 5 AS schema_id FROM lineitem"""
VIEWS["f8_cat_schemas"] = """
SELECT DISTINCT l_suppkey AS database_no, l_partkey % 5 AS schema_id, 'sch' || cast(l_partkey % 5 AS string) AS schema_name FROM lineitem"""
VIEWS["f8_cat_columns"] = """
SELECT DISTINCT l_suppkey AS database_no, l_partkey AS object_id, l_partkey % 4 AS column_id, 'col' || cast(l_partkey % 4 AS string) AS column_name
FROM lineitem"""
VIEWS["f8_p"] = """
SELECT DISTINCT 'db' || cast(l_suppkey AS string) AS database_name,
  CASE l_returnflag WHEN 'R' THEN 'DENY' WHEN 'A' THEN 'GRANT_WITH_GRANT_OPTION' ELSE 'GRANT' END AS state,
  CASE l_linestatus WHEN 'O' THEN 'SELECT' ELSE 'INSERT' END AS permission,
  CASE l_linenumber % 3 WHEN 0 THEN 'DATABASE' WHEN 1 THEN 'SCHEMA' ELSE 'OBJECT_OR_COLUMN' END AS class,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'sch' || cast(l_partkey % 5 AS string) END AS schema_name,
  CASE WHEN l_linenumber % 3 <> 2 THEN '' ELSE 'obj]' || cast(l_partkey AS string) END AS object_name,
  CASE WHEN l_linenumber % 3 <> 2 OR l_partkey % 2 = 0 THEN '' ELSE 'col' || cast(l_partkey % 4 AS string) END AS column_name,
  'user' || cast(cast(floor(l_orderkey / 40) AS bigint) AS string) AS principal FROM lineitem"""
VIEWS["f8_s"] = """
SELECT * FROM f8_p WHERE principal NOT LIKE '%7' AND NOT (schema_name = 'sch3' AND object_name LIKE '%4')
UNION ALL
SELECT database_name, state, permission, class, schema_name, object_name, column_name, principal || 'x' AS principal
FROM f8_p WHERE principal LIKE '%11'"""
VIEWS["f8_objects_s"] = """
SELECT DISTINCT 'db' || cast(l_suppkey AS string) AS database_name, 'sch' || cast(l_partkey % 5 AS string) AS schema_name,
  'obj]' || cast(l_partkey AS string) AS object_name FROM lineitem WHERE l_partkey % 5 <> 4 AND l_partkey % 9 <> 2"""
VIEWS["f8_schemas_s"] = """
SELECT DISTINCT 'db' || cast(l_suppkey AS string) AS database_name, 'sch' || cast(l_partkey % 5 AS string) AS schema_name
FROM lineitem WHERE l_partkey % 5 <> 4"""
VIEWS["f8_members_p"] = """
SELECT DISTINCT 'db' || cast(l_suppkey AS string) AS database_name, 'role' || cast(l_linenumber AS string) AS role_name,
  'user' || cast(cast(floor(l_orderkey / 40) AS bigint) AS string) AS member_name FROM lineitem WHERE l_returnflag = 'A'"""
VIEWS["f8_members_s"] = """
SELECT database_name, role_name, member_name FROM f8_members_p WHERE member_name NOT LIKE '%3' AND role_name <> 'role4'
UNION ALL SELECT database_name, role_name, member_name || 'x' AS member_name FROM f8_members_p WHERE member_name LIKE '%21'"""

# job schedules as bags: equal schedules repeat on purpose.
VIEWS["f9_p"] = """
SELECT event_id AS schedule_id, CASE WHEN user_id % 2 = 0 THEN 'DataPipeline' ELSE 'Notebook' END AS item_type,
  'item' || cast(user_id AS string) AS item_name, event_type AS job_type, cast(event_id % 6 AS string) AS every,
  CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Tue;Mon' ELSE 'Mon;Tue' END AS weekdays,
  event_id % 4 <> 0 AS enabled FROM events"""
VIEWS["f9_s"] = """
SELECT -1 - schedule_id AS schedule_id, item_type, item_name, job_type,
  CASE WHEN schedule_id % 60 = 0 THEN '9' ELSE every END AS every,
  CASE WHEN weekdays = 'Tue;Mon' THEN 'Mon;Tue' ELSE weekdays END AS weekdays, schedule_id % 5 = 0 AS enabled
FROM f9_p WHERE schedule_id % 16 <> 0 AND item_name <> 'item13'"""
VIEWS["f9_items_s"] = """
SELECT DISTINCT item_type, item_name, md5('s' || item_type || item_name) AS item_id FROM f9_p WHERE item_name NOT IN ('item13', 'item20')"""

# claims facts.
VIEWS["f10_claims"] = """
SELECT l.l_orderkey AS claim_id, cast(o.o_orderdate AS date) AS claim_date, o.o_orderpriority AS incident_type,
  n.n_name AS incident_state, CASE WHEN l.l_quantity >= 35 THEN 'High' WHEN l.l_quantity >= 15 THEN 'Medium' ELSE 'Low' END AS predicted_severity,
  l.l_returnflag AS rule_engine_decision, l.l_linestatus AS settlement_status, p.p_brand AS vehicle_make, p.p_type AS coverage_type,
  l.l_extendedprice AS claim_amount, l.l_discount * 10 AS avg_severity_score, l.l_tax >= 0.07 AS fraud_flag
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN part p ON p.p_partkey = l.l_partkey"""
VIEWS["f10_policies"] = """
SELECT p_partkey AS policy_id, p_brand AS vehicle_make, p_type AS coverage_type, p_size AS risk_score FROM part"""

# file listings.
VIEWS["f11_p"] = """
SELECT 'lh' || cast(l_suppkey AS string) AS lakehouse,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Tables/sch/t' ELSE 'Tables/t' END || cast(l_partkey % 30 AS string)
    || CASE WHEN l_linenumber = 1 THEN '/_delta_log/' || lpad(cast(l_orderkey % 50 AS string), 20, '0') || '.json'
            ELSE '/part-' || cast(l_orderkey AS string) || '.parquet' END AS path,
  max(l_shipdate) AS mtime, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS bytes FROM lineitem GROUP BY 1, 2
UNION ALL
SELECT 'lh' || cast(s_suppkey AS string) AS lakehouse, 'Tables/_internal/_delta_log/' || lpad('0', 20, '0') || '.json' AS path,
  TIMESTAMP '1996-01-01 00:00:00' AS mtime, cast(10 AS bigint) AS bytes FROM supplier
UNION ALL
SELECT 'lh' || cast(s_suppkey AS string) AS lakehouse, 'Files/raw/' || s_name || '.bin' AS path,
  TIMESTAMP '1999-01-01 00:00:00' AS mtime, cast(20 AS bigint) AS bytes FROM supplier"""
VIEWS["f11_s"] = """
SELECT * FROM f11_p WHERE lakehouse <> 'lh3' AND path NOT LIKE '%/t7/%'
UNION ALL
SELECT lakehouse, replace(path, '/t9/', '/t99/') AS path, mtime, bytes FROM f11_p WHERE path LIKE '%/t9/%' AND lakehouse <> 'lh3'"""
VIEWS["f11_state"] = """
SELECT lakehouse, TIMESTAMP '1998-06-01 00:00:00' AS last_sync FROM f11_p WHERE lakehouse NOT LIKE '%5' GROUP BY lakehouse"""

# gateways and connections.
VIEWS["f12_gateways"] = """
SELECT s_suppkey AS gateway_id, s_suppkey % 8 AS pair_id,
  CASE s_suppkey % 2 WHEN 0 THEN 'VirtualNetwork' ELSE 'OnPremises' END AS gateway_type,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 25 END AS capacity_id, s_suppkey % 4 AS member_count FROM supplier"""
VIEWS["f12_capacities"] = """
SELECT n_nationkey AS capacity_id, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey"""
VIEWS["f12_regions"] = """
SELECT n_nationkey AS pair_id, min(p.r_name) AS primary_region, min(s.r_name) AS secondary_region
FROM nation JOIN region p ON p.r_regionkey = n_nationkey % 5 JOIN region s ON s.r_regionkey = (n_nationkey + n_nationkey % 2) % 5
GROUP BY n_nationkey"""
VIEWS["f12_connections"] = """
SELECT o_custkey AS item_id, cast(floor(o_orderkey / 5) AS bigint) AS connection_id, cast(floor(o_custkey / 15) AS bigint) AS gateway_id FROM orders"""
VIEWS["f12_connection_roles"] = """
SELECT DISTINCT connection_id, 'u' || cast(connection_id % 10 AS string) AS principal FROM f12_connections WHERE connection_id % 3 <> 1"""
VIEWS["f12_principals"] = """
SELECT item_id, 'u' || cast(min(connection_id) % 10 AS string) AS principal FROM f12_connections GROUP BY item_id"""

# supporting facts.
VIEWS["f13_capacity"] = """
SELECT cast(n_nationkey % 8 AS bigint) AS pair_id, max(CASE WHEN n_nationkey % 8 = 1 THEN 'Paused' WHEN n_nationkey % 8 = 2 THEN '' ELSE 'Active' END) AS capacity_state,
  max(CASE WHEN n_nationkey % 8 = 5 THEN 1 ELSE 0 END) = 1 AS read_error FROM nation GROUP BY n_nationkey % 8"""
VIEWS["f13_runs"] = """
SELECT o_custkey % 8 AS pair_id, o_custkey AS item_id, CASE o_orderkey % 4 WHEN 0 THEN 'schedule' WHEN 1 THEN 'autosync' WHEN 2 THEN 'azcopy' ELSE 'notebook_job' END AS source,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed' ELSE 'InProgress' END AS status,
  o_orderdate AS started, o_orderdate + INTERVAL 45 MINUTES AS ended, o_orderkey AS run_id FROM orders"""
VIEWS["f13_model_parts"] = """
SELECT cast(floor(p_partkey / 10) AS bigint) AS model_id, CASE WHEN p_partkey % 3 = 0 THEN 'model.bim' ELSE 'tables/t' || cast(p_partkey AS string) || '.tmdl' END AS path,
  CASE p_partkey % 3 WHEN 0 THEN '{"model":{"tables":[{"partitions":[{"mode":"directLake"},{}]}]}}'
       WHEN 1 THEN 'partition a' || chr(10) || '  mode: import' ELSE 'partition b' || chr(10) || 'partition c' || chr(10) || '  mode: dual' END AS body
FROM part WHERE NOT (floor(p_partkey / 10) % 6 = 5 AND p_partkey % 10 > 3)"""
VIEWS["f13_refreshes"] = """
SELECT cast(o_custkey AS bigint) AS model_id, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Failed' ELSE 'Unknown' END AS status,
  o_orderdate AS ended, o_orderkey AS refresh_id FROM orders"""
VIEWS["f13_rules"] = """
SELECT s_suppkey % 6 AS role_no, CASE WHEN s_suppkey % 10 = 9 THEN '*' ELSE '/Tables/sch/t' || cast(s_suppkey % 9 AS string) END AS table_path,
  CASE s_suppkey % 3 WHEN 0 THEN 'claim_amount' WHEN 1 THEN 'incident_type' ELSE 'claim_date' END AS column_name, s_suppkey % 7 <> 0 AS has_column_rule,
  CASE WHEN s_suppkey % 54 = 7 THEN 'Deny' WHEN s_suppkey % 2 = 0 THEN 'Permit' END AS effect, CASE s_suppkey % 4 WHEN 1 THEN 'Deny' WHEN 2 THEN 'Permit' ELSE '' END AS column_effect FROM supplier"""
VIEWS["f13_roles_p"] = """
SELECT 'lh' || cast(c_nationkey AS string) AS lakehouse, 'role' || cast(c_custkey % 5 AS string) AS role_name,
  'Permit' AS effect, 'Path' AS attribute, '/Tables/' || c_mktsegment AS attribute_value, c_name AS member,
  'pws/' || c_name AS source_path FROM customer"""
VIEWS["f13_roles_s"] = """
SELECT lakehouse, role_name, effect, attribute, CASE WHEN lakehouse LIKE '%7' AND attribute_value = '/Tables/BUILDING' THEN '/Tables/MOVED' ELSE attribute_value END AS attribute_value,
  member, CASE WHEN lakehouse LIKE '%4' THEN source_path ELSE replace(source_path, 'pws/', 'sws/') END AS source_path
FROM f13_roles_p WHERE NOT (lakehouse LIKE '%2' AND role_name = 'role3')
UNION ALL
SELECT lakehouse, role_name || 'x' AS role_name, effect, attribute, attribute_value, member, source_path FROM f13_roles_p WHERE lakehouse LIKE '%1' AND role_name = 'role0'"""
VIEWS["f13_columns"] = """
SELECT cast(floor(p_partkey / 7) AS bigint) AS table_no, p_partkey AS pos,
  CASE p_partkey % 8 WHEN 0 THEN 'Timestamp' WHEN 1 THEN 'ID' WHEN 2 THEN 'CreatedAt' WHEN 3 THEN 'claim_id' ELSE 'c' || cast(p_partkey AS string) END AS column_name,
  CASE WHEN p_partkey % 8 IN (0, 2, 6) AND floor(p_partkey / 7) % 4 <> 3 THEN 'DateTime' ELSE 'string' END AS column_type FROM part"""
VIEWS["f13_ml_versions"] = """
SELECT c_nationkey AS model_no, cast(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS bigint) AS version,
  CASE WHEN c_custkey % 11 = 0 THEN '' ELSE md5(cast(c_custkey AS string)) END AS run_id, c_custkey % 30 AS experiment_no,
  CASE WHEN c_custkey % 4 = 1 THEN '' ELSE 'abfss://pws/exp-' || cast(c_custkey % 30 AS string) || '/' || md5(cast(c_custkey AS string)) || '/artifacts' END AS source_uri FROM customer"""
VIEWS["f13_experiments"] = """
SELECT c_custkey % 30 AS experiment_no, 'experiment ' || cast(c_custkey % 30 AS string) AS experiment_name,
  'exp-' || cast(c_custkey % 30 AS string) AS p_experiment_id,
  CASE WHEN c_custkey % 30 IN (4, 9) THEN NULL ELSE 'sx-' || cast(c_custkey % 30 AS string) END AS s_experiment_id FROM customer GROUP BY c_custkey % 30"""

# what nine readiness checks look at, for a pair of workspaces per nation.
VIEWS["f14_pairs"] = """
SELECT pair_id, primary_region, secondary_region, CASE WHEN pair_id % 8 = 3 THEN 'Paused' WHEN pair_id % 12 = 9 THEN '' ELSE 'Active' END AS secondary_capacity_state FROM f12_regions"""
VIEWS["f14_facts"] = """
SELECT c_nationkey AS pair_id, c_custkey AS k,
  CASE WHEN c_nationkey % 11 = 10 THEN NULL WHEN c_nationkey % 6 = 1 THEN 0.5E0 ELSE 7.0E0 + c_custkey % 30 END AS measured_rpo_hours,
  CASE WHEN c_nationkey % 13 = 5 AND c_custkey % 4 = 0 THEN 1 ELSE 0 END AS diverged, c_custkey % 7 <> 0 AS supported, 3 AS primary_count,
  CASE WHEN c_nationkey % 10 = 3 THEN 2 ELSE 3 END AS mirrored_count, NOT (c_nationkey % 9 = 2 AND c_custkey % 5 = 0) AS ready,
  CASE WHEN c_nationkey % 6 = 3 AND c_custkey % 3 = 0 THEN 'create_paused' WHEN c_nationkey % 15 = 4 THEN 'error' ELSE 'present' END AS schedule_action,
  c_nationkey % 12 = 11 AS enabled_on_secondary,
  CASE WHEN c_nationkey % 6 = 5 AND c_custkey % 2 = 0 THEN 'grant_dataset_user' WHEN c_nationkey % 10 = 7 THEN 'not_scanned' ELSE 'already_present' END AS share_action,
  CASE WHEN c_nationkey % 8 = 6 AND c_custkey % 3 = 1 THEN 'stale' ELSE 'healthy' END AS status,
  CASE WHEN c_nationkey % 10 = 9 THEN 'bad' WHEN c_nationkey % 5 = 0 THEN 'warn' ELSE 'ok' END AS level FROM customer"""
