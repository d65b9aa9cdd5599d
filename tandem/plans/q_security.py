"""Queries on shares, roles, grants, schedules and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions.rights import principal_keys
from tandem.operators import grants as gr
from tandem.operators import graph
from tandem.operators import reconcile as rec
from tandem.operators import schedules as sch
from tandem.operators import security as sec
from tandem.operators import status as st
from tandem.plans.registry import query

ITEM = ["item_no", "item_type"]


@query("permission_delta", """
SELECT coalesce(p.pair_id, s.pair_id)::BIGINT AS pair_id, coalesce(p.principal, s.principal) AS principal,
  CASE WHEN s.principal IS NULL THEN 'add' WHEN p.principal IS NULL THEN 'removed_detected' WHEN p.role = s.role THEN 'unchanged' ELSE 'change' END AS action,
  p.role AS primary_role, s.role AS secondary_role FROM f7_roles_p p FULL OUTER JOIN f7_roles_s s ON p.pair_id = s.pair_id AND p.principal = s.principal""")
def permission_delta(f):
    return rec.assignment_delta(f["f7_roles_p"], f["f7_roles_s"])


def _p_shares(f):
    rows = f["f7_p"]
    share_id = F.concat_ws("/", *[F.col(c).cast("string") for c in ("item_no", "item_type", "principal", "rights", "additional")])
    return rows.withColumn("share_id", share_id).withColumn("keys", principal_keys("identifier", "email"))


def _s_shares(f):
    return f["f7_s"].withColumn("keys", principal_keys("identifier"))


_HAVE = """
  (SELECT p.*, h.have, h.adds FROM f7_p p LEFT JOIN (
    SELECT p.item_no, p.item_type, p.principal, bit_or(s.rights) AS have, bool_or(s.additional = 'Build') AS adds
    FROM (SELECT DISTINCT item_no, item_type, principal, lower(identifier) AS a, lower(email) AS b FROM f7_p) p
    JOIN f7_s s ON s.item_no = p.item_no AND s.item_type = p.item_type AND lower(s.identifier) IN (p.a, coalesce(p.b, p.a)) GROUP BY 1, 2, 3) h
  USING (item_no, item_type, principal))"""
_TEXT = ("CASE WHEN {m} = 0 THEN 'None' ELSE 'Read' || CASE WHEN {m} & 2 > 0 THEN 'Write' ELSE '' END || CASE WHEN {m} & 4 > 0 THEN 'Reshare' ELSE '' END"
         " || CASE WHEN {m} & 8 > 0 THEN 'Explore' ELSE '' END END")
_PLAN = f"""
  (SELECT *, CASE WHEN action IN ('grant_dataset_user', 'upgrade_dataset_user') THEN {_TEXT.format(m='((rights & 13) | coalesce(have, 0))')} ELSE {_TEXT.format(m='rights')} END AS rights_text,
    CASE WHEN in_role THEN 'role' WHEN action = 'already_present' THEN '' WHEN item_type <> 'SemanticModel' THEN 'no_api' WHEN principal_type = 'App' THEN 'service_principal'
         WHEN rights & 2 > 0 THEN 'write_not_grantable' ELSE '' END AS note
   FROM (SELECT *, CASE WHEN in_role THEN 'already_present' WHEN rights & coalesce(have, 0) = rights AND (additional = '' OR coalesce(adds, false)) THEN 'already_present'
          WHEN item_type <> 'SemanticModel' OR principal_type = 'App' THEN 'manual_portal_share' WHEN coalesce(have, 0) <> 0 THEN 'upgrade_dataset_user' ELSE 'grant_dataset_user' END AS action
     FROM (SELECT h.*, r.principal_key IS NOT NULL AS in_role FROM {_HAVE} h LEFT JOIN f7_role_keys_s r ON r.principal_key = lower(h.identifier))))"""


def _plan(f):
    return sec.share_plan(_p_shares(f), _s_shares(f), f["f7_role_keys_s"], item=ITEM)


@query("share_coverage", f"""
SELECT item_no, item_type, principal, rights::BIGINT AS rights, additional, coalesce(have, 0)::BIGINT AS have, rights & coalesce(have, 0) = rights AS covered FROM {_HAVE}""")
def share_coverage(f):
    return sec.share_coverage(_p_shares(f), _s_shares(f), item=ITEM).select(*ITEM, "principal", "rights", "additional", "have", "covered")


@query("share_plan", f"SELECT item_no, item_type, principal, rights::BIGINT AS rights, additional, action, rights_text, note FROM {_PLAN}")
def share_plan(f):
    return _plan(f).select(*ITEM, "principal", "rights", "additional", "action", "rights_text", "note")


_CLOSURE = """
WITH RECURSIVE reach(g, m) AS (
  SELECT DISTINCT group_id, member_id FROM f7_members WHERE group_id <> member_id
  UNION SELECT r.g, x.member_id FROM reach r JOIN f7_members x ON x.group_id = r.m WHERE x.group_id <> x.member_id),
members AS (SELECT g, m FROM reach WHERE g <> m)
"""


@query("group_members", _CLOSURE + "SELECT g AS group_id, m AS member_id FROM members")
def group_members(f):
    return graph.transitive_members(f["f7_members"])


@query("group_expand", _CLOSURE + """
SELECT item_no, item_type, principal, principal_type, rights::BIGINT AS rights, NULL AS via_group FROM f7_s
UNION ALL SELECT item_no, item_type, m, 'GroupMember', rights, cast(g AS VARCHAR) FROM f7_s JOIN members ON g = principal WHERE principal_type = 'Group'""")
def group_expand(f):
    shares = sec.expand_groups(f["f7_s"], graph.transitive_members(f["f7_members"]), item=ITEM)
    return shares.select(*ITEM, "principal", "principal_type", "rights", "via_group")


@query("share_plan_groups", _CLOSURE + f""",
credit AS (SELECT p.item_no, p.item_type, p.principal, bit_or(s.rights) AS have, bool_or(s.additional = 'Build') AS adds FROM (SELECT DISTINCT item_no, item_type, principal FROM f7_p) p
  JOIN members ON m = p.principal JOIN f7_s s ON s.item_no = p.item_no AND s.item_type = p.item_type AND s.principal = g AND s.principal_type = 'Group' GROUP BY 1, 2, 3),
held AS (SELECT h.* EXCLUDE (have, adds), coalesce(h.have, 0) | coalesce(c.have, 0) AS have, coalesce(h.adds, false) OR coalesce(c.adds, false) AS adds
  FROM {_HAVE} h LEFT JOIN credit c USING (item_no, item_type, principal))
SELECT item_no, item_type, principal, rights::BIGINT AS rights, additional, CASE WHEN r.principal_key IS NOT NULL THEN 'already_present'
  WHEN rights & have = rights AND (additional = '' OR adds) THEN 'already_present' WHEN item_type <> 'SemanticModel' OR principal_type = 'App' THEN 'manual_portal_share'
  WHEN have <> 0 THEN 'upgrade_dataset_user' ELSE 'grant_dataset_user' END AS action FROM held LEFT JOIN f7_role_keys_s r ON r.principal_key = lower(identifier)""")
def share_plan_groups(f):
    members = graph.transitive_members(f["f7_members"])
    return sec.share_plan(_p_shares(f), _s_shares(f), f["f7_role_keys_s"], item=ITEM, members=members).select(
        *ITEM, "principal", "rights", "additional", "action")


@query("action_counts", f"SELECT item_type, action, count(*) AS rows FROM {_PLAN} GROUP BY 1, 2")
def action_counts(f):
    return st.action_counts(_plan(f), by=["item_type", "action"])


_NICK = "'bcdr-ia-' || substr(md5('i' || cast(item_no AS VARCHAR)), 1, 12) || '-' || substr(sha1(rights_text || '|' || additional), 1, 6)"
_ID = "md5('i' || cast(item_no AS VARCHAR))"


@query("access_groups", f"""
SELECT kind, group_key, item_id, item_type, rights_text, additional, count(DISTINCT principal) FILTER (kind = 'managed_group') AS members,
  CASE WHEN item_type = 'SemanticModel' THEN 'api' ELSE 'portal_once' END AS share_mode
FROM (SELECT *, {_ID} AS item_id, CASE WHEN principal_type = 'Group' THEN 'existing_group' ELSE 'managed_group' END AS kind,
  CASE WHEN principal_type = 'Group' THEN cast(principal AS VARCHAR) ELSE {_NICK} END AS group_key FROM {_PLAN} WHERE action = 'manual_portal_share') GROUP BY ALL""")
def access_groups(f):
    plan = _plan(f).withColumn("item_id", F.md5(F.concat(F.lit("i"), F.col("item_no").cast("string"))))
    return sec.access_groups(plan, item_id="item_id")


@query("bitmask_share_plan", """
SELECT item_no, item_type, principal, CASE WHEN f IS NULL THEN 'grant' WHEN hp & a = a AND ha & b = b THEN 'present' ELSE 'upgrade' END AS action,
  CASE WHEN f IS NOT NULL AND NOT (hp & a = a AND ha & b = b) THEN a | hp ELSE a END AS permissions,
  CASE WHEN f IS NOT NULL AND NOT (hp & a = a AND ha & b = b) THEN b | ha ELSE b END AS artifact_permissions
FROM (SELECT item_no, item_type, principal, rights::BIGINT AS a, (rights * 3 % 16)::BIGINT AS b FROM f7_p)
LEFT JOIN (SELECT item_no, item_type, principal, true AS f, bit_or(rights::BIGINT) AS hp, bit_or((rights * 3 % 16)::BIGINT) AS ha FROM f7_s GROUP BY 1, 2, 3) USING (item_no, item_type, principal)""")
def bitmask_share_plan(f):
    masks = [F.col("rights").cast("bigint").alias("permissions"), (F.col("rights") * 3 % 16).cast("bigint").alias("artifact_permissions")]
    rows = lambda v: f[v].select(*ITEM, "principal", *masks)
    return sec.bitmask_share_plan(rows("f7_p"), rows("f7_s"), keys=[*ITEM, "principal"])


@query("direct_shares", """
SELECT item_no::BIGINT AS item_no, kind, status, count(*) AS entries FROM (SELECT *, CASE WHEN folder_role_id IS NOT NULL OR folder_role IS NOT NULL THEN 'inherited'
    WHEN object_id = '' OR kind = '' OR permissions IS NULL THEN 'unparsed' ELSE 'direct' END AS status
  FROM (SELECT *, CASE WHEN group_id IS NOT NULL THEN 'Group' WHEN app_id IS NOT NULL OR is_app THEN 'ServicePrincipal' WHEN upn IS NOT NULL OR user_type = 0 THEN 'User' ELSE '' END AS kind
    FROM f7_entries)) GROUP BY ALL""")
def direct_shares(f):
    return sec.direct_shares(f["f7_entries"]).groupBy("item_no", "kind", "status").agg(F.count(F.lit(1)).alias("entries"))


def _roles(f, side):
    rows = f[f"f13_roles_{side}"]
    members = rows.select("lakehouse", "role_name", "member", "source_path")
    if side == "p":
        members = sec.map_member_paths(members, column="source_path", old="pws", new="sws")
    return sec.normalize_role(rows.select("lakehouse", "role_name", "effect", "attribute", "attribute_value"), members, by=["lakehouse", "role_name"])


@query("normalize_role", """
SELECT lakehouse, role_name, p.rules, p.members, p.r = s.r AS same_rules, p.m = s.m AS same_members FROM
  (SELECT lakehouse, role_name, count(DISTINCT attribute_value) AS rules, count(DISTINCT member) AS members, string_agg(DISTINCT attribute_value, '|' ORDER BY attribute_value) AS r,
     string_agg(DISTINCT member || replace(source_path, 'pws/', 'sws/'), '|' ORDER BY member || replace(source_path, 'pws/', 'sws/')) AS m FROM f13_roles_p GROUP BY 1, 2) p
  FULL JOIN (SELECT lakehouse, role_name, string_agg(DISTINCT attribute_value, '|' ORDER BY attribute_value) AS r,
     string_agg(DISTINCT member || source_path, '|' ORDER BY member || source_path) AS m FROM f13_roles_s GROUP BY 1, 2) s USING (lakehouse, role_name)""")
def normalize_role(f):
    p = _roles(f, "p")
    s = _roles(f, "s").select("lakehouse", "role_name", F.col("rules_digest").alias("s_rules"), F.col("members_digest").alias("s_members"))
    return p.join(s, ["lakehouse", "role_name"], "full").select("lakehouse", "role_name", "rules", "members", (F.col("rules_digest") == F.col("s_rules")).alias("same_rules"),
                                                        (F.col("members_digest") == F.col("s_members")).alias("same_members"))


@query("role_delta", """
SELECT lakehouse, count(*) FILTER (p) AS primary_roles, count(*) FILTER (s) AS secondary_roles, count(*) FILTER (p AND NOT s) AS roles_to_sync, bool_and(p AND s) AS identical,
  CASE WHEN bool_and(p AND s) THEN 'unchanged' WHEN count(*) FILTER (p) = 0 THEN 'no_primary_roles' ELSE 'update' END AS action FROM (
  SELECT lakehouse, role_name, r, m, bool_or(side = 'p') AS p, bool_or(side = 's') AS s FROM (
    SELECT side, lakehouse, role_name, string_agg(DISTINCT attribute_value, '|' ORDER BY attribute_value) AS r, string_agg(DISTINCT member || source_path, '|' ORDER BY member || source_path) AS m
    FROM (SELECT 'p' AS side, lakehouse, role_name, attribute_value, member, replace(source_path, 'pws/', 'sws/') AS source_path FROM f13_roles_p
      UNION ALL SELECT 's', lakehouse, role_name, attribute_value, member, source_path FROM f13_roles_s) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3, 4) GROUP BY lakehouse""")
def role_delta(f):
    return sec.role_delta(_roles(f, "p"), _roles(f, "s"))


def _policies(f):
    rows = f["f13_rules"]
    perm = F.array(F.struct(F.lit("Path").alias("attribute_name"), F.array("table_path").alias("values")), F.struct(F.lit("Action").alias("attribute_name"), F.array(F.lit("Read")).alias("values")))
    column = F.struct("table_path", F.array("column_name").alias("column_names"), F.col("column_effect").alias("effect"), F.array(F.lit("Read")).alias("action"))
    cols = F.when(F.col("has_column_rule"), F.array(column)).otherwise(
        F.array().cast("array<struct<table_path:string,column_names:array<string>,effect:string,action:array<string>>>"))
    rules = F.array(F.struct(F.col("effect"), perm.alias("permission"), cols.alias("columns")))
    return sec.parse_policy(rows.select(F.concat(F.lit("role"), F.col("role_no").cast("string")).alias("role_name"), rules.alias("decision_rules")))


_RULES = """
  (SELECT DISTINCT 'role' || cast(role_no AS VARCHAR) AS role_name, table_path, NULL AS column_name, 'table' AS kind, coalesce(effect, 'Permit') AS effect, NULL AS action FROM f13_rules
   UNION SELECT DISTINCT 'role' || cast(role_no AS VARCHAR), table_path, column_name, 'column', coalesce(nullif(column_effect, ''), 'Permit'), 'Read' FROM f13_rules WHERE has_column_rule)"""


@query("policy_parse", f"SELECT * FROM {_RULES}")
def policy_parse(f):
    return _policies(f)


@query("policy_view", f"""
WITH asked AS (SELECT 'role' || r::VARCHAR AS role_name, '/Tables/sch/t' || t::VARCHAR AS table_path FROM range(7) a(r), range(3) b(t)),
mine AS (SELECT a.role_name, a.table_path, x.kind, x.column_name, x.effect = 'Permit' AS permit FROM asked a JOIN {_RULES} x ON x.role_name = a.role_name AND x.table_path IN (a.table_path, '*')),
cols AS (SELECT unnest(['incident_type', 'claim_amount', 'claim_date']) AS c),
verdict AS (SELECT a.role_name, a.table_path, c.c, coalesce(bool_and(permit) FILTER (kind = 'table'), false) AS readable, count(*) FILTER (kind = 'column') AS rules,
    coalesce(bool_or(permit) FILTER (kind = 'column'), false) AS grants, coalesce(bool_or(permit) FILTER (kind = 'column' AND column_name = c.c), false) AS named,
    coalesce(bool_or(NOT permit) FILTER (kind = 'column' AND column_name = c.c), false) AS denied
  FROM asked a CROSS JOIN cols c LEFT JOIN mine m ON m.role_name = a.role_name AND m.table_path = a.table_path GROUP BY ALL),
shown AS (SELECT role_name, table_path, c FROM verdict WHERE readable AND NOT denied AND (rules = 0 OR NOT grants OR named))
SELECT a.role_name, a.table_path, coalesce(string_agg(s.c, ',' ORDER BY s.c), '') AS columns, CASE WHEN count(s.c) > 0 THEN (SELECT count(*) FROM f10_claims) ELSE 0 END AS rows
FROM asked a LEFT JOIN shown s USING (role_name, table_path) GROUP BY a.role_name, a.table_path""")
def policy_view(f):
    claims, policies = f["f10_claims"].select("incident_type", "claim_amount", "claim_date"), _policies(f)
    views = []
    for role in range(7):
        for table in range(3):
            name, path = f"role{role}", f"/Tables/sch/t{table}"
            seen = sec.policy_view(claims, policies, role=name, table_path=path)
            shown = sec.permitted_columns(policies, role=name, table_path=path, columns=claims.columns)
            views.append(seen.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("role_name"), F.lit(path).alias("table_path"), F.lit(",".join(sorted(shown or []))).alias("columns"), "rows"))
    out = views[0]
    for more in views[1:]:
        out = out.unionByName(more)
    return out


_NAMED = """
  (SELECT database_no, state_desc, permission_name, class_desc, grantee_id, '' AS schema_name, '' AS object_name, '' AS column_name
     FROM f8_cat_permissions WHERE class = 0 AND permission_name <> 'CONNECT'
   UNION ALL
   SELECT a.database_no, state_desc, permission_name, class_desc, grantee_id, coalesce(schema_name, ''), '', ''
     FROM f8_cat_permissions a LEFT JOIN f8_cat_schemas b ON b.database_no = a.database_no AND b.schema_id = a.major_id WHERE class = 3
   UNION ALL
   SELECT a.database_no, state_desc, permission_name, class_desc, grantee_id, coalesce(c.schema_name, ''), coalesce(b.object_name, ''), coalesce(d.column_name, '')
     FROM (SELECT *, CASE WHEN minor_id > 0 THEN minor_id END AS column_no FROM f8_cat_permissions WHERE class = 1) a
     LEFT JOIN f8_cat_objects b ON b.database_no = a.database_no AND b.object_id = a.major_id
     LEFT JOIN f8_cat_schemas c ON c.database_no = b.database_no AND c.schema_id = b.schema_id
     LEFT JOIN f8_cat_columns d ON d.database_no = a.database_no AND d.object_id = a.major_id AND d.column_id = a.column_no)"""


@query("grant_snapshot", f"""
SELECT DISTINCT n.database_no, state_desc AS state, permission_name AS permission, class_desc AS class, schema_name, object_name, column_name, principal_name AS principal
FROM {_NAMED} n JOIN f8_cat_principals u ON u.database_no = n.database_no AND u.principal_id = n.grantee_id
WHERE NOT regexp_matches(lower(principal_name), '^(dbo|public|guest|sys|information_schema)$|^##')""")
def grant_snapshot(f):
    return gr.grant_snapshot(f["f8_cat_permissions"], f["f8_cat_principals"], f["f8_cat_objects"], f["f8_cat_schemas"], f["f8_cat_columns"])


def _q(c: str) -> str:
    return f"'[' || replace({c}, ']', ']]') || ']'"


_STMT = f"""CASE WHEN state = 'DENY' THEN 'DENY ' ELSE 'GRANT ' END || permission || CASE class WHEN 'DATABASE' THEN '' WHEN 'SCHEMA' THEN ' ON SCHEMA::' || {_q('schema_name')}
  ELSE ' ON ' || {_q('schema_name')} || '.' || {_q('object_name')} || CASE WHEN column_name <> '' THEN ' (' || {_q('column_name')} || ')' ELSE '' END END
  || ' TO ' || {_q('principal')} || CASE WHEN state = 'GRANT_WITH_GRANT_OPTION' THEN ' WITH GRANT OPTION' ELSE '' END || ';'"""
_MEMBER = f"'ALTER ROLE ' || {_q('role_name')} || ' ADD MEMBER ' || {_q('member_name')} || ';'"


@query("grant_extra", f"""
SELECT database_name, {_STMT} AS statement FROM (SELECT * FROM f8_s EXCEPT SELECT * FROM f8_p)
UNION ALL SELECT database_name, {_MEMBER} FROM (SELECT * FROM f8_members_s EXCEPT SELECT * FROM f8_members_p)""")
def grant_extra(f):
    return gr.grant_extra(f["f8_p"], f["f8_s"], f["f8_members_p"], f["f8_members_s"])


@query("grant_plan", f"""
SELECT database_name, kind, CASE WHEN kind <> 'skipped' THEN row_number() OVER (PARTITION BY database_name ORDER BY phase, role_name, rank, state, permission, class, schema_name,
  object_name, column_name, principal, member_name) END AS seq, statement FROM (
  SELECT database_name, 'create_role' AS kind, 0 AS phase, role_name, '' AS member_name, 0 AS rank, '' AS state, '' AS permission, '' AS class, '' AS schema_name, '' AS object_name,
    '' AS column_name, '' AS principal, 'CREATE ROLE ' || {_q('role_name')} || ';' AS statement
  FROM (SELECT database_name, role_name FROM f8_members_p EXCEPT SELECT database_name, role_name FROM f8_members_s)
  UNION ALL SELECT database_name, 'role_member', 1, role_name, member_name, 0, '', '', '', '', '', '', '', {_MEMBER} FROM (SELECT * FROM f8_members_p EXCEPT SELECT * FROM f8_members_s)
  UNION ALL SELECT n.database_name, CASE WHEN absent THEN 'skipped' ELSE 'grant' END, CASE WHEN absent THEN 3 ELSE 2 END, '', '',
    CASE class WHEN 'DATABASE' THEN 0 WHEN 'SCHEMA' THEN 1 ELSE CASE WHEN column_name <> '' THEN 3 ELSE 2 END END, state, permission, class, schema_name, object_name, column_name, principal, {_STMT}
  FROM (SELECT x.*, (class = 'SCHEMA' AND NOT EXISTS (SELECT 1 FROM f8_schemas_s z WHERE z.database_name = x.database_name AND z.schema_name = x.schema_name))
      OR (class = 'OBJECT_OR_COLUMN' AND NOT EXISTS (SELECT 1 FROM f8_objects_s z WHERE z.database_name = x.database_name AND z.schema_name = x.schema_name AND z.object_name = x.object_name)) AS absent
    FROM (SELECT * FROM f8_p EXCEPT SELECT * FROM f8_s) x) n)""")
def grant_plan(f):
    return gr.grant_plan(f["f8_p"], f["f8_s"], s_objects=f["f8_objects_s"], s_schemas=f["f8_schemas_s"], p_members=f["f8_members_p"], s_members=f["f8_members_s"])


def _config(f, view):
    config = F.create_map(F.lit("every"), F.array("every"), F.lit("weekdays"), F.when(F.col("weekdays") == "", F.array().cast("array<string>")).otherwise(F.split("weekdays", ";")))
    return f[view].withColumn("config", sch.normalize_config(config)).drop("every", "weekdays")


_CONFIG = """'every=["' || every || '"]' || CASE WHEN coalesce(weekdays, '') = '' THEN '' ELSE '&weekdays=["Mon","Tue"]' END"""
_BAG_P = f"(SELECT *, {_CONFIG} AS config, row_number() OVER (PARTITION BY item_type, item_name, job_type, {_CONFIG} ORDER BY substr(md5(cast(schedule_id AS VARCHAR)), 1, 2), schedule_id) AS n FROM f9_p)"
_BAG_S = _BAG_P.replace("f9_p", "f9_s")
_SCHED = f"""
  (SELECT p.item_type, p.item_name, p.job_type, p.config, p.schedule_id, p.enabled AS primary_enabled, i.item_id AS secondary_item_id,
    CASE WHEN i.item_id IS NOT NULL THEN s.schedule_id END AS secondary_schedule_id,
    CASE WHEN i.item_id IS NULL THEN 'missing_item_in_secondary' WHEN s.schedule_id IS NOT NULL THEN 'present' ELSE 'create_paused' END AS action
   FROM {_BAG_P} p LEFT JOIN f9_items_s i ON i.item_type = p.item_type AND i.item_name = p.item_name
   LEFT JOIN {_BAG_S} s ON s.item_type = p.item_type AND s.item_name = p.item_name AND s.job_type = p.job_type AND s.config = p.config AND s.n = p.n)"""


@query("normalize_config", f"SELECT schedule_id, {_CONFIG} AS config FROM f9_p")
def normalize_config(f):
    return _config(f, "f9_p").select("schedule_id", "config")


@query("schedule_plan", f"SELECT * FROM {_SCHED}")
def schedule_plan(f):
    return sch.schedule_plan(_config(f, "f9_p"), _config(f, "f9_s"), f["f9_items_s"])


@query("schedule_extras", f"SELECT schedule_id, item_name, job_type FROM f9_s WHERE schedule_id NOT IN (SELECT secondary_schedule_id FROM {_SCHED} WHERE secondary_schedule_id IS NOT NULL)")
def schedule_extras(f):
    plan = sch.schedule_plan(_config(f, "f9_p"), _config(f, "f9_s"), f["f9_items_s"])
    return sch.schedule_extras(plan, _config(f, "f9_s")).select("schedule_id", "item_name", "job_type")


@query("schedule_activate", f"""
SELECT m.item_type, m.item_name, m.job_type, m.config, action, CASE WHEN action IN ('create', 'enable') THEN 1 ELSE wanted END AS schedules,
  CASE WHEN action IN ('create', 'enable') THEN wanted - 1 ELSE 0 END AS already_enabled_after, secondary_schedule_id
FROM (SELECT w.*, s.schedule_id AS secondary_schedule_id, CASE WHEN i.item_id IS NULL THEN 'missing_item' WHEN s.schedule_id IS NULL THEN 'create' WHEN s.enabled THEN 'already_enabled' ELSE 'enable' END AS action
  FROM (SELECT item_type, item_name, job_type, {_CONFIG} AS config, count(*) AS wanted FROM f9_p WHERE enabled GROUP BY 1, 2, 3, 4) w
  LEFT JOIN f9_items_s i USING (item_type, item_name)
  LEFT JOIN (SELECT *, {_CONFIG} AS config FROM f9_s QUALIFY row_number() OVER (PARTITION BY item_type, item_name, job_type, {_CONFIG} ORDER BY schedule_id) = 1) s
    USING (item_type, item_name, job_type, config)) m""")
def schedule_activate(f):
    return sch.schedule_activate(_config(f, "f9_p"), _config(f, "f9_s"), f["f9_items_s"])
