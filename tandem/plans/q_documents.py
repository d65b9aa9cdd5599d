"""Queries on definition documents: remap, audit, lineage, hashes, plans, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import documents as doc
from tandem.operators import graph
from tandem.plans.fixtures import PRIMARY_WS, SECONDARY_WS
from tandem.plans.registry import query
from tandem.sources.mappings import merge_mappings

_GUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_NO_IDENTITY = "path <> '.platform' AND path NOT LIKE '%/.platform'"


def _refs(view: str) -> str:
    return f"(SELECT DISTINCT item_id, path, unnest(regexp_extract_all(lower(payload), '{_GUID}')) AS ref FROM {view})"


@query("remap_documents", """
SELECT i.p_id AS item_id, r.path, r.payload FROM f6_parts_r r JOIN f6_ids i USING (k)""")
def remap_documents(f):
    return doc.remap_documents(f["f6_parts_p"], f["f6_map"]).select("item_id", "path", "payload")


@query("remap_encoded", """
SELECT i.p_id AS item_id, r.path, base64(encode(r.payload)) AS payload FROM f6_parts_r r JOIN f6_ids i USING (k)""")
def remap_encoded(f):
    stored = doc.encode_parts(f["f6_parts_p"])
    return doc.encode_parts(doc.remap_documents(doc.decode_parts(stored), f["f6_map"])).select("item_id", "path", "payload")


@query("strip_identity", f"""
SELECT item_id, path, payload FROM f6_parts_p WHERE {_NO_IDENTITY} UNION ALL SELECT item_id, '' AS path, payload FROM f6_parts_p WHERE path = 'meta.json'""")
def strip_identity(f):
    unnamed = f["f6_parts_p"].filter("path = 'meta.json'").withColumn("path", F.lit(None).cast("string"))
    return doc.strip_identity(f["f6_parts_p"].unionByName(unnamed)).select("item_id", "path", "payload")


@query("stale_refs", f"SELECT item_id, path, ref FROM {_refs('f6_parts_s')} JOIN f6_map ON primary_ref = ref")
def stale_refs(f):
    return doc.stale_refs(f["f6_parts_s"], f["f6_map"]).select("item_id", "path", "ref")


_EDGES = f"""
  (SELECT r.item_id AS source_id, r.ref AS target_id, i.item_type AS target_type, CASE WHEN i.side = 'secondary' THEN 'healthy' ELSE 'stale' END AS status,
    CASE WHEN i.side = 'primary' THEN m.secondary_ref END AS expected_id, min(r.path) AS part_path
   FROM {_refs('f6_parts_s')} r JOIN f6_items i ON i.item_id = r.ref LEFT JOIN f6_map m ON m.primary_ref = r.ref
   WHERE r.ref <> r.item_id AND NOT (i.side = 'secondary' AND i.item_type = 'WorkspaceId') GROUP BY ALL)"""


@query("lineage_edges", f"SELECT * FROM {_EDGES}")
def lineage_edges(f):
    return doc.lineage_edges(f["f6_parts_s"], f["f6_items"], f["f6_map"])


@query("lineage_summary", f"""
SELECT target_type, count(*) AS total_connections, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'stale') AS stale FROM {_EDGES} GROUP BY 1""")
def lineage_summary(f):
    return doc.lineage_summary(doc.lineage_edges(f["f6_parts_s"], f["f6_items"], f["f6_map"]), by=["target_type"])


@query("pair_health", """
SELECT pair_id, count(*) AS total_pairs, count(*) FILTER (p AND s) AS healthy, count(*) FILTER (NOT s) AS missing_secondary, count(*) FILTER (NOT p) AS missing_primary
FROM (SELECT pair_id, item_type, display_name, bool_or(side = 'p') AS p, bool_or(side = 's') AS s FROM (
  SELECT pair_id, item_type, display_name, 'p' AS side FROM f2_p UNION ALL SELECT pair_id, item_type, display_name, 's' FROM f2_s) GROUP BY 1, 2, 3) GROUP BY 1""")
def pair_health(f):
    from tandem.operators.reconcile import reconcile

    return doc.pair_health(reconcile(f["f2_p"], f["f2_s"], keys=["item_type", "display_name"]), by=["pair_id"])


@query("lineage_tiers", """
SELECT tier, tier_rank, count(*) AS items FROM (SELECT CASE item_type WHEN 'Lakehouse' THEN 'data_store' WHEN 'Warehouse' THEN 'data_store' WHEN 'SemanticModel' THEN 'model'
    WHEN 'Report' THEN 'consumption' WHEN 'Dashboard' THEN 'consumption' ELSE 'engineering' END AS tier,
  CASE item_type WHEN 'Lakehouse' THEN 0 WHEN 'Warehouse' THEN 0 WHEN 'SemanticModel' THEN 2 WHEN 'Report' THEN 3 WHEN 'Dashboard' THEN 3 ELSE 1 END::BIGINT AS tier_rank FROM f2_s) GROUP BY 1, 2""")
def lineage_tiers(f):
    return doc.lineage_tiers(f["f2_s"]).groupBy("tier", "tier_rank").agg(F.count(F.lit(1)).alias("items"))


@query("fix_plan", f"""
SELECT item_id, count(ref) AS stale_refs, CASE WHEN count(ref) > 0 THEN 'fixed' ELSE 'skipped' END AS action
FROM (SELECT DISTINCT item_id, path FROM f6_parts_s) p LEFT JOIN (SELECT item_id, path, ref FROM {_refs('f6_parts_s')} JOIN f6_map ON primary_ref = ref WHERE {_NO_IDENTITY}) r
  USING (item_id, path) GROUP BY item_id""")
def fix_plan(f):
    return doc.fix_plan(f["f6_parts_s"], f["f6_map"])


_HOST = "lower(regexp_extract({}, '(?i)([a-z0-9-]+\\.(?:[a-z0-9]+-)?(?:datawarehouse|database)\\.fabric\\.microsoft\\.com)', 1))"


@query("connection_map", f"""
SELECT p_id AS primary_ref, s_id AS secondary_ref, 'item' AS kind FROM f6_ids WHERE mapped
UNION SELECT {_HOST.format('p_conn')}, {_HOST.format('s_conn')}, 'sql_host' FROM f6_hosts WHERE s_conn <> ''
UNION SELECT {PRIMARY_WS}, {SECONDARY_WS}, 'workspace'""")
def connection_map(f):
    ids = f["f6_ids"]
    p = ids.select("item_type", "display_name", F.col("p_id").alias("item_id"))
    s = ids.filter("mapped").select("item_type", "display_name", F.col("s_id").alias("item_id"))
    ws = f.sql(f"SELECT {PRIMARY_WS} AS primary_ref, {SECONDARY_WS} AS secondary_ref FROM region WHERE r_regionkey = 0")
    return doc.connection_map(p, s, f["f6_hosts"], ws)


@query("mapping_merge", """
SELECT item_id AS primary_ref, CASE WHEN k % 6 = 0 THEN 'c' WHEN k % 3 = 0 THEN 'a' WHEN k % 2 = 0 THEN 'r' ELSE 'h' END || cast(k AS VARCHAR) AS secondary_ref,
  CASE WHEN k % 6 = 0 THEN 'connection' WHEN k % 3 = 0 THEN 'artifact' WHEN k % 2 = 0 THEN 'reference' ELSE 'host' END AS kind FROM f2_p""")
def mapping_merge(f):
    def rows(kind, letter, keep):
        return f["f2_p"].filter(keep).select(F.col("item_id").alias("primary_ref"), F.concat(F.lit(letter), F.col("k").cast("string")).alias("secondary_ref"), F.lit(kind).alias("kind"))

    return merge_mappings(rows("connection", "c", "k % 6 = 0"), rows("host", "h", "true"), rows("artifact", "a", "k % 3 = 0"), rows("reference", "r", "k % 2 = 0"))


def _digest(*cols: str) -> str:
    return "sha256(" + " || ".join(f"length({c}) || ':' || {c}" for c in cols) + ")"


def _hash(view: str) -> str:
    words = ", ".join(f"sum(cast('0x' || substr(h, {1 + 15 * i}, 15) AS UBIGINT))::VARCHAR" for i in range(4))
    return f"""
  (SELECT k, sha256(concat_ws('/', count(*), {words})) AS definition_hash, count(*) AS parts
   FROM (SELECT DISTINCT k, {_digest('path', 'payload')} AS h FROM {view} WHERE {_NO_IDENTITY}) GROUP BY k)"""


@query("definition_hash", f"SELECT * FROM {_hash('f6_parts_p')}")
def definition_hash(f):
    return doc.definition_hash(f["f6_parts_p"], by=["k"])


_EQUAL = f"""
  (SELECT k, bool_or(p) AS in_primary, bool_or(s) AS in_secondary, bool_and(p AND s) AS equal, count(*) FILTER (NOT (p AND s)) AS differing_parts FROM (
    SELECT k, path, payload, bool_or(side = 'p') AS p, bool_or(side = 's') AS s FROM (
      SELECT k, path, payload, 'p' AS side FROM f6_parts_r UNION ALL SELECT k, path, payload, 's' FROM f6_parts_s WHERE {_NO_IDENTITY}) GROUP BY 1, 2, 3) GROUP BY k)"""


@query("definition_equal", f"SELECT * FROM {_EQUAL}")
def definition_equal(f):
    return doc.definition_equal(doc.remap_documents(f["f6_parts_p"], f["f6_map"]), f["f6_parts_s"], keys=["k"])


@query("definition_delta", f"""
SELECT i.item_type, i.display_name, CASE WHEN i.item_type NOT IN ('Notebook', 'SemanticModel', 'Report') THEN 'not_supported' WHEN p.k IS NULL THEN 'export_failed'
    WHEN by_state OR p.definition_hash IS NOT DISTINCT FROM s.definition_hash THEN 'unchanged' ELSE 'synced' END AS action,
  p.definition_hash AS primary_hash, CASE WHEN NOT by_state THEN s.definition_hash END AS secondary_hash
FROM (SELECT *, k % 5 < 2 AND k % 10 <> 0 AND k % 33 <> 7 AS by_state FROM f6_ids) i
LEFT JOIN (SELECT * FROM {_hash('f6_parts_r')} WHERE k % 33 <> 7) p USING (k) LEFT JOIN {_hash('f6_parts_s')} s USING (k)""")
def definition_delta(f):
    names = f["f6_ids"].select("k", "item_type", "display_name")
    p = doc.definition_hash(doc.remap_documents(f["f6_parts_p"], f["f6_map"]), by=["k"]).filter("k % 33 <> 7")
    s = doc.definition_hash(f["f6_parts_s"], by=["k"])
    state = p.join(names, "k").select("item_type", "display_name", F.when(F.col("k") % 5 < 2, F.col("definition_hash")).otherwise("old").alias("primary_hash"),
                                      (F.col("k") % 10 == 0).alias("changed"))
    return doc.definition_delta(names, p.join(names, "k"), s.join(names, "k"), state)


@query("definition_plan", f"""
SELECT i.p_id AS p_item_id, CASE WHEN i.k % 17 <> 11 THEN i.s_id END AS s_item_id,
  CASE WHEN i.k % 17 = 11 THEN 'create' WHEN e.equal THEN 'unchanged' ELSE 'update' END AS action FROM f6_ids i JOIN {_EQUAL} e USING (k)""")
def definition_plan(f):
    items = f["f6_ids"].select(F.col("p_id").alias("p_item_id"), F.when(F.col("k") % 17 != 11, F.col("s_id")).alias("s_item_id"))
    return doc.definition_plan(items, f["f6_parts_p"].drop("k"), f["f6_parts_s"].drop("k"), f["f6_map"])


_MODES = """
  (SELECT model_id, mode, cast(sum(n) AS BIGINT) AS partitions FROM (
    SELECT model_id, unnest(CASE WHEN path = 'model.bim' THEN ['directLake', 'import'] WHEN body LIKE '%import%' THEN ['import', NULL] ELSE ['dual', 'import'] END) AS mode, 1 AS n
    FROM f13_model_parts) WHERE mode IS NOT NULL GROUP BY 1, 2)"""


@query("storage_modes", f"SELECT * FROM {_MODES}")
def storage_modes(f):
    return doc.storage_modes(f["f13_model_parts"])


@query("model_readiness", f"""
SELECT model_id, coalesce(needs, false) AS needs_data, last_status, NOT coalesce(needs, false) OR coalesce(last_status = 'Completed', false) AS ready
FROM (SELECT DISTINCT k AS model_id FROM f2_p) m
LEFT JOIN (SELECT model_id, bool_or(mode IN ('import', 'directLake', 'dual')) AS needs FROM {_MODES} GROUP BY 1) USING (model_id)
LEFT JOIN (SELECT model_id, arg_max(status, (ended, refresh_id)) AS last_status FROM f13_refreshes GROUP BY 1) USING (model_id)""")
def model_readiness(f):
    models = f["f2_p"].select(F.col("k").alias("model_id"))
    return doc.model_readiness(models, doc.storage_modes(f["f13_model_parts"]), f["f13_refreshes"])


@query("ml_version_plan", """
SELECT model_no::BIGINT AS model_no, version, run_id, experiment_name, s_experiment_id, status, CASE WHEN status = 'register' THEN
    CASE WHEN source_uri = '' THEN 'runs:/{run_id}/model' ELSE 'abfss://sws/' || s_experiment_id || '/{run_id}/artifacts' END END AS new_source
FROM (SELECT v.*, e.experiment_name, e.s_experiment_id, CASE WHEN run_id = '' THEN 'skipped' WHEN s_experiment_id IS NULL THEN 'error' ELSE 'register' END AS status
  FROM f13_ml_versions v LEFT JOIN f13_experiments e USING (experiment_no))""")
def ml_version_plan(f):
    return doc.ml_version_plan(f["f13_ml_versions"], f["f13_experiments"], primary_ws="pws", secondary_ws="sws")


@query("blast_radius", """
WITH RECURSIVE reach(a, n) AS (
  SELECT upstream, downstream FROM f6_edges WHERE upstream <> downstream
  UNION SELECT r.a, e.downstream FROM reach r JOIN f6_edges e ON e.upstream = r.n WHERE e.upstream <> e.downstream)
SELECT k AS node, coalesce(c, 0) AS downstream FROM f6_ids LEFT JOIN (SELECT a, count(*) AS c FROM reach WHERE a <> n GROUP BY a) ON a = k""")
def blast_radius(f):
    return graph.blast_radius(f["f6_edges"])
