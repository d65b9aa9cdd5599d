"""Definition documents: rewrite and audit references, hash, compare and plan.

``parts`` has one row per part of an item's definition: ``item_id``, ``path``, ``payload`` (text;
pass base64 through ``decode_parts`` first). References are found by one scan of each text and
joined to the known ids; there is no search of every text for every id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import text as tx
from tandem.functions.grouping import bag_digest, row_digest, lookup_join
from tandem.operators.reconcile import EXTRA, MISSING, reconcile

# Item types whose definitions can be exported and compared, storage modes that hold data, tiers.
HASHABLE_TYPES = ("Notebook", "DataPipeline", "SemanticModel", "Report", "SparkJobDefinition", "Dataflow", "Eventstream")
DATA_MODES = ("import", "directLake", "dual")
TIERS = {
    "data_store": ("Lakehouse", "Warehouse", "SQLEndpoint", "KQLDatabase", "Eventhouse", "MirroredDatabase"),
    "engineering": ("Notebook", "DataPipeline", "Dataflow", "Eventstream", "SparkJobDefinition", "MLModel", "MLExperiment", "Environment", "CopyJob"),
    "model": ("SemanticModel",),
    "consumption": ("Report", "Dashboard", "DataAgent", "KQLQueryset", "KQLDashboard"),
}
BIM = "STRUCT<model: STRUCT<tables: ARRAY<STRUCT<partitions: ARRAY<STRUCT<mode: STRING>>>>>>"


def decode_parts(parts: DataFrame) -> DataFrame:
    return parts.withColumn("payload", tx.decode_payload("payload"))


def encode_parts(parts: DataFrame) -> DataFrame:
    return parts.withColumn("payload", tx.encode_payload("payload"))


def strip_identity(parts: DataFrame) -> DataFrame:
    """Without the parts that hold the identity of the source item; a missing path is the path ''."""
    return parts.filter(~tx.is_identity_part("path")).withColumn("path", F.coalesce("path", F.lit("")))


def part_references(parts: DataFrame, *, pattern: str = tx.GUID_PATTERN, keep: Sequence[str] = ("item_id", "path")) -> DataFrame:
    """One row per part and distinct reference in it."""
    return parts.select(*keep, F.explode(tx.references("payload", pattern)).alias("ref"))


def _shaped(column: str, pattern: str):
    return F.coalesce(F.col(column), F.lit("")).rlike(f"^(?:{pattern})$")


def unfindable(mapping: DataFrame, *, pattern: str = tx.REFERENCE_PATTERN) -> DataFrame:
    """Mapping rows that neither the pattern nor a run of whole words can find in a text, such as names in brackets."""
    return mapping.filter(~_shaped("primary_ref", pattern) & tx.word_count(F.coalesce("primary_ref", F.lit(""))).isNull())


def literal_pattern(names: Sequence[str], *, base: str = tx.REFERENCE_PATTERN) -> str:
    """``base`` widened by the few names that ``unfindable`` lists."""
    quoted = "|".join("\\Q" + n.replace("\\E", "\\E\\\\E\\Q") + "\\E" for n in sorted(names, key=len, reverse=True))
    return f"(?:{quoted}|{base})" if quoted else base


def known_references(parts: DataFrame, known: DataFrame, *, pattern: str, keep: Sequence[str] = ("item_id", "path")) -> DataFrame:
    """References of each part that are in ``known`` (``ref``, lower-cased, with what else it has), and ``named``.

    References of a shape are found by the pattern. Other names, such as those of connections, are found as runs of whole
    words, up to the number of words that the longest of them has; ``named`` marks them. One scan of each text either way, and
    no search of every text for every name.
    """
    found = lookup_join(part_references(parts, pattern=pattern, keep=keep), known, on=["ref"], spread_by=list(keep)).withColumn("named", F.lit(False))
    names = known.filter(~_shaped("ref", pattern)).withColumn("_words", tx.word_count("ref")).filter("_words IS NOT NULL")
    longest = names.agg(F.max("_words")).first()[0]
    if not longest:
        return found
    runs = parts.select(*keep, F.explode(tx.word_runs("payload", longest)).alias("ref"))
    return found.unionByName(lookup_join(runs, names.drop("_words"), on=["ref"], spread_by=list(keep)).withColumn("named", F.lit(True)))


def remap_documents(parts: DataFrame, mapping: DataFrame, *, pattern: str = tx.REFERENCE_PATTERN) -> DataFrame:
    """Parts with every mapped primary reference replaced by its secondary one; identity parts dropped.

    Only the distinct references of each part travel to the mapping. What comes back is one small
    map per part, bounded by the text itself. A workspace id named in most documents is spread
    over several copies of its mapping row. Names without a shape are replaced as whole words, the longest first.
    """
    key = ["item_id", "path"]
    kept = strip_identity(parts)
    one_each = mapping.groupBy(F.lower("primary_ref").alias("ref")).agg(F.min("secondary_ref").alias("new_ref"))
    hits = known_references(kept, one_each, pattern=pattern)
    lookups = (hits.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("ref", "new_ref"))).alias("_lookup"),
                                      F.collect_set(F.when(F.col("named"), F.col("ref"))).alias("_names"))
               .withColumn("refs_mapped", F.size("_lookup")))
    joined = kept.join(lookups, key, "left").withColumn("_pattern", tx.names_pattern(F.col("_names")))
    shaped = tx.substitute("payload", F.col("_lookup"), pattern)
    named = tx.substitute("payload", F.col("_lookup"), F.concat(F.lit(f"(?:{pattern})|"), "_pattern"))
    rebuilt = F.when(F.col("_lookup").isNull(), F.col("payload")).when(F.col("_pattern").isNull(), shaped).otherwise(named)
    return joined.withColumn("payload", rebuilt).withColumn("refs_mapped", F.coalesce("refs_mapped", F.lit(0))).drop("_lookup", "_names", "_pattern")


def stale_refs(parts: DataFrame, primary_refs: DataFrame, *, pattern: str = tx.REFERENCE_PATTERN) -> DataFrame:
    """References in secondary documents that still name something on the primary."""
    known = primary_refs.select(F.lower("primary_ref").alias("ref")).distinct()
    return known_references(parts, known, pattern=pattern).drop("named").distinct()


def lineage_edges(parts: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """One edge per source and target among known items: healthy, or stale with the id it should name.

    ``items`` has both sides with a ``side`` column and the workspaces as type ``WorkspaceId``.
    Naming the secondary workspace is expected and gives no edge; naming the primary one is stale.
    """
    catalog = items.groupBy(F.lower("item_id").alias("ref")).agg(
        F.min_by(F.struct("side", "item_type"), "side").alias("_item"))
    expected = mapping.groupBy(F.lower("primary_ref").alias("ref")).agg(F.min("secondary_ref").alias("expected_id"))
    catalog = (catalog.select("ref", F.col("_item.side").alias("side"), F.col("_item.item_type").alias("target_type"))
               .filter(~((F.col("side") == "secondary") & (F.col("target_type") == "WorkspaceId"))).join(expected, "ref", "left"))
    refs = part_references(parts).filter(F.col("ref") != F.lower("item_id"))
    edges = refs.groupBy("item_id", "ref").agg(F.min("path").alias("part_path"))
    found = lookup_join(edges, catalog, on=["ref"], spread_by=["item_id"])
    healthy = F.col("side") == "secondary"
    return found.select(F.col("item_id").alias("source_id"), F.col("ref").alias("target_id"), "target_type",
                        F.when(healthy, "healthy").otherwise("stale").alias("status"),
                        F.when(~healthy, F.col("expected_id")).alias("expected_id"), "part_path")


def lineage_summary(edges: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("total_connections"), F.count_if(F.col("status") == "healthy").alias("healthy"),
                                  F.count_if(F.col("status") == "stale").alias("stale"))


def pair_health(pairs: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Counts of reconciled items: healthy, missing on either side."""
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if(~F.col("state").isin(MISSING, EXTRA)).alias("healthy"),
                                  F.count_if(F.col("state") == MISSING).alias("missing_secondary"),
                                  F.count_if(F.col("state") == EXTRA).alias("missing_primary"))


def lineage_tiers(items: DataFrame) -> DataFrame:
    """Where in the flow of data an item sits, from stores to consumption."""
    tier, rank = F.lit("other"), F.lit(len(TIERS))
    for i, (name, types) in enumerate(TIERS.items()):
        match = F.col("item_type").isin(*types)
        tier, rank = F.when(match, name).otherwise(tier), F.when(match, i).otherwise(rank)
    return items.withColumn("tier", tier).withColumn("tier_rank", rank)


def fix_plan(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Secondary items whose documents need a rewrite, with how many references; the others are skipped."""
    stale = stale_refs(strip_identity(parts), mapping).groupBy("item_id").agg(F.count(F.lit(1)).alias("refs"))
    items = parts.select("item_id").distinct()
    return items.join(stale, "item_id", "left").select(
        "item_id", F.coalesce("refs", F.lit(0)).alias("stale_refs"), F.when(F.col("refs").isNotNull(), "fixed").otherwise("skipped").alias("action"))


def uri_mapping(uris: DataFrame) -> DataFrame:
    """Service addresses (p_uri, s_uri) as host to host; a URI is rewritten by rewriting its host."""
    return (uris.select(tx.uri_host("p_uri").alias("primary_ref"), tx.uri_host("s_uri").alias("secondary_ref"))
            .filter("primary_ref IS NOT NULL AND secondary_ref IS NOT NULL AND primary_ref <> secondary_ref").distinct())


def connection_map(p_items: DataFrame, s_items: DataFrame, hosts: DataFrame, workspaces: DataFrame | None = None) -> DataFrame:
    """Primary reference to secondary reference: item ids by type and name, SQL hosts, and workspace ids.

    ``hosts`` has item_type, display_name, p_conn and s_conn connection strings of the same store.
    """
    rows = reconcile(p_items, s_items, keys=["item_type", "display_name"], compare=["item_id"], partition=())
    ids = rows.filter("p_item_id IS NOT NULL AND s_item_id IS NOT NULL AND p_item_id <> s_item_id").select(
        F.col("p_item_id").alias("primary_ref"), F.col("s_item_id").alias("secondary_ref"), F.lit("item").alias("kind"))
    ends = hosts.select(tx.sql_host("p_conn").alias("primary_ref"), tx.sql_host("s_conn").alias("secondary_ref"), F.lit("sql_host").alias("kind"))
    out = ids.unionByName(ends.filter("primary_ref <> '' AND secondary_ref <> '' AND primary_ref <> secondary_ref"))
    if workspaces is not None:
        out = out.unionByName(workspaces.select("primary_ref", "secondary_ref", F.lit("workspace").alias("kind")))
    return out.distinct()


def definition_hash(parts: DataFrame, *, by: Sequence[str] = ("item_id",)) -> DataFrame:
    """One SHA-256 per item over its set of (path, payload), whatever the order of the parts; identity parts do not count."""
    each = strip_identity(parts).select(*by, row_digest("path", "payload").alias("_digest")).distinct()
    return each.groupBy(*by).agg(bag_digest(F.col("_digest")).alias("definition_hash"), F.count(F.lit(1)).alias("parts"))


def definition_equal(p_parts: DataFrame, s_parts: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Do two items hold the same set of (path, payload)? Compare remapped primary parts with secondary ones."""
    side = lambda df, p: strip_identity(df).select(*keys, row_digest("path", "payload").alias("_digest"), F.lit(p).alias("_p"))
    each = (side(p_parts, True).unionByName(side(s_parts, False)).groupBy(*keys, "_digest")
            .agg(F.bool_or("_p").alias("_in_p"), F.bool_or(~F.col("_p")).alias("_in_s")))
    return each.groupBy(*keys).agg(F.bool_or("_in_p").alias("in_primary"), F.bool_or("_in_s").alias("in_secondary"),
                                   F.bool_and(F.col("_in_p") & F.col("_in_s")).alias("equal"),
                                   F.count_if(~(F.col("_in_p") & F.col("_in_s"))).alias("differing_parts"))


def definition_delta(items: DataFrame, p_hashes: DataFrame, s_hashes: DataFrame, state: DataFrame, *,
                     keys: Sequence[str] = ("item_type", "display_name"), types: Sequence[str] = HASHABLE_TYPES) -> DataFrame:
    """What a sync does with each item, from hashes: unchanged, synced, not_supported or export_failed.

    ``p_hashes`` are of remapped definitions. An item whose primary hash equals the stored one,
    and was not left changed, needs no look at the secondary.
    """
    key = list(keys)
    p = p_hashes.select(*key, F.col("definition_hash").alias("primary_hash"))
    s = s_hashes.select(*key, F.col("definition_hash").alias("secondary_hash"))
    saved = state.select(*key, F.col("primary_hash").alias("saved_hash"), F.col("changed").alias("saved_changed"))
    rows = items.select(*key).distinct().join(p, key, "left").join(saved, key, "left")
    quick = (F.col("primary_hash") == F.col("saved_hash")) & ~F.coalesce("saved_changed", F.lit(False))
    rows = rows.withColumn("by_state", F.coalesce(quick, F.lit(False)))
    rows = rows.join(s, key, "left")
    action = (F.when(~F.col("item_type").isin(*types), "not_supported").when(F.col("primary_hash").isNull(), "export_failed")
              .when(F.col("by_state") | F.col("primary_hash").eqNullSafe(F.col("secondary_hash")), "unchanged").otherwise("synced"))
    return rows.select(*key, action.alias("action"), "primary_hash", F.when(~F.col("by_state"), F.col("secondary_hash")).alias("secondary_hash"))


def definition_plan(items: DataFrame, p_parts: DataFrame, s_parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Create, update, unchanged or skipped per item after remapping.

    ``items`` gives ``p_item_id`` and ``s_item_id`` (null when the secondary has no such item).
    """
    pairs = items.select(F.col("p_item_id").alias("item_id"), "s_item_id")
    remapped = remap_documents(p_parts, mapping).join(pairs, "item_id").select(F.col("item_id").alias("p_item_id"), "path", "payload")
    back = s_parts.join(items.filter("s_item_id IS NOT NULL").select(F.col("s_item_id").alias("item_id"), "p_item_id"), "item_id")
    same = definition_equal(remapped, back.select("p_item_id", "path", "payload"), keys=["p_item_id"])
    rows = items.join(same, "p_item_id", "left")
    action = (F.when(~F.coalesce("in_primary", F.lit(False)), "skipped").when(F.col("s_item_id").isNull(), "create")
              .when(F.col("equal"), "unchanged").otherwise("update"))
    return rows.select("p_item_id", "s_item_id", action.alias("action"))


def storage_modes(parts: DataFrame, *, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Partitions per storage mode of a model, from its text or JSON definition; no mode means import."""
    tmdl, bim = F.endswith("path", F.lit(".tmdl")), F.endswith("path", F.lit("model.bim"))
    explicit = F.regexp_extract_all("body", F.lit(r"(?md)^\s*mode:\s*(\w+)"), F.lit(1))
    partitions = F.size(F.regexp_extract_all("body", F.lit(r"(?md)^\s*partition\s"), F.lit(0)))
    implied = F.array_repeat(F.lit("import"), F.greatest(partitions - F.size(explicit), F.lit(0)))
    nested = F.from_json("body", BIM).getField("model").getField("tables").getField("partitions")
    declared = F.transform(F.flatten(F.filter(nested, lambda p: p.isNotNull())),
                           lambda p: F.coalesce(F.nullif(p.getField("mode"), F.lit("")), F.lit("import")))
    modes = F.when(tmdl, F.concat(explicit, implied)).when(bim, F.coalesce(declared, F.array().cast("array<string>")))
    return parts.select(*by, F.explode(modes).alias("mode")).groupBy(*by, "mode").agg(F.count(F.lit(1)).alias("partitions"))


def model_readiness(models: DataFrame, modes: DataFrame, refreshes: DataFrame, *, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Can a model be queried? One that stores data needs a completed last refresh."""
    needs = modes.groupBy(*by).agg(F.bool_or(F.col("mode").isin(*DATA_MODES)).alias("needs_data"))
    last = refreshes.groupBy(*by).agg(F.max_by("status", F.struct("ended", "refresh_id")).alias("last_status"))
    rows = models.select(*by).distinct().join(needs, list(by), "left").join(last, list(by), "left")
    needs_data = F.coalesce("needs_data", F.lit(False))
    return rows.select(*by, needs_data.alias("needs_data"), "last_status",
                       (~needs_data | F.coalesce(F.col("last_status") == "Completed", F.lit(False))).alias("ready"))


def ml_version_plan(versions: DataFrame, experiments: DataFrame, *, primary_ws: str, secondary_ws: str) -> DataFrame:
    """Model versions to register on the secondary, with the source address rewritten.

    A version without a run is skipped; one whose experiment has no namesake is an error. The new
    run's id is not known before it exists, so the plan names it ``{run_id}``.
    """
    rows = versions.join(experiments, "experiment_no", "left")
    status = (F.when(F.coalesce("run_id", F.lit("")) == "", "skipped").when(F.col("s_experiment_id").isNull(), "error").otherwise("register"))
    moved = F.replace(F.replace(F.replace("source_uri", F.col("run_id"), F.lit("{run_id}")), F.col("p_experiment_id"), F.col("s_experiment_id")),
                      F.lit(primary_ws), F.lit(secondary_ws))
    source = (F.when(F.coalesce("source_uri", F.lit("")) == "", F.lit("runs:/{run_id}/model"))
              .when(F.contains("source_uri", F.col("run_id")), moved).otherwise(F.col("source_uri")))
    return rows.withColumn("status", status).select("model_no", "version", "run_id", "experiment_name", "s_experiment_id", "status",
                                                    F.when(F.col("status") == "register", source).alias("new_source"))


def user_tags(tags):
    """A run's tags without the ones the tracker sets itself."""
    return F.map_filter(tags, lambda k, _: ~k.startswith("mlflow."))
