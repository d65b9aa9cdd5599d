"""Shares, groups, data-access roles and table policies. Plans only: nothing is revoked or downgraded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import rights as rt
from tandem.functions.grouping import bag_digest, row_digest, lookup_join
from tandem.operators.reconcile import null_safe_join

GRANT, UPGRADE, MANUAL, PRESENT = "grant_dataset_user", "upgrade_dataset_user", "manual_portal_share", "already_present"
MODEL = "SemanticModel"


def _split(column: str):
    """';'-joined names to a set."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), ";"), lambda v: v != "")


def _held(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rights and additional permissions added up; the permissions of a kind are few names."""
    return (shares.withColumn("_add", F.explode_outer(_split("additional")))
            .groupBy(*by).agg(F.bit_or("rights").alias("_rights"), F.collect_set("_add").alias("_adds")))


def _per_share(rows: DataFrame, rights: str = "_rights", adds: str = "_adds") -> DataFrame:
    return (rows.select("share_id", F.col(rights).alias("_r"), F.explode_outer(adds).alias("_add"))
            .groupBy("share_id").agg(F.bit_or("_r").alias("have"), F.collect_set("_add").alias("have_additional")))


def principal_overlap(p_shares: DataFrame, s_shares: DataFrame, *, item: Sequence[str]) -> DataFrame:
    """What the secondary already gives to each primary share, where any of the principal's identifiers meet.

    Both sides carry ``keys`` (identifiers) and ``rights`` (bits); primary shares carry a unique
    ``share_id``. Secondary rights are added up per item and identifier first, so each identifier
    of a share meets at most one row; no two lists are compared pairwise.
    """
    have = _held(s_shares.withColumn("_key", F.explode("keys")), [*item, "_key"])
    each = p_shares.select(*item, "share_id", F.explode("keys").alias("_key")).join(have, [*item, "_key"])
    return _per_share(each)


def _credited(members: DataFrame, max_members: int | None) -> DataFrame:
    """Members of the groups that count: all, or those of at most ``max_members`` members where the caller sets a limit."""
    if max_members is None:
        return members
    sized = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_members).select("group_id")
    return null_safe_join(members, sized, ["group_id"], "left_semi")


def expand_groups(shares: DataFrame, members: DataFrame, *, item: Sequence[str], max_members: int | None = None) -> DataFrame:
    """Shares plus a virtual share for each member of a shared group, with the group's rights.

    ``members`` is transitive. Every group counts unless ``max_members`` says otherwise.
    """
    groups = shares.filter(F.col("principal_type") == "Group").withColumnRenamed("principal", "group_id")
    virtual = (groups.join(_credited(members, max_members), "group_id").withColumnRenamed("member_id", "principal")
               .withColumn("principal_type", F.lit("GroupMember")).withColumn("via_group", F.col("group_id").cast("string")).drop("group_id"))
    return shares.withColumn("via_group", F.lit(None).cast("string")).unionByName(virtual.select(*shares.columns, "via_group"))


def group_credit(p_shares: DataFrame, s_shares: DataFrame, members: DataFrame, *, item: Sequence[str], max_members: int | None = None) -> DataFrame:
    """Rights that primary shares get through groups shared on the secondary.

    Only groups that have a share are looked at. The walk goes from the planned principal to its groups and then to the shares of
    those groups, so a large group shared on many items is never multiplied out.
    """
    groups = _held(s_shares.filter(F.col("principal_type") == "Group").withColumnRenamed("principal", "group_id"), [*item, "group_id"])
    shared = null_safe_join(_credited(members, max_members), groups.select("group_id").distinct(), ["group_id"], "left_semi").distinct()
    via = p_shares.select(*item, "share_id", F.col("principal").alias("member_id")).join(shared, "member_id")
    return _per_share(via.join(groups, [*item, "group_id"]))


def share_plan(p_shares: DataFrame, s_shares: DataFrame, s_role_keys: DataFrame, *, item: Sequence[str] = ("item_no", "item_type"),
               members: DataFrame | None = None) -> DataFrame:
    """Per primary share: present, grant, upgrade, or a manual step.

    Write cannot be granted by the service; shares of other items than models, and of service
    principals, are manual. An upgrade asks for the union, so nothing held is lost.
    """
    in_role = (lookup_join(p_shares.select("share_id", F.explode("keys").alias("principal_key")), s_role_keys.select("principal_key").distinct(),
                             on=["principal_key"], spread_by=["share_id"])
               .select("share_id").distinct().withColumn("_in_role", F.lit(True)))
    have = principal_overlap(p_shares, s_shares, item=item)
    if members is not None:
        have = _per_share(have.unionByName(group_credit(p_shares, s_shares, members, item=item)), "have", "have_additional")
    rows = p_shares.join(in_role, "share_id", "left").join(have, "share_id", "left")
    want, held = F.col("rights"), F.coalesce("have", F.lit(0))
    covered = (want.bitwiseAND(held) == want) & (F.size(F.array_except(_split("additional"), F.coalesce(
        "have_additional", F.array().cast("array<string>")))) == 0)
    action = (F.when(F.col("_in_role"), PRESENT).when(covered, PRESENT).when(F.col("item_type") != MODEL, MANUAL)
              .when(F.col("principal_type") == "App", MANUAL).when(held != 0, UPGRADE).otherwise(GRANT))
    grantable = want.bitwiseAND(F.lit(rt.GRANTABLE)).bitwiseOR(held)
    note = (F.when(F.col("_in_role"), "role").when(F.col("action") == PRESENT, "").when(F.col("item_type") != MODEL, "no_api")
            .when(F.col("principal_type") == "App", "service_principal").when(want.bitwiseAND(F.lit(rt.WRITE)) != 0, "write_not_grantable").otherwise(""))
    return (rows.withColumn("action", action).withColumn("note", note)
            .withColumn("rights_text", F.when(F.col("action").isin(GRANT, UPGRADE), rt.rights_text(grantable)).otherwise(rt.rights_text(want)))
            .select(*p_shares.columns, "action", "rights_text", "note"))


def share_coverage(p_shares: DataFrame, s_shares: DataFrame, *, item: Sequence[str] = ("item_no", "item_type")) -> DataFrame:
    """Each primary share with the rights its principal has on the secondary item, and whether they suffice."""
    rows = p_shares.join(principal_overlap(p_shares, s_shares, item=item), "share_id", "left")
    held = F.coalesce("have", F.lit(0))
    return rows.withColumn("have", held).withColumn("covered", F.col("rights").bitwiseAND(held) == F.col("rights")).drop("have_additional")


def bitmask_share_plan(p: DataFrame, s: DataFrame, *, keys: Sequence[str], masks: Sequence[str] = ("permissions", "artifact_permissions")) -> DataFrame:
    """Present when the secondary has every wanted bit; else the union as an upgrade, or a grant."""
    have = s.groupBy(*keys).agg(*[F.bit_or(m).alias(f"_have_{m}") for m in masks], F.lit(True).alias("_found"))
    rows = p.join(have, list(keys), "left")
    covered = F.lit(True)
    for m in masks:
        covered = covered & (F.col(f"_have_{m}").bitwiseAND(F.col(m)) == F.col(m))
    action = F.when(F.col("_found").isNull(), "grant").when(covered, "present").otherwise("upgrade")
    rows = rows.withColumn("action", action)
    for m in masks:
        rows = rows.withColumn(m, F.when(F.col("action") == "upgrade", F.col(m).bitwiseOR(F.col(f"_have_{m}"))).otherwise(F.col(m)))
    return rows.drop("_found", *[f"_have_{m}" for m in masks])


def direct_shares(entries: DataFrame) -> DataFrame:
    """Raw access entries with their kind and whether they count: direct, inherited or malformed."""
    kind = rt.principal_kind("group_id", "app_id", "is_app", "upn", "user_type", "email")
    status = (F.when(rt.is_inherited("folder_role_id", "folder_role"), "inherited")
              .when((F.coalesce("object_id", F.lit("")) == "") | (F.col("kind") == "") | F.col("permissions").isNull(), "unparsed").otherwise("direct"))
    return entries.withColumn("kind", kind).withColumn("status", status)


def access_group_members(plan: DataFrame, *, item_id: str) -> DataFrame:
    """Members of the access groups that stand in for manual shares, one row each.

    Users and service principals go to one managed group per item and set of rights; a share with
    an existing group stays with that group; other kinds are reported as unsupported.
    """
    manual = plan.filter(F.col("action") == MANUAL)
    kind = (F.when(F.col("principal_type") == "Group", "existing_group").when(F.col("principal_type").isin("User", "App"), "managed_group")
            .otherwise("unsupported"))
    rows = manual.withColumn("kind", kind).withColumn(
        "group_key", F.when(F.col("kind") == "existing_group", F.lower(F.col("principal").cast("string")))
        .when(F.col("kind") == "managed_group", rt.group_nickname(item_id, "rights_text", F.coalesce("additional", F.lit("")))))
    return rows.select("kind", "group_key", item_id, "item_type", "rights_text", "additional", "principal", "principal_type").distinct()


def access_groups(plan: DataFrame, *, item_id: str) -> DataFrame:
    """One row per access group with its number of members; the service shares a model by API, other items once by hand."""
    members = access_group_members(plan, item_id=item_id)
    specs = members.groupBy("kind", "group_key", item_id, "item_type", "rights_text", "additional").agg(
        F.count_if(F.col("kind") == "managed_group").alias("members"))
    return specs.withColumn("share_mode", F.when(F.col("item_type") == MODEL, "api").otherwise("portal_once"))


def normalize_role(rules: DataFrame, members: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """A comparable form of each role: fingerprints of its rules, constraints included, and of its members.

    ``rules`` has one row per rule value, ``members`` one per member. Order and repetition do not
    matter, and a role with very many members is not gathered in one place.
    """
    def prints(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c not in by]
        each = df.select(*by, row_digest(*columns).alias("_digest")).distinct()
        return each.groupBy(*by).agg(bag_digest(F.col("_digest")).alias(f"{name}_digest"), F.count(F.lit(1)).alias(name))

    return prints(rules, "rules").join(prints(members, "members"), list(by), "full")


def role_delta(p_roles: DataFrame, s_roles: DataFrame, *, by: Sequence[str] = ("lakehouse",), role: str = "role_name") -> DataFrame:
    """Do the normalised roles of each store agree? ``identical`` stores are skipped, the others synced whole.

    The primary's member paths must already be mapped to the secondary.
    """
    side = lambda df, p: df.select(*by, role, "rules_digest", "members_digest", F.lit(p).alias("_p"))
    each = (side(p_roles, True).unionByName(side(s_roles, False)).groupBy(*by, role, "rules_digest", "members_digest")
            .agg(F.bool_or("_p").alias("_in_p"), F.bool_or(~F.col("_p")).alias("_in_s")))
    out = each.groupBy(*by).agg(
        F.count_if("_in_p").alias("primary_roles"), F.count_if("_in_s").alias("secondary_roles"),
        F.count_if(F.col("_in_p") & ~F.col("_in_s")).alias("roles_to_sync"), F.bool_and(F.col("_in_p") & F.col("_in_s")).alias("identical"))
    action = F.when(F.col("primary_roles") == 0, "no_primary_roles").when(F.col("identical"), "unchanged").otherwise("update")
    return out.withColumn("action", action)


def map_member_paths(members: DataFrame, *, column: str, old: str, new: str) -> DataFrame:
    """Member paths that start with the primary id, moved to the secondary; the others stay."""
    moved = F.concat(F.lit(new), F.substring(column, len(old) + 1, 2147483647))
    return members.withColumn(column, F.when(F.col(column).startswith(old), moved).otherwise(F.col(column)))


PERMIT = "Permit"
EVERY = "*"


def parse_policy(roles: DataFrame) -> DataFrame:
    """Roles with nested rules to rows of (role, table_path, column_name, kind, effect, action).

    ``decision_rules`` is an array of {effect, permission: [{attribute_name, values}], columns: [{table_path, column_names, effect,
    action}]}; a missing effect is Permit. The path '*' stands for every table. ``action`` lists a column rule's actions, sorted.
    """
    rules = roles.select("role_name", F.explode("decision_rules").alias("rule"))
    fields = roles.schema["decision_rules"].dataType.elementType
    column_fields = fields["columns"].dataType.elementType.names
    has = lambda names, name, value: value if name in names else F.lit(None)
    effect = lambda value: F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(PERMIT))
    tables = (rules.select("role_name", effect(has(fields.names, "effect", F.col("rule")["effect"])).alias("effect"), F.explode("rule.permission").alias("perm"))
              .filter("perm.attribute_name = 'Path'").select("role_name", "effect", F.explode("perm.values").alias("table_path"))
              .withColumn("column_name", F.lit(None).cast("string")).withColumn("kind", F.lit("table")).withColumn("action", F.lit(None).cast("string")))
    columns = rules.select("role_name", F.explode("rule.columns").alias("col"))
    action = F.array_join(F.array_sort(has(column_fields, "action", F.col("col")["action"]).cast("array<string>")), ",")
    columns = columns.select("role_name", effect(has(column_fields, "effect", F.col("col")["effect"])).alias("effect"), F.col("col.table_path").alias("table_path"),
                             F.explode("col.column_names").alias("column_name"), F.lit("column").alias("kind"), action.alias("action"))
    return tables.unionByName(columns).select("role_name", "table_path", "column_name", "kind", "effect", "action").distinct()


def permitted_columns(policies: DataFrame, *, role: str, table_path: str, columns: Sequence[str]) -> list[str] | None:
    """Columns a role may read of a table; null when it may not read the table at all.

    A table needs a permit for its path or for '*', and a denial of either outweighs it. Where any column rule names the table,
    only permitted columns that are not denied are shown, even if none of them exists. Whatever is neither Permit nor absent
    denies. The rules of one role and one table that matter are few; only they reach the driver.
    """
    mine = policies.filter((F.col("role_name") == role) & F.col("table_path").isin(table_path, EVERY)).withColumn("permit", F.lower("effect") == PERMIT.lower())
    rules = mine.groupBy("kind").agg(
        F.bool_and("permit").alias("all"), F.bool_or("permit").alias("any"),
        F.collect_set(F.when(F.col("permit") & F.col("column_name").isin(*columns, EVERY), F.col("column_name"))).alias("shown"),
        F.collect_set(F.when(~F.col("permit") & F.col("column_name").isin(*columns, EVERY), F.col("column_name"))).alias("hidden")).collect()
    kinds = {r["kind"]: r for r in rules}
    if "table" not in kinds or not kinds["table"]["all"]:
        return None
    if "column" not in kinds:
        return list(columns)
    shown, hidden = set(kinds["column"]["shown"]), set(kinds["column"]["hidden"])
    if not kinds["column"]["any"]:  # denials alone take away from the whole table
        shown = {EVERY}
    return [c for c in columns if (c in shown or EVERY in shown) and c not in hidden and EVERY not in hidden]


def policy_view(df: DataFrame, policies: DataFrame, *, role: str, table_path: str) -> DataFrame:
    """The table as a role sees it: no rows without a table permit, and only the permitted columns.

    A role with a permit but no column left sees neither rows nor columns.
    """
    columns = permitted_columns(policies, role=role, table_path=table_path, columns=df.columns)
    if columns is None:
        return df.filter(F.lit(False))
    return df.select(*columns) if columns else df.filter(F.lit(False)).select()
