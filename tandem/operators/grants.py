"""SQL grants: catalog snapshot, delta, and the ordered plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import rights as rt
from tandem.functions.grouping import ordinal
from tandem.session import materialize

TUPLE = ["state", "permission", "class", "schema_name", "object_name", "column_name", "principal"]
MEMBER = ["role_name", "member_name"]


def grant_snapshot(permissions: DataFrame, principals: DataFrame, objects: DataFrame, schemas: DataFrame, columns: DataFrame) -> DataFrame:
    """Grants by name from the catalog tables; system principals and plain CONNECT do not count.

    Class 0 is the database, 1 an object or column, 3 a schema; the object and column joins hold
    for class 1 only.
    """
    pe = permissions.filter(F.col("class").isin(0, 1, 3))
    pr = principals.select("database_no", F.col("principal_id").alias("grantee_id"), "principal_name")
    rows = pe.join(pr, ["database_no", "grantee_id"]).filter(~rt.is_skipped_principal("principal_name"))
    rows = rows.filter(~((F.col("class_desc") == "DATABASE") & (F.col("permission_name") == "CONNECT")))
    # Each class is joined on keys that its rows have: a null key would gather a database's rows of the other classes in one task.
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    whole = rows.filter("class = 0").select("*", *none("schema_name", "object_name", "column_name"))
    by_schema = rows.filter("class = 3").withColumn("schema_id", F.col("major_id")).join(schemas, ["database_no", "schema_id"], "left")
    by_schema = by_schema.select(*rows.columns, "schema_name", *none("object_name", "column_name"))
    by_object = rows.filter("class = 1").withColumn("object_id", F.col("major_id")).withColumn("column_id", F.when(F.col("minor_id") > 0, F.col("minor_id")))
    by_object = by_object.join(objects, ["database_no", "object_id"], "left").join(schemas, ["database_no", "schema_id"], "left")
    by_object = by_object.join(columns, ["database_no", "object_id", "column_id"], "left").select(*rows.columns, "schema_name", "object_name", "column_name")
    rows = whole.unionByName(by_schema).unionByName(by_object)
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("database_no", text("state_desc").alias("state"), text("permission_name").alias("permission"), text("class_desc").alias("class"),
                       text("schema_name").alias("schema_name"), text("object_name").alias("object_name"), text("column_name").alias("column_name"),
                       F.col("principal_name").alias("principal")).distinct()


def scope_rank():
    """Database, schema, object, column. A grant on an object clears those on its columns, so columns come last."""
    return (F.when(F.col("class") == "DATABASE", 0).when(F.col("class") == "SCHEMA", 1)
            .when(F.col("column_name") != "", 3).otherwise(2))


def grant_extra(p: DataFrame, s: DataFrame, p_members: DataFrame, s_members: DataFrame) -> DataFrame:
    """What only the secondary has, as statements. A report: it is never revoked."""
    grants = _only(s, p, TUPLE).select("database_name", rt.grant_statement().alias("statement"))
    members = _only(s_members, p_members, MEMBER)
    return grants.unionByName(members.select("database_name", _add_member().alias("statement")))


def _only(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` does not have: one aggregate for the distinct and the difference."""
    on = ["database_name", *keys]
    both = a.select(*on, F.lit(False).alias("_there")).unionByName(b.select(*on, F.lit(True).alias("_there")))
    return both.groupBy(*on).agg(F.bool_or("_there").alias("_there")).filter(~F.col("_there")).drop("_there")


def _add_member():
    return F.concat(F.lit("ALTER ROLE "), rt.quote_ident("role_name"), F.lit(" ADD MEMBER "), rt.quote_ident("member_name"), F.lit(";"))


def grant_plan(p: DataFrame, s: DataFrame, *, s_objects: DataFrame, s_schemas: DataFrame, p_members: DataFrame, s_members: DataFrame) -> DataFrame:
    """Statements that bring each database up to the primary, in the order they must run.

    Roles come before members and members before grants; grants go by scope and then by tuple. A
    grant on something the secondary does not have is skipped and keeps no place in the order.
    """
    empty = F.lit("")
    blank = [empty.alias(c) for c in TUPLE]
    roles = _only(p_members, s_members, ["role_name"])
    members = _only(p_members, s_members, MEMBER)
    new = _only(p, s, TUPLE)
    on_schema = s_schemas.select("database_name", "schema_name").distinct().withColumn("_schema", F.lit(True))
    on_object = s_objects.select("database_name", "schema_name", "object_name").distinct().withColumn("_object", F.lit(True))
    new = new.join(on_schema, ["database_name", "schema_name"], "left").join(on_object, ["database_name", "schema_name", "object_name"], "left")
    absent = (((F.col("class") == "SCHEMA") & F.col("_schema").isNull()) | ((F.col("class") == "OBJECT_OR_COLUMN") & F.col("_object").isNull()))
    rows = (roles.select("database_name", F.lit("create_role").alias("kind"), F.col("role_name"), empty.alias("member_name"), F.lit(0).alias("scope"), *blank,
                         F.concat(F.lit("CREATE ROLE "), rt.quote_ident("role_name"), F.lit(";")).alias("statement"))
            .unionByName(members.select("database_name", F.lit("role_member").alias("kind"), "role_name", "member_name", F.lit(0).alias("scope"), *blank,
                                        _add_member().alias("statement")))
            .unionByName(new.select("database_name", F.when(absent, "skipped").otherwise("grant").alias("kind"), empty.alias("role_name"),
                                    empty.alias("member_name"), scope_rank().alias("scope"), *TUPLE, rt.grant_statement().alias("statement"))))
    phase = F.when(F.col("kind") == "create_role", 0).when(F.col("kind") == "role_member", 1).when(F.col("kind") == "grant", 2).otherwise(3)
    # A delta is small next to the grants it comes from; it is kept rather than worked out again for the counts.
    rows = materialize(rows.withColumn("phase", phase))
    # Leading columns and then the heads of the names split a large database, schema or role over many tasks.
    # Only members have a member name and only grants an object, so the two heads do not disturb the order.
    heads = rows.withColumn("_object_head", F.substring("object_name", 1, 8)).withColumn("_member_head", F.substring("member_name", 1, 8))
    ranked = ordinal(heads, group=["database_name"],
                     levels=[["phase", "role_name", "scope", "state", "permission", "class", "schema_name"], ["_object_head", "_member_head"]],
                     rest=["object_name", "column_name", "principal", "member_name"], out="seq")
    return ranked.select("database_name", "kind", F.when(F.col("phase") < 3, F.col("seq")).alias("seq"), "statement")
