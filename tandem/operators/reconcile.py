"""Compare two replicas by key.

``reconcile`` unions the two sides and aggregates once by key. That is one exchange with a
map-side combine: duplicate and null keys collapse before they are shuffled, so a key that holds
a large share of a side costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_SYNC = "in_sync"
MISMATCH = "mismatch"
MISSING = "missing_in_secondary"
EXTRA = "extra_in_secondary"


def _tagged(df: DataFrame, on: Sequence[str], compare: Sequence[str], primary: bool) -> DataFrame:
    return df.select(*on, F.lit(primary).alias("_primary"), *[F.col(c).alias(f"_v_{c}") for c in compare])


def reconcile(p: DataFrame, s: DataFrame, *, keys: Sequence[str], compare: Sequence[str] = (),
              partition: Sequence[str] = ("pair_id",), unique: bool = False) -> DataFrame:
    """One row per key: ``state`` and both sides' values as ``p_<col>`` and ``s_<col>``.

    With ``unique`` the keys are known to identify a row: nothing can be combined before the
    shuffle, so the rows go there first and are sorted once. Otherwise they are combined on the
    map side, and the greatest row of a duplicated key stands for it.
    """
    on = [*partition, *keys]
    both = _tagged(p, on, compare, True).unionByName(_tagged(s, on, compare, False))
    aggs = [F.bool_or("_primary").alias("in_primary"), F.bool_or(~F.col("_primary")).alias("in_secondary")]
    if unique:
        for c in compare:
            aggs.append(F.max(F.when(F.col("_primary"), F.col(f"_v_{c}"))).alias(f"p_{c}"))
            aggs.append(F.max(F.when(~F.col("_primary"), F.col(f"_v_{c}"))).alias(f"s_{c}"))
        rows = both.repartition(*on).groupBy(*on).agg(*aggs)
    else:
        if compare:
            whole = F.struct(*[F.col(f"_v_{c}").alias(c) for c in compare])
            aggs.append(F.max(F.when(F.col("_primary"), whole)).alias("_p"))
            aggs.append(F.max(F.when(~F.col("_primary"), whole)).alias("_s"))
        rows = both.groupBy(*on).agg(*aggs)
        for c in compare:
            rows = rows.withColumn(f"p_{c}", F.col(f"_p.{c}")).withColumn(f"s_{c}", F.col(f"_s.{c}"))
        rows = rows.drop("_p", "_s")
    equal = reduce(Column.__and__, [F.col(f"p_{c}").eqNullSafe(F.col(f"s_{c}")) for c in compare], F.lit(True))
    state = (F.when(~F.col("in_secondary"), MISSING).when(~F.col("in_primary"), EXTRA)
             .when(equal, IN_SYNC).otherwise(MISMATCH))
    values = [c for col in compare for c in (f"p_{col}", f"s_{col}")]
    return rows.withColumn("state", state).select(*on, "state", *values)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match; the key columns come from ``left``."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def missing(p: DataFrame, s: DataFrame, *, keys: Sequence[str], partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Primary rows whose key is not on the secondary."""
    on = [*partition, *keys]
    return null_safe_join(p, s.select(*on).distinct(), on, "left_anti")


def extra(p: DataFrame, s: DataFrame, *, keys: Sequence[str], partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Secondary rows whose key is not on the primary."""
    return missing(s, p, keys=keys, partition=partition)


def matched(p: DataFrame, s: DataFrame, *, keys: Sequence[str], value: str,
            partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Keys on both sides with the id each side gives them (``p_<value>``, ``s_<value>``)."""
    rows = reconcile(p, s, keys=keys, compare=[value], partition=partition)
    return rows.filter(F.col("state").isin(IN_SYNC, MISMATCH)).drop("state")


def presence(p: DataFrame, s: DataFrame, *, keys: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Every key of either side with presence flags and row counts."""
    on = [*partition, *keys]
    both = (p.select(*on, F.lit(1).alias("_p"), F.lit(0).alias("_s"))
            .unionByName(s.select(*on, F.lit(0).alias("_p"), F.lit(1).alias("_s"))))
    return (both.groupBy(*on).agg(F.sum("_p").alias("primary_rows"), F.sum("_s").alias("secondary_rows"))
            .withColumn("in_primary", F.col("primary_rows") > 0)
            .withColumn("in_secondary", F.col("secondary_rows") > 0))


def mirrored(p: DataFrame, s: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Keys found on both sides."""
    return p.select(*keys).intersect(s.select(*keys))


def catalog_drift(p: DataFrame, s: DataFrame, *, partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Item states by (type, name); a name left over on both sides is a type mismatch.

    Exact matches are taken out first, so a table store and its query endpoint with one name do
    not collide.
    """
    rows = reconcile(p, s, keys=["item_type", "display_name"], compare=["item_id"], partition=partition)
    rows = rows.withColumn("state", F.when(F.col("state") == MISMATCH, IN_SYNC).otherwise(F.col("state")))
    name = [*partition, "display_name"]
    left_over = rows.filter(F.col("state") != IN_SYNC)
    is_missing, is_extra = F.col("state") == MISSING, F.col("state") == EXTRA
    both = (left_over.groupBy(*name).agg(
        F.min(F.when(is_extra, F.col("item_type"))).alias("_s_type"),
        F.min_by(F.when(is_extra, F.col("s_item_id")), F.when(is_extra, F.col("item_type"))).alias("_s_id"),
        F.bool_or(is_missing).alias("_any_missing"), F.bool_or(is_extra).alias("_any_extra"))
        .filter(F.col("_any_missing") & F.col("_any_extra")))
    joined = null_safe_join(rows, both, name, "left").drop("_any_missing", "_any_extra")
    changed = F.col("_s_type").isNotNull() & (F.col("state") != IN_SYNC)
    return (joined.filter(~(F.coalesce(changed, F.lit(False)) & is_extra))
            .withColumn("secondary_type", F.when(is_extra | (F.col("state") == IN_SYNC), F.col("item_type"))
                        .when(changed, F.col("_s_type")))
            .withColumn("s_item_id", F.when(changed, F.col("_s_id")).otherwise(F.col("s_item_id")))
            .withColumn("state", F.when(changed, "type_mismatch").otherwise(F.col("state")))
            .drop("_s_type", "_s_id"))


def assignment_delta(p: DataFrame, s: DataFrame, *, partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Role assignments by principal: add, change, unchanged, and removed as a report only."""
    rows = reconcile(p, s, keys=["principal"], compare=["role"], partition=partition)
    action = (F.when(F.col("state") == MISSING, "add").when(F.col("state") == MISMATCH, "change")
              .when(F.col("state") == IN_SYNC, "unchanged").otherwise("removed_detected"))
    return rows.select(*partition, "principal", action.alias("action"),
                       F.col("p_role").alias("primary_role"), F.col("s_role").alias("secondary_role"))


def label_drift(p: DataFrame, s: DataFrame, *, partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Sensitivity labels of items on both sides; both empty is not reported."""
    rows = reconcile(p, s, keys=["item_type", "display_name"], compare=["item_id", "label"], partition=partition)
    have = rows.filter(F.col("state").isin(IN_SYNC, MISMATCH))
    left, right = F.coalesce("p_label", F.lit("")), F.coalesce("s_label", F.lit(""))
    return (have.filter((left != "") | (right != ""))
            .select(*partition, "item_type", "display_name",
                    F.when(left == right, "LABEL_IN_SYNC").otherwise("LABEL_MISMATCH").alias("state"),
                    F.when(left == "", "none").otherwise(left).alias("primary_label"),
                    F.when(right == "", "none").otherwise(right).alias("secondary_label")))


def required_present(required: DataFrame, have: DataFrame, *, keys: Sequence[str],
                     partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Per partition: how many required names exist, how many do not, and whether all do."""
    rows = reconcile(required, have, keys=keys, partition=partition).filter(F.col("state") != EXTRA)
    return (rows.groupBy(*partition).agg(
        F.count_if(F.col("state") == IN_SYNC).alias("present"), F.count_if(F.col("state") == MISSING).alias("missing"))
        .withColumn("ready", F.col("missing") == 0))


def folder_map(p: DataFrame, s: DataFrame, *, partition: Sequence[str] = ("pair_id",)) -> DataFrame:
    """Primary folder to the secondary folder of the same name, or ``create``."""
    rows = reconcile(p, s, keys=["folder_name"], compare=["folder_id"], partition=partition).filter(F.col("state") != EXTRA)
    return rows.select(*partition, "folder_name", F.col("p_folder_id").alias("primary_folder_id"),
                       F.col("s_folder_id").alias("secondary_folder_id"),
                       F.when(F.col("state") == MISSING, "create").otherwise("mapped").alias("action"))


def rebind_plan(reports: DataFrame, p_items: DataFrame, s_items: DataFrame) -> DataFrame:
    """Report to primary model to the secondary model of the same name.

    A report whose model is not in the primary catalog falls back to a model named like itself.
    """
    models = p_items.filter(F.col("item_type") == "SemanticModel").groupBy("pair_id", F.col("item_id").alias("model_id")).agg(
        F.max("display_name").alias("model_name"))
    named = lambda item_type, out: (s_items.filter(F.col("item_type") == item_type)
                                    .groupBy("pair_id", F.col("display_name").alias(f"{out}_name"))
                                    .agg(F.max("item_id").alias(f"s_{out}_id")))
    wanted = (reports.join(models, ["pair_id", "model_id"], "left")
              .withColumn("fallback", F.col("model_name").isNull())
              .withColumn("model_name", F.coalesce("model_name", "report_name")))
    plan = (wanted.join(named("SemanticModel", "model"), ["pair_id", "model_name"], "left")
            .join(named("Report", "report"), ["pair_id", "report_name"], "left"))
    action = (F.when(F.col("s_report_id").isNull(), "report_missing").when(F.col("s_model_id").isNull(), "model_missing")
              .otherwise("rebind"))
    return plan.select("pair_id", "report_name", "report_id", "model_name", "fallback", "s_report_id", "s_model_id",
                       action.alias("action"))


def cleanup_plan(p_tables: DataFrame, s_tables: DataFrame, *, keys: Sequence[str], apply: bool = False) -> DataFrame:
    """Tables only on the secondary. A plan; nothing is deleted here."""
    return extra(p_tables.select(*keys).distinct(), s_tables.select(*keys).distinct(), keys=keys, partition=()).withColumn(
        "status", F.lit("delete" if apply else "would_delete"))


def merge_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides under the union of their columns."""
    return a.unionByName(b, allowMissingColumns=True)


