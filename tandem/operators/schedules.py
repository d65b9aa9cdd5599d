"""Job schedules: replicate them paused, and enable them on failover.

Within an item and job type, equal configurations are matched one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.grouping import ordinal, spread

KEY = ["item_type", "item_name", "job_type"]


def normalize_config(config: Column | str) -> Column:
    """A configuration (map of name to list) without nulls and empty lists, lists sorted, as one canonical text."""
    col = F.col(config) if isinstance(config, str) else config
    kept = F.map_filter(col, lambda _, v: v.isNotNull() & (F.size(v) > 0))
    entries = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(
        e.getField("key"), F.lit("="), F.to_json(F.array_sort(e.getField("value"))))))
    return F.array_join(entries, "&")


def schedule_plan(p: DataFrame, s: DataFrame, s_items: DataFrame) -> DataFrame:
    """Per primary schedule: present on the secondary, to be created paused, or its item is missing.

    The n-th of equal schedules on one side meets the n-th on the other. Numbers are given in a
    spread order, so a bag that holds a large share of all schedules is numbered by many tasks.
    """
    numbered = lambda df: ordinal(df.withColumn("_spread", spread("schedule_id")), group=[*KEY, "config"], levels=[["_spread"]],
                                  rest=["schedule_id"], out="_n").drop("_spread")
    items = s_items.select("item_type", "item_name", F.col("item_id").alias("secondary_item_id"))
    wanted = numbered(p).join(items, ["item_type", "item_name"], "left")
    have = numbered(s).select(*KEY, "config", "_n", F.col("schedule_id").alias("secondary_schedule_id"))
    rows = wanted.join(have, [*KEY, "config", "_n"], "left")
    no_item = F.col("secondary_item_id").isNull()
    action = F.when(no_item, "missing_item_in_secondary").when(F.col("secondary_schedule_id").isNotNull(), "present").otherwise("create_paused")
    return rows.select(*KEY, "config", "schedule_id", F.col("enabled").alias("primary_enabled"), "secondary_item_id",
                       F.when(~no_item, F.col("secondary_schedule_id")).alias("secondary_schedule_id"), action.alias("action"))


def schedule_extras(plan: DataFrame, s: DataFrame) -> DataFrame:
    """Secondary schedules no primary one was matched to. A report."""
    used = plan.filter("secondary_schedule_id IS NOT NULL").select(F.col("secondary_schedule_id").alias("schedule_id"))
    return s.join(used, "schedule_id", "left_anti")


def schedule_activate(manifest: DataFrame, s: DataFrame, s_items: DataFrame) -> DataFrame:
    """On failover: what becomes of each enabled schedule of the manifest.

    Equal schedules share one replica: once it is enabled the others find it enabled. The first of
    a bag therefore decides, and the rest are ``already_enabled``.
    """
    wanted = manifest.filter("enabled").groupBy(*KEY, "config").agg(F.count(F.lit(1)).alias("wanted"), F.min("schedule_id").alias("schedule_id"))
    first = F.min_by(F.struct("schedule_id", "enabled"), F.col("schedule_id"))
    have = s.groupBy(*KEY, "config").agg(first.alias("_first"))
    items = s_items.select("item_type", "item_name", "item_id")
    rows = wanted.join(items, ["item_type", "item_name"], "left").join(have, [*KEY, "config"], "left")
    action = (F.when(F.col("item_id").isNull(), "missing_item").when(F.col("_first").isNull(), "create")
              .when(F.col("_first.enabled"), "already_enabled").otherwise("enable"))
    rows = rows.withColumn("action", action)
    changed = F.col("action").isin("create", "enable")
    return rows.select(*KEY, "config", "action", F.when(changed, 1).otherwise(F.col("wanted")).cast("bigint").alias("schedules"),
                       F.when(changed, F.col("wanted") - 1).otherwise(0).alias("already_enabled_after"),
                       F.col("_first.schedule_id").alias("secondary_schedule_id"))
