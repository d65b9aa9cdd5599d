"""Roll-ups: inventory, coverage, lag, readiness and the checks before a failover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.reconcile import EXTRA, IN_SYNC, MISMATCH, MISSING, reconcile

# Names of items the service itself creates, and item groups.
SYSTEM_PREFIXES = ("BCDR_",)
DATA_STORAGE = ("Lakehouse", "Warehouse", "SQLEndpoint", "KQLDatabase", "Eventhouse")
NOT_REPLICABLE = ("Warehouse", "SQLEndpoint")
CRITICAL_CHECKS = ("region", "rpo", "items", "models", "refs")
LAG_SOURCES = ("schedule", "autosync", "azcopy", "azcopy_schedule", "notebook_job")


def is_system_item(name: str = "display_name", prefixes: Sequence[str] = SYSTEM_PREFIXES):
    tests = [F.coalesce(F.col(name), F.lit("")).startswith(p) for p in prefixes]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def business_items(items: DataFrame, *, prefixes: Sequence[str] = SYSTEM_PREFIXES) -> DataFrame:
    return items.filter(~is_system_item(prefixes=prefixes))


def system_items(items: DataFrame, *, prefixes: Sequence[str] = SYSTEM_PREFIXES) -> DataFrame:
    return items.filter(is_system_item(prefixes=prefixes))


def _sides(p: DataFrame, s: DataFrame, *columns: str) -> DataFrame:
    return (p.select(*columns, F.lit("primary").alias("side"))
            .unionByName(s.select(*columns, F.lit("secondary").alias("side"))))


def _side_counts(p: DataFrame, s: DataFrame, by: Sequence[str]) -> DataFrame:
    return _sides(p, s, *by).groupBy(*by).agg(
        F.count_if(F.col("side") == "primary").alias("primary_count"),
        F.count_if(F.col("side") == "secondary").alias("secondary_count"))


def _sync_pct(primary: str, secondary: str):
    return F.when(F.col(primary) == 0, 0.0).otherwise(
        100.0 * F.least(F.col(secondary), F.col(primary)) / F.greatest(F.col(primary), F.lit(1)))


def inventory(p: DataFrame, s: DataFrame) -> DataFrame:
    """Items per pair and type on each side, with the share of counts."""
    return _side_counts(p, s, ["pair_id", "item_type"]).withColumn(
        "sync_pct", F.round(_sync_pct("primary_count", "secondary_count"), 4))


def coverage(p: DataFrame, s: DataFrame) -> DataFrame:
    """Per pair and type: distinct names on each side and on both, percentage rounded half to even."""
    names = reconcile(p, s, keys=["item_type", "display_name"])
    cards = names.groupBy("pair_id", "item_type").agg(
        F.count_if(F.col("state") != EXTRA).alias("primary_count"),
        F.count_if(F.col("state") != MISSING).alias("secondary_count"),
        F.count_if(F.col("state") == IN_SYNC).alias("mirrored_count"))
    pct = F.when(F.col("primary_count") > 0, F.bround(F.col("mirrored_count") * 100.0 / F.col("primary_count"), 0)).otherwise(0.0)
    return (cards.withColumn("percentage", pct.cast("bigint"))
            .withColumn("category", F.when(F.col("item_type").isin(*DATA_STORAGE), "data_storage").otherwise("components"))
            .withColumn("supported", ~F.col("item_type").isin(*NOT_REPLICABLE)))


def coverage_gaps(p: DataFrame, s: DataFrame) -> DataFrame:
    """One row per missing or extra name, with the number of gaps of its type.

    Long form on purpose: a list per type would put all names of a type into one row.
    """
    gaps = reconcile(p, s, keys=["item_type", "display_name"]).filter(F.col("state") != IN_SYNC)
    counts = gaps.groupBy("pair_id", "item_type").agg(F.count(F.lit(1)).alias("gap_count"))
    return gaps.join(counts, ["pair_id", "item_type"]).select(
        "pair_id", "item_type", "gap_count", F.col("state").alias("gap"), "display_name")


def drift_counts(drift: DataFrame) -> DataFrame:
    """States per pair and type, as one column each, with the severity used to order them."""
    count = lambda state: F.count_if(F.col("state") == state)
    return (drift.groupBy("pair_id", "item_type").agg(
        count(IN_SYNC).alias("synced"), count("type_mismatch").alias("mismatch"),
        count(MISSING).alias("missing"), count(EXTRA).alias("extra"))
        .withColumn("severity", F.when(F.col("missing") > 0, 0).when(F.col("mismatch") > 0, 1)
                    .when(F.col("extra") > 0, 2).otherwise(3)))


def _count_check(counts: DataFrame, artifact, check) -> DataFrame:
    variance = F.abs(F.col("primary_count") - F.col("secondary_count"))
    return counts.select("pair_id", artifact.alias("artifact"), check.alias("check"), F.col("primary_count").alias("primary_value"),
                         F.col("secondary_count").alias("secondary_value"), variance.alias("variance"),
                         F.when(variance == 0, "pass").otherwise("warning").alias("status"))


def count_checks(p: DataFrame, s: DataFrame, *, p_tables: DataFrame, s_tables: DataFrame,
                 p_rows: DataFrame | None = None, s_rows: DataFrame | None = None) -> DataFrame:
    """Assurance checks: items per type, tables per store, existence of the store, rows per table.

    ``*_tables`` hold one row per (pair_id, store, table_key), ``*_rows`` one per row of the
    tables. Data stores are checked by their tables, not by their number.
    """
    stores = ("Lakehouse", "Warehouse")
    types = _side_counts(p.filter(~F.col("item_type").isin(*stores)), s.filter(~F.col("item_type").isin(*stores)), ["pair_id", "item_type"])
    out = _count_check(types, F.col("item_type"), F.lit("Item Count"))
    tables = _side_counts(p_tables, s_tables, ["pair_id", "store"]).filter(F.col("primary_count") > 0)
    store = F.concat(F.lit("Store: "), "store")
    gone = F.col("secondary_count") == 0
    by_store = _count_check(tables, store, F.when(gone, "Existence").otherwise("Table Count"))
    missing = F.col("check") == "Existence"
    out = out.unionByName(by_store.withColumn("variance", F.when(~missing, F.col("variance")))
                          .withColumn("status", F.when(missing, "fail").otherwise(F.col("status"))))
    if p_rows is not None and s_rows is not None:
        counts = _side_counts(p_rows, s_rows, ["pair_id", "store", "table_key"]).filter(F.col("primary_count") > 0)
        out = out.unionByName(_count_check(counts, F.concat("store", F.lit(" -> "), "table_key"), F.lit("Row Count")))
    return out


def health_score(items: DataFrame, capacity: DataFrame) -> DataFrame:
    """Health per pair from capacity state and item count; 0 when the side could not be read."""
    counts = business_items(items).groupBy("pair_id").agg(F.count(F.lit(1)).alias("item_count"))
    rows = capacity.join(counts, "pair_id", "left").withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    state = F.lower(F.coalesce("capacity_state", F.lit("")))
    branches = lambda error, stopped, empty, unknown, ok: (
        F.when(F.col("read_error"), error).when((state != "") & (state != "active"), stopped)
        .when(F.col("item_count") == 0, empty).when(state == "", unknown).otherwise(ok))
    return rows.select("pair_id", "item_count", branches(0, 25, 50, 75, 100).alias("health"),
                       branches(F.lit("ERROR"), F.concat(F.lit("CAPACITY_"), F.upper(state)), F.lit("EMPTY"),
                                F.lit("CAPACITY_UNKNOWN"), F.lit("HEALTHY")).alias("status"))


def lag_status(lags: DataFrame) -> DataFrame:
    """HEALTHY / NEEDS_SYNC / STALE / NO_DR from ``has_secondary``, ``lag_minutes``, ``artifact_drift``."""
    lag = F.col("lag_minutes")
    return lags.withColumn("status", F.when(~F.col("has_secondary"), "NO_DR").when(lag.isNull(), "NEEDS_SYNC")
                           .when((lag <= 15) & (F.col("artifact_drift") == 0), "HEALTHY")
                           .when(lag <= 60, "NEEDS_SYNC").otherwise("STALE"))


def replication_lag(events: DataFrame, *, now) -> DataFrame:
    """Latest sync event per pair over all sources; on a tie the earlier source in ``LAG_SOURCES`` wins."""
    rank = F.array_position(F.array(*[F.lit(s) for s in LAG_SOURCES]), F.col("source"))
    best = events.filter((rank > 0) & F.col("ts").isNotNull()).groupBy("pair_id").agg(
        F.max_by(F.struct("source", "ts"), F.struct("ts", -rank)).alias("best"))
    minutes = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("best.ts").cast("timestamp"))) / 60000000
    return best.select("pair_id", F.col("best.source").alias("lag_source"), F.col("best.ts").alias("last_sync_ts"),
                       F.round(minutes, 1).alias("lag_minutes"))


def readiness(checks: DataFrame, *, rpo: DataFrame | None = None) -> DataFrame:
    """Verdict per pair from (check_id, level). Not being able to tell is never GO.

    With ``rpo`` (pair_id, measured_rpo_hours) each pair also says how many hours of data a failover now would lose.
    """
    level = lambda name: F.count_if(F.col("level") == name).alias(name)
    blind = F.count_if((F.col("level") == "unknown") & F.col("check_id").isin(*CRITICAL_CHECKS))
    out = checks.groupBy("pair_id").agg(level("ok"), level("warn"), level("bad"), level("unknown"), blind.alias("blind"))
    verdict = (F.when(F.col("bad") > 0, "NO-GO").when(F.col("blind") > 0, "CAN'T ASSESS")
               .when((F.col("warn") > 0) | (F.col("unknown") > 0), "GO WITH RISK").otherwise("GO"))
    out = out.withColumn("verdict", verdict).drop("blind")
    if rpo is None:
        return out
    return out.join(rpo.groupBy("pair_id").agg(F.max("measured_rpo_hours").alias("expected_data_loss_hours")), "pair_id", "left")


def readiness_checks(pairs: DataFrame, *, rpo: DataFrame | None = None, coverage_rows: DataFrame | None = None,
                     models: DataFrame | None = None, schedules: DataFrame | None = None, shares: DataFrame | None = None,
                     lineage: DataFrame | None = None, gateways: DataFrame | None = None) -> DataFrame:
    """The checks behind ``readiness``, one row per pair and check.

    ``pairs`` has pair_id, primary_region, secondary_region, secondary_capacity_state. A source
    that is not given, or has no row for a pair, leaves its check ``unknown``. Schedules and shares whose scan failed or
    was not made come as rows of action ``error`` or ``not_scanned``; both are open work.
    """
    rows = pairs
    pr, sr = F.coalesce("primary_region", F.lit("")), F.coalesce("secondary_region", F.lit(""))
    cap = F.lower(F.coalesce("secondary_capacity_state", F.lit("")))
    levels = {"region": F.when((pr == "") | (sr == ""), "unknown").when(pr == sr, "bad").otherwise("ok"),
              "capacity": F.when(cap == "", "unknown").when(cap == "active", "ok").otherwise("warn")}

    def add(check_id: str, source: DataFrame | None, aggregates: dict, level) -> None:
        """Join one row of figures per pair; a pair without one is not known."""
        nonlocal rows
        if source is None:
            levels[check_id] = F.lit("unknown")
            return
        figures = source.groupBy("pair_id").agg(*[c.alias(f"_{n}") for n, c in aggregates.items()], F.lit(True).alias(f"_seen_{check_id}"))
        rows = rows.join(figures, "pair_id", "left")
        levels[check_id] = F.when(F.col(f"_seen_{check_id}").isNull(), "unknown").otherwise(level)

    hours = F.col("_hours")
    add("rpo", rpo, {"hours": F.max("measured_rpo_hours"), "diverged": F.max("diverged")},
        F.when(hours.isNull(), "unknown").when(F.col("_diverged") > 0, "bad").when(hours <= 1, "ok").when(hours <= 24, "warn").otherwise("bad"))
    add("items", None if coverage_rows is None else coverage_rows.filter("supported"),
        {"gap": F.sum(F.col("primary_count") - F.col("mirrored_count"))}, F.when(F.col("_gap") > 0, "warn").otherwise("ok"))
    add("models", models, {"not_ready": F.count_if(~F.col("ready"))}, F.when(F.col("_not_ready") > 0, "bad").otherwise("ok"))
    add("schedules", schedules, {"todo": F.count_if((F.col("action") != "present") | F.col("enabled_on_secondary"))},
        F.when(F.col("_todo") > 0, "warn").otherwise("ok"))
    add("perms", shares, {"open": F.count_if(F.col("action") != "already_present")}, F.when(F.col("_open") > 0, "warn").otherwise("ok"))
    add("refs", lineage, {"stale": F.count_if(F.col("status") == "stale")}, F.when(F.col("_stale") > 0, "bad").otherwise("ok"))
    add("gateways", gateways, {"n_bad": F.count_if(F.col("level") == "bad"), "n_open": F.count_if(F.col("level") != "ok")},
        F.when(F.col("_n_bad") > 0, "bad").when(F.col("_n_open") > 0, "warn").otherwise("ok"))
    checks = F.explode(F.array(*[F.struct(F.lit(n).alias("check_id"), level.alias("level")) for n, level in levels.items()]))
    return rows.select("pair_id", checks.alias("_check")).select("pair_id", "_check.check_id", "_check.level")


def failover_simulation(p: DataFrame, s: DataFrame) -> DataFrame:
    """Dry run per pair: both sides readable, and count coverage of at least 80 per cent."""
    counts = _side_counts(p, s, ["pair_id"])
    pct = F.bround(100.0 * F.least("secondary_count", "primary_count") / F.greatest("primary_count", F.lit(1)), 0)
    return (counts.withColumn("sync_pct", pct.cast("bigint"))
            .withColumn("primary_ok", F.col("primary_count") > 0).withColumn("secondary_ok", F.col("secondary_count") > 0)
            .withColumn("coverage_ok", F.col("sync_pct") >= 80)
            .withColumn("status", F.when(F.col("primary_ok") & F.col("secondary_ok") & F.col("coverage_ok"), "DRY_RUN_PASS")
                        .otherwise("DRY_RUN_FAIL")))


def parity_check(p: DataFrame, s: DataFrame, *, max_missing: int = 10, max_diff: int = 20) -> DataFrame:
    """Is the secondary reasonably current, per pair; types where it holds fewer items are issues."""
    states = reconcile(p, s, keys=["item_type", "display_name"]).groupBy("pair_id").agg(
        F.count_if(F.col("state") == MISSING).alias("missing"))
    types = _side_counts(p, s, ["pair_id", "item_type"]).groupBy("pair_id").agg(
        F.sum("primary_count").alias("primary_count"), F.sum("secondary_count").alias("secondary_count"),
        F.count_if(F.col("primary_count") > F.col("secondary_count")).alias("parity_issues"))
    return states.join(types, "pair_id").withColumn(
        "current", ~((F.col("missing") > max_missing) | (F.col("primary_count") - F.col("secondary_count") > max_diff)))


def dr_event_metrics(events: DataFrame) -> DataFrame:
    """RTO per pair and kind of event: runs, successes, mean and latest seconds."""
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1000000
    ok = F.col("status") == "Completed"
    return events.withColumn("seconds", seconds).groupBy("pair_id", "source").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(ok).alias("succeeded"), F.round(F.avg("seconds"), 3).alias("avg_rto_seconds"),
        F.max_by("seconds", F.struct("started", "run_id")).alias("last_rto_seconds"),
        F.max_by(ok, F.struct("started", "run_id")).alias("last_success"))


def latest_per(df: DataFrame, *, by: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row of each group that is last in ``order``; an aggregate, so partial on the map side."""
    return (df.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_row"))
            .select(*by, *[F.col(f"_row.{c}").alias(c) for c in keep]))


def recent(df: DataFrame, *, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group. The rank limit is applied before the shuffle too."""
    window = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def action_counts(plan: DataFrame, *, by: Sequence[str] = ("action",)) -> DataFrame:
    return plan.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def sync_totals(results: DataFrame, *, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return results.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def gateway_enrich(gateways: DataFrame, capacities: DataFrame, connections: DataFrame) -> DataFrame:
    """Gateways with the region of their capacity and the number of connections bound to them."""
    bound = connections.groupBy("gateway_id", "connection_id").agg(F.lit(1).alias("_one")).groupBy("gateway_id").agg(
        F.count(F.lit(1)).alias("connection_count"))
    return (gateways.join(capacities.groupBy("capacity_id").agg(F.max("region").alias("region")), "capacity_id", "left")
            .join(bound, "gateway_id", "left").withColumn("connection_count", F.coalesce("connection_count", F.lit(0))))


def gateway_verdict(gateways: DataFrame, regions: DataFrame) -> DataFrame:
    """How a gateway behaves when the primary region is lost."""
    rows = gateways.join(regions, "pair_id", "left")
    reg, p, s = (F.coalesce(c, F.lit("")) for c in ("region", "primary_region", "secondary_region"))
    bound = F.col("gateway_type") == "VirtualNetwork"
    cases = [
        (bound & (reg != "") & (s != "") & (reg != s) & ((reg == p) | (p == "")), "bad", "bound_to_lost_region"),
        (bound & (reg != "") & (s != "") & (reg == s) & (p == s), "warn", "same_region_as_both"),
        (bound & (reg != "") & (reg == s), "ok", "in_dr_region"),
        (bound & (reg == ""), "warn", "region_unknown"),
        (bound, "warn", "region_bound"),
        (F.coalesce("member_count", F.lit(0)) < 2, "warn", "single_member"),
    ]
    level, reason = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for test, lvl, why in cases[1:]:
        level, reason = level.when(test, lvl), reason.when(test, why)
    return rows.select("gateway_id", "pair_id", "gateway_type", "region", "connection_count",
                       level.otherwise("ok").alias("level"), reason.otherwise("clustered").alias("reason"))


def connection_grants(used: DataFrame, principals: DataFrame, roles: DataFrame) -> DataFrame:
    """(connection, principal) pairs that are used but not granted yet.

    A connection used by many items is granted once per principal.
    """
    need = used.join(principals, "item_id").groupBy("connection_id", "principal").agg(F.count(F.lit(1)).alias("used_by"))
    return need.join(roles.select("connection_id", "principal").distinct(), ["connection_id", "principal"], "left_anti")


def distinct_connections(used: DataFrame) -> DataFrame:
    """Each connection once, with the number of items that use it."""
    return used.groupBy("connection_id", "item_id").agg(F.lit(1).alias("_one")).groupBy("connection_id").agg(
        F.count(F.lit(1)).alias("item_count"))


