"""How far a replica is behind, measured on the primary's own commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE_HOURS = 0.1


def latest_commit(commits: DataFrame) -> DataFrame:
    """The highest version per table and its time; not the newest file."""
    return commits.groupBy("pair_id", "table_key").agg(
        F.max("version").alias("version"), F.max_by("commit_ts", "version").alias("commit_ts"),
        F.max_by("has_ict", "version").alias("has_ict"), F.min("commit_ts").alias("first_ts"))


def _hours(later, earlier):
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.round(F.greatest(F.lit(0.0), micros / F.lit(3600000000.0)), 2)


def freshness(p_commits: DataFrame, s_commits: DataFrame, *, tolerance_hours: float = TOLERANCE_HOURS) -> DataFrame:
    """State and lag of every table of either side.

    The lag is the time between the primary commit the secondary holds and the primary's latest.
    Where that commit is no longer retained, the earliest one that is gives a lower bound. File
    times of the secondary are copy times; they stand in only when the primary lists no times.
    """
    key = ["pair_id", "table_key"]
    s = latest_commit(s_commits).select(*key, F.col("version").alias("s_version"), F.col("commit_ts").alias("s_ts"))
    p = latest_commit(p_commits).select(*key, F.col("version").alias("p_version"), F.col("commit_ts").alias("p_ts"), "has_ict", "first_ts")
    # The held commit is looked up by (table, version): a table with a long history is spread over its versions.
    held = s.select(*key, F.col("s_version").alias("version"))
    base = (p_commits.select(*key, "version", "commit_ts").join(held, [*key, "version"])
            .groupBy(*key).agg(F.max("commit_ts").alias("base_ts")))
    p = p.join(base, key, "left")
    rows = p.join(s, key, "full")
    known = F.col("p_version").isNotNull() & F.col("s_version").isNotNull()
    older = known & (F.col("s_version") < F.col("p_version"))
    timed = older & F.col("p_ts").isNotNull()
    lag = (F.when(known & (F.col("s_version") == F.col("p_version")), F.lit(0.0))
           .when(timed & F.col("base_ts").isNotNull(), _hours(F.col("p_ts"), F.col("base_ts")))
           .when(timed & F.col("first_ts").isNotNull(), _hours(F.col("p_ts"), F.col("first_ts")))
           .when(timed & F.col("s_ts").isNotNull(), _hours(F.col("p_ts"), F.col("s_ts"))))
    rows = rows.withColumn("behind_hours", lag).withColumn(
        "lag_is_lower_bound", F.coalesce(timed & F.col("base_ts").isNull() & lag.isNotNull(), F.lit(False)))
    state = (F.when(F.col("s_version").isNull(), "missing_in_secondary").when(F.col("p_version").isNull(), "extra_in_secondary")
             .when(F.col("s_version") > F.col("p_version"), "diverged").when(F.col("behind_hours").isNull(), "unknown")
             .when(F.col("behind_hours") > tolerance_hours, "behind").otherwise("in_sync"))
    return rows.select(*key, state.alias("state"), "behind_hours", "lag_is_lower_bound",
                       F.col("p_version").alias("primary_version"), F.col("s_version").alias("secondary_version"),
                       F.col("has_ict").alias("in_commit_timestamps"))


def rpo_summary(fresh: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Measured RPO per pair: worst and upper-median lag, states, and whether all was measured.

    Tables are counted per distinct lag first; the median and all totals come from those counts,
    so the comparison is worked out once and no pair's tables are gathered in one place.
    ``errors`` has one row per pair whose listing failed.
    """
    state = lambda name: F.count_if(F.col("state") == name)
    counts = {"tables_compared": F.count(F.lit(1)), "_lower": F.count_if("lag_is_lower_bound"),
              "tables_without_in_commit_timestamps": F.count_if(~F.col("in_commit_timestamps")),
              "in_sync": state("in_sync"), "behind": state("behind"), "diverged": state("diverged"),
              "missing": state("missing_in_secondary"), "extra": state("extra_in_secondary"), "unknown": state("unknown")}
    per_lag = fresh.groupBy("pair_id", "behind_hours").agg(*[c.alias(n) for n, c in counts.items()])
    timed = F.when(F.col("behind_hours").isNotNull(), F.col("tables_compared")).otherwise(0)
    by_pair = Window.partitionBy("pair_id")
    running = F.sum(timed).over(by_pair.orderBy(F.col("behind_hours").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = per_lag.withColumn("_running", running).withColumn("_total", F.sum(timed).over(by_pair))
    median = F.min(F.when(F.col("_running") > F.floor(F.col("_total") / 2), F.col("behind_hours")))
    out = ranked.groupBy("pair_id").agg(*[F.sum(n).alias(n) for n in counts], F.max("behind_hours").alias("measured_rpo_hours"),
                                        median.alias("median_lag_hours"))
    out = out.withColumn("rpo_is_lower_bound", F.col("_lower") > 0).drop("_lower")
    if errors is None:
        return out.withColumn("complete", F.col("unknown") == 0)
    failed = errors.select("pair_id").distinct().withColumn("_failed", F.lit(True))
    return out.join(failed, "pair_id", "left").withColumn(
        "complete", (F.col("unknown") == 0) & F.col("_failed").isNull()).drop("_failed")


def row_integrity(p_counts: DataFrame, s_counts: DataFrame, *, keys: list[str], tolerance_pct: float = 1.0) -> DataFrame:
    """Row counts of two replicas: pass, info (version differs or within tolerance), fail, or a read error.

    Each side has ``row_count`` (null when it could not be read) and ``version``.
    """
    p = p_counts.select(*keys, F.col("row_count").alias("primary_rows"), F.col("version").alias("primary_version"))
    s = s_counts.select(*keys, F.col("row_count").alias("secondary_rows"), F.col("version").alias("secondary_version"))
    rows = p.join(s, keys, "left")
    variance = F.abs(F.col("primary_rows") - F.col("secondary_rows"))
    pct = variance * 100.0 / F.greatest(F.col("primary_rows"), F.lit(1))
    status = (F.when(F.col("primary_rows").isNull(), "primary_read_error").when(F.col("secondary_rows").isNull(), "secondary_read_error")
              .when((variance == 0) & F.col("primary_version").eqNullSafe(F.col("secondary_version")), "pass")
              .when(variance == 0, "info").when(pct <= tolerance_pct, "info").otherwise("fail"))
    return rows.withColumn("variance", variance).withColumn("status", status)


def integrity_rollup(checks: DataFrame, *, by: list[str]) -> DataFrame:
    """Tables checked, passed and failed per group, and the status the next run is gated on."""
    passed = F.col("status").isin("pass", "info")
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tables_checked"), F.count_if(passed).alias("tables_passed"),
        F.count_if(~passed & (F.col("status") != "unknown")).alias("tables_failed")).withColumn(
        "integrity_status", F.when(F.col("tables_failed") > 0, "fail").otherwise("pass"))
