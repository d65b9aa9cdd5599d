"""Replicate tables: full copy, change feed, commit log and watermark.

Without a transactional table format in reach, a merge is a new version of the target written
next to the old one; a table name is a column, so many tables move in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.grouping import bag_digest, fits, lookup_join, row_digest
from tandem.operators.reconcile import null_safe_join
from tandem.session import materialize

# Change feed columns and types, and names that mark keys and event times.
CHANGE_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")
UPSERTS = ("insert", "update_postimage")
KEY_NAMES = ("id", "key", "pk", "row_id", "claim_id", "policy_id")
TIME_NAMES = ("Timestamp", "EventTime", "IngestionTime", "CreatedAt", "UpdatedAt", "ModifiedDate", "timestamp", "eventTime")


def read_table(spark: SparkSession, path: str, *, source: str = "parquet") -> DataFrame:
    return spark.read.format(source).load(path)


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite", source: str = "parquet") -> None:
    df.write.mode(mode).format(source).save(path)


def full_sync(spark: SparkSession, source_path: str, target_path: str, *, source: str = "parquet") -> DataFrame:
    """Copy a whole table with its schema; returns the copy as read back."""
    write_table(read_table(spark, source_path, source=source), target_path, source=source)
    return read_table(spark, target_path, source=source)


def cdf_latest(changes: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """The last change of each key, by commit version and then commit time. Pre-images are not changes."""
    values = [c for c in changes.columns if c not in keys]
    real = changes.filter(F.col("_change_type").isin(*UPSERTS, "delete"))
    last = real.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_commit_version", "_commit_timestamp", "_change_type")).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def _small(keys: DataFrame) -> DataFrame:
    """Keys marked for broadcast if their number allows it. They must be cheap to count."""
    return F.broadcast(keys) if fits(keys) else keys


def cdf_merge(target: DataFrame, changes: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """The target after the changes: latest change per key wins, a delete followed by an insert survives.

    The changes are reduced once and kept; when their keys are few the target is not shuffled.
    """
    latest = materialize(cdf_latest(changes, keys=keys))
    untouched = null_safe_join(target, _small(latest.select(*keys)), list(keys), "left_anti")
    upserts = latest.filter(F.col("_change_type").isin(*UPSERTS)).drop(*CHANGE_COLUMNS)
    return untouched.unionByName(upserts, allowMissingColumns=True)


def _fingerprint(df: DataFrame, values: Sequence[str], side: str) -> list:
    """Two independent 64-bit hashes of the values; both are fixed-width, so the aggregate over them is a hash aggregate."""
    cells = [c for v in values for c in (F.col(v), F.col(v).isNull())]
    return [F.xxhash64(*cells).alias(f"_{side}_a"), F.xxhash64(F.lit("second"), *reversed(cells)).alias(f"_{side}_b")]


def cdf_extract(old: DataFrame, new: DataFrame, *, keys: Sequence[str], version: int) -> DataFrame:
    """The change feed that turns ``old`` into ``new``. Keys identify rows on both sides.

    Only keys and 128-bit fingerprints of the rows are shuffled to find what changed. The changed
    keys are kept, and the values are read for them alone: without a shuffle of the tables when
    the keys are few, by a join on the keys when they are not.
    """
    keys = list(keys)
    values = [c for c in new.columns if c not in keys]
    none = lambda side: [F.lit(None).cast("bigint").alias(f"_{side}_{x}") for x in "ab"]
    both = (old.select(*keys, *_fingerprint(old, values, "old"), *none("new"))
            .unionByName(new.select(*keys, *none("old"), *_fingerprint(new, values, "new"))))
    pairs = both.repartition(*keys).groupBy(*keys).agg(*[F.max(f"_{side}_{x}").alias(f"_{side}_{x}") for side in ("old", "new") for x in "ab"])
    same = F.col("_old_a").eqNullSafe(F.col("_new_a")) & F.col("_old_b").eqNullSafe(F.col("_new_b"))
    kind = F.when(F.col("_old_a").isNull(), "insert").when(F.col("_new_a").isNull(), "delete").otherwise("update_postimage")
    changed = materialize(pairs.filter(~same).select(*keys, kind.alias("_change_type")))
    gone = F.col("_change_type") == "delete"
    after = null_safe_join(new.select(*keys, *values), _small(changed.filter(~gone)), keys, "inner")
    before = null_safe_join(old.select(*keys, *values), _small(changed.filter(gone)), keys, "inner")
    return after.unionByName(before).withColumn("_commit_version", F.lit(version).cast("bigint"))


def changed_since(changes: DataFrame, last_version: int) -> DataFrame:
    """Changes of a feed after a version; the filter reaches the scan."""
    return changes.filter(F.col("_commit_version") > last_version)


def incremental_filter(df: DataFrame, *, ts_col: str, watermark) -> DataFrame:
    """Rows later than a watermark; none or 0 means all rows. The literal takes the column's type, so the filter is pushed."""
    if not watermark:
        return df
    return df.filter(F.col(ts_col) > F.lit(watermark).cast(df.schema[ts_col].dataType))


def log_incremental(commits: DataFrame, state: DataFrame) -> DataFrame:
    """Files added by commits after the synced version, and the new version per table.

    A table without state, or with a commit that did not parse, falls back to a listing.
    """
    key = ["pair_id", "table_key"]
    rows = lookup_join(commits, state.select(*key, "last_version"), on=key, spread_by=["version"], how="left")
    newer = F.col("last_version").isNotNull() & (F.col("version") > F.col("last_version"))
    failed = newer & F.col("unparsed")
    tables = rows.groupBy(*key).agg(
        F.max("version").alias("new_version"), F.max("last_version").alias("last_version"),
        F.bool_or(failed).alias("_failed"), F.count_distinct(F.when(newer & F.col("is_commit"), F.col("version"))).alias("new_commits"))
    files = (rows.filter(newer & F.col("add_path").isNotNull()).select(*key, "add_path").distinct()
             .groupBy(*key).agg(F.count(F.lit(1)).alias("new_files")))
    method = F.when(F.col("last_version").isNull() | F.col("_failed"), "file_listing_fallback").otherwise("commit_log")
    return (tables.join(files, key, "left").withColumn("method", method)
            .select(*key, "method", "new_version",
                    F.when(F.col("method") == "commit_log", F.col("new_commits")).otherwise(-1).alias("new_commits"),
                    F.when(F.col("method") == "commit_log", F.coalesce("new_files", F.lit(0))).otherwise(-1).alias("new_files")))


def new_files(commits: DataFrame, state: DataFrame) -> DataFrame:
    """The distinct files behind ``log_incremental``."""
    key = ["pair_id", "table_key"]
    rows = lookup_join(commits, state.select(*key, "last_version"), on=key, spread_by=["version"])
    return rows.filter((F.col("version") > F.col("last_version")) & F.col("add_path").isNotNull()).select(*key, "add_path").distinct()


def sync_mode(versions: DataFrame, state: DataFrame, gate: DataFrame, *, mode: str = "auto") -> DataFrame:
    """What the next run does per table: full, up_to_date, incremental, or blocked by a failed check."""
    key = ["pair_id", "table_key"]
    rows = (versions.join(state.select(*key, "last_version"), key, "left")
            .join(gate.groupBy("pair_id").agg(F.max(F.col("integrity_status") == "fail").alias("_failed")), "pair_id", "left"))
    decided = (F.when(F.lit(mode == "full"), "full").when(F.coalesce("_failed", F.lit(False)), "blocked_integrity")
               .when(F.col("last_version").isNull() | (F.col("last_version") < 0), "full")
               .when(F.col("version") <= F.col("last_version"), "up_to_date").otherwise("incremental"))
    return rows.select(*key, "version", "last_version", decided.alias("sync_mode"))


def state_upsert(state: DataFrame, new: DataFrame, *, keys: Sequence[str], order: str | None = None, may_go_back: bool = False) -> DataFrame:
    """One state row per key: the one furthest on by ``order`` (the first column that is no key), of equal ones the newer.

    With ``may_go_back`` a new row replaces the old one even if it is behind it.
    """
    values = [c for c in state.columns if c not in keys]
    rank = [F.col("_new"), F.col(order or values[0])] if may_go_back else [F.col(order or values[0]), F.col("_new")]
    # The values themselves break remaining ties, so that repeated rows give the same state in any order.
    rank = F.struct(*[x for r in rank for x in (r.isNotNull(), r)], *values)
    rows = state.withColumn("_new", F.lit(0)).unionByName(new.select(*state.columns).withColumn("_new", F.lit(1)))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in state.columns])


def advance_state(state: DataFrame, results: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """``state_upsert`` for the tables whose run had no errors; the others keep their watermark."""
    return state_upsert(state, results.filter(F.col("errors") == 0), keys=keys)


def reverse_sync(p: DataFrame, s: DataFrame, *, keys: Sequence[str], ts_col: str, since, before: DataFrame | None = None) -> DataFrame:
    """Failback: changes made on the secondary since the failover, as a feed for the primary.

    Only keys the secondary touched after ``since`` are compared; the primary is semi-joined to them. ``before`` has the keys
    that the secondary held at the failover: those it holds no more were deleted since. Without it no deletion can be told
    from a row that had not been replicated yet, and none is reported.
    """
    touched = s.filter(F.col(ts_col) > F.lit(since).cast(s.schema[ts_col].dataType))
    known = null_safe_join(p, touched.select(*keys).distinct(), list(keys), "left_semi")
    feed = cdf_extract(known.select(*touched.columns), touched, keys=keys, version=0).drop("_commit_version")
    if before is None:
        return feed
    gone = null_safe_join(before.select(*keys).distinct(), s.select(*keys), list(keys), "left_anti")
    deleted = null_safe_join(p.select(*touched.columns), gone, list(keys), "left_semi").withColumn("_change_type", F.lit("delete"))
    return feed.unionByName(deleted.select(*feed.columns))


def detect_time_column(columns: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """The event-time column of each table: a preferred name, else the first datetime column, else null."""
    rank = F.array_position(F.array(*[F.lit(n) for n in TIME_NAMES]), F.col("column_name"))
    order = F.struct(F.when(rank > 0, rank).otherwise(len(TIME_NAMES) + 1), F.col("pos"))
    is_time = F.lower(F.trim("column_type")) == "datetime"
    return columns.groupBy(*by).agg(F.min_by(F.when(is_time, F.col("column_name")), F.when(is_time, order)).alias("ts_col"))


def time_column(df: DataFrame) -> str | None:
    """The same rule for one DataFrame."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    return next((n for n in TIME_NAMES if n in names), names[0] if names else None)


def infer_keys(columns: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Key columns of each table: all with a key name, whatever their case, else the first column."""
    named = F.lower("column_name").isin(*KEY_NAMES)
    marked = columns.withColumn("_named", named)
    per_table = marked.groupBy(*by).agg(F.bool_or("_named").alias("_any"), F.min("pos").alias("_first"))
    return (marked.join(per_table, list(by)).filter(F.col("_named") | (~F.col("_any") & (F.col("pos") == F.col("_first"))))
            .select(*by, "column_name", F.when(F.col("_named"), "name").otherwise("first_column").alias("rule")))


def cut_points(pending: DataFrame, *, table: str, ts_col: str, cap: int, grains: Sequence[str] = ("hour", "second")) -> DataFrame:
    """Per table, the time up to which a batch of about ``cap`` rows goes; ties at the cut stay together.

    Rows are counted per grain of time; only the grain in which the cap falls is counted at the
    next finer one, down to single times. No table is sorted in one task, however large its backlog.
    """
    by_table = Window.partitionBy(table)

    def with_running(counts: DataFrame, order: str) -> DataFrame:
        earlier = F.sum("_n").over(by_table.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return counts.withColumn("_before", F.col("_start") + F.coalesce(earlier, F.lit(0)))

    # One pass counts at the finest grain; the coarser ones are sums of its rows.
    finest = F.date_trunc(grains[-1], F.col(ts_col))
    cells = (pending.groupBy(table, finest.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.max(ts_col).alias("_last"))
             .withColumn("_start", F.lit(0).cast("bigint")))
    last = cells.groupBy(table).agg(F.max("_last").alias("last_ts"))
    for grain in grains:
        grained = cells.withColumn("_grain", F.date_trunc(grain, F.col("_cell")))
        counts = with_running(grained.groupBy(table, "_start", "_grain").agg(F.sum("_n").alias("_n")), "_grain")
        crossing = counts.filter((F.col("_before") < cap) & (F.col("_before") + F.col("_n") >= cap)).select(table, "_grain", "_before")
        cells = grained.join(crossing, [table, "_grain"]).select(table, "_cell", "_n", F.col("_before").alias("_start"))
    rows = pending.select(table, ts_col, finest.alias("_cell")).join(cells.select(table, "_cell", "_start"), [table, "_cell"])
    times = with_running(rows.groupBy(table, "_start", ts_col).agg(F.count(F.lit(1)).alias("_n")), ts_col)
    cuts = times.filter(F.col("_before") < cap).groupBy(table).agg(F.max(ts_col).alias("cut_ts"))
    return last.join(cuts, table, "left").select(table, F.coalesce("cut_ts", "last_ts").alias("cut_ts"))


def pending_events(events: DataFrame, state: DataFrame, *, ts_col: str = "ts", table: str = "table_key", target: DataFrame | None = None,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Rows later than their table's watermark; a table without a state row is loaded whole (``first_run``).

    No watermark says whether a row without a time was loaded. On the first run all of them are. Later they are pending if
    ``target`` (what was loaded, with ``table`` and ``keys``) does not hold their key, so pass it where times may be missing.
    """
    seen = state.select(table, "last_ts", F.lit(True).alias("_seen"))
    rows = lookup_join(events, seen, on=[table], spread_by=[ts_col, *keys], how="left").withColumn("first_run", F.col("_seen").isNull())
    later = F.col(ts_col).isNotNull() & (F.col("last_ts").isNull() | (F.col(ts_col) > F.col("last_ts")))
    fresh = rows.filter(F.col("first_run") | later).drop("last_ts", "_seen")
    if target is None:
        return fresh
    timeless = rows.filter(~F.col("first_run") & F.col(ts_col).isNull()).drop("last_ts", "_seen")
    loaded = target.filter(F.col(ts_col).isNull()) if ts_col in target.columns else target
    on = [table, *keys]
    return fresh.unionByName(null_safe_join(timeless, loaded.select(*on).distinct(), on, "left_anti"))


def watermark_replicate(events: DataFrame, state: DataFrame, *, ts_col: str = "ts", table: str = "table_key", cap: int | None = None,
                        target: DataFrame | None = None, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The next batch of every table, and the state after it. Rows beyond ``cap`` wait for the next batch.

    Pending rows without a time go with the first batch, beside the ``cap`` timed ones: no cut could find them again. A table
    whose rows all lack a time gets a state row with a null time, so it is not loaded whole each run. Write or checkpoint the
    state before it is used for the next batch, so that its plan does not grow with the number of batches.
    """
    batch = pending_events(events, state, ts_col=ts_col, table=table, target=target, keys=keys)
    if cap is not None:
        cuts = materialize(cut_points(batch.filter(F.col(ts_col).isNotNull()), table=table, ts_col=ts_col, cap=cap))
        batch = lookup_join(batch, cuts, on=[table], spread_by=[ts_col], how="left").filter(
            F.col(ts_col).isNull() | (F.col(ts_col) <= F.col("cut_ts"))).drop("cut_ts")
    reached = batch.groupBy(table).agg(F.max(ts_col).alias("last_ts"))
    return batch, state_upsert(state.select(table, "last_ts"), reached, keys=[table])


def event_sync_plan(columns: DataFrame, state: DataFrame, *, table: str = "table_key", mode: str = "incremental") -> DataFrame:
    """How each event table is copied: full when it has no time column, initial before its first watermark, else incremental."""
    rows = detect_time_column(columns, by=[table]).join(state.select(table, "last_ts"), table, "left")
    decided = (F.when(F.lit(mode == "full") | F.col("ts_col").isNull(), "full").when(F.col("last_ts").isNull(), "initial").otherwise("incremental"))
    return rows.select(table, "ts_col", "last_ts", decided.alias("sync_mode"), (decided != "incremental").alias("clears_target"))


def late_safe_increment(events: DataFrame, target: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Rows not in the target yet, whatever their time: late rows are not lost to a watermark.

    Of several rows of a key, the one with the smallest row hash is taken, in every run the same.
    """
    others = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.xxhash64(*events.columns)).alias("_first") if others else F.count(F.lit(1)).alias("_first")
    once = events.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in events.columns])
    return null_safe_join(once, target.select(*keys).distinct(), list(keys), "left_anti")


def table_checksum(df: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Row count and order-free fingerprint of a table or its groups."""
    digest = row_digest(*[c for c in df.columns if c not in by])
    grouped = df.withColumn("_digest", digest).groupBy(*by)
    return grouped.agg(F.count(F.lit(1)).alias("row_count"), bag_digest(F.col("_digest")).alias("checksum"))
