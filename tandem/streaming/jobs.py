"""Structured Streaming jobs: incremental replication, drift watch, late-safe ingest.

Work that could be polled on a timer is a stream here, and its checkpoint is the watermark.
``trigger={"availableNow": True}`` drains what is there and stops, ``{"processingTime": "15 minutes"}``
keeps a schedule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.reconcile import EXTRA, MISSING, catalog_drift, null_safe_join, reconcile
from tandem.operators.replicate import late_safe_increment
from tandem.streaming import log

DRAIN: Mapping[str, object] = {"availableNow": True}


def _source(spark: SparkSession, src_dir: str, schema: T.StructType, glob: str | None, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(src_dir)


def stream_replicate(spark: SparkSession, src_dir: str, dst_dir: str, checkpoint: str, *, schema: T.StructType, keys: Sequence[str], ts_col: str,
                     trigger: Mapping[str, object] = DRAIN, glob: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """Copy new files of a source to the replica as they arrive; ``read_replica`` gives the merged table.

    A batch keeps the latest row of each key and is appended. The target is merged when it is
    read, or by ``compact``; it is not rewritten for every batch.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        log.write_batch(log.latest_per_key(batch, keys=keys, order=[ts_col]), dst_dir, batch_id, ts_col=ts_col)

    stream = _source(spark, src_dir, schema, glob, max_files)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_replica(spark: SparkSession, dst_dir: str, *, schema: T.StructType, keys: Sequence[str], ts_col: str) -> DataFrame:
    """The replica: the latest row of each key over all logged batches."""
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = log.read_batches(spark, dst_dir, text)
    return log.latest_per_key(rows, keys=keys, order=[ts_col, "batch_id"]).select(*[f.name for f in schema.fields])


def compact(spark: SparkSession, dst_dir: str, new_dir: str, *, schema: T.StructType, keys: Sequence[str], ts_col: str) -> None:
    """Merge all batches of a replica into one batch of a new folder, from which a stream can go on."""
    last = log.read_runs(spark, dst_dir).agg(F.max("batch_id")).first()[0]
    if last is not None:
        log.write_batch(read_replica(spark, dst_dir, schema=schema, keys=keys, ts_col=ts_col), new_dir, last, ts_col=ts_col)


def stream_late(spark: SparkSession, src_dir: str, dst_dir: str, checkpoint: str, *, schema: T.StructType, keys: Sequence[str], ts_col: str,
                trigger: Mapping[str, object] = DRAIN, glob: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """Ingest that loses no late row and takes none twice.

    Rows are told apart by key, not by a watermark: a batch is anti-joined with what is there.
    Events do not change, so a row that comes again carries the time it had; only the part of the
    target in the batch's range of times is read. ``late`` marks rows older than the newest row of
    earlier batches, which a bare watermark would drop.
    """
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        earlier = F.col("batch_id") < batch_id
        low, high = batch.agg(F.min(ts_col), F.max(ts_col)).first()
        known = log.read_batches(session, dst_dir, text).filter(earlier)
        if low is not None:
            kind = batch.schema[ts_col].dataType
            known = known.filter(F.col(ts_col).between(F.lit(low).cast(kind), F.lit(high).cast(kind)) | F.col(ts_col).isNull())
        # The log holds times as text; they are compared in the column's own type.
        newest = log.read_runs(session, dst_dir).filter(earlier).agg(F.max(F.col("max_ts").cast(batch.schema[ts_col].dataType))).first()[0]
        fresh = late_safe_increment(batch, known, keys=keys)
        mark = F.lit(False) if newest is None else F.col(ts_col) <= F.lit(newest).cast(batch.schema[ts_col].dataType)
        log.write_batch(fresh.withColumn("late", mark), dst_dir, batch_id, ts_col=ts_col)

    stream = _source(spark, src_dir, schema, glob, max_files)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


WATCH_SCHEMA = ("pair_id BIGINT, item_type STRING, display_name STRING, item_id STRING, definition_hash STRING, "
                "snapshot_id BIGINT, change STRING, state STRING")


def stream_drift_watch(spark: SparkSession, src_dir: str, dst_dir: str, checkpoint: str, *, schema: T.StructType, secondary: DataFrame | Callable[[], DataFrame],
                       trigger: Mapping[str, object] = DRAIN, glob: str | None = None) -> StreamingQuery:
    """Re-check the catalog as snapshots of it arrive.

    A snapshot row has pair_id, item_type, display_name, item_id, definition_hash and snapshot_id.
    Each item is compared with the previous snapshot of its pair (new, changed, unchanged,
    removed) and with the secondary. Pass a function that reads the secondary, and every batch sees it as it is then.
    """
    item = ["item_type", "display_name"]

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        newest = batch.groupBy("pair_id").agg(F.max("snapshot_id").alias("snapshot_id"))
        current = batch.join(newest, ["pair_id", "snapshot_id"], "left_semi")
        pairs = newest.select("pair_id")
        seen = log.read_batches(session, dst_dir, WATCH_SCHEMA).filter((F.col("batch_id") < batch_id))
        previous = _last_snapshot(seen).filter("change <> 'removed'").join(pairs, "pair_id", "left_semi")
        versus_previous = reconcile(current, previous, keys=item, compare=["item_id", "definition_hash"])
        change = (F.when(F.col("state") == MISSING, "new").when(F.col("state") == EXTRA, "removed")
                  .when(F.col("p_definition_hash").eqNullSafe(F.col("s_definition_hash")), "unchanged").otherwise("changed"))
        changes = versus_previous.select("pair_id", *item, F.coalesce("p_item_id", "s_item_id").alias("item_id"),
                                         F.coalesce("p_definition_hash", "s_definition_hash").alias("definition_hash"), change.alias("change"))
        standby = secondary() if callable(secondary) else secondary
        drift = catalog_drift(current, standby.join(pairs, "pair_id", "left_semi")).filter(F.col("state") != EXTRA)
        states = drift.select("pair_id", *item, "state")
        rows = null_safe_join(changes, states, ["pair_id", *item], "left").join(newest, "pair_id")
        log.write_batch(rows.select(*[c.split()[0] for c in WATCH_SCHEMA.split(", ")]), dst_dir, batch_id)

    stream = _source(spark, src_dir, schema, glob, None)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _last_snapshot(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("pair_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["pair_id", "batch_id"], "left_semi")


def read_drift_watch(spark: SparkSession, dst_dir: str) -> DataFrame:
    """The latest check of every pair."""
    return _last_snapshot(log.read_batches(spark, dst_dir, WATCH_SCHEMA)).drop("batch_id")


def run_history(runs: DataFrame, *, by: Sequence[str], interval_minutes: int) -> DataFrame:
    """Runs per group: count, rows moved, the last run and its status, and when the next is due."""
    last = F.max_by(F.struct("status", "finished"), F.struct("finished", "run_id"))
    out = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("run_count"), F.sum("rows").alias("rows"), last.alias("_last"))
    return out.select(*by, "run_count", "rows", F.col("_last.finished").alias("last_run"), F.col("_last.status").alias("last_status"),
                      (F.col("_last.finished") + F.expr(f"INTERVAL {int(interval_minutes)} MINUTES")).alias("next_run"))
