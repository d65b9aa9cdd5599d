"""Where streaming jobs put their output: idempotent batches, made visible by a run log.

Each micro-batch goes to ``<root>/data/batch_id=<n>`` and, once that is complete, to one row in
``<root>/runs/batch_id=<n>``. A batch that is tried again overwrites its own folder; readers see
only batches that are in the run log, so a half-written batch is never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "rows BIGINT, max_ts STRING, late_rows BIGINT, status STRING, finished TIMESTAMP"


def write_batch(batch: DataFrame, root: str, batch_id: int, *, ts_col: str | None = None) -> None:
    """Write one batch and log it. Row count and latest time are observed during the write, not by a second pass."""
    spark = batch.sparkSession
    seen = Observation()
    latest = F.max(F.col(ts_col)).cast("string") if ts_col else F.max(F.lit(None).cast("string"))
    late = F.count_if("late") if "late" in batch.columns else F.sum(F.lit(0))
    watched = batch.observe(seen, F.count(F.lit(1)).alias("rows"), latest.alias("max_ts"), late.alias("late_rows"))
    watched.write.mode("overwrite").parquet(f"{root}/data/batch_id={batch_id}")
    got = seen.get
    run = spark.createDataFrame([(got["rows"], got["max_ts"], got["late_rows"] or 0, "ok")], "rows BIGINT, max_ts STRING, late_rows BIGINT, status STRING")
    run.withColumn("finished", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/batch_id={batch_id}")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The run log; empty before the first run."""
    try:
        return spark.read.schema(f"{RUN_SCHEMA}, batch_id BIGINT").parquet(f"{root}/runs")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], f"{RUN_SCHEMA}, batch_id BIGINT")


def read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of all logged batches with their ``batch_id``; the semi-join prunes folders that are not logged."""
    try:
        data = spark.read.schema(f"{schema}, batch_id BIGINT").parquet(f"{root}/data")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], f"{schema}, batch_id BIGINT")
    return data.join(read_runs(spark, root).select("batch_id"), "batch_id", "left_semi")


def latest_per_key(rows: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def schema_text(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
