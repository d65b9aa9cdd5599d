"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app_name: str = "tandem", *, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators assume; ``extra`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode, where driver and executors are one
    process. On a cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tandem-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared work folder."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor does not replay an iteration."""
    spark = df.sparkSession
    root = work_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, label: str, *, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back, so that it is computed once and survives lost executors.

    With ``tidy`` it is packed more tightly, and the files of its shuffles go as soon as it is written, not at some later collection
    of garbage on the driver.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    if tidy:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd" if tidy else None)
    finally:
        if tidy:
            spark.conf.set(_CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Remove what ``keep`` wrote, once all that reads it is written itself."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
