"""File listings: reading one, finding table folders, summarising, planning a copy."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.grouping import lookup_join
from tandem.sources.commit_log import LOG_FOLDERS

# A table is a folder with a commit log, directly below Tables/ or one schema folder deeper.
# Names that start with an underscore are skipped.
TABLE_PATH = r"^Tables/([^/_][^/]*(?:/[^/_][^/]*)?)/_delta_log/"


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Path, modification time and size of every file below ``root`` and in the tables' commit logs, without content."""
    base = root.rstrip("/")
    reader = lambda: spark.read.format("binaryFile")
    files = reader().option("recursiveFileLookup", "true").load(base)
    try:
        files = files.unionByName(reader().load(f"{base}/{LOG_FOLDERS}"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # no table has a log
            raise
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))


def discover_tables(listing: DataFrame, *, by: tuple[str, ...] = ("lakehouse",)) -> DataFrame:
    """Table folders in a listing, with their key (``schema.table``) and layout."""
    found = listing.select(*by, F.regexp_extract("path", TABLE_PATH, 1).alias("table_path")).filter("table_path <> ''").distinct()
    return (found.withColumn("table_key", F.replace("table_path", F.lit("/"), F.lit(".")))
            .withColumn("layout", F.when(F.contains("table_path", F.lit("/")), "schema").otherwise("flat")))


def dir_summary(listing: DataFrame, *, by: tuple[str, ...] = ("lakehouse", "side")) -> DataFrame:
    """Folders and files per group. Folders are the distinct parents of the files."""
    parent = F.regexp_replace("path", r"/[^/]*$", "")
    per_folder = listing.groupBy(*by, parent.alias("_dir")).agg(F.count(F.lit(1)).alias("_files"), F.sum("bytes").alias("_bytes"))
    return per_folder.groupBy(*by).agg(F.count(F.lit(1)).alias("dirs"), F.sum("_files").alias("files"), F.sum("_bytes").alias("bytes"))


def mtime_plan(listing: DataFrame, state: DataFrame, *, by: tuple[str, ...] = ("lakehouse",)) -> DataFrame:
    """Each file with ``copy`` or ``skip``: newer than the last sync, or never synced.

    ``state`` must hold the watermark of the previous run, not the one this run will write.
    """
    rows = lookup_join(listing, state.select(*by, "last_sync"), on=list(by), spread_by=["path"], how="left")
    newer = F.col("last_sync").isNull() | (F.col("mtime") > F.col("last_sync"))
    return rows.withColumn("action", F.when(newer, "copy").otherwise("skip"))
