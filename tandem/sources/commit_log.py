"""Commit logs: ``<table>/_delta_log/<20 digits>.json``, one JSON action per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.grouping import lookup_join

COMMIT_FILE = r"/_delta_log/(\d{20})\.json$"
TABLE_OF_COMMIT = r"^(?:.*/)?Tables/(.+)/_delta_log/\d{20}\.json$"
ACTION = "add STRUCT<path STRING>, commitInfo MAP<STRING, STRING>, _corrupt STRING"


# Log folders of tables right below Tables/ or in a schema folder. File listings pass over names
# that start with an underscore, so the folders are named.
LOG_FOLDERS = "Tables/{[^_]*,[^_]*/[^_]*}/_delta_log"


def read_commit_lines(spark: SparkSession, root: str, *, modified_after: str | None = None) -> DataFrame:
    """Lines of the commit files of all tables under ``root`` with the file's path and modification time.

    Only the folders are matched on the driver; their files are listed by a job. A glob in
    ``root`` covers many stores at once.
    """
    reader = spark.read.option("pathGlobFilter", "*.json")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.text(f"{root.rstrip('/')}/{LOG_FOLDERS}").select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("commit_ts"), F.col("value").alias("line"))


def parse_commits(lines: DataFrame) -> DataFrame:
    """Actions of numbered commits: table, version, time, added path, in-commit time, parse failure.

    Checkpoints and pointer files carry no 20-digit number and drop out.
    """
    keep = [c for c in lines.columns if c not in ("file_path", "line")]
    parsed = (lines.withColumn("_version", F.regexp_extract("file_path", COMMIT_FILE, 1))
              .filter((F.col("_version") != "") & (F.trim("line") != ""))
              .withColumn("_action", F.from_json("line", ACTION, {"columnNameOfCorruptRecord": "_corrupt"})))
    return parsed.select(
        *keep, F.regexp_extract("file_path", TABLE_OF_COMMIT, 1).alias("table_key"),
        F.col("_version").cast("bigint").alias("version"), F.col("_action.add.path").alias("add_path"),
        F.col("_action.commitInfo").isNotNull().alias("is_commit"),
        F.map_contains_key(F.coalesce("_action.commitInfo", F.create_map().cast("map<string,string>")),
                           F.lit("inCommitTimestamp")).alias("has_ict"),
        F.col("_action._corrupt").isNotNull().alias("unparsed"))


def commit_history(actions: DataFrame, *, partition: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """One row per commit: version, time, and whether it carries an in-commit timestamp."""
    return actions.groupBy(*partition, "table_key", "version").agg(
        F.max("commit_ts").alias("commit_ts"), F.bool_or("has_ict").alias("has_ict"))


def read_commit_log(spark: SparkSession, root: str, *, modified_after: str | None = None) -> DataFrame:
    return parse_commits(read_commit_lines(spark, root, modified_after=modified_after))


EXPORTED = "table_key STRING, version BIGINT, add STRUCT<path: STRING, size: BIGINT>, remove STRUCT<path: STRING>"
TABLE = ("pair_id", "table_key")


def write_export(actions: DataFrame, root: str) -> None:
    """File actions (``pair_id``, ``table_key``, ``version``, ``op``, ``path``, ``size``) as JSON lines, a folder per pair.

    A line carries its table and version, so many tables and commits share a file and nothing is listed per commit.
    """
    of = lambda op, *fields: F.when(F.col("op") == op, F.struct(*fields)).alias(op)
    line = F.to_json(F.struct("table_key", F.col("version").cast("bigint").alias("version"), of("add", "path", "size"), of("remove", "path")))
    actions.select("pair_id", line.alias("value")).write.partitionBy("pair_id").text(root)


def read_export(spark: SparkSession, root: str, *, pair_type: str = "string") -> DataFrame:
    """The actions behind ``write_export``; a line that is no action has ``op`` null, and only its pair is known."""
    lines = spark.read.schema(f"value STRING, pair_id {pair_type}").text(root)
    x = F.from_json("value", EXPORTED)
    op = F.when(x["add"]["path"].isNotNull(), "add").when(x["remove"]["path"].isNotNull(), "remove")
    return lines.select("pair_id", x["table_key"].alias("table_key"), x["version"].alias("version"), op.alias("op"),
                        F.coalesce(x["add"]["path"], x["remove"]["path"]).alias("path"), x["add"]["size"].alias("size"))


def write_checkpoint(active: DataFrame, versions: DataFrame, root: str) -> None:
    """The files of each table at its version; a table without files leaves one row without a path, so that it is known to be empty."""
    rows = versions.select(*TABLE, "version").join(active.select(*TABLE, "path", "size"), list(TABLE), "left")
    rows.select("table_key", "version", "path", "size", "pair_id").write.partitionBy("pair_id").parquet(root)


def read_checkpoint(spark: SparkSession, root: str, *, pair_type: str = "string") -> DataFrame:
    return spark.read.schema(f"table_key STRING, version BIGINT, path STRING, size BIGINT, pair_id {pair_type}").parquet(root)


def _order() -> Column:
    """Actions of a path in order; what one commit both removes and adds is there after it."""
    return F.struct(F.col("version"), (F.col("op") == "add").alias("adds"))


def active_files(actions: DataFrame, versions: DataFrame, checkpoints: DataFrame | None = None) -> DataFrame:
    """Files of each table at ``versions.version``: ``pair_id``, ``table_key``, ``path``, ``size``, ``added`` (version).

    The newest checkpoint at or below the version stands for the log up to it (``added`` is the checkpoint's version for its files).
    After it the last action of a path counts. All tables go through one aggregate by table and path, so a table with a third of
    all files is spread; what is known per table (its version, its checkpoint) is looked up.
    """
    at = versions.select(*TABLE, F.col("version").alias("_at"))
    rows = actions.filter("op IS NOT NULL").select(*TABLE, "version", "op", "path", "size")
    if checkpoints is not None:
        marks = checkpoints.select(*TABLE, F.col("version").alias("_from")).distinct()
        newest = marks.join(at, list(TABLE)).filter("_from <= _at").groupBy(*TABLE).agg(F.max("_from").alias("_from"))
        at = at.join(newest, list(TABLE), "left")
        saved = checkpoints.filter("path IS NOT NULL").select(*TABLE, "version", F.lit("add").alias("op"), "path", "size", F.lit(True).alias("saved"))
        rows = rows.withColumn("saved", F.lit(False)).unionByName(saved)
        rows = lookup_join(rows, at, on=list(TABLE), spread_by=["path"])
        rows = rows.filter(F.when(F.col("saved"), F.col("version") == F.col("_from")).otherwise(
            (F.col("version") > F.coalesce("_from", F.lit(-1))) & (F.col("version") <= F.col("_at"))))
    else:
        rows = lookup_join(rows, at, on=list(TABLE), spread_by=["path"]).filter("version <= _at")
    last = rows.groupBy(*TABLE, "path").agg(F.max_by(F.struct("op", "size", "version"), _order()).alias("last"))
    return last.filter("last.op = 'add'").select(*TABLE, "path", "last.size", F.col("last.version").alias("added"))


def copy_plan(actions: DataFrame, state: DataFrame, listing: DataFrame, *, failed: DataFrame | None = None) -> DataFrame:
    """``pair_id``, ``table_key``, ``method``, ``action`` (copy or delete) and ``path`` of what brings a copy from its version to the newest.

    By the log: a path is copied if it is there now and was added after the synced version (again, perhaps), and deleted if it was
    there and is not now; what came and went in between is neither. A table without a synced version, or in ``failed`` (a commit could
    not be read), is planned from ``listing`` (``path``, ``mtime``) instead: files newer than the last sync are copied, and nothing is
    deleted, as a listing does not tell what is no longer part of the table.
    """
    key = list(TABLE)
    synced = state.select(*key, "last_version", "last_sync")
    if failed is not None:
        bad = failed.select(*key).distinct().withColumn("_bad", F.lit(True))
        synced = synced.join(bad, key, "left").withColumn("last_version", F.when(F.col("_bad").isNull(), F.col("last_version"))).drop("_bad")
    rows = lookup_join(actions.filter("op IS NOT NULL").select(*key, "version", "op", "path"), synced.filter("last_version IS NOT NULL"), on=key, spread_by=["path"])
    old = F.col("version") <= F.col("last_version")
    paths = rows.groupBy(*key, "path").agg(
        F.max_by("op", F.when(old, _order())).alias("before"), F.max_by("op", _order()).alias("now"),
        F.max(F.when(~old & (F.col("op") == "add"), True)).alias("fresh"), F.max(F.when(old, True)).alias("seen"))
    held = F.col("seen").isNotNull() & (F.col("before") == "add")
    action = F.when((F.col("now") == "add") & F.col("fresh"), "copy").when((F.col("now") == "remove") & held, "delete")
    by_log = paths.select(*key, F.lit("commit_log").alias("method"), action.alias("action"), "path").filter("action IS NOT NULL")
    times = lookup_join(listing.select(*key, "path", "mtime"), synced, on=key, spread_by=["path"], how="left").filter("last_version IS NULL")
    newer = times.filter(F.col("last_sync").isNull() | (F.col("mtime") > F.col("last_sync")))
    return by_log.unionByName(newer.select(*key, F.lit("file_listing").alias("method"), F.lit("copy").alias("action"), "path"))
