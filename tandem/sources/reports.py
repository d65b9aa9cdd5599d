"""Reports as files, and tables in the catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def write_report(df: DataFrame, path: str, *, source: str = "json", mode: str = "overwrite") -> None:
    """A report as JSON lines or CSV, one file per task; large reports are not funnelled through one."""
    writer = df.write.mode(mode)
    if source == "csv":
        writer = writer.option("header", "true")
    writer.format(source).save(path)


def register_tables(spark: SparkSession, tables: Iterable[tuple[str, str]], *, source: str = "parquet") -> DataFrame:
    """Make (name, location) folders known to the catalog; existing names are left alone, and told apart if they lie elsewhere.

    The result has one row per table with what happened; one failure does not stop the others.
    """
    results = []
    for name, location in tables:
        schema, _, table = name.rpartition(".")
        full = f"`{schema}`.`{table}`" if schema else f"`{table}`"
        place = location.replace("'", "\\'")
        try:
            if schema:
                spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
            existed = spark.catalog.tableExists(full.replace("`", ""))
            spark.sql(f"CREATE TABLE IF NOT EXISTS {full} USING {source} LOCATION '{place}'")
            held = spark.sql(f"DESCRIBE TABLE EXTENDED {full}").filter("col_name = 'Location'").first()["data_type"] if existed else location
            bare = lambda path: path.split(":", 1)[-1].replace("//", "/").rstrip("/")
            status = "registered" if not existed else "exists" if bare(held) == bare(location) else "other_location"
            results.append((name, location, status, None if status != "other_location" else held))
        except Exception as error:  # the report carries it
            results.append((name, location, "error", str(error)))
    return spark.createDataFrame(results, "table_name STRING, location STRING, status STRING, error STRING")
