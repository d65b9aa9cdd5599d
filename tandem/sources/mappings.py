"""Reference mappings from CSV files and discovery, merged by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the three mapping files. A kind further down wins over the ones above.
FILES = {
    "reference": ("primary_reference", "secondary_reference", "reference_type"),
    "artifact": ("primary_artifact_id", "secondary_artifact_id", "artifact_type", "primary_name", "secondary_name"),
    "connection": ("primary_connection_name", "secondary_connection_name", "connection_type"),
}
PRECEDENCE = ("host", *FILES)


def read_mapping(spark: SparkSession, path: str, kind: str) -> DataFrame:
    columns = FILES[kind]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", "true").csv(path)
    return rows.select(F.col(columns[0]).alias("primary_ref"), F.col(columns[1]).alias("secondary_ref"), F.lit(kind).alias("kind"))


def merge_mappings(*mappings: DataFrame) -> DataFrame:
    """One row per primary reference; explicit rows override discovered hosts."""
    rows = mappings[0]
    for m in mappings[1:]:
        rows = rows.unionByName(m)
    rank = F.array_position(F.array(*[F.lit(k) for k in PRECEDENCE]), F.col("kind"))
    best = rows.filter("primary_ref IS NOT NULL").groupBy("primary_ref").agg(
        F.max(F.struct(rank.alias("rank"), "secondary_ref", "kind")).alias("_best"))
    return best.select("primary_ref", F.col("_best.secondary_ref").alias("secondary_ref"), F.col("_best.kind").alias("kind"))


def read_mappings(spark: SparkSession, *, reference: str | None = None, artifact: str | None = None, connection: str | None = None,
                  discovered: DataFrame | None = None) -> DataFrame:
    tables = [] if discovered is None else [discovered.select("primary_ref", "secondary_ref", F.lit("host").alias("kind"))]
    for kind, path in (("reference", reference), ("artifact", artifact), ("connection", connection)):
        if path:
            tables.append(read_mapping(spark, path, kind))
    if not tables:
        raise ValueError("no mapping given")
    return merge_mappings(*tables)
