"""Delimited text, quoted so that every value comes back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marker keeps null apart from the empty string; the escape keeps quotes and backslashes.
OPTIONS = {"nullValue": "\\N", "emptyValue": "", "escape": '"', "quoteAll": "true",
           "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
           "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def to_delimited(df: DataFrame) -> DataFrame:
    """One ``line`` per row."""
    return df.select(F.to_csv(F.struct(*df.columns), OPTIONS).alias("line"))


def from_delimited(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows behind the lines, in the given schema."""
    text = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return lines.select(F.from_csv("line", F.lit(text), OPTIONS).alias("_row")).select("_row.*")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    return spark.read.schema(schema).options(**{**OPTIONS, "header": "true", **options}).csv(path)
