"""Binds a query to the replica pairs derived in ``fixtures`` and to its SQL."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.plans.fixtures import TABLES, VIEWS

_NAME = re.compile(r"\bf\d+_[a-z_]+\b")
_TABLE = re.compile(r"\b(" + "|".join(TABLES) + r")\b")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _closure(sql: str) -> list[str]:
    """Fixture views that ``sql`` needs, each after the ones it depends on."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


class Facts:
    """The derived tables over one data folder; ``facts["f1_p"]`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A given table; its schema is read once per query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._tables[name].createOrReplaceTempView(self._view(name))
        return self._tables[name]

    def _view(self, name: str) -> str:
        return f"given_{name}_{zlib.crc32(self.sf_dir.encode()):08x}"

    def sql(self, text: str) -> DataFrame:
        views = _closure(text)
        body = " ".join([text, *(VIEWS[v] for v in views)])
        tables = sorted(set(_TABLE.findall(body)))
        for t in tables:
            self.table(t)
        parts = [f"{t} AS (SELECT * FROM {self._view(t)})" for t in tables]
        parts += [f"{v} AS ({VIEWS[v]})" for v in views]
        return self.spark.sql(f"WITH {', '.join(parts)} {text}")

    def __getitem__(self, view: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {view}")


def _widen(df: DataFrame) -> DataFrame:
    """Report every integer as BIGINT, so row numbers and counts have one type."""
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[
        F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, narrow) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def with_views(sql: str) -> str:
    """``sql`` with the views it names in front of it."""
    views = _closure(sql)
    stripped = sql.strip()
    if not views:
        return stripped
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    head, _, tail = stripped.partition(" ")
    if head.upper() == "WITH":
        recursive, _, rest = tail.strip().partition(" ")
        if recursive.upper() == "RECURSIVE":
            return f"WITH RECURSIVE {ctes}, {rest}"
        return f"WITH {ctes}, {tail}"
    return f"WITH {ctes} {stripped}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(facts) -> DataFrame`` under ``name``, with the SQL that must agree."""

    def wrap(fn: Callable[[Facts], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _widen(fn(Facts(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return wrap
