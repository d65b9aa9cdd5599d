"""Order-free fingerprints and skew-safe ordinals, built from partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORDS = 4
_DIGITS = 15


def row_digest(*columns: Column | str) -> Column:
    """SHA-256 of the columns, each length-prefixed so that no two rows share an encoding."""
    encoded = []
    for column in columns:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        encoded.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*encoded), 256)


def bag_digest(digest: Column) -> Column:
    """Aggregate: one fingerprint for a bag of SHA-256 digests, whatever their order.

    The words of the digests are added up, so the aggregate is partial on the map side and a
    group of any size stays a few numbers; nothing is collected.
    """
    sums = [
        F.sum(F.conv(F.substring(digest, 1 + i * _DIGITS, _DIGITS), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(_WORDS)
    ]
    return F.sha2(F.concat_ws("/", F.count(digest).cast("string"), *sums), 256)


def ordinal(df: DataFrame, *, group: Sequence[str], levels: Sequence[Sequence[str]], rest: Sequence[str], out: str) -> DataFrame:
    """1-based position of each row in its group, in the order of the ``levels`` and then ``rest``.

    Each level splits the cells of the one before. Rows are ranked inside their finest cell only;
    what lies before a cell comes from counts of its siblings. A group that holds most of the
    table is thus spread over as many tasks as it has cells. The columns may not be null.
    """
    cell = [*group, *[c for level in levels for c in level]]
    # One row per finest cell; the coarser counts are sums of these, so the rows are read for them once.
    cells = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    offsets = cells.select(*cell, F.lit(0).cast("bigint").alias("_before"))
    parent = list(group)
    for level in levels:
        child = [*parent, *level]
        earlier = Window.partitionBy(*parent).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        siblings = (cells.groupBy(*child).agg(F.sum("_n").alias("_n"))
                    .select(*child, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_earlier")))
        offsets = offsets.join(siblings, child).select(*cell, (F.col("_before") + F.col("_earlier")).alias("_before"))
        parent = child
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*cell).orderBy(*rest)))
    return (local.join(offsets, cell).withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint")).drop("_local", "_before"))


def spread(column: Column | str, *, digits: int = 2) -> Column:
    """A uniform, deterministic prefix for ``ordinal`` when the order inside a group is free."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.substring(F.md5(text), 1, digits)


BROADCAST_ROWS = 1_000_000


#: Bytes of values up to which a table is sent to every executor.
BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of a row's values: texts as they are, nested values as JSON, eight for any other."""
    total = F.lit(0).cast("bigint")
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(col)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(col)))
        else:
            size = F.lit(0)
        total = total + 8 + F.coalesce(size, F.lit(0))
    return total


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Has a table at most so many rows and bytes? Looks no further than the rows."""
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(_width(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def lookup_join(facts: DataFrame, lookup: DataFrame, *, on: Sequence[str], spread_by: Sequence[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, salts: int = 16) -> DataFrame:
    """Join many facts to a table that is unique on ``on``, when a few keys may dominate the facts.

    The lookup's size is checked. Up to ``max_rows`` and ``max_bytes`` it is broadcast, and the facts are not moved
    at all; left to itself the runtime would learn the size only after it had begun to shuffle
    the facts. A larger one is repeated ``salts`` times and each fact goes to one of the copies,
    so the rows of a hot key are shared out, also where an aggregate on the same key follows and
    the runtime would not split the join.
    """
    if fits(lookup, max_rows, max_bytes):
        return facts.join(F.broadcast(lookup), list(on), how)
    copies = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
