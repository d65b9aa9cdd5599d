"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import keep


def _least(edges: DataFrame) -> DataFrame:
    """Per node ``u`` its smallest neighbour, joined back to the edges. The sum is partial before it is shuffled."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node that has an edge.

    ``edges`` has columns ``u`` and ``v`` (bigint). Each round links every node's larger neighbours to its smallest one, then
    its smaller neighbours likewise; the number of rounds grows with the logarithm of the largest component's diameter. Every
    round is written to the shared folder, so a lost executor repeats one round at most. Links stay in Spark.
    """
    edges = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = keep(links.filter("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
