"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints at most three bits apart agree in one of them up to one
bit, so each fingerprint looks up the 33 values around each of its segments in a table of segments, and every match is
verified over all 64 bits. Links join distinct fingerprints only; documents of equal fingerprint are one node. Components
come from star contractions in Spark.

Where very many distinct fingerprints share a segment (large groups of near copies), listing their pairs would be
quadratic. There, fingerprints within one bit of a common value are at most two bits apart, so each such ball (65 members at
most) is first linked by a star; then only fingerprints of different stars are paired. No link between components is lost.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; fewer words than
a shingle make one shingle; null ids are ignored as component ids unless the component has no other; repeated rows each
appear; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import keep, table
from tandem.llm.components import components
from tandem.llm.words import LOWER

SHINGLE = 3
SEED = 42
BITS = 3
#: A segment value shared by more distinct fingerprints than this is dense.
DENSE = 64


def fingerprint(text: str | None) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp`` (signed 64 bits) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id bigint, text_hash bigint, fp bigint")


def _segments(prints: DataFrame) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).alias("value")) for s in (0, 1)])
    return prints.select("*", F.explode(parts).alias("x")).select("*", "x.segment", "x.value").drop("x")


def _stars(dense: DataFrame) -> DataFrame:
    """Edges between fingerprints within one bit of a common value."""
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) for i in range(64)])
    groups = dense.select("fp", F.explode(ball).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("members"))
    edges = groups.filter(F.size("members") > 1).select(F.array_min("members").alias("v"), F.explode("members").alias("u"))
    return edges.filter("u <> v").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Edges ``u``, ``v`` whose components are those of all pairs of distinct fingerprints at most three bits apart."""
    prints = prints.select("fp").distinct()
    table_side = keep(_segments(prints), "segments")
    crowded = table_side.groupBy("segment", "value").count().filter(F.col("count") > DENSE)
    dense = table_side.join(crowded, ["segment", "value"], "left_semi").select("fp").distinct()
    stars = keep(_stars(dense), "stars")
    roots = components(stars).select(F.col("node").alias("fp"), F.col("root").alias("star"))
    table_side = keep(table_side.join(roots, "fp", "left").withColumn("star", F.coalesce("star", "fp")), "segments")
    masks = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(32)])
    probes = table_side.select(F.col("fp").alias("u"), F.col("star").alias("u_star"), "segment", F.explode(masks).alias("mask"), "value")
    probes = probes.select("u", "u_star", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    # Spark sizes the probes without the explode, so by its own estimate the driver might get all of them to broadcast.
    found = probes.hint("merge").join(table_side, ["segment", "value"]).filter(
        (F.col("u") < F.col("fp")) & (F.col("u_star") != F.col("star")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("fp"))) <= BITS))
    return stars.select("u", "v").unionByName(found.select("u", F.col("fp").alias("v")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``fp``, ``component_id`` (smallest id reachable) and ``first`` (the row that stands for the component)."""
    rows = keep(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id"), F.col("text_hash"))).alias("first")
    prints = rows.groupBy("fp").agg(first)
    roots = components(links(rows)).select(F.col("node").alias("fp"), "root")
    prints = keep(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "prints")
    tops = prints.groupBy("root").agg(F.min("first").alias("first"))
    named = prints.select("fp", "root").join(tops, "root").select("fp", "first")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", F.col("first.doc_id").alias("component_id"), "first")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each component, with their own columns.

    The row with the smallest id stays (of equal ids, the one with the smallest text hash). Repeated rows, equal in id and
    text, are reduced to one; only those rows are shuffled for it.
    """
    rows = near_duplicates(docs, id_col=id_col, text_col=text_col).groupBy("doc_id", "text_hash", "first").count()
    rows = rows.filter(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")))
    stay = keep(rows.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"), F.col("count").alias("n")), "stay")
    whole = docs.select(F.struct("*").alias("doc"))
    met = whole.join(stay, F.col("doc")[id_col].cast("bigint").eqNullSafe(F.col("id")) & (F.xxhash64(F.col("doc")[text_col]) == F.col("th")))
    single = met.filter("n = 1").select("doc.*")
    return single.unionByName(met.filter("n > 1").dropDuplicates(["id", "th"]).select("doc.*"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
