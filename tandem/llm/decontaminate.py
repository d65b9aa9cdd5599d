"""Benchmark decontamination: rare n-grams as seeds join documents with test items, then Smith-Waterman alignment.

An alignment (match 2, mismatch -1, gap -1 per word) that reaches the share ``score`` of a perfect copy keeps a number of the
item's word pairs as they are: with m matches and c words of cost there are at most c + 1 runs of matches, so at least m - c - 1 pairs, which
is at least 2 * score * size - size - 1. So whichever pairs of an item are its seeds, some of them stand in the copy if they are
more than the rest: each item is seeded by that many of its pairs, those found in the fewest documents, and one more where a copy
keeps two. Items so short that a copy may keep no pair are seeded by single words in the same way; those of fewer than
``EDITED`` words match exact copies only.

A pass over the documents keeps, per row, the n-grams that items may hold (a bit table of bounded size sorts out the others). Their
document counts choose the seeds; seeds and documents meet in a join, and what is left is joined with the texts. There bounds on the score
(words of the item in a run of the document, and in a window as long as an alignment can be) leave few passages, which are
aligned. Neither seeds nor bounds fall below the score, so the result is what aligning every item with every document gives.

Defined cases: null texts are empty; items without words never match; repeated rows of documents give repeated result rows,
repeated items match each for itself; empty tables give an empty result. Ids may be null and are carried along. Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.llm.common import keep, table
from tandem.llm.words import WordIds, grams, plain_words

#: Fewest words of a test item that can match. One-word items match every document with the word; raise it where that is not wanted.
SHORTEST = 1
#: Fewest words of a test item whose edited copies count; shorter ones match exact copies.
EDITED = 4
#: Share of a perfect copy's alignment score from which a passage counts as taken from the item.
SCORE = 0.6
#: Bits of the table that sorts out n-grams no item holds: 256 for each n-gram, 2 ** SIEVE (16 MB) at most. A full one lets more pass, no less.
SIEVE = 27
#: Test items that meet one text at a time, about.
TOGETHER = 64
MATCH, MISMATCH, GAP = 2, -1, -1
#: Against rounding where a bound is compared with a score.
SLACK = 1e-6

_FOUND = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint, n_seeds bigint"
_ITEMS = "item bigint, item_id bigint, copies bigint, words array<bigint>, share double, size int, n_seeds int, need int, grams array<bigint>"


def share_of(size: int, score: float) -> float:
    """Share of a perfect copy's score that an item of this size must reach."""
    return score if size >= EDITED else 1.0


def seeding(size: int, score: float) -> tuple[int, int, int]:
    """Words of an n-gram, places of the item to seed, and how many of these any copy keeps."""
    share = share_of(size, score)
    n, places, sure = 2, size - 1, math.ceil((MATCH * share - 1) * size - 1 - SLACK)
    if sure < 1:
        n, places, sure = 1, size, max(1, math.ceil(share * size - SLACK))
    more = min(1, sure - 1)
    return n, places - sure + 1 + more, 1 + more


def _rows(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score with its last row and column (both inclusive)."""
    steps = np.arange(len(passage) + 1, dtype=np.int64)
    above = np.zeros(len(passage) + 1, np.int64)
    best = (0, -1, -1)
    for i, word in enumerate(item):
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - GAP * steps) + GAP * steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j - 1)
        above = row
    return best


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the first word and the word after the last of the passage that it covers."""
    score, i, j = _rows(item, passage)
    if score <= 0:
        return 0, 0, 0
    _, _, back = _rows(item[:i + 1][::-1], passage[:j + 1][::-1])
    return score, j - back, j + 1


def _passages(own: np.ndarray, at: np.ndarray, found: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Ranges of words that may hold a copy; each possible copy lies in one of them.

    ``at`` and ``found`` are places and words of the document, those of the item only.
    """
    size = len(own)
    needed = max(1, math.ceil(share * size - SLACK))
    # Places of item words as matches and all between as differences: the best run is at least the score.
    rise = (MATCH + 1) * np.arange(len(at)) - at
    if not len(at) or (rise - np.minimum.accumulate(rise)).max() + MATCH < MATCH * share * size - SLACK:
        return []
    # With m matches, differences are at most MATCH * (m - score * size).
    span = max(1, int((1 + MATCH * max(0.0, 1 - share)) * size + SLACK))
    kinds, counts = np.unique(own, return_counts=True)
    place = np.searchsorted(kinds, found)
    merged: list[list[int]] = []
    for step in np.unique(np.concatenate([at // span, np.maximum(at // span - 1, 0)])).tolist():
        first, last = np.searchsorted(at, [step * span, (step + 2) * span])
        if last - first < needed or np.minimum(np.bincount(place[first:last], minlength=len(kinds)), counts).sum() < needed:
            continue
        if merged and step * span <= merged[-1][1]:
            merged[-1][1] = (step + 2) * span
        else:
            merged.append([step * span, (step + 2) * span])
    return [tuple(x) for x in merged]


def _item_rows(score: float, shortest: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for batch in batches:
            out = []
            for item, item_id, copies, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "copies", "text"))):
                words = memo.of(plain_words(text))
                size = len(words)
                if size >= max(1, shortest):
                    n, places, need = seeding(size, score)
                    out.append((item, item_id, copies, words.view(np.int64), share_of(size, score), n, places, need, grams(words, n).view(np.int64)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                names = ("item", "item_id", "copies", "words", "share", "size", "n_seeds", "need", "grams")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows


def _held(sizes: list[int], bits: int, pieces: dict[int, bytes]):
    """Task side: per document the n-grams that the bit table lets pass, each once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        sieve = np.zeros(1 << (bits - 3), np.uint8)
        for piece, content in pieces.items():
            sieve[piece << 12:(piece + 1) << 12] = np.frombuffer(content, np.uint8)
        sieve = np.unpackbits(sieve, bitorder="little").view(bool) if bits <= 24 else sieve
        for batch in batches:
            keys, lists = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                ids = memo.of(plain_words(text.as_py()))
                own = np.concatenate([grams(ids, n) for n in sizes]) if len(sizes) > 1 else grams(ids, sizes[0])
                bit = own >> np.uint64(64 - bits)
                passed = sieve[bit] if bits <= 24 else sieve[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
                own = np.unique(own[passed])
                if len(own):
                    keys.append(key)
                    lists.append(own.view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["key", "grams"])

    return rows


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignment of texts with the items that their seeds point to."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_seeds", pa.int64())])
    memo = WordIds()
    for batch in batches:
        rows = []
        items, begins = batch.column("items"), batch.column("items").offsets.to_numpy()
        parts = items.values
        words, seeds = parts.field("words"), parts.field("seeds")
        item_ids, copies, shares, sizes = (parts.field(c).to_pylist() for c in ("item_id", "copies", "share", "size"))
        for row, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
            ids = memo.of(plain_words(text.as_py()))
            kinds, place = np.unique(ids, return_inverse=True)
            for k in range(begins[row], begins[row + 1]):
                own = words[k].values.to_numpy().view(np.uint64)
                mine = np.isin(kinds, own)
                at = np.flatnonzero(mine[place])
                best = (0, 0, 0)
                for first, last in _passages(own, at, ids[at], shares[k]):
                    score, start, end = smith_waterman(own, ids[first:last])
                    if score > best[0]:
                        best = (score, first + start, first + end)
                share = best[0] / (MATCH * len(own))
                if best[0] and share >= shares[k]:
                    n_seeds = int(np.isin(grams(ids, sizes[k]), seeds[k].values.to_numpy().view(np.uint64)).sum())
                    rows += [(doc_id, item_ids[k], share, best[1], best[2], n_seeds)] * copies[k]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sieve(items: DataFrame, most: int) -> tuple[list[int], int, dict[int, bytes]]:
    """Lengths of n-grams in use, bits of the table's index, and its parts of 2 ** 15 bits that are not empty."""
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.sum(F.size("grams")).alias("n")).collect()}
    bits = min(most, max(16, (256 * sum(counts.values())).bit_length()))
    bit = F.shiftrightunsigned("gram", 64 - bits)
    found = items.select(F.explode("grams").alias("gram")).groupBy(F.shiftright(bit, 15).alias("piece"))
    parts = found.agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(32767))).alias("content"))
    return sorted(counts), bits, {r["piece"]: bytes(r["content"]) for r in parts.collect()}


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", score: float = SCORE, shortest: int = SHORTEST, sieve: int = SIEVE, together: int = TOGETHER) -> DataFrame:
    """A row for each document and test item it holds a copy of: ``score``, ``start_word``, ``end_word`` (words from 0), ``n_seeds``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.groupBy("item_id", "text").agg(F.count("*").alias("copies")).withColumn("item", F.monotonically_increasing_id())
    items = keep(items.mapInArrow(_item_rows(score, shortest), _ITEMS), "items")
    sizes, bits, pieces = _sieve(items, sieve)
    if not sizes:
        return docs.sparkSession.createDataFrame([], _FOUND)
    held = keep(rows.select("key", "text").mapInArrow(_held(sizes, bits, pieces), "key bigint, grams array<bigint>"), "held")
    held = held.select("key", F.explode("grams").alias("gram"))

    # The places of each item whose n-grams stand in the fewest documents.
    places = items.select("item", "n_seeds", "need", F.posexplode("grams").alias("place", "gram"))
    common = held.groupBy("gram").agg(F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n_docs", F.lit(0)), "gram", "place"))
    seeds = places.join(common, "gram", "left").withColumn("rank", rank).filter(F.col("rank") <= F.col("n_seeds"))
    seeds = keep(seeds.select("item", "gram", "place", "need"), "seeds")

    # Copies of a text share its key, so places are told apart rather than counted.
    met = held.join(seeds, "gram").groupBy("key", "item", "need").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    met = keep(met.filter((F.col("need") == 1) | (F.col("low") < F.col("high"))).select("key", "item"), "met")
    of_item = seeds.groupBy("item").agg(F.collect_list("gram").alias("seeds"))
    detail = items.join(of_item, "item").select("item", F.struct("item_id", "copies", "share", "size", "words", "seeds").alias("own"))
    parts = met.groupBy("key").agg(F.ceil(F.count("*") / together).alias("parts"))
    lists = met.join(parts, "key").join(detail, "item").groupBy("key", F.pmod(F.xxhash64("item"), F.col("parts")).alias("part"))
    lists = lists.agg(F.collect_list("own").alias("items")).drop("part")
    return rows.join(lists, "key").select("doc_id", "text", "items").mapInArrow(_verify, _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", score: float = SCORE,
                  shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that hold no copy of a test item, with their own columns.

    A document is known by its id and text hash here, so that rows without an id are judged as well.
    """
    whole = docs.select(F.struct("*").alias("doc"))
    key = F.xxhash64(F.col("doc")[id_col], F.col("doc")[text_col])
    found = contaminated(whole.select(key.alias("key"), F.col("doc")[text_col].alias("text")), benchmark, id_col="key", score=score,
                         shortest=shortest)
    bad = keep(found.select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return whole.join(bad, key == F.col("key"), "left_anti").select("doc.*")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
