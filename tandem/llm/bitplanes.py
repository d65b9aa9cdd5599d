"""Token ids as shuffled planes: whole texts encoded, ids cut into fixed blocks, each block transposed and compressed.

The file format is a Parquet folder written by Spark, so it reaches any store and a lost executor leaves no half file. A row
is a segment: consecutive documents in ascending id order. ``payload`` holds the segment's blocks one after the other; a block of
``block_ids`` ids (the last one shorter) is transposed into byte planes (or bit planes) as wide as its largest id needs, and
every plane is compressed with zstandard. ``widths`` (planes of each block) and ``plane_ends`` (end of each plane in the
payload) are the chunk index; ``doc_ids`` and ``lengths`` say whose ids they are. All but ``payload`` can be read without it.

Documents are dealt out by ranges of (id, text hash), so shards are in ascending order and copies of one id do not meet in one
task. A segment is closed at ``segment_ids`` ids; a document is never split between segments, as its text is one value anyway.

Defined cases: null and empty texts are the end id alone; a null id comes first; repeated rows are written each, rows of
one id in order of their text hash; an empty table gives no segment. Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.llm.common import table
from tandem.llm.words import LOWER, Memo, give_back, of_process
from tandem.session import new_folder

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 18
END_ID = 1
#: Bytes of pieces and their ids that a worker process remembers from task to task, at most; forgetting changes no id.
REMEMBERED = 192 << 20
#: Pieces that are encoded as one text and told apart by the places of their ids.
TOGETHER = 256

_SEGMENTS = ("shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, block_ids int, planes string, "
             "widths array<int>, plane_ends array<bigint>, payload binary")
_DOCS = "doc_id bigint, shard int, segment int, offset bigint, n_tokens bigint, ids_crc32 bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def transpose(ids: np.ndarray, planes: str) -> np.ndarray:
    """Planes of a block, lowest first, without planes that are zero in every id; one plane at least."""
    cells = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if planes == "byte":
        return np.ascontiguousarray(cells.T[:max(1, -(-top // 8))])
    return np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T[:max(1, top)], axis=1, bitorder="little")


def restore(planes_of_block: np.ndarray, n_ids: int, planes: str) -> np.ndarray:
    cells = np.zeros((n_ids, 4), np.uint8)
    if planes == "byte":
        cells[:, :len(planes_of_block)] = planes_of_block.T
    else:
        bits = np.zeros((n_ids, 32), np.uint8)
        bits[:, :len(planes_of_block)] = np.unpackbits(planes_of_block, axis=1, bitorder="little", count=n_ids).T
        cells = np.packbits(bits, axis=1, bitorder="little")
    return cells.reshape(-1).view("<u4")


def pack(ids: np.ndarray, *, block_ids: int, planes: str, level: int = 3) -> tuple[list[int], list[int], bytes]:
    """Planes of each block, end of each compressed plane, and the payload."""
    squeeze, widths, ends, parts, at = zstandard.ZstdCompressor(level=level), [], [], [], 0
    for first in range(0, len(ids), block_ids):
        block = transpose(ids[first:first + block_ids], planes)
        widths.append(len(block))
        for plane in block:
            parts.append(squeeze.compress(plane.tobytes()))
            at += len(parts[-1])
            ends.append(at)
    return widths, ends, b"".join(parts)


def unpack(n_ids: int, block_ids: int, planes: str, widths: list[int], ends: list[int], payload: bytes) -> np.ndarray:
    expand, out, at, plane = zstandard.ZstdDecompressor(), [], 0, 0
    for block, width in enumerate(widths):
        size = min(block_ids, n_ids - block * block_ids)
        rows = []
        for end in ends[plane:plane + width]:
            rows.append(np.frombuffer(expand.decompress(payload[at:end]), np.uint8))
            at = end
        plane += width
        out.append(restore(np.stack(rows), size, planes))
    return np.concatenate([*out, np.zeros(0, "<u4")]).astype("<u4")


#: A comma or full stop between a letter or digit (ASCII, or Latin letters of two bytes) and white space.
_POINT = re.compile(rb"[,.](?:(?<=[a-z0-9][,.])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][,.]))(?=[ \n])")


class PieceEncoder:
    """Ids of whole texts, piece by piece.

    The default tokenizer lower-cases, drops white space, and parts letters from other signs, so the ids of a text are those of its
    pieces between spaces and line feeds, one after the other. A piece is encoded once in a worker and remembered. Before the text is cut, A-Z are
    lowered and a single comma or full stop after a word is set apart, which changes no id and leaves fewer distinct pieces; texts
    that may hold a special token (``<|``) are cut as they are. ``by_piece`` must be off for a tokenizer of another kind; whole
    texts are encoded then.
    """

    def __init__(self, path: str, by_piece: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_piece = Tokenizer.from_file(path), by_piece
        self.known = Memo(REMEMBERED)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, many at a time; those that may hold a special token each by itself."""
        texts = [x.decode("utf-8", "surrogatepass") for x in pieces]
        if any("<|" in t for t in texts):
            return self._encode(texts)
        out: list[bytes] = []
        parts = [texts[i:i + TOGETHER] for i in range(0, len(texts), TOGETHER)]
        for part, e in zip(parts, self.tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False)):
            places = np.fromiter((at for at, _ in e.offsets), np.int64, len(e.ids))
            cuts = (4 * np.searchsorted(places, np.cumsum([0, *(len(x) + 1 for x in part)]))).tolist()
            ids = array("I", e.ids).tobytes()
            out.extend([ids[a:b] for a, b in zip(cuts, cuts[1:])])
        return out

    @staticmethod
    def pieces(text: str) -> list[bytes]:
        raw = text.encode("utf-8", "surrogatepass")
        if b"<|" not in raw:
            raw = _POINT.sub(rb" \g<0>", raw.translate(LOWER))
        return raw.replace(b"\n", b" ").split(b" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_piece:
            return self._encode(texts)
        pieces = [self.pieces(x) for x in texts]
        known = self.known
        if known.full():
            known.clear()
        new = [x for x in set().union(*pieces) if x not in known]
        special = [x for x in new if b"<|" in x]
        if special:
            new = list(set(new).difference(special))
        for some in (special, new):
            for first in range(0, len(some), 1 << 14):
                part = some[first:first + (1 << 14)]
                known.learn(part, self._encode_pieces(part))
        return [b"".join(map(known.__getitem__, x)) for x in pieces]


def _writer(encoder: Callable[[], Callable[[list[str]], list[bytes]]], block_ids: int, segment_ids: int, planes: str):
    end = np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, docs, ids, held, segment, shard = encoder(), [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(ids), "<u4")
            widths, ends, payload = pack(whole, block_ids=block_ids, planes=planes)
            row = {"shard": shard, "segment": segment, "doc_ids": docs, "lengths": [len(x) // 4 for x in ids], "n_ids": len(whole),
                   "block_ids": block_ids, "planes": planes, "widths": widths, "plane_ends": ends, "payload": payload}
            types = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.string(),
                     pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], list(row))

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                for doc_id, where, own in zip(part.column("doc_id").to_pylist(), part.column("shard").to_pylist(), encode(part.column("text").to_pylist())):
                    shard = where
                    docs.append(doc_id)
                    ids.append(own + end)
                    held += len(ids[-1]) // 4
                    if held >= segment_ids:
                        yield close()
                        docs, ids, held, segment = [], [], 0, segment + 1
        if docs:
            yield close()
        give_back()

    return write


def write_ids(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, by_piece: bool = True,
              planes: str = "byte", block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, shards: int | None = None) -> None:
    """Encode every text and write the ids under ``path``. ``shards`` is the number of parts, that of shuffles by default."""
    spark = docs.sparkSession
    name = tokenizer or default_tokenizer()
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = (F.col("doc_id"), F.xxhash64("text"))
    rows = rows.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    encoder = lambda: of_process(f"encoder {name} {by_piece}", lambda: PieceEncoder(name, by_piece))
    (rows.mapInArrow(_writer(encoder, block_ids, segment_ids, planes), _SEGMENTS)
     .write.option("compression", "uncompressed").parquet(path))


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["n_ids"], row["block_ids"], row["planes"], row["widths"], row["plane_ends"], row["payload"]).tobytes()
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["segment"], np.int32)),
                 pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], ["doc_id", "shard", "segment", "offset", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard``, ``segment`` and ``first_id``, the number of ids before the segment. Read without the payload.

    Segments are added up within their shard; only one sum per shard meets the others.
    """
    rows = spark.read.schema(_SEGMENTS).parquet(path).select("shard", "segment", "n_ids")
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before(Window.orderBy("shard"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("shard").orderBy("segment"))), F.lit(0))
    return rows.withColumn("inside", inside).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("inside")).alias("first_id"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``. A segment is decoded by itself, without a shuffle."""
    docs = spark.read.schema(_SEGMENTS).parquet(path).mapInArrow(_read_segments, _DOCS)
    return docs.join(read_index(spark, path), ["shard", "segment"]).select(
        "doc_id", (F.col("first_id") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op1_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
