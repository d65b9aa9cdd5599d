"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors are dealt out by ranges of their length, longest first, so a shard holds vectors of like length however many share one.
   Within a shard they are cut into buckets of at most ``BUCKET`` rows; a bucket is one row of a table (ids, lengths, integer
   components in the narrowest type, all as binary) with its longest and shortest length. A vector's name is (bucket, place), so
   rows of one id stay apart.
2. Queries are taken from the buckets and packed into blocks of ``BLOCK``. Blocks meet buckets in the cells of a grid: a cell is a
   few neighbouring buckets and a few blocks, joined by the cell's number. A cell's size does not grow with the table.
3. The cells of the longest buckets come first. They give each query a value that its k-th score cannot fall below. A block is
   then sent only to groups of buckets that are long enough to hold a score of that value for one of its queries.
4. In a cell, buckets go from long to short, and the query's value rises with what was found. For each bucket and query the local
   cosine threshold is ``value / (query length * longest)``. Above one, the bucket is left out. From ``COORD_FROM`` on,
   coordinates prune: a unit vector within that cosine has each coordinate in an interval around the query's own, so the
   query's ``FOCUS`` largest coordinates are looked up in sorted columns of the bucket. Below it lengths prune: a prefix of
   the bucket, whose vectors are long enough, is multiplied. Either way the integer products decide.
5. The best k of each cell meet in a window per query.

Products are exact while they fit a long; components are clipped to +-2^62, and scores to +-(2^63 - 1).

Defined cases: a null vector, or one with a null or non-finite component, takes no part; vectors of unequal size count as filled up
with zeros; an empty vector scores zero with all. Repeated rows, also of one id, are candidates of each other; a null id is a
candidate (last among equal scores) and no query. An empty table, or one without queries, gives an empty result. Only the named
columns are read.
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

K = 20
SCALE = 64
#: Queries are the rows whose id this divides.
EVERY = 20
#: Vectors of a bucket, and queries of a block.
BUCKET = 1024
BLOCK = 512
#: Buckets, and blocks, of one cell at most.
SIDE = 32
#: Local cosine threshold from which coordinates prune, and how many coordinates are looked up.
COORD_FROM = 0.7
FOCUS = 3
#: Relative slack of bounds that are worked out in floating point.
SLACK = 1e-9
_LIMIT = 2.0 ** 62

_BUCKETS = "bucket bigint, n int, dim int, kind string, longest double, shortest double, ids binary, lengths binary, vectors binary"
_BLOCKS = "block bigint, n int, dim int, kind string, ids binary, lengths binary, refs binary, vectors binary"
_FOUND = "ref_bucket bigint, ref_place int, query_id bigint, vec_bucket bigint, vec_place int, vec_id bigint, score bigint"


def _narrow(values: np.ndarray) -> np.ndarray:
    most = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(t).max))


def _lengths(values: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(values.astype(np.float64)).sum(axis=1))


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for place, row in enumerate(rows):
        out[place, :len(row)] = row
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices, in the cheapest arithmetic that keeps every sum exact."""
    size = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, size - x.shape[1]))) if x.shape[1] < size else x for x in (a, b))
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, size)
    for kind, limit in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53), (np.int64, 2.0 ** 62)):
        if bound < limit:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def _bucketed(limit: int):
    """Rows (id, integer components), sorted by length, to buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BUCKETS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        shard, number, ids, rows = 0, 0, [], []

        def close() -> pa.RecordBatch:
            values = _narrow(_matrix(rows))
            lengths = _lengths(values)
            order = np.argsort(-lengths, kind="stable")
            named = pa.array(ids, pa.int64()).take(pa.array(order))
            known = np.array([v is not None for v in named.to_pylist()])
            packed = np.stack([np.asarray(named.fill_null(0)).astype("<i8"), known.astype("<i8")])
            values, lengths = np.ascontiguousarray(values[order]), lengths[order]
            row = [(shard << 32) + number, len(ids), values.shape[1], values.dtype.str, lengths[0], lengths[-1], packed.tobytes(), lengths.astype("<f8").tobytes(),
                   values.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            shards, vectors = batch.column("shard").to_pylist(), batch.column("vector")
            for shard_of, vec_id, vector in zip(shards, batch.column("vec_id").to_pylist(), vectors):
                shard = shard_of
                ids.append(vec_id)
                rows.append(np.asarray(vector.values))
                if len(ids) >= limit:
                    yield close()
                    number, ids, rows = number + 1, [], []
        if ids:
            yield close()

    return run


def integer_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``vector`` (integers) and ``length`` of all vectors that take part."""
    component = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"), F.lit(_LIMIT)), F.lit(-_LIMIT)).cast("bigint")
    column = F.col(vector_col)
    sound = column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    rows = vectors.filter(sound).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(column, component).alias("vector"))
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.withColumn("length", F.sqrt(squared))


def buckets_of(rows: DataFrame, *, shards: int, bucket: int = BUCKET) -> DataFrame:
    """The written table of buckets. Shards are ranges of the length, longest first."""
    order = (F.col("length").desc(), F.xxhash64("vec_id", "vector"))
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return keep(dealt.select(F.spark_partition_id().alias("shard"), "vec_id", "vector").mapInArrow(_bucketed(bucket), _BUCKETS), "buckets")


class _Held:
    """The arrays of a bucket or a block. Sorted columns of a bucket are made when they are asked for."""

    def __init__(self, row: dict):
        self.n, self.name = row["n"], row.get("bucket", row.get("block"))
        self.ids, self.known = np.frombuffer(row["ids"], "<i8").reshape(2, -1)
        self.lengths = np.frombuffer(row["lengths"], "<f8")
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(self.n, row["dim"])
        self.refs = np.frombuffer(row["refs"], "<i8").reshape(2, -1) if "refs" in row else None
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def unit(self) -> np.ndarray:
        return self.vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]

    def sorted_column(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.columns:
            column = self.vectors[:, f] / np.where(self.lengths > 0, self.lengths, 1.0)
            order = np.argsort(column, kind="stable")
            self.columns[f] = (column[order], order)
        return self.columns[f]


def feasible(bucket: _Held, focus: np.ndarray, at: np.ndarray, cosine: float) -> np.ndarray:
    """Places of a bucket whose coordinates ``focus`` allow a cosine of ``cosine`` with a unit vector that has ``at`` there."""
    spread = np.sqrt(np.maximum(0.0, 1 - at * at) * max(0.0, 1 - cosine * cosine)) + SLACK
    low, high = at * cosine - spread, at * cosine + spread
    # Beyond these points the interval's end is the sphere itself.
    low, high = np.where(at <= -cosine, -1.0 - SLACK, low), np.where(at >= cosine, 1.0 + SLACK, high)
    ranges = []
    for f, a, b in zip(focus.tolist(), low, high):
        column, order = bucket.sorted_column(f)
        ranges.append((int(column.searchsorted(a, "left")), int(column.searchsorted(b, "right")), f, a, b))
    first, last, least, *_ = min(ranges, key=lambda r: r[1] - r[0])
    places = bucket.columns[least][1][first:last]
    scale = np.where(bucket.lengths[places] > 0, bucket.lengths[places], 1.0)
    for _, _, f, a, b in ranges:
        if f != least and len(places):
            value = bucket.vectors[places, f] / scale
            inside = (value >= a) & (value <= b)
            places, scale = places[inside], scale[inside]
    return places


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, null ids last."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], 1 - known[near], -scores[near]))][:k]


class _Top:
    """The best k of one query so far."""

    def __init__(self, value: float, k: int):
        self.value, self.k = value, k
        self.rows = np.zeros((5, 0), np.int64)  # score, id, known, bucket, place

    def add(self, scores: np.ndarray, bucket: _Held, places: np.ndarray) -> None:
        good = scores >= self.value
        if not good.any():
            return
        scores, places = scores[good], places[good]
        best = _best(scores, bucket.ids[places], bucket.known[places], self.k)
        new = np.stack([scores[best], bucket.ids[places[best]], bucket.known[places[best]], np.full(len(best), bucket.name), places[best]])
        rows = np.concatenate([self.rows, new], axis=1)
        self.rows = rows[:, _best(rows[0], rows[1], rows[2], self.k)]
        if self.rows.shape[1] >= self.k:
            self.value = max(self.value, float(self.rows[0, -1]))


def search_bucket(block: _Held, bucket: _Held, tops: list[_Top], coord_from: float = COORD_FROM) -> None:
    """All queries of a block against one bucket."""
    longest = float(bucket.lengths[0])
    value = np.array([t.value for t in tops])
    reach = block.lengths * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, value / reach, np.where(value > 0, np.inf, -np.inf))
    for q in np.flatnonzero((local >= coord_from) & (local <= 1 + SLACK)).tolist():
        unit = block.vectors[q] / block.lengths[q]
        focus = np.argsort(-np.abs(unit[:bucket.vectors.shape[1]]), kind="stable")[:FOCUS]
        # A shorter vector needs a larger cosine still, so the threshold of the longest one holds for all of the bucket.
        places = feasible(bucket, focus, unit[focus], float(local[q]) * (1 - SLACK)) if len(focus) else np.arange(bucket.n)
        places = places[(places != block.refs[1, q]) | (bucket.name != block.refs[0, q])]
        if len(places):
            tops[q].add(products(block.vectors[q:q + 1], bucket.vectors[places])[0], bucket, places)
    by_length = np.flatnonzero(local < coord_from)
    if not len(by_length):
        return
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(block.lengths[by_length] > 0, value[by_length] / block.lengths[by_length], -np.inf) * (1 - SLACK)
    prefix = np.where(value[by_length] > 0, np.searchsorted(-bucket.lengths, -least, "right"), bucket.n)
    most = int(prefix.max())
    scores = products(block.vectors[by_length], bucket.vectors[:most])
    for q, row, end in zip(by_length.tolist(), scores, prefix.tolist()):
        places = np.flatnonzero(row[:end] >= tops[q].value)
        places = places[(places != block.refs[1, q]) | (bucket.name != block.refs[0, q])]
        tops[q].add(row[places], bucket, places)


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _FOUND.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        buckets = sorted((_Held(r) for r in left.to_pylist()), key=lambda b: (-b.lengths[0], b.name))
        out: list[pa.RecordBatch] = []
        for row in right.to_pylist():
            block = _Held(row)
            start = np.frombuffer(row["starts"], "<f8") if row["starts"] is not None else np.full(block.n, -np.inf)
            tops = [_Top(float(v), k) for v in start]
            for bucket in buckets:
                search_bucket(block, bucket, tops)
            counts = [t.rows.shape[1] for t in tops]
            rows = np.concatenate([t.rows for t in tops], axis=1) if tops else np.zeros((5, 0), np.int64)
            of = np.repeat(np.arange(block.n), counts)
            columns = [block.refs[0][of], block.refs[1][of].astype(np.int32), block.ids[of], rows[3], rows[4].astype(np.int32), None, rows[0]]
            arrays = [pa.array(rows[1], pa.int64(), mask=rows[2] == 0) if c is None else pa.array(c, t) for c, t in zip(columns, types)]
            out.append(pa.RecordBatch.from_arrays(arrays, names))
        schema = pa.schema(list(zip(names, types)))
        return pa.Table.from_batches(out, schema)

    return run


def _blocks(every: int, size: int):
    """Queries of the buckets, packed into blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        held: list[tuple] = []

        def close(rows: list[tuple]) -> pa.RecordBatch:
            values = _narrow(_matrix([r[3] for r in rows]))
            refs = np.array([[r[0] for r in rows], [r[1] for r in rows]], "<i8")
            ids = np.array([[r[2] for r in rows], [1] * len(rows)], "<i8")
            # Blocks are named by their first query, which is in no other block.
            name = (int(refs[0, 0]) << 12) + int(refs[1, 0])
            row = [name, len(rows), values.shape[1], values.dtype.str, ids.tobytes(), _lengths(values).astype("<f8").tobytes(), refs.tobytes(), values.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                bucket = _Held(row)
                mine = np.flatnonzero((bucket.known == 1) & (bucket.ids % every == 0))
                held.extend((bucket.name, p, int(bucket.ids[p]), bucket.vectors[p].astype(np.int64)) for p in mine.tolist())
                while len(held) >= size:
                    yield close(held[:size])
                    held = held[size:]
        if held:
            yield close(held)

    return run


def _starts(k: int):
    """Per block the value that each query's k-th score reaches, from what was found first; the smallest length that matters."""
    def run(blocks: pa.Table, found: pa.Table) -> pa.Table:
        scores: dict[tuple[int, int], list[int]] = {}
        for b, p, s in zip(*(found.column(c).to_pylist() for c in ("ref_bucket", "ref_place", "score"))):
            scores.setdefault((b, p), []).append(s)
        names, starts, reaches = [], [], []
        for row in blocks.to_pylist():
            block = _Held(row | {"kind": "<i1", "dim": 0, "vectors": b""})
            value = np.array([sorted(s)[-k] if len(s := scores.get((b, p), [])) >= k else -np.inf for b, p in zip(*block.refs.tolist())])
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(value > 0, np.where(block.lengths > 0, value / block.lengths, np.inf), -np.inf)
            names.append(block.name)
            starts.append(value.astype("<f8").tobytes())
            reaches.append(float(need.min()) * (1 - SLACK))
        return pa.table({"block": pa.array(names, pa.int64()), "starts": pa.array(starts, pa.binary()), "reach": pa.array(reaches, pa.float64())})

    return run


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
          bucket: int = BUCKET, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best rows for every row whose id ``every`` divides, itself left out."""
    if bucket > 1 << 12:
        raise ValueError("a bucket has at most 4096 rows")
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col=id_col, vector_col=vector_col, scale=scale)
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    # A cell is ``edge`` buckets by ``edge`` blocks: cells for every core several times over while the table is small, of bounded size
    # when it is large. A shard is one cell wide, so its number is that of the group of buckets.
    n_buckets, n_blocks = max(1, -(-n_rows // bucket)), max(1, -(-n_queries // block))
    edge = max(1, min(side, math.isqrt(n_buckets * n_blocks // max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    buckets = buckets_of(rows, shards=-(-n_buckets // edge), bucket=bucket)
    blocks = keep(buckets.mapInArrow(_blocks(every, block), _BLOCKS), "query-blocks")
    group = F.shiftright("bucket", 32).alias("g")
    groups = keep(buckets.select(group, "longest").groupBy("g").agg(F.max("longest").alias("longest")), "groups")
    last = groups.agg(F.max("g")).first()[0] or 0
    of_block = F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks // edge)))
    cell = _cell(k)

    def search(left: DataFrame, right: DataFrame) -> DataFrame:
        """Buckets and blocks of the same cell (``g``, ``h``)."""
        return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(cell, _FOUND)

    here = buckets.withColumn("g", group)
    across = F.explode(F.sequence(F.lit(0), F.lit(-(-n_blocks // edge) - 1)).cast("array<bigint>")).alias("h")
    first = keep(search(here.filter("g = 0").select("*", across),
                        blocks.withColumn("g", F.lit(0).cast("bigint")).withColumn("h", of_block).withColumn("starts", F.lit(None).cast("binary"))), "first-found")
    homes = blocks.select("block", "n", "ids", "lengths", "refs")
    # What was found goes to the block of its query.
    refs = homes.mapInArrow(_query_names, "block bigint, ref_bucket bigint, ref_place int")
    starts = keep(homes.groupBy("block").cogroup(first.join(refs, ["ref_bucket", "ref_place"]).groupBy("block"))
                  .applyInArrow(_starts(k), "block bigint, starts binary, reach double"), "starts")
    later = (starts.select("block", "reach", F.explode(F.sequence(F.lit(0), F.lit(last)).cast("array<bigint>")).alias("g")).filter("g > 0")
             .join(groups, "g").filter(F.col("longest") >= F.col("reach")).select("block", "g"))
    later = keep(later.withColumn("h", of_block), "cells")
    found = first.unionByName(search(here.join(later.select(F.col("g").alias("g"), F.col("h").alias("h")).distinct(), "g"), later.join(blocks, "block").join(starts.select("block", "starts"), "block")))
    best = Window.partitionBy("ref_bucket", "ref_place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "vec_bucket", "vec_place")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _query_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            buckets, places = np.frombuffer(row["refs"], "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(buckets), row["block"])), pa.array(buckets), pa.array(places.astype(np.int32))],
                                             ["block", "ref_bucket", "ref_place"])


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for ``op11_topk``: every query against every row.
ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
WHERE rank <= {K}"""
