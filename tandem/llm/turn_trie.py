"""Prefix trie of conversations from sorted matrices of turn ids.

1. Every turn becomes a 128-bit id of role and text and its number of words, before anything is shuffled. Conversations are rebuilt:
   the first ``h`` turns come from the first conversation of their family, the rest are their own. Members of a family lie in one
   partition, so building and borrowing share one exchange.
2. Conversations are dealt out by ranges of (turn ids, conversation id). The order of turn ids, a shorter sequence first, is a
   depth-first order of the trie, so the members of any node are neighbours, also when very many conversations are equal.
3. A shard puts its turn ids into matrices padded to ``STRIP`` turns and sorts them with a lexsort. A row that differs from
   the one above in a column starts a new node there and in all later columns: changes are OR-accumulated along the row. Rows that
   share their strip with a neighbour go on to the next strip, the others end in nodes of one member. ``reduceat`` over the
   node starts gives members, children, leaves and words of every depth.
4. A node with members in two shards lies on the path of a shard's first or last row. Shards give such nodes in parts. Parts are
   added up by the node's id; a node's own share of words and leaves is counted by the first shard that holds it, and goes from there
   up its path. The ids of conversations that end in such a node pass in order through one running hash, piece by piece, since
   SHA-256 has no parts.

A conversation is one value (its turn ids, 16 bytes a turn), as a document's text is; no group of conversations is ever collected.

Defined cases: null role or text is empty; turns of one number are in order of their id; repeated turns count each; rows without a
conversation id belong to no conversation and are left out; a conversation without turns is a member of the root; an empty table has
no node. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.functions.grouping import lookup_join
from tandem.llm.common import BLANK_RUN, BLANKS, keep, table

#: Conversations of a family, and the number of borrowed turns less one at most.
FAMILY = 20
BORROWED = 4
#: Turns of a matrix.
STRIP = 8
#: Turns of a shard on average, and conversation ids of one piece of an ends list.
SHARD_TURNS = 400_000
PIECE = 4096

_PARTS = ("shard int, final boolean, name binary, depth int, branch int, shared int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
          "n_leaves bigint, words bigint, saved_tokens bigint, ends_sha256 string, pieces array<binary>")


def rebuilt(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``ids`` (16 bytes a turn) and ``words`` (per turn) of every rebuilt conversation."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    trimmed = F.btrim(part(text_col), F.lit(BLANKS))
    # The role's length keeps role and text apart.
    turn = F.md5(F.concat(F.octet_length(part(role_col)).cast("string"), F.lit(":"), part(role_col), part(text_col)).cast("binary"))
    conv = F.col(id_col).cast("bigint")
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % FAMILY).alias("family"), F.col(turn_col).cast("bigint").alias("turn"), turn.alias("id"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_RUN))).alias("words"))
    order = F.struct(F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "id", "words")
    own = rows.repartition("family").groupBy("family", "conv_id").agg(F.array_sort(F.collect_list(order)).alias("turns"))
    heads = own.filter(F.col("conv_id") == F.col("family")).select("family", F.slice("turns", 1, BORROWED - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    whole = own.join(heads, "family", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", F.array().cast("array<struct<timed:boolean,turn:bigint,id:string,words:int>>")), F.lit(1), h),
        F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    return whole.select("conv_id", joined.alias("ids"), F.transform("turns", lambda t: t["words"]).alias("words"))


class Shard:
    """The trie of one shard's conversations, which lie in order of their turn ids and conversation ids.

    Nodes are gathered strip by strip, column by column: ``first`` and ``last`` (rows of the node, last exclusive), ``depth``, ``ends``
    (rows that end there) and ``words`` of its last turn.
    """

    def __init__(self, conv: np.ndarray, ids: list[bytes], words: list[np.ndarray]):
        sizes = np.fromiter((len(x) // 16 for x in ids), np.int64, len(ids))
        order = self._sorted(conv, ids, sizes)
        self.conv, self.sizes = conv[order], sizes[order]
        self.ids, self.words = [ids[i] for i in order.tolist()], [words[i] for i in order.tolist()]
        nodes = [np.array([[0], [len(conv)], [0]])]
        values = [np.zeros(1, np.int64)]
        for first, last, depth, value in self._strips():
            nodes.append(np.stack([first, last, depth]))
            values.append(value)
        nodes, value = np.concatenate(nodes, axis=1), np.concatenate(values)
        deep = np.lexsort((nodes[2], nodes[0]))  # depth first
        self.first, self.last, self.depth = nodes[:, deep]
        self.value = value[deep]
        self._sum()

    @staticmethod
    def _strip(ids: list[bytes], base: int) -> np.ndarray:
        """Turn ids from ``base`` on as a matrix of two numbers a turn, padded with zeros."""
        raw = b"".join(x[16 * base:16 * (base + STRIP)].ljust(16 * STRIP, b"\0") for x in ids)
        return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(ids), 2 * STRIP)

    def _sorted(self, conv: np.ndarray, ids: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Order of the rows. Rows that are equal in one strip are sorted by the next."""
        order, todo, base = np.arange(len(conv)), [np.arange(len(conv))], 0
        while todo:
            later = []
            for places in todo:
                rows = order[places]
                matrix = self._strip([ids[i] for i in rows.tolist()], base)
                shown = np.clip(sizes[rows] - base, 0, STRIP + 1)  # a sequence that ends comes before one that goes on
                by = np.lexsort((conv[rows], shown, *matrix.T[::-1]))
                order[places] = rows[by]
                matrix, shown = matrix[by], shown[by]
                same = (matrix[1:] == matrix[:-1]).all(axis=1) & (shown[1:] == shown[:-1]) & (shown[1:] > STRIP)
                cuts = np.flatnonzero(~same) + 1
                starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(places)]))
                later.extend(places[a:b] for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 1)
            todo, base = later, base + STRIP
        return order

    def _strips(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        rows, base = np.flatnonzero(self.sizes > 0), 0
        # Groups of rows with the same first ``base`` turns; ``fresh`` marks the first row of each.
        fresh = np.zeros(len(rows), bool)
        fresh[:1] = True
        while len(rows):
            matrix = self._strip([self.ids[i] for i in rows.tolist()], base)
            changed = np.zeros((len(rows), STRIP), bool)
            differs = matrix[1:] != matrix[:-1]
            changed[1:] = differs[:, ::2] | differs[:, 1::2]
            changed[:, 0] |= fresh
            # A node starts where this column or one before it differs from the row above.
            starts = np.logical_or.accumulate(changed, axis=1)
            alone_from = np.full(len(rows), STRIP)
            for column in range(STRIP):
                shown = self.sizes[rows] > base + column
                # A row above that has ended differs by its padding; its place still lies before the node's first row.
                heads = np.flatnonzero(starts[:, column] & shown)
                if not len(heads):
                    break
                counts = np.add.reduceat(shown.astype(np.int64), heads)
                first = rows[heads]
                words = np.fromiter((self.words[r][base + column] for r in first.tolist()), np.int64, len(first))
                yield first, first + counts, np.full(len(first), base + column + 1), words
                lone = heads[counts == 1]
                alone_from[lone] = np.minimum(alone_from[lone], column)
            going = self.sizes[rows] > base + STRIP
            # A row that is alone in its node goes down by itself: a node of one member a turn.
            for row in rows[going & (alone_from < STRIP)].tolist():
                n = int(self.sizes[row]) - base - STRIP
                ones = np.full(n, row)
                yield ones, ones + 1, np.arange(base + STRIP + 1, base + STRIP + 1 + n), self.words[row][base + STRIP:].astype(np.int64)
            together = going & (alone_from == STRIP)
            fresh = starts[together, STRIP - 1] | ~np.concatenate(([False], together[:-1]))[together]
            rows, base = rows[together], base + STRIP

    def _sum(self) -> None:
        """Sums over subtrees. In depth-first order a subtree is a run of nodes, found by the rows it covers."""
        n = len(self.first)
        self.count = self.last - self.first
        # Rows that end in a node come before its children's rows.
        ends = np.zeros(n, np.int64)
        parent = np.full(n, -1)
        path: list[int] = []
        for i, depth in enumerate(self.depth.tolist()):
            del path[depth:]
            if path:
                parent[i] = path[-1]
            path.append(i)
        children = np.bincount(parent[1:], minlength=n)
        inside = np.bincount(parent[1:], weights=self.count[1:], minlength=n).astype(np.int64)
        ends = self.count - inside
        after = np.arange(1, n + 1)  # end of the subtree
        for i in range(n - 1, 0, -1):
            if after[i] > after[parent[i]]:
                after[parent[i]] = after[i]
        self.parent, self.children, self.ends, self.after = parent, children, ends, after

    def subtree(self, own: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(own)))
        return sums[self.after] - sums[:-1]

    def path(self, row: int) -> np.ndarray:
        """Nodes that a row is a member of."""
        return np.flatnonzero((self.first <= row) & (row < self.last))


def _digest(conv: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, conv.tolist())).encode()).hexdigest()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PARTS.split(", ")]
    types = [pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.list_(pa.binary())]
    shard, conv, ids, words = 0, [], [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard")[0].as_py()
        conv.append(np.asarray(batch.column("conv_id")))
        ids.extend(batch.column("ids").to_pylist())
        words.extend(np.asarray(w.values) for w in batch.column("words"))
    if not ids:
        return
    t = Shard(np.concatenate(conv), ids, words)
    n, rows = len(t.first), len(t.conv)
    head, tail = t.path(0), t.path(rows - 1)
    edge = np.zeros(n, bool)
    edge[head] = edge[tail] = True
    # Nodes of the edge count for others only when their parts have met.
    own_saved = np.where(edge, 0, (t.count - 1) * t.value)
    leaves, saved = t.subtree(np.where(edge, 0, t.children == 0)), t.subtree(own_saved)
    inner = np.bincount(t.parent[1:][~edge[1:]], minlength=n)
    least = np.minimum.reduceat(np.append(t.conv, np.iinfo(np.int64).max), np.stack([t.first, t.last], axis=1).ravel())[::2]
    common = int(t.depth[np.intersect1d(head, tail)].max())
    branch = np.where(np.isin(np.arange(n), head), 0, 1)

    def rows_of(places: np.ndarray, final: bool) -> pa.RecordBatch:
        size = len(places)
        first, ends = t.first[places].tolist(), t.ends[places].tolist()
        name = [hashlib.md5(t.ids[r][:16 * d]).digest() for r, d in zip(first, t.depth[places].tolist())] if not final else [None] * size
        pieces = [[",".join(map(str, t.conv[a:min(a + PIECE, r + e)].tolist())).encode() for a in range(r, r + e, PIECE)] for r, e in zip(first, ends)] if not final else [None] * size
        digest = [_digest(t.conv[r:r + e]) for r, e in zip(first, ends)] if final else [None] * size
        above = least[np.maximum(t.parent[places], 0)]
        known = t.parent[places] >= 0
        columns = [np.full(size, shard), np.full(size, final), name, t.depth[places], branch[places], np.full(size, common), least[places],
                   pa.array(above, pa.int64(), mask=~known), t.count[places], (t.children if final else inner)[places], leaves[places], t.value[places], saved[places],
                   digest, pieces]
        return pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, types)], names)

    # The parents of inner nodes may lie on the edge, and then their smallest member may lie in another shard.
    orphan = np.zeros(n, bool)
    orphan[1:] = ~edge[1:] & edge[t.parent[1:]]
    yield rows_of(np.flatnonzero(edge), False)
    for first in range(0, n, 1 << 14):
        places = np.arange(first, min(n, first + (1 << 14)))
        yield rows_of(places[~edge[places] & ~orphan[places]], True)
    places = np.flatnonzero(orphan)
    for first in range(0, len(places), 1 << 14):
        part = places[first:first + (1 << 14)]
        batch = rows_of(part, True)
        above = [hashlib.md5(t.ids[r][:16 * (d - 1)]).digest() for r, d in zip(t.first[part].tolist(), t.depth[part].tolist())]
        yield batch.set_column(names.index("name"), "name", pa.array(above, pa.binary()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running hash over pieces that come in order, node by node."""
    name, depth, running, some = None, None, hashlib.sha256(), False
    row = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([depth], pa.int32()), pa.array([running.hexdigest()])], ["name", "depth", "ends_sha256"])
    for batch in batches:
        for of, d, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "depth", "piece"))):
            if (of, d) != (name, depth):
                if some:
                    yield row()
                name, depth, running, some = of, d, hashlib.sha256(), False
            running.update(b"," + piece if some else piece)
            some = True
    if some:
        yield row()


_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    whole = keep(rebuilt(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "rebuilt")
    turns, convs = whole.agg(F.sum(F.size("words")), F.count(F.lit(1))).first()
    shards = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-((turns or 0) + convs) // shard_turns))
    dealt = whole.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    parts = keep(dealt.select(F.spark_partition_id().alias("shard"), "conv_id", "ids", "words").mapInArrow(_build, _PARTS), "trie-parts")
    inner, edge = parts.filter("final"), parts.filter("not final")
    key = ["name", "depth"]

    # Parts of a node meet. Its parent is a node of the edge too, above it on the same path.
    sums = edge.groupBy(*key).agg(
        F.min("shard").alias("owner"), F.min("conv_id").alias("least"), F.sum("n_convs").alias("total"), F.sum("n_children").alias("inner_children"))
    # One row per node and shard: at most two paths a shard.
    on_path = edge.select("shard", *key, "branch", "shared", "n_leaves", "words", "saved_tokens").join(sums, key)
    down = Window.partitionBy("shard", "branch").orderBy("depth")
    joint = F.max(F.when((F.col("branch") == 0) & (F.col("depth") == F.col("shared")), F.struct("name", "least"))).over(Window.partitionBy("shard"))
    on_path = on_path.withColumn("above", F.coalesce(F.lag(F.struct("name", "least")).over(down), F.when(F.col("depth") > 0, joint)))
    on_path = keep(on_path, "trie-edge")
    owned = on_path.filter(F.col("shard") == F.col("owner"))
    edge_children = owned.filter("depth > 0").groupBy(F.col("above.name").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("edge_children"))
    known = on_path.join(edge_children, key, "left").withColumn("children", F.col("inner_children") + F.coalesce("edge_children", F.lit(0)))
    mine = F.col("shard") == F.col("owner")
    known = known.withColumn("leaves", F.when(mine & (F.col("children") == 0), 1).otherwise(0)).withColumn(
        "saved", F.when(mine, (F.col("total") - 1) * F.col("words")).otherwise(0))

    # What a shard counted itself already holds for all its nodes above; what edge nodes add goes up their path.
    up = Window.partitionBy("shard", "branch").orderBy(F.col("depth").desc())
    other = Window.partitionBy("shard")
    for out, counted in (("leaves", "n_leaves"), ("saved", "saved_tokens")):
        below = F.sum(out).over(up)
        beside = F.sum(F.when(F.col("branch") == 1, F.col(out)).otherwise(0)).over(other)
        known = known.withColumn(f"{out}_all", F.col(counted) + below + F.when((F.col("branch") == 0) & (F.col("depth") <= F.col("shared")), beside).otherwise(0))
    nodes = known.groupBy(*key).agg(
        F.min("least").alias("conv_id"), F.min("above.least").alias("parent_conv_id"), F.min("total").alias("n_convs"), F.min("children").alias("n_children"),
        F.sum("leaves_all").alias("n_leaves"), F.sum("saved_all").alias("saved_tokens"))
    nodes = keep(nodes, "trie-nodes")
    pieces = edge.select(*key, "shard", F.posexplode("pieces").alias("at", "piece"))
    hashes = (pieces.repartition(*key).sortWithinPartitions(*key, "shard", "at").select(*key, "piece")
              .mapInArrow(_hashed, "name binary, depth int, ends_sha256 string"))
    whole = nodes.join(hashes, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    # Inner nodes below an edge node take its smallest member as their parent's.
    parents = nodes.select("name", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    # Most nodes below the root share that one parent, so the join is one to a checked or salted look-up.
    below = lookup_join(inner.filter(F.col("name").isNotNull()), parents, on=["name", "depth"], spread_by=["conv_id"]).withColumn("parent_conv_id", F.col("above"))
    columns = [F.col(c).cast("string" if c == "ends_sha256" else "bigint").alias(c) for c in _NODE]
    return inner.filter(F.col("name").isNull()).select(*columns).unionByName(below.select(*columns)).unionByName(whole.select(*columns))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: DuckDB SQL for ``op12_turn_trie``: every prefix of every rebuilt conversation.
ORACLE = rf"""
WITH t AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(role := role, text := text)
    ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS own FROM t GROUP BY c),
f AS (SELECT c, own, c - c % {FAMILY} AS base, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y // 2, 3988292384::BIGINT * (y % 2)))) AS crc FROM own),
r AS (SELECT f.c, list_concat(coalesce(own2.own, [])[1:h], f.own[h + 1:]) AS ts
    FROM (SELECT *, (xor(crc, 4294967295::BIGINT) % {BORROWED})::BIGINT AS h FROM f) f LEFT JOIN own own2 ON own2.c = f.base),
p AS (SELECT c, d, len(ts) = d AS is_end, md5(ts[1:d]::VARCHAR) AS name, CASE WHEN d > 0 THEN md5(ts[1:d - 1]::VARCHAR) END AS above, ts[d].text AS last
    FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT name, d, min(c) AS conv_id, min(above) AS above, count(*) AS n_convs, min(last) AS last,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM p GROUP BY name, d),
k AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.above = n.name AND m.d = n.d + 1) AS n_children,
    (n_convs - 1) * len(regexp_extract_all(coalesce(last, ''), '[^\x20\x09-\x0D]+')) AS own_saved FROM n),
pairs AS (SELECT DISTINCT a.name AS top, a.d AS top_d, b.name, b.d FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
s AS (SELECT top, top_d, sum((n_children = 0)::INT) AS n_leaves, sum(own_saved) AS saved_tokens FROM pairs JOIN k USING (name, d) GROUP BY top, top_d)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
    k.ends_sha256 FROM k JOIN s ON s.top = k.name AND s.top_d = k.d LEFT JOIN k u ON u.name = k.above AND u.d = k.d - 1"""
