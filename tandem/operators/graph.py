"""Reachability over lineage and group membership, with cycles.

1. Nodes are told apart by weakly connected component (alternating stars: rounds grow with the logarithm of the diameter).
2. A component of at most ``local_nodes`` nodes is worked out within a task, many of them together: strongly connected nodes are
   condensed, and each condensed node gets the bitmap of what it reaches, in one pass over the condensed graph from its ends.
3. In larger components all pairs go one edge further a round; only pairs that are new go on. That costs what there are pairs, and a
   lineage is wide but not deep: most items reach few others. It ends by itself, or is left after ``limit`` rounds or when pairs
   as rows would take more room than as bits; both only say which way the rest is found.
4. What is left then is a matrix of bits, cut into blocks of ``block`` rows and columns; only blocks with a bit exist. It begins with
   the pairs found so far. The matrix (with the diagonal set) is multiplied by itself until no bit is added: each round doubles
   the length of the paths that are covered, so cycles need no care and the rounds are the logarithm of the longest shortest path.
   Blocks meet by a join on the block number between them, and products of one block are OR-ed.

Null ends and edges from a node to itself are left out; repeated edges count once.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.grouping import ordinal, spread
from tandem.session import forget, keep, materialize

# Functions that run in Python tasks travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Nodes of a component that is worked out within a task: its bitmaps take at most 2 MB.
LOCAL_NODES = 4096
#: Rows and columns of a block of bits.
BLOCK = 1024
#: Rounds of one edge each that are always tried, and pairs that are always stored as rows; beyond that a pair may take 64 bits of the matrix.
STEPS = 16
FEW_PAIRS = 10_000_000
SPARSE = 64
#: Edges of small components that go to one task together, on average.
TOGETHER = 50_000


def _least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def weak_components(links: DataFrame, *, max_rounds: int | None = None) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``links`` (``src``, ``dst``, no loops).

    Each round ties every node's larger neighbours to its smallest one, then its smaller ones. ``max_rounds`` is a guard that raises.
    """
    edges = materialize(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before, rounds = mark(edges), 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise ValueError(f"no fixed point after {max_rounds} rounds")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        edges = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                            .filter("u <> v").distinct())
        after, rounds = mark(edges), rounds + 1
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def condensed(n: int, edges: list[tuple[int, int]]) -> tuple[list[int], int]:
    """Number of the strongly connected component of each node; what a component reaches has smaller numbers."""
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        out[a].append(b)
    order, low, of, count, seen = [0] * n, [0] * n, [-1] * n, 0, 0
    stack: list[int] = []
    for root in range(n):
        if order[root]:
            continue
        walk = [(root, iter(out[root]))]
        seen += 1
        order[root] = low[root] = seen
        stack.append(root)
        while walk:
            node, rest = walk[-1]
            step = next(rest, None)
            if step is None:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    while True:
                        member = stack.pop()
                        of[member] = count
                        if member == node:
                            break
                    count += 1
            elif not order[step]:
                seen += 1
                order[step] = low[step] = seen
                stack.append(step)
                walk.append((step, iter(out[step])))
            elif of[step] < 0:
                low[node] = min(low[node], order[step])
    return of, count


def reached(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Per node the bitmap of the nodes it reaches, itself included."""
    of, count = condensed(n, edges)
    maps = [0] * count
    for node, c in enumerate(of):
        maps[c] |= 1 << node
    after: list[set[int]] = [set() for _ in range(count)]
    for a, b in edges:
        if of[a] != of[b]:
            after[of[a]].add(of[b])
    for c in range(count):
        for d in after[c]:
            maps[c] |= maps[d]
    return [maps[c] for c in of]


def _local(pairs: bool, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        groups: dict[object, list[tuple]] = {}
        for component, src, dst in zip(*(table.column(c).to_pylist() for c in ("component", "src", "dst"))):
            groups.setdefault(component, []).append((src, dst))
        left, right = [], []
        for links in groups.values():
            nodes = sorted({x for link in links for x in link})
            number = {x: i for i, x in enumerate(nodes)}
            for i, bits in enumerate(reached(len(nodes), [(number[a], number[b]) for a, b in links])):
                bits &= ~(1 << i)
                if pairs:
                    found = np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(len(nodes) // 8 + 1, "little"), np.uint8), bitorder="little")).tolist()
                    left.extend([nodes[i]] * len(found))
                    right.extend(nodes[j] for j in found)
                else:
                    left.append(nodes[i])
                    right.append(bits.bit_count())
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((left, right), schema)], schema=schema)

    return run


def _bits(data: bytes, block: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=block * block).reshape(block, block)


def _fill(block: int, key: pa.Schema):
    """One block from its bits; a block on the diagonal has all of it set."""
    def run(table: pa.Table) -> pa.Table:
        cells = np.zeros((block, block), bool)
        cells[np.asarray(table.column("r")), np.asarray(table.column("c"))] = True
        names = ("component", "i", "j")
        return pa.Table.from_arrays([*(table.column(c).slice(0, 1).combine_chunks().cast(f.type) for c, f in zip(names, key)), pa.array([np.packbits(cells).tobytes()])], schema=key)

    return run


def _multiply(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                product = _bits(a, block).astype(np.float32) @ _bits(b, block).astype(np.float32)
                out.append(np.packbits(product > 0).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "i", "j")), pa.array(out, pa.binary())], ["component", "i", "j", "bits"])

    return run


def _either(table: pa.Table) -> pa.Table:
    bits = table.column("bits").to_pylist()
    total = np.frombuffer(bits[0], np.uint8).copy()
    for other in bits[1:]:
        total |= np.frombuffer(other, np.uint8)
    return table.slice(0, 1).set_column(table.schema.get_field_index("bits"), "bits", pa.array([total.tobytes()], pa.binary()))


def _set_bits(pairs: bool, block: int):
    """Row by row: how many bits are set, or which."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                component, i, j, bits = (batch.column(c)[at] for c in ("component", "i", "j", "bits"))
                cells = _bits(bits.as_py(), block)
                rows, columns = np.nonzero(cells) if pairs else (np.arange(block), cells.sum(axis=1))
                right = columns + j.as_py() * block if pairs else columns
                yield pa.RecordBatch.from_arrays(
                    [pa.array([component.as_py()] * len(rows), batch.column("component").type), pa.array(rows + i.as_py() * block, pa.int64()), pa.array(right, pa.int64())],
                    ["component", "pos", "value"])

    return run


def _stepwise(links: DataFrame, *, limit: int, most: float) -> tuple[DataFrame, bool]:
    """Pairs ``src``, ``dst`` of different nodes with a path of up to ``limit`` + 1 edges between them, and whether that is all pairs.

    It stops early when more than ``most`` pairs are known.
    """
    spark = links.sparkSession
    known = lambda steps: spark.read.schema(steps[0].schema).parquet(*(s.kept_path for s in steps))
    steps = [keep(links.select("src", "dst"), "steps", tidy=True)]
    ways = steps[0].select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    total = steps[0].count()
    while True:
        if len(steps) > limit or total > most:
            return known(steps), False
        met = steps[-1].join(ways, "dst").filter("src <> next").select("src", F.col("next").alias("dst")).distinct()
        new = keep(met.join(known(steps), ["src", "dst"], "left_anti"), "steps", tidy=True)
        found = new.count()
        if not found:
            forget(new)
            return known(steps), True
        steps, total = [*steps, new], total + found


def _large(links: DataFrame, nodes: DataFrame, kind: str, *, pairs: bool, block: int, steps: int, max_rounds: int | None) -> DataFrame:
    """Large components: edge by edge, and what that leaves by repeated squaring of blocks. ``nodes`` has ``component`` and ``node``."""
    largest, cells = nodes.groupBy("component").count().agg(F.max("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    found, whole = _stepwise(links, limit=max(steps, (largest // block) ** 2) if steps else 0, most=max(FEW_PAIRS, cells / SPARSE))
    if whole and pairs:
        return found
    if whole:
        counted = found.select("src", F.lit(1).alias("n")).unionByName(nodes.select(F.col("node").alias("src"), F.lit(0).alias("n")))
        return counted.groupBy("src").agg(F.sum("n").alias("dst"))
    links = found.join(nodes.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")
    return _squared(links, nodes, kind, pairs=pairs, block=block, max_rounds=max_rounds)


def _squared(links: DataFrame, nodes: DataFrame, kind: str, *, pairs: bool, block: int, max_rounds: int | None) -> DataFrame:
    """Large components by repeated squaring of their blocks. ``nodes`` has ``component`` and ``node``."""
    key = f"component {kind}, i bigint, j bigint"
    schema = pa.schema([("component", pa.string() if kind == "string" else pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("bits", pa.binary())])
    placed = materialize(ordinal(nodes.withColumn("cell", spread("node")), group=["component"], levels=[["cell"]], rest=["node"], out="pos")
                         .select("component", "node", (F.col("pos") - 1).alias("pos")))
    of = lambda name, end: placed.select("component", F.col("node").alias(name), F.col("pos").alias(end))
    ends = links.join(of("src", "p"), ["component", "src"]).join(of("dst", "q"), ["component", "dst"]).select("component", "p", "q")
    ends = ends.unionByName(placed.select("component", F.col("pos").alias("p"), F.col("pos").alias("q")))
    cell = lambda c, out: F.floor(F.col(c) / block).cast("bigint").alias(out)
    cells = ends.select("component", cell("p", "i"), cell("q", "j"), (F.col("p") % block).cast("int").alias("r"), (F.col("q") % block).cast("int").alias("c"))
    blocks = materialize(cells.groupBy("component", "i", "j").applyInArrow(_fill(block, schema), key + ", bits binary"))
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("component", "i", "j", "bits"))).first()
    before, rounds = mark(blocks), 0
    while True:
        if max_rounds is not None and rounds >= max_rounds:
            raise ValueError(f"no fixed point after {max_rounds} rounds")
        left = blocks.select("component", "i", F.col("j").alias("k"), F.col("bits").alias("a"))
        right = blocks.select("component", F.col("i").alias("k"), "j", F.col("bits").alias("b"))
        products = left.join(right, ["component", "k"]).select("component", "i", "j", "a", "b").mapInArrow(_multiply(block), key + ", bits binary")
        blocks = materialize(products.groupBy("component", "i", "j").applyInArrow(_either, key + ", bits binary"))
        after, rounds = mark(blocks), rounds + 1
        if after == before:
            break
        before = after
    found = blocks.mapInArrow(_set_bits(pairs, block), f"component {kind}, pos bigint, value bigint")
    named = placed.select("component", "pos", F.col("node").alias("src"))
    if pairs:
        other = placed.select("component", F.col("pos").alias("value"), F.col("node").alias("dst"))
        return found.filter("pos <> value").join(named, ["component", "pos"]).join(other, ["component", "value"]).select("src", "dst")
    return found.groupBy("component", "pos").agg((F.sum("value") - 1).alias("dst")).join(named, ["component", "pos"]).select("src", "dst")


def _reach(edges: DataFrame, *, pairs: bool, local_nodes: int, block: int, steps: int, max_rounds: int | None) -> DataFrame:
    """``src`` and ``dst``: nodes and how many others they reach (0 included), or which."""
    spark = edges.sparkSession
    text = isinstance(edges.schema["src"].dataType, T.StringType)
    kind = "string" if text else "bigint"
    links = materialize(edges.select(F.col("src").cast(kind), F.col("dst").cast(kind)).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())
    roots = materialize(weak_components(links, max_rounds=max_rounds))
    sizes = roots.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    whole = materialize(links.join(roots.withColumnRenamed("node", "src"), "src").join(sizes, "component").select("component", "src", "dst", (F.col("n") > local_nodes).alias("large")))
    n_edges, n_large = whole.agg(F.count(F.lit(1)), F.sum(F.col("large").cast("bigint"))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_edges // TOGETHER))
    found = pa.schema([("src", pa.string() if text else pa.int64()), ("dst", pa.string() if pairs and text else pa.int64())])
    out = f"src {kind}, dst {kind if pairs else 'bigint'}"
    small = (whole.filter("not large").select(F.pmod(F.xxhash64("component"), F.lit(tasks)).alias("task"), "component", "src", "dst")
             .groupBy("task").applyInArrow(_local(pairs, found), out))
    if not n_large:
        return small
    nodes = roots.join(sizes.filter(F.col("n") > local_nodes), "component").select("component", "node")
    return small.unionByName(_large(whole.filter("large").drop("large"), nodes, kind, pairs=pairs, block=block, steps=steps, max_rounds=max_rounds))


def blast_radius(edges: DataFrame, *, local_nodes: int = LOCAL_NODES, block: int = BLOCK, steps: int = STEPS, max_rounds: int | None = None) -> DataFrame:
    """How many items depend on each item, directly or not. ``edges`` has ``upstream`` and ``downstream``."""
    counts = _reach(edges.select(F.col("upstream").alias("src"), F.col("downstream").alias("dst")), pairs=False, local_nodes=local_nodes, block=block,
                    steps=steps, max_rounds=max_rounds).select(F.col("src").alias("node"), F.col("dst").alias("downstream"))
    nodes = edges.select(F.col("upstream").alias("node")).union(edges.select("downstream")).distinct()
    return nodes.join(counts, "node", "left").select("node", F.coalesce("downstream", F.lit(0)).alias("downstream"))


def transitive_members(members: DataFrame, *, local_nodes: int = LOCAL_NODES, block: int = BLOCK, steps: int = STEPS, max_rounds: int | None = None) -> DataFrame:
    """Members of each group including those of nested groups (``group_id``, ``member_id``)."""
    pairs = _reach(members.select(F.col("group_id").alias("src"), F.col("member_id").alias("dst")), pairs=True, local_nodes=local_nodes, block=block, steps=steps,
                   max_rounds=max_rounds)
    return pairs.select(F.col("src").alias("group_id"), F.col("dst").alias("member_id"))
