"""Alignment of two tokenizers over the same bytes, and how firmly their ids belong together in the corpus.

1. A text is encoded by both tokenizers, in units that a task remembers, and the bytes of the tokens are spelled out. Only where both spell a space and the text
   do its tokens count. Their ends are two rising sequences of byte offsets.
2. Both sequences are merged by the merge path: a binary search on each of the evenly spaced diagonals tells how many ends of either
   side lie before it, so a text (or many texts, one after the other) falls into pieces of equal work that know nothing of each
   other. A piece reports the offsets where both sides end; an end that a diagonal parts from its equal is found by the later piece.
   The pieces' reports, put together, are the groups; a group that began in an earlier piece is closed by the one that finds its end.
3. The links of a group are all pairs of its A and B tokens. They are expanded a bounded number at a time, large groups by their
   distinct ids, and kept as a sparse matrix (document, id pair, links) for each block of documents.
4. Per block the number of documents that hold a pair is summed before it is shuffled, so a pair that is in every document is one row a
   block. The highest count per A id has at most as many rows as the vocabulary and is broadcast.
5. The counts of a block's pairs come back to the block, and its matrix gives the sums of each document.

Defined cases: a null or empty text, and one that a tokenizer does not spell (a text with U+2581, for one), has no tokens: zeros and
an empty digest; repeated rows are documents of their own; a null id is kept; an empty table gives an empty result. Strings of special
tokens are plain text. Whole texts are used. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import keep, table
from tandem.llm.words import Memo, give_back, of_process

SPACE = "▁"
#: Bytes of text that are encoded together, ends of a merge piece, tokens and links that are worked on at a time, and links of a block.
ENCODED = 1 << 19
PIECE = 1 << 16
AT_ONCE = 1 << 18
BLOCK_LINKS = 3_000_000
#: Groups of more links than this are counted by distinct ids.
LARGE = 1 << 12
#: Bytes of units whose ids a task remembers, for each side.
REMEMBERED = 40 << 20
#: Units that are encoded as one text, and what stands before them.
CHUNK = 256
FRONT = " a"
#: A unit starts at a space or line end that follows another sign than white space. Neither tokenizer has a token across that place:
#: A's words take no white space but one space in front, and B's pieces have no space behind another sign.
_UNIT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")

_BLOCKS = ("block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, "
           "pairs binary, holders binary, entries array<bigint>, places binary, links binary")
_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_signs() -> dict[str, int]:
    """The byte behind each sign of a byte-level vocabulary: printable bytes stand for themselves, the others are numbered from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Spelling:
    """Bytes of every id of a vocabulary, in one flat array."""

    def __init__(self, words: dict[int, bytes]):
        size = max(words) + 1
        self.lengths = np.array([len(words.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(words.get(i, b"") for i in range(size)), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def spells(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        """Do the ids spell these bytes?"""
        at = 0
        for first in range(0, len(ids), AT_ONCE):
            part = ids[first:first + AT_ONCE]
            n = self.lengths[part]
            ends = np.cumsum(n)
            total = int(ends[-1])
            where = np.repeat(self.starts[part] - (ends - n), n) + np.arange(total)
            if at + total > len(raw) or not np.array_equal(self.flat[where], raw[at:at + total]):
                return False
            at += total
        return at == len(raw)


class Pair:
    """Both tokenizers with the spelling of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        signs = byte_signs()
        self.a_words = Spelling({i: bytes(signs[c] for c in word) for word, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in signs for c in word)})
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
        self.b_words = Spelling({i: piece(i) for i in range(self.b.vocab_size()) if not self.b.is_control(i) and not self.b.is_unknown(i)})
        self.lone = [self.b.piece_to_id(SPACE)]
        self.front = tuple(len(x[0]) for x in self._ids([FRONT]))
        size = max(len(self.a_words.lengths), len(self.b_words.lengths))
        decimal = [str(i).encode() for i in range(size)]
        self.n_digits = np.array([len(d) for d in decimal], np.int64)
        self.digits = np.frombuffer(b"".join(d.ljust(8) for d in decimal), np.uint8).reshape(size, 8)

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides of texts that start with a space. B puts one in front by itself, but not before nothing."""
        a = [np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = [np.array(ids or self.lone, np.int32) for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]
        return a, b

    def _whole(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both sides of texts that start with a space; none where they do not spell the bytes."""
        raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        return [(a.tobytes(), b.tobytes()) if self.a_words.spells(a, r) and self.b_words.spells(b, r) else None for a, b, r in zip(*self._ids(texts), raw)]

    def _alone(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of units, each by itself. A unit that starts with a line end gets a front that is cut off again."""
        skip = [(0, 0) if u[0] == " " else self.front for u in units]
        whole = self._whole([u if u[0] == " " else FRONT + u for u in units])
        return [(found[0][4 * i:], found[1][4 * j:]) if found else None for found, (i, j) in zip(whole, skip)]

    def _units(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of units. A few hundred are encoded as one text and cut at their ends, as no token crosses these."""
        out: list[tuple[bytes, bytes] | None] = []
        chunks = [units[i:i + CHUNK] for i in range(0, len(units), CHUNK)]
        for chunk, a, b in zip(chunks, *self._ids([FRONT + "".join(c) for c in chunks])):
            raw = [u.encode() for u in chunk]
            cuts = np.cumsum([len(FRONT), *map(len, raw)])
            whole = np.frombuffer(b"".join([FRONT.encode(), *raw]), np.uint8)
            a_ends, b_ends = self.a_words.ends(a), self.b_words.ends(b)
            i, j = np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)
            if not (self.a_words.spells(a, whole) and self.b_words.spells(b, whole)):
                out.extend(self._alone(chunk))  # some unit is not spelled
                continue
            a, b, i, j = a.tobytes(), b.tobytes(), (4 * i + 4).tolist(), (4 * j + 4).tolist()
            out.extend(zip([a[x:y] for x, y in zip(i, i[1:])], [b[x:y] for x, y in zip(j, j[1:])]))
        return out

    def encode(self, texts: list[str], known: tuple[Memo, Memo] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none for a text that is not spelled by both. With ``known``, unit by unit."""
        none, spaced = np.zeros(0, np.int32), [" " + t for t in texts]
        if known is None:
            pairs = [p if t else None for t, p in zip(texts, self._whole(spaced))]
        else:
            of_a, of_b = known
            units = [_UNIT.findall(t) if t != " " else None for t in spaced]
            if of_a.full() or of_b.full():
                of_a.clear()
                of_b.clear()
            new = list(set().union(*(u for u in units if u)).difference(of_a))
            # What ends with white space would grow together with the next one, and is the end of its text.
            ends = [u for u in new if u[-1].isspace()]
            for part, encode in ((ends, self._alone), ([u for u in new if not u[-1].isspace()], self._units)):
                for first, last in _slices(np.fromiter(map(len, part), np.int64, len(part)), ENCODED):
                    found = encode(part[first:last])
                    of_a.learn(part[first:last], [p[0] if p else b"" for p in found])
                    of_b.learn(part[first:last], [p[1] if p else b"" for p in found])
            pairs = []
            for own in units:
                a, b = ([m[u] for u in own] for m in (of_a, of_b)) if own else ([b""], [b""])
                pairs.append((b"".join(a), b"".join(b)) if all(a) else None)  # a unit has a token, if it is spelled
        return [(np.frombuffer(p[0], np.int32), np.frombuffer(p[1], np.int32)) if p else (none, none) for p in pairs]


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """How many elements of either rising sequence lie before each diagonal; equal ones of ``a`` come first. With both ends."""
    diagonals = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        # Does the next element of ``a`` come before the diagonal?
        before = np.zeros(len(middle), bool)
        before[open_] = a[middle[open_]] <= b[diagonals[open_] - middle[open_] - 1]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return np.append(low, len(a)), np.append(diagonals - low, len(b))


def common_ends(a: np.ndarray, b: np.ndarray, a_from: int, a_to: int, b_from: int, b_to: int) -> tuple[np.ndarray, np.ndarray]:
    """One piece: for each of its ends of ``b`` that is an end of ``a`` too, how many tokens of either side end there or before."""
    first = max(0, a_from - 1)  # its equal may be the last of the piece before
    window, mine = a[first:a_to], b[b_from:b_to]
    rank = np.searchsorted(window, mine, "right")
    equal = np.flatnonzero((rank > 0) & (window[np.maximum(rank - 1, 0)] == mine)) if len(window) else np.zeros(0, np.int64)
    return first + rank[equal], b_from + equal + 1


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of both sides into groups, with a zero in front: group g has the tokens from cut g to cut g + 1."""
    i, j = merge_path(a, b, piece)
    found = [common_ends(a, b, *cell) for cell in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
    zero = np.zeros(1, np.int64)
    return np.concatenate([zero, *(f[0] for f in found)]), np.concatenate([zero, *(f[1] for f in found)])


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items of at most ``most`` in all, one item at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield first, last
        first = last


def _inside(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def group_texts(pair: Pair, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of groups as text ``a1,a2|b1;...;`` with the end of each group in it."""
    sizes = np.diff(a_cuts) + np.diff(b_cuts)
    for first, last in _slices(sizes, AT_ONCE):
        a0, b0 = int(a_cuts[first]), int(b_cuts[first])
        n_a, n_b = np.diff(a_cuts[first:last + 1]), np.diff(b_cuts[first:last + 1])
        a_ends, b_ends = a_cuts[first + 1:last + 1] - a0, b_cuts[first + 1:last + 1] - b0
        ids = np.empty(int(a_ends[-1] + b_ends[-1]), np.int64)
        sep = np.full(len(ids), ord(","), np.uint8)
        ids[np.arange(int(a_ends[-1])) + np.repeat(b_ends - n_b, n_a)] = a[a0:a0 + int(a_ends[-1])]
        ids[np.arange(int(b_ends[-1])) + np.repeat(a_ends, n_b)] = b[b0:b0 + int(b_ends[-1])]
        sep[a_ends + b_ends - n_b - 1], sep[a_ends + b_ends - 1] = ord("|"), ord(";")
        n = pair.n_digits[ids]
        ends = np.cumsum(n + 1)
        out = np.empty(int(ends[-1]), np.uint8)
        out[ends - 1] = sep
        starts = ends - n - 1
        for k in range(int(n.max())):
            has = np.flatnonzero(n > k)
            out[starts[has] + k] = pair.digits[ids[has], k]
        yield first, last, out.tobytes(), ends[a_ends + b_ends - 1]


def group_links(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group, id pair and number of links, a bounded number of rows at a time; a pair may come more than once."""
    n_a, n_b = np.diff(a_cuts), np.diff(b_cuts)
    size = n_a * n_b
    small = np.where(size <= LARGE, size, 0)
    for first, last in _slices(small, AT_ONCE):
        of = np.flatnonzero(small[first:last]) + first
        if len(of):
            at_a = np.repeat(a_cuts[of], n_a[of]) + _inside(n_a[of])
            group = np.repeat(of, n_a[of])
            wide = n_b[group]
            pair = np.repeat(a[at_a].astype(np.int64) << 32, wide) | b[np.repeat(b_cuts[group], wide) + _inside(wide)]
            yield np.repeat(group, wide), pair, np.ones(len(pair), np.int64)
    for g in np.flatnonzero(size > LARGE).tolist():
        own_a, times_a = np.unique(a[a_cuts[g]:a_cuts[g + 1]], return_counts=True)
        own_b, times_b = np.unique(b[b_cuts[g]:b_cuts[g + 1]], return_counts=True)
        step = max(1, AT_ONCE // len(own_b))
        for i in range(0, len(own_a), step):
            pair = ((own_a[i:i + step].astype(np.int64) << 32)[:, None] | own_b[None, :]).ravel()
            yield np.full(len(pair), g), pair, (times_a[i:i + step, None] * times_b[None, :]).ravel()


def _squeeze(values: np.ndarray) -> bytes:
    """Compressed 64-bit numbers, byte plane by byte plane."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


class _Block:
    """Documents of one block and their links."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.docs, self.pairs, self.links, self.size = [], [], [], 0

    def add(self, pair: Pair, known: tuple[Memo, Memo] | None, ids: list, texts: list[str], piece: int) -> None:
        both = pair.encode(texts, known)
        a, b = (np.concatenate([x[side] for x in both]) for side in (0, 1))
        # One text after the other: as all of a text is spelled by both sides, its end is the end of a group.
        a_cuts, b_cuts = groups(pair.a_words.ends(a), pair.b_words.ends(b), piece)
        last_token = np.cumsum([len(x[0]) for x in both])
        doc_cuts = np.searchsorted(a_cuts, np.concatenate(([0], last_token)))
        base, n_groups = len(self.rows), np.diff(doc_cuts)
        size = np.concatenate(([0], np.cumsum(np.diff(a_cuts) * np.diff(b_cuts))))
        n_links = np.diff(size[doc_cuts])
        digests = [hashlib.sha256() for _ in texts]
        of_group = np.repeat(np.arange(len(texts)), n_groups)
        for first, last, text, ends in group_texts(pair, a, b, a_cuts, b_cuts):
            docs = of_group[first:last]
            for doc in np.unique(docs).tolist():
                g0, g1 = max(first, int(doc_cuts[doc])), min(last, int(doc_cuts[doc + 1]))
                begin, end = int(ends[g0 - first - 1]) if g0 > first else 0, int(ends[g1 - first - 1])
                digests[doc].update(text[begin:end - (g1 == doc_cuts[doc + 1])])  # nothing after the last group
        for doc, (own, digest) in enumerate(zip(both, digests)):
            self.rows.append((ids[doc], len(own[0]), len(own[1]), int(n_groups[doc]), int(n_links[doc]), digest.hexdigest() if len(own[0]) else ""))
        for group, found, links in group_links(a, b, a_cuts, b_cuts):
            self.docs.append((base + of_group[group]).astype(np.int64))
            self.pairs.append(found)
            self.links.append(links)
            self.size += len(found)

    def row(self, name: int) -> pa.RecordBatch:
        nothing = np.zeros(0, np.int64)
        docs, pairs, links = (np.concatenate([nothing, *x]) for x in (self.docs, self.pairs, self.links))
        known, place = np.unique(pairs, return_inverse=True)
        cell = docs * max(1, len(known)) + place
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        heads = np.flatnonzero(np.diff(cell, prepend=-1))
        total = np.add.reduceat(links[order], heads) if len(heads) else nothing
        cell = cell[heads]
        doc, place = np.divmod(cell, max(1, len(known)))
        holders = np.bincount(place, minlength=len(known))
        entries = np.bincount(doc, minlength=len(self.rows))
        columns = list(zip(*self.rows))
        longs = pa.list_(pa.int64())
        row = [(name, pa.int64()), (list(columns[0]), longs), *((list(c), longs) for c in columns[1:5]), (list(columns[5]), pa.list_(pa.string())),
               (_squeeze(np.diff(known, prepend=0)), pa.binary()), (_squeeze(holders), pa.binary()), (entries.tolist(), longs),
               (_squeeze(np.diff(place, prepend=0)), pa.binary()), (_squeeze(total), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], [c.split()[0] for c in _BLOCKS.split(", ")])


def _aligner(a_path: str, b_path: str, piece: int, block_links: int, by_unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = of_process(f"pair {a_path} {b_path}", lambda: Pair(a_path, b_path))
        known = (Memo(REMEMBERED), Memo(REMEMBERED)) if by_unit else None
        block, number, ids, texts, held, part = _Block(), 0, [], [], 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append(text.as_py())
                held += len(texts[-1]) + 16
                if held >= ENCODED:
                    block.add(pair, known, ids, texts, piece)
                    ids, texts, held = [], [], 0
                    if block.size >= block_links:
                        yield block.row((part << 32) + number)
                        block, number = _Block(), number + 1
        if ids:
            block.add(pair, known, ids, texts, piece)
        if block.rows:
            yield block.row((part << 32) + number)
        del block, known
        give_back()

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, holders in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "holders"))):
            pairs, holders = np.cumsum(_expand(pairs)), _expand(holders)
            for first in range(0, len(pairs), 1 << 16):
                own = pairs[first:first + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(own), pa.array(holders[first:first + (1 << 16)])], ["block", "pair", "holders"])


def _sums(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    names, out = [c.split()[0] for c in _RESULT.split(", ")], []
    types = [pa.int64()] * 7 + [pa.string()]
    for row in blocks.to_pylist():
        known = np.cumsum(_expand(row["pairs"]))
        count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        at = np.searchsorted(known, np.asarray(counts.column("pair")))
        count[at] = np.asarray(counts.column("count"))
        best[at] = np.asarray(counts.column("best"))
        place, links = np.cumsum(_expand(row["places"])), _expand(row["links"])
        ends = np.cumsum(row["entries"])
        total = lambda values: np.diff(np.concatenate(([0], np.cumsum(values * links)))[np.concatenate(([0], ends))])
        columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], total(best[place]), total(count[place]), row["groups_sha256"]]
        out.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names))
    return pa.Table.from_batches(out, pa.schema(list(zip(names, types))))


def align_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None,
                 by_unit: bool = True, piece: int = PIECE, block_links: int = BLOCK_LINKS) -> DataFrame:
    """``by_unit`` must be off for tokenizers of another kind; whole texts are encoded at once then. Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    a_path, b_path = tokenizers or default_tokenizers()
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = keep(rows.mapInArrow(_aligner(a_path, b_path, piece, block_links, by_unit), _BLOCKS), "aligned-blocks")
    held = blocks.select("block", "pairs", "holders").mapInArrow(_pairs, "block bigint, pair bigint, holders bigint")
    counts = keep(held.groupBy("pair").agg(F.sum("holders").alias("count")), "pair-counts")
    # One row per id of A's vocabulary at most.
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("top"))
    judged = (counts.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(top), "a")
              .select("pair", "count", (F.col("count") == F.col("top")).cast("bigint").alias("best")))
    back = held.select("block", "pair").join(judged, "pair")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_sums, _RESULT)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
