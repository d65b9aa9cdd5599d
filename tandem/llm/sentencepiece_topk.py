"""SentencePiece segmentations sampled without replacement.

A text's lattice has an arc for every vocabulary piece that matches at a place; a character without a piece is one arc of its
bytes. Pieces never cross the start of a word, a line end, or the place between a word and certain signs, so the lattice is a
row of small lattices, one per unit. A unit is worked out once and remembered: backward sums over its arcs give each arc's chance
given the place it starts from.

Sampling is a perturbed best-first search over the tree of arc sequences. The root's Gumbel value is drawn and handed down the
path of the first sample. Every set of sequences that leaves a known path at one place is a tree node; its best perturbed value
is a Gumbel of the set's log chance, truncated at the path's own value. The node with the largest value is opened next: that value
is exact, so it is also the search's bound, and the opened sequence is the next sample. After ``samples`` of them the largest value
left is the threshold; a sequence's inclusion score is the chance that its value exceeds it.

Piece weights follow from the ranks of the model's scores (Zipf): a model of merges has ranks and no chances. All random
numbers are hashes of the row key and the place, so a row gets the same samples wherever and however often it is computed.

Defined cases: a null or empty text has one segmentation, the empty one; texts with fewer segmentations than ``samples`` give
all of them, with inclusion one; repeated rows get the same samples; a null id is a key like any other; an empty table gives an
empty result. Whole texts are segmented. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import table
from tandem.llm.words import give_back, of_process

SAMPLES = 2
SEED = 17
#: Bytes of units and their lattices that a task remembers; forgetting changes no result. All are forgotten at its end.
REMEMBERED = 96 << 20
#: Units that are walked at a time.
CHUNK = 40_000
SPACE = "▁"
#: Signs that part a unit when a word stands before them.
_SIGNS = ",;|%$*#&!?."
#: What an id that spells nothing of a text decodes to.
UNKNOWN = " \u2047 ".encode()
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1B54A32D192ED03)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of a flat array, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    room = np.empty_like(x)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=room)
    x ^= room
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=room)
    x ^= room
    return x


def uniform(key: np.ndarray, place: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that depend on nothing but the three values."""
    bits = _mix(_mix(key + place.astype(np.uint64) * _GOLD) + draw.astype(np.uint64) * _STEP)
    bits >>= np.uint64(11)
    numbers = bits.astype(np.float64)
    numbers += 0.5
    numbers *= 2.0 ** -53
    return numbers


#: No Gumbel number made from 53 random bits is larger; a node farther below another one cannot be the best.
REACH = 37.0


class _Grown:
    """An array that grows by half when it is full."""

    def __init__(self, kind):
        self.room, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros(len(self.room) // 2, self.room.dtype)])
        self.room[self.size:self.size + len(values)] = values
        self.size += len(values)


class Pieces:
    """The vocabulary: weights, ids and bytes of symbols. A symbol is a piece, or a character that falls back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        usable = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = [sp.id_to_piece(i) for i in usable]
        rank = np.empty(len(usable))
        rank[np.lexsort((usable, [-sp.get_score(i) for i in usable]))] = np.arange(len(usable))
        total = np.log(len(usable)) + 0.5772
        self.weights = [float(-np.log(r + 1) - np.log(total)) for r in rank]
        self.byte_weight = float(-np.log(len(usable)) - np.log(total))
        self.byte_ids = {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.ids: list[tuple[int, ...]] = [(i,) for i in usable]
        byte = lambda i: bytes([int(sp.id_to_piece(i)[3:-1], 16)])
        of_id = {i: t.replace(SPACE, " ").encode() for i, t in zip(usable, texts)} | {i: byte(i) for i in self.byte_ids.values()}
        raw = [of_id.get(i, UNKNOWN) for i in range(sp.vocab_size())]
        self.id_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.id_starts, self.id_bytes = np.cumsum(self.id_sizes) - self.id_sizes, np.frombuffer(b"".join(raw), np.uint8)
        # What may begin a text that is put together from the bytes of its ids, and what may go on.
        self.begins = np.array([i in of_id and i not in self.byte_ids.values() and of_id[i][:1] == b" " for i in range(sp.vocab_size())])
        self.goes_on = np.array([i in of_id for i in range(sp.vocab_size())])
        self.longest = max(map(len, texts))
        # Letters that a piece joins to such a sign are no letters here, so that no piece crosses the cut.
        joined = {t[i - 1] for t in texts for i in range(1, len(t)) if t[i] in _SIGNS and re.match(r"[^\W\d_]", t[i - 1])}
        word = f"{SPACE}*[^\\W\\d_{re.escape(''.join(sorted(joined)))}]+(?=[{re.escape(_SIGNS)}])|"
        # A word before a sign; else up to the next word; else the rest of a line; else a line end.
        self.unit = re.compile(f"{word}{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.single = {t: s for s, t in enumerate(texts) if len(t) == 1}
        hashes = np.array([self.hash(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in texts], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.symbols = hashes[order], order
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.hashes >> np.uint64(44)] = True
        self.fallback: dict[int, int] = {}
        self._tables = None

    @staticmethod
    def hash(points: np.ndarray) -> int:
        value = np.zeros(1, np.uint64)
        for p in points:
            value = value * _GOLD + np.uint64(p) + np.uint64(1)
        return int(_mix(value)[0])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` that are pieces, and their symbols."""
        at = np.flatnonzero(self.sieve[keys >> np.uint64(44)])
        where = np.minimum(np.searchsorted(self.hashes, keys[at]), len(self.hashes) - 1)
        hit = self.hashes[where] == keys[at]
        return at[hit], self.symbols[where[hit]]

    def byte_symbol(self, point: int) -> int:
        if point not in self.fallback:
            raw = chr(point).encode("utf-8", "surrogatepass")
            self.fallback[point] = len(self.ids)
            names = [f"<0x{b:02X}>" for b in raw]
            self.ids.append(tuple(self.byte_ids[n] for n in names) if all(n in self.byte_ids for n in names) else (self.unknown,))
            self.weights.append(self.byte_weight * len(raw))
            self._tables = None
        return self.fallback[point]

    def spell(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a sequence of symbols."""
        if self._tables is None:
            sizes = np.array([len(r) for r in self.ids])
            self._tables = (sizes, np.cumsum(sizes) - sizes, np.fromiter((i for r in self.ids for i in r), np.int32))
        counts, starts, flat = self._tables
        n = counts[symbols]
        if (n == 1).all():
            return flat[starts[symbols]]
        return flat[_places(starts[symbols], n)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids spell, without the space in front. An unknown or control id spells the sign of the unknown id."""
        starts, n = self.id_starts[ids], self.id_sizes[ids]
        return self.id_bytes[_places(starts, n)].tobytes()[1:]

    def texts(self, lists: pa.ListArray) -> pa.StringArray:
        """What each list of ids spells, the bytes of all ids gathered together. The model's own decoder reads the lists that this may not
        fit: those with other ids than pieces and bytes, without a single space in front, or whose bytes are no characters."""
        ids, slow = lists.flatten(), np.ones(len(lists), bool)
        if len(ids) and not ids.null_count and not lists.null_count:
            ids, cuts = ids.to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            sizes, heads = np.diff(cuts), np.minimum(cuts[:-1], len(ids) - 1)
            known = (ids >= 0) & (ids < len(self.goes_on))
            ids = np.where(known, ids, 0)
            odd = np.concatenate(([0], np.cumsum(~(known & self.goes_on[ids]))))
            starts, n = self.id_starts[ids], self.id_sizes[ids]
            ends = np.concatenate(([0], np.cumsum(n)))
            raw = self.id_bytes[_places(starts, n)]
            begins = self.begins[ids[heads]] & (sizes > 0)
            second = raw[np.minimum(ends[heads] + 1, len(raw) - 1)]
            slow = ~(begins & (odd[cuts[1:]] == odd[cuts[:-1]]) & (ends[cuts[1:]] - ends[cuts[:-1]] > 1) & (second != 32))
            if not slow.any():
                try:
                    raw.tobytes().decode()  # a space stands before every text, so that none runs into the next one
                except UnicodeDecodeError:
                    slow[:] = True
                else:
                    left = np.delete(raw, ends[cuts[:-1]])
                    offsets = (ends[cuts] - np.arange(len(cuts))).astype(np.int32)
                    return pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(left))
            if not slow.all():
                some = np.flatnonzero(~slow)
                out = np.full(len(lists), None, object)
                out[some] = self.texts(lists.take(pa.array(some))).to_pylist()
                rest = np.flatnonzero(slow)
                out[rest] = self.texts(lists.take(pa.array(rest))).to_pylist()
                return pa.array(out.tolist(), pa.string())
        return pa.array([self.sp.decode(x) if x else "" for x in lists.to_pylist()], pa.string())


class Lattices:
    """Arcs of all remembered units. A state is a place in a unit; its arcs lie together, longest first.

    ``chance`` sums the chances of a state's arcs up to each, with 2 at the last; ``rest`` is the log chance of its other arcs."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.base, self.names = {}, 0
        self.first, self.chance, self.log, self.rest, self.target, self.symbol = (
            _Grown(k) for k in (np.int32, np.float32, np.float32, np.float32, np.int32, np.int32))
        self.first.add(np.zeros(1, np.int64))

    def add(self, units: list[str]) -> None:
        """Work out the lattices of new units together."""
        pieces = self.pieces
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.repeat(np.cumsum(sizes), sizes)
        starts, room, froms, lengths, symbols = np.arange(len(points)), ends - np.arange(len(points)), [], [], []
        value = np.zeros(len(points), np.uint64)
        for length in range(1, pieces.longest + 1):
            if length > 1:
                fits = np.flatnonzero(room >= length)
                starts, room, value = starts[fits], room[fits], value[fits]
            if not len(starts):
                break
            value = value * _GOLD + points[starts + (length - 1)] + np.uint64(1)
            at, found = pieces.look_up(_mix(value))
            froms.append(starts[at])
            lengths.append(np.full(len(at), length))
            symbols.append(found)
            if length == 1:
                bare = np.ones(len(points), bool)
                bare[at] = False
                bare = np.flatnonzero(bare)
                known = {int(p): pieces.byte_symbol(int(p)) for p in np.unique(points[bare])}
                froms.append(bare)
                lengths.append(np.ones(len(bare), np.int64))
                symbols.append(np.fromiter((known[int(p)] for p in points[bare]), np.int64, len(bare)))
        start, length, symbol = (np.concatenate(x[::-1]) for x in (froms, lengths, symbols))
        order = np.argsort(start, kind="stable")  # longest first within a place
        start, length, symbol = start[order], length[order], symbol[order]
        weight = np.array(pieces.weights)[symbol]
        # Sums over all ways to the unit's end, from the last place backwards; places as far from the end go together.
        left = ends[start] - start
        stop = left == length
        order = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")
        by_left, reach, ways = left[order], np.where(stop, len(points), start + length)[order], weight[order]
        heads = np.flatnonzero((np.diff(start[order], prepend=-1) != 0) | (np.diff(by_left, prepend=-1) != 0))
        places, counts = start[order][heads], np.diff(np.append(heads, len(order)))
        total = np.zeros(len(points) + 1)
        cuts = np.flatnonzero(np.diff(by_left[heads], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(heads)]):
            first, last = heads[a], heads[b] if b < len(heads) else len(order)
            way = ways[first:last] + total[reach[first:last]]
            at = heads[a:b] - first
            most = np.maximum.reduceat(way, at)
            total[places[a:b]] = most + np.log(np.add.reduceat(np.exp(way - np.repeat(most, counts[a:b])), at))
        log = np.minimum(weight + total[np.where(stop, len(points), start + length)] - total[start], 0.0)
        counts = np.bincount(start, minlength=len(points))
        last = np.cumsum(counts)
        odds = np.exp(log)
        sums = np.cumsum(odds)
        chance = sums - np.repeat(np.concatenate(([0.0], sums[last[:-1] - 1])), counts)
        chance[last - 1] = 2.0
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(-np.expm1(log), 1e-16))
        rest[np.repeat(counts == 1, counts)] = -np.inf  # a place with one arc cannot be left
        states, arcs = self.first.size - 1, self.log.size
        self.first.add(arcs + last)
        self.chance.add(np.minimum(chance, 2.0))
        self.log.add(log)
        self.rest.add(rest)
        self.target.add(np.where(stop, -1, states + start + length))
        self.symbol.add(symbol)
        self.base.update(zip(units, (states + np.cumsum(sizes) - sizes).tolist()))
        self.names += len(points) + 200 * len(units)  # what the texts of units and their entries take

    def held(self) -> int:
        """About as many bytes are in use."""
        return 20 * self.log.size + 4 * self.first.size + self.names

    def pick(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        arc, chance, u = self.first.room[state].astype(np.int64), self.chance.room, u.astype(np.float32)
        todo = np.flatnonzero(chance[arc] < u)
        while len(todo):
            arc[todo] += 1
            todo = todo[chance[arc[todo]] < u[todo]]
        return arc

    def walk(self, state: np.ndarray, key: np.ndarray, place: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray]:
        """From each start to the end of its unit: number of the start and arc, in order."""
        left, starts, arcs, step = np.arange(len(state)), [], [], 0
        while len(left):
            arc = self.pick(state, uniform(key[left], place[left], np.array([draw * 1_000_003 + step])))
            starts.append(left)
            arcs.append(arc)
            state = self.target.room[arc]
            on = state >= 0
            left, state, step = left[on], state[on], step + 1
        starts, arcs = np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*arcs, np.zeros(0, np.int64)])
        order = np.argsort(starts, kind="stable")
        return starts[order], arcs[order]


class _Path:
    """One sampled sequence with the nodes that leave it. ``arcs`` and ``units`` run along the text."""

    def __init__(self, lattices: Lattices, key: np.ndarray, number: int, arcs: np.ndarray, units: np.ndarray, value: float, kept: int, barred: tuple[int, ...],
                 need: int):
        self.arcs, self.units, self.value, self.kept, self.barred = arcs, units, value, kept, barred
        log = lattices.log.room[arcs].astype(np.float64)
        ends = np.cumsum(log)
        self.log_chance = float(ends[-1]) if len(ends) else 0.0
        self.leave = np.zeros(0)
        done, size = kept, min(len(arcs), kept + 256)
        while done < size:  # those before ``kept`` belong to the path this one left
            part = slice(done, size)
            rest = lattices.rest.room[arcs[part]].astype(np.float64)
            if barred and done == kept:
                gone = np.exp(lattices.log.room[np.array((*barred, arcs[kept]))].astype(np.float64)).sum()
                more = self._siblings(lattices, int(arcs[kept])) - len(barred) - 1
                rest[0] = np.log(max(1.0 - gone, 1e-16)) if more > 0 else -np.inf
            location = ends[part] - log[part] + rest
            noise = -np.log(uniform(key, np.arange(done, size), np.array([500_000_003 + number])))
            with np.errstate(over="ignore"):
                leave = location - np.log(noise + np.exp(location - value))
            self.leave = np.concatenate([self.leave, leave])
            done = size
            # What comes later lies lower and lower; it is needed only within reach of the ``need`` best.
            least = np.partition(self.leave, -need)[-need] if len(self.leave) >= need else -np.inf
            if size < len(arcs) and ends[size - 1] >= least - REACH:
                size = min(len(arcs), 2 * size)

    @staticmethod
    def _siblings(lattices: Lattices, arc: int) -> int:
        chance, a, b = lattices.chance.room, arc, arc
        while a > 0 and chance[a - 1] != 2.0:
            a -= 1
        while chance[b] != 2.0:
            b += 1
        return b - a + 1


class _Search:
    """Search over one text. ``base`` are the states of its units."""

    def __init__(self, key: int, base: np.ndarray, samples: int):
        self.key, self.base, self.need = np.array([key], np.uint64), base, samples + 1
        self.paths: list[_Path] = []
        self.value = float(-np.log(-np.log(uniform(self.key, np.zeros(1), np.array([999_999_937]))[0])))
        self.pending = (0, np.zeros(0, np.int64), np.zeros(0, np.int64), ())
        self.walked = 0  # first unit of the pending walk
        self.state = base

    def best(self) -> tuple[float, _Path | None, int]:
        found = (-np.inf, None, 0)
        for path in self.paths:
            if len(path.leave):
                t = int(path.leave.argmax())
                if path.leave[t] > found[0]:
                    found = (float(path.leave[t]), path, t + path.kept)
        return found

    def open(self, lattices: Lattices, draw: int) -> bool:
        """Take the best node off the frontier and prepare the walk that completes its sequence."""
        value, path, t = self.best()
        if path is None:
            return False
        path.leave[t - path.kept] = -np.inf
        barred = (int(path.arcs[t]), *(path.barred if t == path.kept else ()))
        size = _Path._siblings(lattices, barred[0])
        first = barred[0]
        while first > 0 and lattices.chance.room[first - 1] != 2.0:
            first -= 1
        others = [a for a in range(first, first + size) if a not in barred]
        weights = np.exp(lattices.log.room[np.array(others)].astype(np.float64))
        u = uniform(self.key, np.array([t]), np.array([700_000_001 + draw]))[0] * weights.sum()
        arc = others[min(int(np.searchsorted(np.cumsum(weights), u)), len(others) - 1)]
        unit = int(path.units[t])
        self.value = value
        self.pending = (t, np.append(path.arcs[:t], arc), path.units[:t + 1], barred)
        target = int(lattices.target.room[arc])
        self.walked = unit if target >= 0 else unit + 1
        self.state = self.base[self.walked:].copy()
        if target >= 0:
            self.state[0] = target
        return True

    def close(self, lattices: Lattices, units: np.ndarray, arcs: np.ndarray) -> None:
        kept, before, units_before, barred = self.pending
        self.paths.append(_Path(lattices, self.key, len(self.paths), np.concatenate([before, arcs]), np.concatenate([units_before, units + self.walked]),
                                self.value, kept, barred, self.need))


def _expand(lattices: Lattices, searches: list[_Search], draw: int) -> None:
    """Walk all pending texts together."""
    sizes = np.array([len(s.state) for s in searches], np.int64)
    ends = np.cumsum(sizes)
    key = np.repeat(np.array([s.key[0] for s in searches], np.uint64), sizes)
    place = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes) + np.repeat(np.array([s.walked for s in searches], np.int64), sizes)
    starts, arcs = lattices.walk(np.concatenate([s.state for s in searches]), key, place, draw)
    cuts = np.searchsorted(starts, ends)
    a = 0
    for search, end, size, b in zip(searches, ends.tolist(), sizes.tolist(), cuts.tolist()):
        search.close(lattices, starts[a:b] - (end - size), arcs[a:b])
        a = b


def normalize(text: str) -> str:
    return (SPACE + text.replace(" ", SPACE)) if text else ""


def segment(lattices: Lattices, keys: list[int], texts: list[str], samples: int) -> Iterator[tuple[int, int, float, float, float, np.ndarray, bool]]:
    """Number of the text, rank, log chance, perturbed value, inclusion score, ids, and whether the ids, read back, spell the text."""
    units = [lattices.pieces.unit.findall(normalize(t)) for t in texts]
    if lattices.held() > REMEMBERED:
        lattices.forget()
    new = list(set().union(*units).difference(lattices.base))
    if new:
        lattices.add(new)
    base = lattices.base
    searches = [_Search(k, np.fromiter(map(base.__getitem__, u), np.int64, len(u)), samples) for k, u in zip(keys, units)]
    _expand(lattices, searches, 0)
    for draw in range(1, samples):
        more = [s for s in searches if s.open(lattices, draw)]
        if not more:
            break
        _expand(lattices, more, draw)
    for number, (search, text) in enumerate(zip(searches, texts)):
        threshold = search.best()[0]
        raw = text.encode("utf-8", "surrogatepass")
        for rank, path in enumerate(search.paths, 1):
            symbols = lattices.symbol.room[path.arcs]
            with np.errstate(over="ignore"):
                inclusion = float(-np.expm1(-np.exp(path.log_chance - threshold)))
            ids = lattices.pieces.spell(symbols)
            yield number, rank, path.log_chance, path.value, inclusion, ids, lattices.pieces.decode(ids) == raw


_ROWS = ("doc_id bigint, rank int, n_pieces bigint, log_chance double, perturbed double, inclusion double, ids_crc32 bigint, decoded boolean")
#: Texts that are decoded at once.
TOGETHER = 500


def _sampler(path: str, samples: int, with_ids: bool, with_crc: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = of_process(f"lattices {path}", lambda: Lattices(path))
        names = [x.split()[0] for x in _ROWS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

        def done(ids: list, keys: list[int], texts: list[str]) -> pa.RecordBatch:
            rows, crcs = [], [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts] if with_crc else []
            for number, rank, log_chance, value, inclusion, pieces, same in segment(lattices, keys, texts, samples):
                crc = zlib.crc32(pieces.astype("<u4").tobytes())
                rows.append((ids[number], rank, len(pieces), log_chance, value, inclusion, crc, same, *([pieces] if with_ids else []),
                             *([crcs[number]] if with_crc else [])))
            more = [("ids", pa.list_(pa.int32()))] * with_ids + [("text_crc32", pa.int64())] * with_crc
            columns = zip(names + [n for n, _ in more], types + [t for _, t in more], zip(*rows))
            named = {n: pa.array(list(v), t) for n, t, v in columns}
            return pa.RecordBatch.from_arrays(list(named.values()), list(named))

        def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, keys, texts, size = [], [], [], 0
            for doc_id, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                keys.append(key % (1 << 64))
                texts.append(text.as_py())
                size += texts[-1].count(" ") + 1
                if size >= CHUNK:
                    yield done(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
            if ids:
                yield done(ids, keys, texts)

        try:
            for batch in batches:
                yield from rows_of(batch)
        finally:
            lattices.forget()
            give_back()

    return run


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, seed: int = SEED, model: str | None = None,
           with_ids: bool = True, with_crc: bool = False) -> DataFrame:
    """Up to ``samples`` distinct segmentations of every text, best perturbed value first; ``ids`` where ``with_ids``.

    With ``with_crc`` also ``text_crc32`` (unsigned, of the text's UTF-8 bytes), to compare what is decoded with."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_sampler(model or default_model(), samples, with_ids, with_crc),
                           _ROWS + ", ids array<int>" * with_ids + ", text_crc32 bigint" * with_crc)


def decode(rows: DataFrame, *, ids_col: str = "ids", out_col: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text that its ids spell as ``out_col``, which may not be one of its columns; null ids give an empty text."""
    if out_col in rows.columns:
        raise ValueError(f"there is a column {out_col} already")
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = of_process(f"lattices {path}", lambda: Lattices(path)).pieces
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([*batch.columns, pieces.texts(batch.column(ids_col))], [*batch.schema.names, out_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids, read back by the decoder; ``decoded`` says that this gives the text, to the last character."""
    rows = decode(sample(table(spark, sf_dir, "documents").select("doc_id", "text"), with_crc=True))
    spelled = F.col("decoded") & (F.crc32(F.col("text").cast("binary")) == F.col("text_crc32"))
    return rows.withColumn("decoded", spelled).withColumn("text_sha256", F.sha2("text", 256)).drop("text", "text_crc32")
