"""Top-k search, turn trie and token alignment against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tandem.llm import token_alignment, topk_search, turn_trie


def _best(vectors, k=20, every=20):
    """Every query against every row, in whole numbers."""
    rows = []
    for vec_id, v in vectors:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            rows.append((vec_id, [int(np.floor(64 * x)) for x in v]))
    out = []
    for i, (query, a) in enumerate(rows):
        if query is None or query % every:
            continue
        scores = [(-max(1 - (1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), other is None, other or 0, other) for j, (other, b) in enumerate(rows) if j != i]
        out += [(query, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=repr)


def _vectors(seed, n=700, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        kind = i % 5
        if kind < 2:
            v = centres[i % 6] + 0.02 * rng.normal(size=dim)  # near copies, for which coordinates prune
        elif kind == 2:
            v = rng.normal(size=dim) * rng.choice([0.01, 1.0, 8.0])  # very unequal lengths
        elif kind == 3:
            v = centres[0]  # ties
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(x) for x in v]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_equals_brute_force(spark, seed):
    rows = _vectors(seed)
    rows += [(20, rows[20][1]), (20, rows[40][1]), (None, rows[0][1]), (701, None), (702, [1.0, None]), (703, [float("nan")] * 12), (704, [float("inf")] * 12),
             (720, []), (740, [0.0] * 12), (760, [0.5] * 3), (-20, rows[3][1])]
    frame = spark.createDataFrame([(i, v, "b", 1) for i, v in rows], "vec_id bigint, embedding array<double>, bucket string, rank int")
    found = topk_search.top_k(frame, bucket=32, block=8, side=3).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, found.collect()), key=repr) == _best(rows)


def test_top_k_few_rows_huge_components_and_empty(spark):
    rows = [(0, [1e9, 2.0]), (1, [3e9, -1.0]), (2, [1e16, 1e16]), (20, [-1e16, 1e16]), (3, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk_search.top_k(frame, k=3).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, found.collect()), key=repr) == _best(rows, k=3)  # scores beyond a long count as its ends
    assert topk_search.top_k(frame.limit(0)).count() == 0
    assert topk_search.top_k(frame.filter("vec_id = 1")).count() == 0


def test_coordinate_intervals_lose_no_vector():
    rng = np.random.default_rng(5)
    vectors = np.floor(64 * rng.normal(size=(400, 8)))
    vectors[200:] = np.floor(vectors[0] + rng.normal(size=(200, 8)) * 6)
    lengths = np.sqrt((vectors ** 2).sum(axis=1))
    order = np.argsort(-lengths)
    vectors, lengths = vectors[order].astype("<i2"), lengths[order]
    bucket = topk_search._Held({"n": 400, "bucket": 1, "dim": 8, "kind": "<i2", "ids": np.zeros((2, 400), "<i8").tobytes(), "lengths": lengths.tobytes(),
                                "vectors": vectors.tobytes()})
    for q in range(0, 400, 7):
        unit = vectors[q] / lengths[q]
        cosines = bucket.unit() @ unit
        for least in (0.7, 0.9, 0.99):
            focus = np.argsort(-np.abs(unit))[:3]
            kept = set(topk_search.feasible(bucket, focus, unit[focus], least).tolist())
            assert set(np.flatnonzero(cosines >= least + 1e-9).tolist()) <= kept
            assert len(kept) < 400 or least < 0.9


def _trie(turns):
    """Nodes of the trie, straight from its definition."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = own.get(base, [])[:h] + mine[h:]
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    blank = " \t\n\x0b\x0c\r"
    words = lambda s: len("".join(" " if x in blank else x for x in s).split(" ")) - "".join(" " if x in blank else x for x in s).split(" ").count("")
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[:len(node)] == node]
        children = lambda n: [m for m in below if len(m) == len(n) + 1 and m[:len(n)] == n]
        ends = sorted(c for c in members if len(whole[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children(node)), sum(not children(n) for n in below),
                    sum((len(nodes[n]) - 1) * (words(n[-1][1]) if n else 0) for n in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _turns(seed, convs=120, longest=30):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        n = rng.choice([1, 2, 3, 5, 9, longest]) if c % 3 else 12
        for t in range(n):
            same = c % 3 == 0 or rng.random() < 0.5
            rows.append((c, t, "user" if t % 2 else None, f"hot {t}" if same else f"x{rng.randrange(3)} y\x0bz"))
    rows += [(500, None, "user", "a"), (500, None, "user", "b"), (500, 1, None, None), (500, 1, None, None), (541, 0, "r", ""), (-41, 0, "r", "t t"), (-40, 0, "r", "t t"),
             (None, 0, "user", "lost"), (None, 1, "user", "lost"), (1000, 0, "user", " "), (1003, 0, "user", " ")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_turn_trie_equals_its_definition(spark, seed):
    rows = _turns(seed)
    frame = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, name string, shard int")
    for shard_turns in (1 << 20, 40):  # few shards, and so many that nodes lie in several
        found = turn_trie.trie(frame, shard_turns=shard_turns).select(*_NODE)
        assert sorted(map(tuple, found.collect()), key=repr) == _trie(rows)


def test_turn_trie_one_giant_class_and_one_giant_conversation(spark):
    rows = [(20 * c, t, "user", f"t{t}") for c in range(400) for t in range(2)] + [(9007, t, "user", f"long {t}") for t in range(700)] + [(9009, t, "user", f"long {t}") for t in range(701)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {(r.conv_id, r.depth): r for r in turn_trie.trie(frame, shard_turns=60).collect()}
    assert found[0, 2].n_convs == 400 and found[0, 2].n_children == 0
    assert found[0, 2].ends_sha256 == hashlib.sha256(",".join(str(20 * c) for c in range(400)).encode()).hexdigest()
    assert found[0, 0].n_convs == 402
    assert sum(r.n_children == 0 for r in found.values()) == found[0, 0].n_leaves
    assert turn_trie.trie(frame.limit(0)).count() == 0


def _aligned(rows):
    pair = token_alignment.Pair(*token_alignment.default_tokenizers())
    spelled = lambda words, i: words.flat[words.starts[i]:words.starts[i] + words.lengths[i]].tobytes()
    docs, held = [], Counter()
    for doc_id, text in rows:
        text, found = text or "", []
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        a_bytes, b_bytes = [spelled(pair.a_words, i) for i in a], [spelled(pair.b_words, i) for i in b]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        i = j = x = y = 0
        own_a, own_b = [], []
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                own_a.append(a[i])
                x, i = x + len(a_bytes[i]), i + 1
            else:
                own_b.append(b[j])
                y, j = y + len(b_bytes[j]), j + 1
            if x == y and own_a and own_b:
                found.append((own_a, own_b))
                own_a, own_b = [], []
        links = Counter((p, q) for g, h in found for p in g for q in h)
        held.update(set(links))
        docs.append((doc_id, len(a), len(b), found, links))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    text_of = lambda found: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in found)
    return sorted([(d, n_a, n_b, len(found), sum(links.values()), sum(n for k, n in links.items() if held[k] == top[k[0]]), sum(n * held[k] for k, n in links.items()),
                    hashlib.sha256(text_of(found).encode()).hexdigest() if found else "") for d, n_a, n_b, found, links in docs], key=repr)


_ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_token_alignment_equals_brute_force(spark, texts):
    rng = random.Random(3)
    signs = "ab \n\t,.ü漢😀é‍0123  <|endoftext|></s>\x00\x7f"
    rows = [(i, t) for i, t in texts.items() if i % 3 == 0]
    rows += [(10_000 + i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 80)))) for i in range(150)]
    rows += [(20_000, None), (20_001, ""), (20_002, " "), (20_003, "a▁b"), (20_004, "<|endoftext|> </s> <s>"), (20_005, "x" * 5000), (20_006, "same same"), (20_006, "same same"),
             (None, "same same"), (20_007, "漢" * 300 + "𝒳😀" * 200), (20_008, "\n" * 400), (20_009, " " * 401 + "z")]
    frame = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id bigint, text string, block bigint, pair string")
    want = _aligned(rows)
    for settings in ({}, {"piece": 7, "block_links": 500, "by_unit": False}):
        found = token_alignment.align_tokens(frame, **settings).select(*_ALIGNED)
        assert sorted(map(tuple, found.collect()), key=repr) == want


def test_token_alignment_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_alignment.align_tokens(frame).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert [tuple(r) for r in token_alignment.align_tokens(one).select(*_ALIGNED).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_merge_path_pieces_are_equal_work():
    rng = np.random.default_rng(1)
    for _ in range(30):
        top = int(rng.integers(2, 400))
        a, b = (np.unique(np.append(rng.integers(1, top, rng.integers(1, 200)), top)) for _ in range(2))
        for piece in (1, 3, 50):
            i, j = token_alignment.merge_path(a, b, piece)
            work = np.diff(i) + np.diff(j)
            assert (work[:-1] == piece).all() and 0 < work[-1] <= piece
            a_cuts, b_cuts = token_alignment.groups(a, b, piece)
            assert a[a_cuts[1:] - 1].tolist() == b[b_cuts[1:] - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 60).astype(np.int32), rng.integers(0, 9, 60).astype(np.int32)
    cuts = np.array([0, 5, 40, 60]), np.array([0, 30, 31, 60])
    def total():
        out = Counter()
        for g, p, n in token_alignment.group_links(a, b, *cuts):
            for x in zip(g.tolist(), p.tolist(), n.tolist()):
                out[x[:2]] += x[2]
        return out
    plain = total()
    monkeypatch.setattr(token_alignment, "LARGE", 100)
    monkeypatch.setattr(token_alignment, "AT_ONCE", 10)
    assert total() == plain and sum(plain.values()) == 5 * 30 + 35 + 20 * 29


def test_units_give_the_ids_of_whole_texts(texts):
    pair = token_alignment.Pair(*token_alignment.default_tokenizers())
    assert not any(" " in pair.b.id_to_piece(i)[1:].lstrip("▁").replace("▁", " ") for i in range(pair.b.vocab_size()))
    rng = random.Random(8)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\u2028", "\x1c", "\x85", "'s", "'", "1", "22", "ü", "漢", "😀", "_", "-", ".", "▁", "\x00", "<s>"]
    rows = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))) for _ in range(6000)] + list(texts.values())
    known = (token_alignment.Memo(1 << 16), token_alignment.Memo(1 << 16))
    for first in range(0, len(rows), 500):
        part = rows[first:first + 500]
        for text, one, all_ in zip(part, pair.encode(part, known), pair.encode(part, None)):
            assert one[0].tolist() == all_[0].tolist() and one[1].tolist() == all_[1].tolist(), repr(text)
