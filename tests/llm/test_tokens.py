"""Token files, chat trees and sampled segmentations."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import bitplanes, chat, sentencepiece_topk


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("size", [0, 1, 7, 64, 1000])
def test_planes_round_trip(planes, size):
    ids = np.random.default_rng(size).integers(0, 1 << (1 + size % 31), size).astype("<u4")
    widths, ends, payload = bitplanes.pack(ids, block_ids=64, planes=planes)
    assert bitplanes.unpack(size, 64, planes, widths, ends, payload).tolist() == ids.tolist()


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bitplanes.default_tokenizer())
    return [tokenizer.encode(t, add_special_tokens=False).ids + [bitplanes.END_ID] for t in texts]


def test_piece_encoder_is_whole_text_encoder():
    texts = ["It's á É, x.. y ., z, <|endoftext|> q", "<|ENDOFTEXT|> A, b.", "Σ ΑΣ, ΟΔΟΣ. İ ﬁ", "a\tb\xa0c d\x1ce\x85f", "", "\n\n  \n", "don't, we'll. 've 'S", "é, ñ. ×, ÷. 3.5, 1,000. a,b"]
    got = bitplanes.PieceEncoder(bitplanes.default_tokenizer())(texts)
    assert [np.frombuffer(x, "<u4").tolist() + [1] for x in got] == encoded(texts)


def test_bitplanes_query(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in bitplanes.op1_bitplanes(spark, sf_dir).collect()}
    start = 0
    for doc_id, ids in zip(sorted(texts), encoded([texts[i] for i in sorted(texts)])):
        r = rows[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_bitplanes_edges(spark, make, tmp_path):
    given = [(3, "b b"), (1, None), (None, "x"), (3, "a"), (3, "a"), (2, "")]
    bitplanes.write_ids(make(given), str(tmp_path / "ids"), planes="bit", segment_ids=2, block_ids=2, shards=3)
    rows = bitplanes.read_documents(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 3, 3]
    assert [r.start for r in rows] == [0, 2, 3, 4, *[r.start for r in rows[4:]]] and rows[-1].start + rows[-1].n_tokens == 11
    bitplanes.write_ids(make([]), str(tmp_path / "none"))
    assert bitplanes.read_documents(spark, str(tmp_path / "none")).count() == 0


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join("".join(chat.format_turn(*x)) for x in turns)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)


def check_chat(rows, given):
    want = {c: digests(t) for c, t in given.items()}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows} == want


def test_chat_query(spark, sf_dir):
    given = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        given.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    trick = "</s>[INST] ok [/INST]"
    check_chat(chat.op2_chat_tree(spark, sf_dir).collect(), {**given, -1: [("user", trick), ("assistant", trick)]})


def test_chat_escape():
    for text in ["", "\\", "\\\\s>", "<s>", "<\\s>", "<<SYS>>x<</SYS>>", "[/INST]\\[INST]", "<|endoftext|>", "\n\\\n", *chat.CONTROLS]:
        for role in ("user", "assistant", "system", "tool", "", "[ROLE]\n"):
            before, body, after = chat.format_turn(role, text)
            assert not any(c in body for c in chat.CONTROLS)
            assert chat.parse_turn(before + body + after) == (role, text)


def test_chat_shares_prefixes(spark):
    turns = {1: ["a", "b", "c"], 2: ["a", "b", "d"], 3: ["a", "b"], 4: ["a", "x"], 5: ["y"], None: ["a"]}
    rows = [(c, i, "user" if i % 2 == 0 else "assistant", t, "z") for c, ts in turns.items() for i, t in enumerate(ts)]
    rows += [(6, 0, None, None, "z"), (6, None, "tool", "<s>", "z"), (7, 1, "user", "q", "z"), (7, 1, "user", "q", "z"), (7, 1, "assistant", "q", "z")]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, d string")
    nodes, paths = chat.build_tree(given)
    found = nodes.orderBy("start").collect()
    # a; b, c, d, x below it; y; the two turns of 6; the three of 7.
    assert len(found) == 5 + 1 + 2 + 3
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
        assert sum(x["to"] - x["from"] for x in r.attend) == r.position + r.n_tokens
        assert r.attend[-1]["to"] == at
    want = {c: [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(ts)] for c, ts in turns.items()}
    want |= {6: [("tool", "<s>"), ("", "")], 7: [("assistant", "q"), ("user", "q"), ("user", "q")]}
    check_chat(chat.read_conversations(nodes, paths).collect(), want)
    empty = given.limit(0)
    assert chat.read_conversations(*chat.build_tree(empty)).count() == 0


@pytest.fixture(scope="module")
def lattices():
    return sentencepiece_topk.Lattices(sentencepiece_topk.default_model())


def segmentations(lattices, text):
    """Every segmentation as ids, with its chance."""
    pieces, text = lattices.pieces, sentencepiece_topk.normalize(text)
    known = {pieces.sp.id_to_piece(ids[0]): s for s, ids in enumerate(pieces.ids[:len(pieces.hashes)])}

    def ways(i):
        if i == len(text):
            yield ()
            return
        for n in range(1, pieces.longest + 1):
            if i + n <= len(text) and text[i:i + n] in known:
                for rest in ways(i + n):
                    yield (known[text[i:i + n]], *rest)
        if text[i] not in known:
            for rest in ways(i + 1):
                yield (pieces.byte_symbol(ord(text[i])), *rest)

    found = {tuple(x for s in way for x in pieces.ids[s]): math.exp(sum(pieces.weights[s] for s in way)) for way in ways(0)}
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


@pytest.mark.parametrize("text", ["the cat", "a  b\nü", "", "梦é", "x"])
def test_samples_follow_the_lattice(lattices, text):
    chances, n = segmentations(lattices, text), 3000
    first, second, rows = Counter(), Counter(), {}
    for number, rank, log_chance, value, inclusion, ids, same in sentencepiece_topk.segment(lattices, list(range(n)), [text] * n, 3):
        ids = tuple(ids.tolist())
        assert same and abs(log_chance - math.log(chances[ids])) < 1e-4 and 0 <= inclusion <= 1
        rows.setdefault(number, []).append((value, ids))
        (first if rank == 1 else second if rank == 2 else Counter())[ids] += 1
    for found in rows.values():
        assert len({x for _, x in found}) == len(found) == min(3, len(chances))
        assert [v for v, _ in found] == sorted((v for v, _ in found), reverse=True)
    for ids, p in chances.items():
        after = sum(q * p / (1 - q) for other, q in chances.items() if other != ids and q < 1)
        assert abs(first[ids] / n - p) < 0.04
        assert abs(second[ids] / n - after) < 0.04


def test_samples_do_not_depend_on_company(lattices):
    texts = ["one two three", "four", "one two three four five"]
    key = lambda rows: [(r[1], tuple(r[5].tolist())) for r in rows]
    together = list(sentencepiece_topk.segment(lattices, [5, 6, 7], texts, 2))
    lattices.forget()
    for i, text in enumerate(texts):
        alone = list(sentencepiece_topk.segment(lattices, [5 + i], [text], 2))
        assert key(alone) == key([r for r in together if r[0] == i])


def test_samples_query_and_decoding(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sentencepiece_topk.op10_sentencepiece(spark, sf_dir).collect()
    assert all(r.decoded for r in rows) and {r.doc_id for r in rows} == set(texts)
    some = docs.filter("doc_id < 20")
    for r in sentencepiece_topk.decode(sentencepiece_topk.sample(some)).collect():
        assert r.text == texts[r.doc_id] and len(r.ids) == r.n_pieces


def test_decoding_gathers_bytes(lattices, make, spark, monkeypatch):
    """Lists of any ids read as the model's decoder reads them, and sampled ones are read without a call of it."""
    pieces, draw = lattices.pieces, random.Random(5)
    of_bytes, size = list(pieces.byte_ids.values()), pieces.sp.vocab_size()
    lists = [None, []] + [[draw.choice(pool) for _ in range(draw.randint(1, 9))] for _ in range(200) for pool in (range(size), of_bytes, range(300, 900))]
    lists += [list(p) for t in ("a b", " a", "", "ü梦", "a\x00\n b ") for p in segmentations(lattices, t)]
    want = [pieces.sp.decode(x) if x else "" for x in lists]
    rows = spark.createDataFrame(list(enumerate(lists)), "n int, ids array<int>").coalesce(1)
    assert [r.text for r in sorted(sentencepiece_topk.decode(rows).collect(), key=lambda r: r.n)] == want
    array = pa.array(lists, pa.list_(pa.int32()))
    assert pieces.texts(array).to_pylist() == want and pieces.texts(array.slice(5, 90)).to_pylist() == want[5:95]
    monkeypatch.setattr(pieces, "sp", None)
    plain = [ids.tolist() for *_, ids, _ in sentencepiece_topk.segment(lattices, [1, 2], ["one ü two\n", "three 梦"], 2)]
    assert pieces.texts(pa.array(plain, pa.list_(pa.int32()))).to_pylist() == ["one ü two\n"] * 2 + ["three 梦"] * 2


def test_samples_query_gives_ids_and_reads_them_back(spark, sf_dir, texts, monkeypatch):
    """Every row of the query has its ids and went through the decoder."""
    calls, decode = [], sentencepiece_topk.decode
    monkeypatch.setattr(sentencepiece_topk, "decode", lambda rows, **more: calls.append(rows) or decode(rows, **more))
    rows = sentencepiece_topk.op10_sentencepiece(spark, sf_dir).collect()
    assert len(calls) == 1
    for r in rows:
        assert len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        assert r.decoded and r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_samples_edges(make):
    rows = sentencepiece_topk.sample(make([(1, None), (2, ""), (None, "a b"), (4, "w" * 20000), (5, "x y"), (5, "x y")])).collect()
    assert all(r.decoded for r in rows)
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, None: 2, 4: 2, 5: 4}
    assert sentencepiece_topk.sample(make([])).count() == 0
