"""Near-duplicates, decontamination, repeated passages and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tandem.llm import decontaminate, passages, simhash
from tandem.llm.components import components
from tandem.llm.words import grams, plain_words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(3, 8))) for _ in range(n)]


def fingerprint(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    shingles = [" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def roots(prints):
    """Smallest id reachable over at most three differing bits."""
    parent = {i: i for i in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3):
            a, b = sorted((top(i), top(ids[j])))
            parent[b] = a
    return {i: top(i) for i in ids}


def test_simhash_query(spark, sf_dir, texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = roots(prints)
    rows = simhash.op8_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_simhash_dense_groups(spark, monkeypatch):
    """Balls around a few centres, so that segments are shared by many fingerprints."""
    monkeypatch.setattr(simhash, "DENSE", 4)
    draw = random.Random(3)
    prints = {}
    for centre in [draw.getrandbits(64) for _ in range(3)] + [0]:
        for _ in range(60):
            value = centre
            for bit in draw.sample(range(64), draw.randint(0, 4)):
                value ^= 1 << bit
            prints[len(prints)] = value
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in prints.items()]
    rows = spark.createDataFrame(signed, "doc_id bigint, fp bigint")
    found = {r.node: r.root for r in components(simhash.links(rows)).collect()}
    want = roots(prints)
    group = lambda named: {frozenset(i for i in prints if named(i) == x) for x in {named(i) for i in prints}}
    assert group(lambda i: found.get(signed[i][1], signed[i][1])) == group(lambda i: min(signed[j][1] for j in prints if want[j] == want[i]))


def test_simhash_probes_are_not_broadcast(spark):
    """The looked-up values are 33 times what Spark takes them for, so no table of them is sent to the driver, however small it seems."""
    plan = simhash.links(spark.range(40).selectExpr("id * 7919 as fp"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_simhash_edges_and_dedup(make):
    base = words(1, 60)
    near = base[:59] + ["changed"]
    given = [(5, " ".join(base)), (2, " ".join(base)), (None, " ".join(base)), (7, None), (6, ""), (8, " \n"), (9, "one two"), (9, "one two"), (9, "other words here"), (None, "alone")]
    rows = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(make(given)).collect()]
    assert sorted(rows, key=repr) == sorted([(5, 2), (2, 2), (None, 2), (7, 6), (6, 6), (8, 6), (9, 9), (9, 9), (9, 9), (None, None)], key=repr)
    docs = make(given)
    stay = simhash.deduplicate(docs)
    assert stay.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in stay.collect()), key=repr) == sorted(
        [(2, " ".join(base)), (6, ""), (9, "one two"), (9, "other words here"), (None, "alone")], key=repr)
    assert simhash.deduplicate(make([])).count() == 0
    assert bin(fingerprint(" ".join(base)) ^ fingerprint(" ".join(near))).count("1") < 32


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "u bigint, v bigint")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {**dict.fromkeys(range(n + 1), 0), 1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def local_score(item, passage):
    rows = [[0] * (len(passage) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(passage, 1):
            row.append(max(0, rows[-1][j - 1] + (2 if a == b else -1), rows[-1][j] - 1, row[-1] - 1))
        rows.append(row)
    return max(map(max, rows))


def test_smith_waterman():
    draw = random.Random(5)
    for _ in range(60):
        item = [draw.randrange(6) for _ in range(draw.randint(1, 14))]
        passage = [draw.randrange(6) for _ in range(draw.randint(1, 20))]
        score, start, end = decontaminate.smith_waterman(np.array(item), np.array(passage))
        assert score == local_score(item, passage)
        if score:
            assert local_score(item, passage[start:end]) == score


def test_decontaminate_query(spark, sf_dir, texts):
    """Every document with all words of an item in a row is found, and nothing without an aligned passage is."""
    items = {r.item_id: plain_words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r for r in decontaminate.op9_decontaminate(spark, sf_dir).collect()}
    bodies = {i: plain_words(t) for i, t in texts.items()}
    for i, body in bodies.items():
        joined = b" " + b" ".join(body) + b" "
        for k, item in items.items():
            if b" " + b" ".join(item) + b" " in joined:
                assert found[i, k].score == 1.0
    for (i, k), r in found.items():
        assert local_score(items[k], bodies[i]) / (2 * len(items[k])) >= decontaminate.SCORE


def test_decontaminate_edited_copies(spark, make):
    items = {1: words(10, 40), 2: words(11, 30), 3: ["too", "short"]}
    edited = list(items[1])
    edited[7:8], edited[20:21], edited[30:30] = ["swapped"], [], ["put", "in"]
    half = items[1][:15] + words(12, 25)
    given = [(1, " ".join(words(20, 50) + edited + words(21, 50))), (2, " ".join(items[2]).upper() + "!"), (3, " ".join(half)), (4, " ".join(words(22, 200))),
             (5, None), (6, ""), (None, " ".join(items[2])), (7, "too short"), (8, " ".join(items[1] + items[2])), (9, " ".join(items[2])), (9, " ".join(items[2]))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(9, None)], "item_id bigint, text string")
    found = decontaminate.contaminated(make(given), bench)
    rows = sorted(((r.doc_id or -1, r.item_id) for r in found.collect()))
    assert rows == [(-1, 2), (1, 1), (2, 2), (7, 3), (8, 1), (8, 2), (9, 2), (9, 2)]
    parts = decontaminate.contaminated(make(given), bench, sieve=16, together=1)
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, found.collect()))
    assert (7, 3) not in {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(given), bench, shortest=3).collect()}
    docs = make(given)
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated(make([]), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontaminate_finds_what_alignment_finds(spark, make):
    """Copies with many changed words, one of them with every fourth word changed, against brute-force alignment."""
    draw, common = random.Random(3), words(70, 30)
    items = {i: [draw.choice(common) if draw.random() < 0.4 else w for w in words(600 + i, 30 + i)] for i in range(24)}
    given = []
    for i, item in items.items():
        for share in (0.15, 0.2, 0.25):
            copy = [x for w in item for x in ([w] if draw.random() >= share else draw.choice([["changed"], [], [w, "put"], [draw.choice(common)]]))]
            around = [draw.choice(common) if draw.random() < 0.4 else w for w in words(900 + len(given), 40)]
            given.append((len(given), around[:20] + copy + around[20:]))
        given.append((len(given), ["x" if k % 4 == 3 else w for k, w in enumerate(item)]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    want = {(d, i): local_score(item, body) / (2 * len(item)) for d, body in given for i, item in items.items() if d // 4 == i or d % 4 == 0}
    want = {k: v for k, v in want.items() if v >= decontaminate.SCORE}
    assert len(want) > 60
    rows = decontaminate.contaminated(make([(d, " ".join(body)) for d, body in given]), bench).collect()
    found = {(r.doc_id, r.item_id): r.score for r in rows}
    assert want.items() <= found.items()
    assert all(k in want for k in found if k[0] // 4 == k[1] or k[0] % 4 == 0)


def test_decontaminate_short_and_repeated_items(spark, make):
    """Items of one to six words against brute force; repeated items match each, whatever the size of the bit table and of the lists."""
    draw, few = random.Random(5), words(77, 12)
    items = [(i, [draw.choice(few) for _ in range(1 + i % 6)]) for i in range(60)]
    items += [items[7], items[7], (None, items[11][1])]
    given = [(i, [draw.choice(few) for _ in range(draw.randint(0, 12))]) for i in range(120)] + [(5, items[11][1]), (5, items[11][1])]
    share = lambda item: decontaminate.SCORE if len(item) >= decontaminate.EDITED else 1.0
    want = sorted((d, -1 if i is None else i) for d, body in given for i, item in items
                  if local_score(item, body) >= 2 * share(item) * len(item) - 1e-9)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(3, ""), (4, "?!")], "item_id bigint, text string")
    rows = decontaminate.contaminated(make([(d, " ".join(body)) for d, body in given]), bench, together=7).collect()
    assert len(want) > 300 and sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in rows) == want


def test_seeding_is_kept_by_any_copy():
    """Random edits that keep the score keep the pairs (or words) that the seeds rely on."""
    draw = random.Random(6)
    for _ in range(3000):
        size = draw.randint(4, 40)
        item, copy = list(range(size)), []
        rate = draw.random() * 0.5
        for w in item:
            copy += [w] if draw.random() >= rate else draw.choice([[-1], [], [-1, w]])
        if not copy or local_score(item, copy) < 2 * decontaminate.SCORE * size:
            continue
        n, places, need = decontaminate.seeding(size, decontaminate.SCORE)
        kept = {tuple(copy[i:i + n]) for i in range(len(copy) - n + 1)}
        held = [tuple(item[i:i + n]) in kept for i in range(size - n + 1)]
        assert sum(sorted(held)[:places]) >= need


def test_winnowing_guarantee():
    shared = words(30, passages.GRAM + passages.WINDOW - 1)
    number = lambda tokens: np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    for seed in range(20):
        a, b = (number(words(100 + 2 * seed + k, 30 + seed) + shared + words(500 + seed + k, 40)) for k in (0, 1))
        picks = [set(grams(x, passages.GRAM)[passages.winnow(grams(x, passages.GRAM))].tolist()) for x in (a, b)]
        assert picks[0] & picks[1]


def best_chain(matches):
    matches, value = sorted(set(matches)), {}
    for i, (a, b) in enumerate(matches):
        gains = [value[j] - passages.SKIP * (a - x + b - y - 2 * passages.GRAM) for j, (x, y) in enumerate(matches[:i]) if x < a and y < b]
        value[i] = passages.GRAM + max([0.0, *gains])
    return max(value.values())


def test_chain_is_optimal():
    draw = random.Random(8)
    for _ in range(80):
        matches = [(draw.randrange(60), draw.randrange(60)) for _ in range(draw.randint(1, 25))]
        chains = passages.chain(matches)
        assert sorted(m for c in chains for m in c) == sorted(set(matches))
        first = chains[0]
        assert all(x < a and y < b for (x, y), (a, b) in zip(first, first[1:]))
        value = passages.GRAM
        for (x, y), (a, b) in zip(first, first[1:]):
            value += passages.GRAM - passages.SKIP * (a - x + b - y - 2 * passages.GRAM)
        assert value == pytest.approx(best_chain(matches))


def test_passages_query(spark, sf_dir, texts):
    """Documents that share fifty words in a row with another are all found; every other find is a near copy."""
    bodies, holders = {i: plain_words(t) for i, t in texts.items()}, {}
    for i, body in bodies.items():
        for j in range(len(body) - 49):
            holders.setdefault(tuple(body[j:j + 50]), set()).add(i)
    want = set().union(*[x for x in holders.values() if len(x) > 1])
    rows = passages.op4_passages(spark, sf_dir).collect()
    assert want <= {r.doc_id for r in rows}
    for r in rows:
        assert 0 <= r.start_word < r.end_word <= len(bodies[r.doc_id]) and r.end_word - r.start_word >= 50
        assert r.other_id != r.doc_id and r.identity >= passages.IDENTITY
        mine, other = bodies[r.doc_id][r.start_word:r.end_word], set(bodies[r.other_id])
        assert sum(w in other for w in mine) >= 0.6 * len(mine)


def test_passages_fuzzy_and_clean(make):
    passage = words(40, 70)
    fuzzy = list(passage)
    fuzzy[10:11], fuzzy[35:35], fuzzy[50:51] = ["x1"], ["x2", "x3"], []
    given = [(1, " ".join(words(41, 80) + passage + words(42, 80))), (2, " ".join(words(43, 30) + fuzzy + words(44, 10))), (3, " ".join(words(45, 300))),
             (4, " ".join(passage[:30] + words(46, 100))), (5, None), (6, ""), (None, " ".join(passage)), (7, " ".join(passage)), (7, " ".join(passage)), (8, "the same line\n" * 400)]
    rows = {r.doc_id: r for r in passages.repeated_passages(make(given)).collect()}
    assert set(rows) == {1, 2, 7}
    assert (rows[1].start_word, rows[1].end_word) == (80, 150)
    assert abs(rows[2].start_word - 30) <= 1 and abs(rows[2].end_word - 101) <= 2
    assert passages.repeated_passages(make([])).count() == 0


def test_passages_with_a_common_line(make):
    """Pairs that share a passage with a line of other documents in it are found, whatever the order of keys."""
    line, given = words(2000, 30), [(1000 + i, words(2001 + i, 40) + words(2000, 30) + words(2051 + i, 40)) for i in range(30)]
    for i in range(40):
        passage = words(2200 + i, 30)
        passage[i % 30:i % 30] = line
        given += [(2 * i + k, words(2300 + 2 * i + k, 40) + passage + words(2400 + 2 * i + k, 40)) for k in (0, 1)]
    rows = passages.repeated_passages(make([(i, " ".join(x)) for i, x in given])).collect()
    assert {r.doc_id for r in rows if r.start_word == 40 and r.end_word == 100} == set(range(80))


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] + 1 if x == y else max(above[j], row[-1]))
    return row[-1]


@pytest.mark.parametrize("edits", [0.05, 0.1, 0.15])
def test_passages_recall_of_edited_copies(make, edits):
    """Of the planted copies that a brute-force alignment puts well over ``IDENTITY``, nearly all are found."""
    draw, given, planted = random.Random(int(100 * edits)), [], []
    for i in range(100):
        passage = words(3000 + i, 70)
        copy = [x for w in passage for x in ([w] if draw.random() >= edits else draw.choice([["changed"], ["other"], [], [w, "put"]]))]
        given += [(2 * i, words(3200 + i, 40) + passage + words(3400 + i, 40)), (2 * i + 1, words(3600 + i, 40) + copy + words(3800 + i, 40))]
        if common_words(passage, copy) >= (passages.IDENTITY + 0.03) * max(len(passage), len(copy)):
            planted.append(i)
    found = {r.doc_id for r in passages.repeated_passages(make([(i, " ".join(x)) for i, x in given])).collect()}
    assert len(planted) > 50
    assert sum(2 * i in found and 2 * i + 1 in found for i in planted) >= 0.97 * len(planted)


def test_alignment_of_many_at_once():
    """The batch form of the extension gives what the single form gives, for every kind of pair."""
    draw, pairs = random.Random(17), []
    for _ in range(400):
        a = [draw.randrange(draw.choice([3, 50])) for _ in range(draw.randint(0, 64))]
        b = [x for w in a for x in ([w] if draw.random() > 0.2 else draw.choice([[], [w, 7], [8]]))][:draw.randint(0, 64)]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
    wide = [np.array([np.pad(x, (0, 64 - len(x)), constant_values=x[-1] if len(x) else 0) for x in side]) for side in zip(*pairs)]
    sizes = [np.array([len(x) for x in side]) for side in zip(*pairs)]
    assert [tuple(x) for x in passages.extend_all(*wide, *sizes).tolist()] == [passages.extend(a, b) for a, b in pairs]


def test_chains_told_by_codes_end_soon():
    """A side that is said to end soon covers at most ``SOON`` words of either stretch, by the words themselves."""
    draw, told, chance = random.Random(19), 0, 0
    for few in (2, 3, 5, 30, 3000):
        for _ in range(300):
            a = np.array([draw.randrange(few) for _ in range(draw.randint(0, 64))], np.int32)
            b = np.array([x for w in a for x in ([w] if draw.random() > 0.4 else draw.choice([[], [w, 7], [8]]))][:64], np.int32)
            b = b if draw.random() < 0.5 else np.array([draw.randrange(few) for _ in range(draw.randint(0, 64))], np.int32)
            code = lambda x, size: passages._around(passages._codes(x), np.zeros(1, int), np.zeros(1, int), np.full(1, len(x)), 1, size)
            near = passages._unpacked(passages._packed(code(a, passages.NEAR)))
            assert (near == code(a, passages.NEAR)).all()
            if passages.ends_soon(near, code(b, passages.WIDE))[0]:
                told += 1
                chance += few == 3000
                assert max(passages.extend(a, b)[:2]) <= passages.SOON
    assert told > 300 and chance > 100


def test_chance_seeds_carry_no_words(make, monkeypatch):
    """Texts that share a few words in a row by chance: their chains are told from passages before any words are sent for them."""
    held, keep = {}, passages.keep

    def spy(df, label, **more):
        kept = keep(df, label, **more)
        held.setdefault(label, (kept.columns, kept.count()))
        return kept

    monkeypatch.setattr(passages, "keep", spy)
    few, passage = words(8000, 8), words(8001, 60)
    given = [(i, " ".join(words(8100 + i, 60) + few + words(8200 + i, 60))) for i in range(30)]
    given += [(100 + i, " ".join(words(8300 + i, 30) + passage + words(8400 + i, 30))) for i in range(2)]
    rows = passages.repeated_passages(make(given)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.other_id) for r in rows) == [(100, 30, 90, 101), (101, 30, 90, 100)]
    assert held["chains"][1] >= 20 and "a_words" not in held["chains"][0] and held["hopeful"][1] <= 3


def test_passages_are_not_put_together_from_lines_of_several_documents(make):
    """Documents of three 22-word lines, each shared with another document only, hold no passage of fifty words."""
    lines = [words(7000 + i, 22) for i in range(30)]
    deal = lines + lines[7:] + lines[:7]
    given = [(i, " ".join(sum(deal[i::20], []))) for i in range(20)]
    assert passages.repeated_passages(make(given)).count() == 0


def test_passages_of_common_lines(make):
    """Passages put together from lines that many documents hold are found where the pair alone has them in this order."""
    draw, lines, given = random.Random(4), [words(7100 + i, 12) for i in range(25)], []
    for i in range(20):
        passage = sum(draw.sample(lines, 5), [])
        given += [(2 * i + k, " ".join(words(7200 + 2 * i + k, 40) + passage + words(7300 + 2 * i + k, 40))) for k in (0, 1)]
    rows = passages.repeated_passages(make(given)).collect()
    found = {r.doc_id for r in rows if r.start_word <= 45 and r.end_word >= 95}
    assert len(found) >= 38


@pytest.mark.parametrize("few", [2, 64])
def test_passages_whose_parts_stand_in_other_documents(make, monkeypatch, few):
    """Five 12-word lines in an order that only two documents share, every line in many others: all forty are found."""
    monkeypatch.setattr(passages, "FEW", few)
    for seed in (1, 2, 4):
        draw, lines, given = random.Random(seed), [words(7100 + i, 12) for i in range(25)], []
        for i in range(20):
            passage = sum(draw.sample(lines, 5), [])
            given += [(2 * i + k, " ".join(words(7200 + 2 * i + k, 40) + passage + words(7300 + 2 * i + k, 40))) for k in (0, 1)]
        rows = passages.repeated_passages(make(given)).collect()
        assert {r.doc_id for r in rows if r.start_word <= 45 and r.end_word >= 95} == set(range(40))


def test_passages_of_frequent_lines_with_a_word_put_between(make, monkeypatch):
    """Two lines that many documents hold far from each other: those where one changed word parts them are found."""
    monkeypatch.setattr(passages, "FEW", 8)
    one, two = words(7500, 26), words(7501, 26)
    given = [(10 + i, " ".join(words(8500 + i, 10) + one + words(9000 + i, 60) + two + words(9500 + i, 10))) for i in range(400)]
    given += [(k, " ".join(words(7800 + k, 20) + one + words(7900 + k, 1) + two + words(8000 + k, 20))) for k in range(2)]
    rows = passages.repeated_passages(make(given)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in rows) == [(0, 20, 73), (1, 20, 73)]


def test_repeated_rows_are_one_document(make):
    passage = words(40, 70)
    given = [(1, " ".join(words(41, 80) + passage)), (2, " ".join(passage + words(43, 30)))]
    want = sorted(map(repr, passages.repeated_passages(make(given)).collect()))
    assert sorted(map(repr, passages.repeated_passages(make(given * 5)).collect())) == want and len(want) == 2


def test_passages_twice_in_one_document(make):
    """A document that holds a passage twice has both places reported, whichever document has the smaller key."""
    given = []
    for i in range(16):
        passage = words(5000 + i, 60)
        given += [(2 * i, words(5100 + i, 30) + passage + words(5200 + i, 200) + passage + words(5300 + i, 30)), (2 * i + 1, words(5400 + i, 20) + passage)]
    rows = passages.repeated_passages(make([(i, " ".join(x)) for i, x in given])).collect()
    want = [(2 * i, 30) for i in range(16)] + [(2 * i, 290) for i in range(16)] + [(2 * i + 1, 20) for i in range(16)]
    assert sorted((r.doc_id, r.start_word) for r in rows) == sorted(want)
    assert all(r.end_word - r.start_word == 60 for r in rows)
