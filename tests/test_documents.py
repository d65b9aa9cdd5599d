"""References, lineage, hashes and plans over definition documents; reachability."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from tandem.functions import text as tx
from tandem.operators import documents as doc
from tandem.operators import graph
from tandem.session import materialize

A, B, C = (f"{c * 8}-1111-2222-3333-{c * 12}" for c in "abc")
SA, SB = (f"{c * 8}-1111-2222-3333-{c * 12}" for c in "de")
PARTS, MAP = "item_id STRING, path STRING, payload STRING", "primary_ref STRING, secondary_ref STRING"


def remap(spark, text, mapping, **options):
    parts = spark.createDataFrame([("i", "p", text)], PARTS)
    return doc.remap_documents(parts, spark.createDataFrame(mapping, MAP), **options).first()["payload"]


def test_every_reference_is_replaced_once(spark):
    text = f'{{"ws":"{A}","again":"{A.upper()}","item":"{B}","unknown":"{C}"}}'
    assert remap(spark, text, [(A, SA), (B, SB)]) == f'{{"ws":"{SA}","again":"{SA}","item":"{SB}","unknown":"{C}"}}'


def test_replacements_do_not_chain(spark):
    assert remap(spark, f"{A} {B}", [(A, B), (B, C)]) == f"{B} {C}"


def test_texts_at_the_edges(spark):
    for text in ("", "no reference", A, f"{A}{B}", f"x{A}y", f"\n{A}\n", f"mark \u0001 {A} \u0001", "\u0001"):
        assert remap(spark, text, [(A, SA), (B, SB)]) == text.replace(A, SA).replace(B, SB)


def test_hosts_in_connection_strings_and_addresses(spark):
    hosts = [("p-1.datawarehouse.fabric.microsoft.com", "s-1.datawarehouse.fabric.microsoft.com"), ("q1.z1.kusto.example.com", "q2.z9.kusto.example.com")]
    text = 'Server=tcp:P-1.datawarehouse.fabric.microsoft.com,1433; "https://q1.z1.kusto.example.com/db" host q1.z1.kusto.example.com.'
    assert remap(spark, text, hosts) == 'Server=tcp:s-1.datawarehouse.fabric.microsoft.com,1433; "https://q2.z9.kusto.example.com/db" host q2.z9.kusto.example.com.'


def test_names_without_a_shape_need_a_wider_pattern(spark):
    mapping = spark.createDataFrame([("my (conn)", "dr conn"), (A, SA)], MAP)
    assert [r["primary_ref"] for r in doc.unfindable(mapping).collect()] == ["my (conn)"]
    assert remap(spark, f"use my (conn) of {A}", [("my (conn)", "dr conn"), (A, SA)], pattern=doc.literal_pattern(["my (conn)"])) == f"use dr conn of {SA}"


def test_names_are_replaced_as_whole_words_without_a_pattern(spark):
    mapping = [("Sales Connection", "DR Sales"), ("Sales", "DR"), ("db.local", "db2.local"), (A, SA), ("a\\\\Eb", "x"), ("No Such Name Here At All", "y")]
    text = f'{{"c": "Sales Connection", "d":"sales",  "h": "db.local:1433", "id": "{A}", "p": "PreSales Sales_x", "e": "a\\\\Eb"}}'
    want = f'{{"c": "DR Sales", "d":"DR",  "h": "db2.local:1433", "id": "{SA}", "p": "PreSales Sales_x", "e": "x"}}'
    assert remap(spark, text, mapping) == want
    parts = spark.createDataFrame([("i", "p", text), ("j", None, "Sales"), ("k", "q", None), ("l", "q", "")], "item_id STRING, path STRING, payload STRING")
    known = spark.createDataFrame([(m[0],) for m in mapping], "primary_ref STRING")
    found = {(r["item_id"], r["ref"]) for r in doc.stale_refs(parts, known).collect()}
    assert found == {("i", x) for x in ("sales connection", "sales", "db.local", A.lower(), "a\\\\eb")} | {("j", "sales")}
    plan = {r["item_id"]: (r["stale_refs"], r["action"]) for r in doc.fix_plan(parts, known).collect()}
    assert plan == {"i": (5, "fixed"), "j": (1, "fixed"), "k": (0, "skipped"), "l": (0, "skipped")}


def test_identity_parts_are_dropped_and_base64_survives(spark):
    parts = spark.createDataFrame([("i", ".platform", "x"), ("i", "sub/.platform", "x"), ("i", "a.platform", base64.b64encode(("é" * 80 + A).encode()).decode())], PARTS)
    out = doc.encode_parts(doc.remap_documents(doc.decode_parts(parts), spark.createDataFrame([(A, SA)], MAP))).collect()
    assert [(r["path"], base64.b64decode(r["payload"]).decode()) for r in out] == [("a.platform", "é" * 80 + SA)]
    assert "\n" not in out[0]["payload"]
    assert spark.createDataFrame([("%%%",)], "v STRING").select(tx.decode_payload("v")).first()[0] == ""


def test_a_reference_in_most_documents_does_not_gather_them(spark):
    parts = spark.range(3000).select(F.col("id").cast("string").alias("item_id"), F.lit("p").alias("path"),
                                     F.when(F.col("id") % 3 != 0, F.lit(f"ws {A}")).otherwise(F.concat(F.lit("only "), F.col("id").cast("string"))).alias("payload"))
    mapping = spark.createDataFrame([(A, SA)], MAP)
    out = doc.remap_documents(parts, mapping)
    assert out.filter(F.col("payload") == f"ws {SA}").count() == 2000 and out.count() == 3000
    assert doc.stale_refs(parts, mapping).count() == 2000


def test_lineage_states(spark):
    items = spark.createDataFrame([(A, "primary", "Lakehouse"), (SA, "secondary", "Lakehouse"), (B, "primary", "Notebook"), (C, "primary", "WorkspaceId"), (SB, "secondary", "WorkspaceId")],
                                  "item_id STRING, side STRING, item_type STRING")
    parts = spark.createDataFrame([("me", "a", f"{SA} {SB} {C}"), ("me", "b", f"{A} {B} {SA}"), (SA, "a", f"self {SA}")], PARTS)
    got = {(r["source_id"], r["target_id"]): (r["status"], r["expected_id"], r["part_path"]) for r in doc.lineage_edges(parts, items, spark.createDataFrame([(A, SA)], MAP)).collect()}
    assert got == {("me", SA): ("healthy", None, "a"), ("me", A): ("stale", SA, "b"), ("me", B): ("stale", None, "b"), ("me", C): ("stale", None, "a")}


def test_hash_ignores_order_repetition_and_identity_but_not_content(spark):
    rows = lambda *parts: spark.createDataFrame([("i", p, b) for p, b in parts], PARTS)
    value = lambda df: doc.definition_hash(df).first()["definition_hash"]
    base = value(rows(("a", "1"), ("b", "2")))
    assert base == value(rows(("b", "2"), (".platform", "id"), ("a", "1"), ("a", "1")))
    assert base not in {value(rows(("a", "12"), ("b", ""))), value(rows(("a", "2"), ("b", "1"))), value(rows(("a", "1")))}


def test_definition_states(spark):
    keys = "item_type STRING, display_name STRING"
    items = spark.createDataFrame([("Notebook", n) for n in ("same", "saved", "dirty", "differs", "broken")] + [("Lakehouse", "l")], keys)
    hashes = lambda rows: spark.createDataFrame(rows, keys + ", definition_hash STRING")
    p = hashes([("Notebook", "same", "1"), ("Notebook", "saved", "2"), ("Notebook", "dirty", "3"), ("Notebook", "differs", "4"), ("Lakehouse", "l", "5")])
    s = hashes([("Notebook", "same", "1"), ("Notebook", "saved", "x"), ("Notebook", "dirty", "x"), ("Notebook", "differs", "x")])
    state = spark.createDataFrame([("Notebook", "saved", "2", False), ("Notebook", "dirty", "3", True)], keys + ", primary_hash STRING, changed BOOLEAN")
    got = {r["display_name"]: r["action"] for r in doc.definition_delta(items, p, s, state).collect()}
    assert got == {"same": "unchanged", "saved": "unchanged", "dirty": "synced", "differs": "synced", "broken": "export_failed", "l": "not_supported"}


def test_storage_modes_of_text_and_json(spark):
    bim = '{"model":{"tables":[{"partitions":[{"mode":"directLake"},{"mode":""},{}]},{"name":"no partitions"}]}}'
    parts = spark.createDataFrame([(1, "t.tmdl", "partition a\n\tmode: dual\n  partition b\n"), (1, "model.bim", bim), (2, "model.bim", "{bad"), (3, "other", "mode: import")],
                                  "model_id INT, path STRING, body STRING")
    assert {(r["model_id"], r["mode"]): r["partitions"] for r in doc.storage_modes(parts).collect()} == {(1, "dual"): 1, (1, "import"): 3, (1, "directLake"): 1}


def test_connection_map_matches_type_and_name(spark):
    schema = "item_type STRING, display_name STRING, item_id STRING"
    p = spark.createDataFrame([("Lakehouse", "x", A), ("SQLEndpoint", "x", B), ("Report", "same", C)], schema)
    s = spark.createDataFrame([("SQLEndpoint", "x", SB), ("Lakehouse", "x", SA), ("Report", "same", C)], schema)
    hosts = spark.createDataFrame([("Lakehouse", "x", "tcp:P1.datawarehouse.fabric.microsoft.com,1433", "s1.dr-database.fabric.microsoft.com"), ("Lakehouse", "y", "none", "")],
                                  "item_type STRING, display_name STRING, p_conn STRING, s_conn STRING")
    got = {(r["primary_ref"], r["secondary_ref"]) for r in doc.connection_map(p, s, hosts).collect()}
    assert got == {(A, SA), (B, SB), ("p1.datawarehouse.fabric.microsoft.com", "s1.dr-database.fabric.microsoft.com")}


def test_reach_with_cycles_and_a_hub(spark):
    edges = [(0, 0), (0, 1), (1, 2), (2, 0), (2, 3)] + [(3, n) for n in range(10, 60)]
    want, links = {}, {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(links.get(n, ()))
        while todo:
            m = todo.pop()
            if m not in seen:
                seen.add(m)
                todo += links.get(m, ())
        want[n] = len(seen - {n})
    df = spark.createDataFrame(edges, "upstream BIGINT, downstream BIGINT")
    assert {r["node"]: r["downstream"] for r in graph.blast_radius(df).collect()} == want
    with pytest.raises(ValueError):
        graph.blast_radius(df, max_rounds=1)


def test_checkpoints_go_to_the_shared_folder(spark):
    assert "Scan ExistingRDD" in materialize(spark.range(3))._jdf.queryExecution().executedPlan().toString()


def _reachable(edges):
    out = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            out.setdefault(a, set()).add(b)
    found = {}
    for start in {x for e in edges for x in e if x is not None}:
        seen, todo = set(), list(out.get(start, ()))
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo.extend(out.get(node, ()))
        found[start] = seen - {start}
    return found


@pytest.mark.parametrize("local_nodes, block", [(4096, 1024), (3, 4)])
def test_reachability_of_random_graphs(spark, local_nodes, block):
    """Cycles, loops, nulls, repeats, many small components; the second setting sends nearly all through blocks."""
    rng = random.Random(7)
    edges = [(f"a{rng.randrange(14)}", f"a{rng.randrange(14)}") for _ in range(20)] + [(f"b{i}", f"b{rng.randrange(i)}") for i in range(1, 12)]
    edges += [(f"c{i}", f"c{i % 2}x") for i in range(6)] + [("d", "d"), ("e", None), (None, "e"), *edges[:3]]
    want = _reachable(edges)
    frame = spark.createDataFrame(edges, "upstream string, downstream string")
    got = {r.node: r.downstream for r in graph.blast_radius(frame, local_nodes=local_nodes, block=block).collect() if r.node is not None}
    assert got == {k: len(v) for k, v in want.items()}
    pairs = graph.transitive_members(frame.toDF("group_id", "member_id"), local_nodes=local_nodes, block=block).collect()
    assert len(pairs) == len(set(pairs)) and {tuple(p) for p in pairs} == {(k, x) for k, v in want.items() for x in v}


def test_reachability_of_a_long_chain_and_a_long_cycle(spark):
    """Five thousand nodes in a row, and as many in a ring, take rounds by the logarithm of the length."""
    n = 5000
    edges = [(i, i + 1) for i in range(n - 1)] + [(n + i, n + (i + 1) % n) for i in range(n)]
    frame = spark.createDataFrame(edges, "upstream bigint, downstream bigint")
    got = {r.node: r.downstream for r in graph.blast_radius(frame, max_rounds=16).collect()}
    assert got == {i: n - 1 - i for i in range(n)} | {n + i: n - 1 for i in range(n)}


def test_reachability_of_a_wide_lineage_needs_no_matrix(spark, monkeypatch):
    """Six thousand items, each fed by two earlier ones, and a cycle: pairs are few, so no blocks are multiplied."""
    def multiplied(block):
        raise AssertionError("blocks are multiplied")

    monkeypatch.setattr(graph, "_multiply", multiplied)
    edges = [(i // k, i) for i in range(6000) for k in (2, 3)] + [(5999, 5990), (5990, 5999)]
    got = {r.node: r.downstream for r in graph.blast_radius(spark.createDataFrame(edges, "upstream bigint, downstream bigint")).collect()}
    assert got == {k: len(v) for k, v in _reachable(edges).items()}


@pytest.mark.parametrize("steps", [0, 1])
def test_reachability_goes_on_in_blocks(spark, monkeypatch, steps):
    """Blocks take over where the rounds of one edge end, or where pairs become too many."""
    rng = random.Random(11)
    edges = [(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}") for _ in range(45)] + [(f"b{i}", f"b{i + 1}") for i in range(20)]
    if steps:
        monkeypatch.setattr(graph, "FEW_PAIRS", 50)
        monkeypatch.setattr(graph, "SPARSE", 10**6)
    want = _reachable(edges)
    frame = spark.createDataFrame(edges, "upstream string, downstream string")
    got = {r.node: r.downstream for r in graph.blast_radius(frame, local_nodes=3, block=4, steps=steps).collect()}
    assert got == {k: len(v) for k, v in want.items()}
    pairs = graph.transitive_members(frame.toDF("group_id", "member_id"), local_nodes=3, block=4, steps=steps).collect()
    assert len(pairs) == len(set(pairs)) and {tuple(p) for p in pairs} == {(k, x) for k, v in want.items() for x in v}
