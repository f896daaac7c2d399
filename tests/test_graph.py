"""The graph engine on small graphs whose answers are plain to see."""

import hashlib
import json
import random
from collections import deque

import pytest

from tracelode.operators import analytics, budget, export, resolve, tables, traverse
from tracelode.operators.components import weak_components
from tracelode.operators.graph import PropertyGraph
from tracelode.operators.search import find_by_name, resolve_focus

NODE = "id string, type string, name string, full_name string, file_path string, summary string, is_exported boolean"
EDGE = "id string, type string, from_id string, to_id string, resolved boolean"


def graph(spark, nodes, edges):
    n = [(i, t, i, i, f"/repo/src/{i}.ts", "", True) for i, t in nodes]
    e = [(f"{t}:{a}:{b}", t, a, b, t != "CALLS_UNRESOLVED") for a, t, b in edges]
    return PropertyGraph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_chain(spark):
    g = graph(spark, [(x, "function") for x in "abcd"], [("a", "CALLS", "b"), ("b", "CALLS", "c"), ("a", "CALLS", "a")])
    assert [r["id"] for r in traverse.find_path(g, "a", "c").orderBy("step").collect()] == ["a", "b", "c"]
    assert traverse.find_path(g, "c", "a").count() == 0
    assert [r["id"] for r in traverse.find_path(g, "a", "a").collect()] == ["a"]
    assert {r["id"]: (r["in_degree"], r["out_degree"]) for r in g.degrees().collect()} == {"a": (1, 2), "b": (1, 1), "c": (1, 0), "d": (0, 0)}
    assert ids(g.neighbours("b")) == ["a", "b", "c"]
    assert g.health().first().asDict() == {"node_count": 4, "edge_count": 3, "unresolved_count": 0, "isolated_count": 1}
    assert traverse.path_edges(g, traverse.find_path(g, "a", "c")).count() == 2


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert g.degrees().count() == g.importance().count() == g.referential().count() == 0
    assert traverse.find_related(g, "x", 2).nodes.count() == 0
    document = export.bundle(g, {}, {})
    assert document["nodes"] == document["edges"] == [] and json.loads(export.to_json(document)) == document
    assert export.ai_bundle(g, {}, {})["summary"]["cycles"] == []


def test_entry_chain_with_an_absent_source(spark):
    g = graph(spark, [("main", "function"), ("handler", "function")], [("project", "ENTRY_POINT", "main"), ("main", "CALLS", "handler")])
    chains = traverse.call_chains(g.entry_points().select("id"), g.edges_of("CALLS"))
    assert [r["chain"] for r in chains.collect()] == ["main>handler"]
    assert g.referential().count() == 1
    assert g.induced(g.nodes, keep_entry_points=True).count() == 2
    assert export.ai_bundle(g, {}, {})["summary"]["entryPoints"] == ["main"]


def sequential(nodes, edges, start, depth, most):
    """Breadth-first expansion one node at a time."""
    seen, found_edges, queue, truncated = {start}, set(), deque([(start, 0)]), False
    out = sorted((f"{t}:{a}:{b}", a, b) for a, t, b in edges)
    while queue:
        if len(seen) >= most:
            truncated = True
            break
        at, d = queue.popleft()
        if d > depth:
            continue
        for e, a, b in [x for x in out if x[1] == at] + [x for x in out if x[2] == at]:
            found_edges.add(e)
            other = b if a == at else a
            if other not in seen:
                seen.add(other)
                if d < depth:
                    queue.append((other, d + 1))
    return sorted(seen & set(nodes)), sorted(found_edges), truncated


@pytest.mark.parametrize("seed", range(4))
def test_related(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i:02}" for i in range(14)]
    edges = sorted({(rng.choice(names), rng.choice(["CALLS", "USES"]), rng.choice(names)) for _ in range(18)})
    g = graph(spark, [(n, "function") for n in names], edges)
    whole = traverse.find_related(g, "v00", 1)
    nodes, found, _ = sequential(names, edges, "v00", 1, 10**9)
    assert (ids(whole.nodes), ids(whole.edges)) == (nodes, found)
    for most in (3, 6):
        cut = traverse.find_related_capped(g, "v00", 2, most)
        assert (ids(cut.nodes), ids(cut.edges), cut.truncated) == sequential(names, edges, "v00", 2, most)


def test_measures(spark):
    edges = [("a", "CALLS", "b"), ("b", "CALLS", "c"), ("c", "CALLS", "d"), ("d", "CALLS", "b"), ("e", "USES", "f")]
    g = graph(spark, [(x, "function") for x in "abcdef"], edges)
    ranks = {r["id"]: r["rank"] for r in analytics.pagerank(g.nodes, g.edges, rounds=100, tolerance=1e-9).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["b"] > ranks["a"]
    path = graph(spark, [(x, "function") for x in "abcd"], [("a", "CALLS", "b"), ("b", "CALLS", "c"), ("c", "CALLS", "d")])
    between = {r["id"]: r["betweenness"] for r in analytics.betweenness(path.nodes, path.edges, normalised=False).collect()}
    assert between == {"a": 0, "b": 2, "c": 2, "d": 0}
    assert {r["id"]: r["component"] for r in analytics.strong_components(g.nodes, g.edges).collect()} == {"a": "a", "b": "b", "c": "b", "d": "b", "e": "e", "f": "f"}
    assert {r["id"]: r["component"] for r in weak_components(g.nodes, g.edges).collect()} == dict(zip("abcdef", "aaaaee", strict=True))
    assert [r["cycle"] for r in traverse.cycles(g.edges, 5).collect()] == ["b>c>d"]
    two = [(x, "CALLS", y) for part in ("abc", "xyz") for x in part for y in part if x < y] + [("c", "CALLS", "x")]
    apart = {r["id"]: r["community"] for r in analytics.communities(graph(spark, [(x, "function") for x in "abcxyz"], two).nodes.select("id"), graph(spark, [], two).edges).collect()}
    assert len({apart[x] for x in "abc"}) == len({apart[x] for x in "xyz"}) == 1 and apart["a"] != apart["x"]
    assert [r["path"] for r in traverse.all_shortest_paths(g.edges, "a", "d").collect()] == ["a>b>c>d"]
    assert ids(traverse.closure(g.edges, "b", reverse=True)) == ["a", "c", "d"]


def test_budget_skips_and_goes_on(spark):
    rng = random.Random(8)
    items = [(f"i{k:03}", k, rng.randrange(1, 40)) for k in range(200)]
    want, left = [], 150
    for i, _, t in items:
        if t <= left:
            want.append(i)
            left -= t
    df = spark.createDataFrame(items, "id string, place int, tokens int")
    for batch in (1000, 7):
        assert budget.take_fitting(df, 150, ["place", "id"], batch=batch) == want
    assert budget.split_budget(8000) == (4480, 1920)


def test_tables(spark):
    old = spark.createDataFrame([("a", "1", 1, 1), ("b", "2", 1, 1)], "path string, hash string, created_at long, updated_at long")
    new = spark.createDataFrame([("b", "3", 5, 5), ("c", "4", 5, 5)], "path string, hash string, created_at long, updated_at long")
    assert sorted(map(tuple, tables.upsert(old, new, ["path"]).collect())) == [("a", "1", 1, 1), ("b", "3", 1, 5), ("c", "4", 5, 5)]
    assert sorted(map(tuple, tables.difference(old, new, "path", "hash").collect())) == [("a", "removed"), ("b", "changed"), ("c", "added")]
    assert tables.difference(old, old, "path", "hash").count() == 0


def test_removal_keeps_integrity(spark):
    g = graph(spark, [(x, "class") for x in "abc"], [("a", "EXTENDS", "b"), ("b", "EXTENDS", "c")]).without(spark.createDataFrame([("b",)], "id string"))
    assert ids(g.nodes) == ["a", "c"] and g.edges.count() == 0


def test_search(spark):
    g = graph(spark, [("Alpha", "class"), ("alphabet", "class"), ("beta", "class")], [])
    assert [r["id"] for r in find_by_name(g, " ALPHA ").collect()] == ["Alpha", "alphabet"] and find_by_name(g, "  ").count() == 0
    assert resolve_focus(g, "Alpha").first()["tier"] == 1 and resolve_focus(g, "ALPHA").first()["tier"] == 2
    assert resolve_focus(g, "BET").count() == 0 and resolve_focus(g, "eta").first()["id"] == "beta"


def test_names(spark):
    files = spark.createDataFrame([("/r/a.ts", "A"), ("/r/lib/b.ts", "B"), ("/r/c/index.ts", "C")], "path string, id string")
    rows = [(1, "/r/a.ts", "./lib/b.js"), (2, "/r/a.ts", "@x/b"), (3, "/r/lib/b.ts", "../c"), (4, "/r/a.ts", "left-pad"), (5, "/r/a.ts", "./gone")]
    imports = spark.createDataFrame(rows, "ord int, file_path string, module string")
    aliases = spark.createDataFrame([("@x/", "", "/r/lib/*", 0)], "prefix string, suffix string, target string, priority int")
    found = {r["ord"]: (r["target_id"], r["external"]) for r in resolve.resolve_imports(imports, files, aliases, "/r").collect()}
    assert found == {1: ("B", False), 2: ("B", False), 3: ("C", False), 4: ("module:left-pad", True), 5: ("module:./gone", False)}


def test_fingerprint_ignores_order(spark):
    edges = [("a", "CALLS", "b"), ("b", "USES", "c")]
    one = export.fingerprint(graph(spark, [(x, "class") for x in "abc"], edges)).first()[0]
    two = export.fingerprint(graph(spark, [(x, "class") for x in "cba"], edges[::-1])).first()[0]
    assert one == two != export.fingerprint(graph(spark, [(x, "class") for x in "abd"], edges)).first()[0]


def test_yaml():
    assert export.to_yaml({"a": [{"b": 1, "c": []}, "x: y"], "d": {"e": None}}) == 'a:\n  - b: 1\n    c: []\n  - "x: y"\nd:\n  e: null'
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
