"""What queries write and hold grows no faster than their input: seen on small graphs by the rows of the tables they make."""

import os
import random

import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__
from tracelode.operators import components, export, traverse
from tracelode.operators import graph as graphs
from tracelode.operators.graph import PropertyGraph

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NODE = "id string, type string, name string, full_name string, file_path string, summary string, is_exported boolean"
EDGE = "id string, type string, from_id string, to_id string, resolved boolean"


def graph(spark, nodes, edges):
    n = [(i, t, i, i, f"/repo/src/{i}.ts", "", True) for i, t in nodes]
    return PropertyGraph(spark.createDataFrame(n, NODE), spark.createDataFrame([(f"{t}:{a}:{b}", t, a, b, True) for a, t, b in edges], EDGE))


@pytest.fixture
def rows(monkeypatch):
    """Rows of every table that walks and measures write, in turn."""
    counts = []

    def counted(make):
        def run(df):
            out = make(df)
            counts.append(out.count())
            return out

        return run

    for module in (traverse, graphs, components, export):
        for name in ("stored", "checkpointed"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, counted(getattr(module, name)))
    return counts


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", ["scan_nodes", "filter_glob", "node_tokens", "leaf_nodes", "edges_by_type", "stats_edges_by_type", "neighbors", "provenance_header", "induced_edges", "core_modules"])
def test_a_query_of_one_pass_writes_nothing(spark, monkeypatch, name):
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *_, **__: pytest.fail("a table is written"))
    assert __spark_entry__.queries()[name](spark, FOLDER).count() > 0


def test_an_overview_walks_no_seed_after_the_cut(spark, rows):
    classes = [f"c{i:02}" for i in range(60)]
    g = graph(spark, [("p", "project"), ("f", "file"), *[(c, "class") for c in classes]], [*[("p", "ENTRY_POINT", c) for c in classes], *[("f", "DEFINES", c) for c in classes]])
    found = traverse.overview(g, traverse.overview_seeds(g), 20)
    first = sorted([(t, i) for i, t in [("p", "project"), ("f", "file"), *[(c, "class") for c in classes]]])[:20]
    assert found.truncated and sorted(r["id"] for r in found.nodes.collect()) == sorted(i for _, i in first)
    assert found.edges.count() == 120 and max(rows) < 400


def test_an_overview_over_several_seeds(spark):
    g = graph(spark, [("p", "project"), ("a", "file"), ("b", "file"), ("x", "class"), ("y", "class")], [("a", "DEFINES", "x"), ("b", "DEFINES", "y")])
    for most, nodes, edges, cut in ((1, "p", ["DEFINES:a:x"], True), (2, "px", ["DEFINES:a:x"], True), (3, "pax", ["DEFINES:a:x", "DEFINES:b:y"], True), (9, "pabxy", ["DEFINES:a:x", "DEFINES:b:y"], False)):
        found = traverse.overview(g, traverse.overview_seeds(g), most)
        assert (sorted(r["id"] for r in found.nodes.collect()), sorted(r["id"] for r in found.edges.collect()), found.truncated) == (sorted(nodes), edges, cut), most


def test_a_path_is_looked_for_from_the_narrower_end(spark, rows):
    wide = [("p", "OWNS", f"c{i:03}") for i in range(300)] + [(f"{a}{i:03}", "OWNS", f"{b}{i:03}") for a, b in ("ck", "km") for i in range(300)]
    g = graph(spark, [("p", "project")], [*wide, ("m007", "CALLS", "f"), ("m009", "CALLS", "f")])
    assert [r["id"] for r in traverse.find_path(g, "p", "f").orderBy("step").collect()] == ["p", "c007", "k007", "m007", "f"]
    assert sum(n >= 300 for n in rows) == 2  # what the project's one step crosses and reaches
    assert traverse.find_path(g, "f", "p").count() == 0 and traverse.find_path(g, "p", "f", 3).count() == 0 and traverse.find_path(g, "p", "f", 4).count() == 5


def test_paths_are_those_of_breadth_first_order(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(60)})
    g = graph(spark, [("n00", "file")], [(a, "CALLS", b) for a, b in pairs])
    onward = {}
    for a, b in pairs:
        onward.setdefault(a, []).append(b)
    for target in ("n01", "n07", "n13", "n24"):
        best, seen = {"n00": ([], ["n00"])}, {"n00"}
        while best and target not in best:
            step = {}
            for a, (by, path) in best.items():
                for b in onward.get(a, ()):
                    if b not in seen:
                        x = ([*by, f"CALLS:{a}:{b}"], [*path, b])
                        step[b] = min(step.get(b, x), x)
            best, seen = step, seen | set(step)
        want = best[target][1] if best else []
        assert [r["id"] for r in traverse.find_path(g, "n00", target).orderBy("step").collect()] == want


def test_components_shrink_with_every_round(spark, rows):
    rng = random.Random(3)
    ids = [f"n{i:03}" for i in range(240)]
    line = [(ids[i], ids[i + 1]) for i in range(120)]
    pairs = line + [(rng.choice(ids[130:]), rng.choice(ids[130:])) for _ in range(100)]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    g = graph(spark, [(i, "file") for i in ids], [(a, "CALLS", b) for a, b in pairs])
    assert {r["id"]: r["component"] for r in components.weak_components(g.nodes, g.edges).collect()} == {i: find(i) for i in ids}
    assert sum(n > len(pairs) / 2 for n in rows) <= 14  # the pairs once, and what is jumped over their roots


def test_edges_without_nodes_and_twice(spark):
    g = graph(spark, [("a", "file"), ("b", "file")], [("a", "CALLS", "b"), ("a", "CALLS", "b"), ("a", "CALLS", "x"), ("x", "CALLS", "b"), ("b", "CALLS", "b")])
    assert sorted(r["id"] for r in g.referential().collect()) == ["CALLS:a:b", "CALLS:b:b"]
    assert {r["id"]: r["importance"] for r in g.importance().collect()} == {"a": 1.0, "b": 1.0}
    assert export.core_modules(g).count() == 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_indexing_broadcasts_no_relation_of_the_files(spark):
    found = __spark_entry__.queries()["index_files"](spark, FOLDER)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") > 20 and plan.count("BroadcastHashJoin") == 0


def test_sources_of_one_small_file_are_parsed_by_many_tasks(spark, monkeypatch):
    from tracelode.operators import index as indexer

    held = []
    monkeypatch.setattr(indexer, "checkpointed", lambda df: held.append(df) or components.checkpointed(df))
    files = spark.createDataFrame([(f"/repo/f{i}.ts", "export const a = 1;\n") for i in range(200)], "path string, content string").coalesce(1)
    indexer.index(files, "demo", "/repo")
    assert held[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_rounds_by_country_are_the_same_graph(spark):
    from pyspark.sql import functions as F

    from tracelode.operators import analytics
    from tracelode.plans import walks
    from tracelode.plans.registry import Data
    from tracelode.sources.tables import on_spark

    d = Data(spark, FOLDER)
    edges = components.stored(on_spark(spark, FOLDER, walks.ROUNDS))
    nodes = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    mine, by_country, passed = walks._rounds(d)
    assert {r["id"] for r in mine.collect()} == {r["id"] for r in nodes.collect()} and passed.count() > 0
    tables = d.table("lineitem").where("l_returnflag = 'R' AND l_quantity > 40").count() + d.table("supplier").count() + d.table("customer").count()
    assert by_country.count() <= tables
    want = {r["id"]: r["betweenness"] for r in analytics.betweenness(nodes, edges).collect()}
    found = {r["id"]: r["betweenness"] for r in analytics.betweenness(mine, by_country, passed=passed).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want) and max(want.values()) > 0
    sizes = analytics.strong_components(nodes, edges).groupBy("component").count().groupBy("count").agg(F.count("*")).collect()
    assert {tuple(r) for r in sizes} == {tuple(r) for r in __spark_entry__.queries()["scc_sizes"](spark, FOLDER).collect()}
