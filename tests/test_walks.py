"""Cycles, components, centrality and streams on graphs made here, against plain Python."""

import random
from collections import deque

from tracelode.operators import analytics, traverse
from tracelode.streaming import watch


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"{u}>{v}", "CALLS", u, v, True) for u, v in pairs], "id string, type string, from_id string, to_id string, resolved boolean")


def test_long_cycles_are_found(spark):
    ring = [(f"a{i:02}", f"a{(i + 1) % 11:02}") for i in range(11)]
    tail = [("a00", "t0"), ("t0", "t1"), ("x", "a03"), ("s", "s")]
    found = traverse.cycles(edges_of(spark, ring + tail)).collect()
    assert [(r["length"], r["cycle"]) for r in found] == [(1, "s"), (11, ">".join(f"a{i:02}" for i in range(11)))]


def brute_cycles(pairs, most):
    onward, out = {}, set()
    for u, v in pairs:
        onward.setdefault(u, set()).add(v)

    def walk(path):
        for v in onward.get(path[-1], ()):
            if v == path[0]:
                out.add(tuple(path))
            elif v > path[0] and v not in path and len(path) < most:
                walk([*path, v])

    for u in onward:
        walk([u])
    return out


def test_cycles_against_brute_force(spark):
    rng = random.Random(6)
    pairs = {(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}") for _ in range(36)}
    want = sorted((len(c), ">".join(c)) for c in brute_cycles(pairs, 7))
    found = [(r["length"], r["cycle"]) for r in traverse.cycles(edges_of(spark, pairs), 7, 10_000, by_nodes=False).collect()]
    assert found == want and len(want) > 3


def test_betweenness_against_brute_force(spark):
    rng = random.Random(9)
    ids = [f"n{i:02}" for i in range(18)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)})
    onward = {u: [v for a, v in pairs if a == u] for u in ids}
    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        far, ways, queue = {s: 0}, {s: [[s]]}, deque([s])
        while queue:
            u = queue.popleft()
            for v in onward[u]:
                if v not in far:
                    far[v], ways[v] = far[u] + 1, []
                    queue.append(v)
                if far[v] == far[u] + 1:
                    ways[v] += [[*w, v] for w in ways[u]]
        for t, paths in ways.items():
            for p in paths:
                for x in p[1:-1]:
                    want[x] += 1 / len(paths)
    edges = edges_of(spark, pairs)
    nodes = spark.createDataFrame([(i,) for i in [*ids, "alone"]], "id string")
    found = {r["id"]: r["betweenness"] for r in analytics.betweenness(nodes, edges, normalised=False).collect()}
    assert found.keys() == {*ids, "alone"} and all(abs(found[i] - want.get(i, 0.0)) < 1e-9 for i in found)


def test_pagerank_stops_at_its_tolerance(spark):
    rng = random.Random(2)
    pairs = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(70)}
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(33)], "id string")
    ids, out = [f"n{i}" for i in range(33)], {}
    for u, v in pairs:
        out.setdefault(u, set()).add(v)
    rank = dict.fromkeys(ids, 1 / 33)
    for _ in range(200):
        lost = sum(r for i, r in rank.items() if i not in out)
        new = dict.fromkeys(ids, 0.15 / 33 + 0.85 * lost / 33)
        for u, vs in out.items():
            for v in vs:
                new[v] += 0.85 * rank[u] / len(vs)
        rank = new
    found = {r["id"]: r["rank"] for r in analytics.pagerank(nodes, edges_of(spark, pairs), 100, tolerance=1e-9).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and all(abs(found[i] - rank[i]) < 1e-7 for i in ids)


def test_state_says_each_change_once(spark, tmp_path):
    schema = "user_id long, ts timestamp, event_id long, value double"
    rows = [[(1, 3, 10, 1.0), (2, 1, 11, 2.0), (1, 2, 12, 9.0)], [(1, 1, 13, 7.0), (2, 5, 14, 3.0)], [(2, 5, 13, 8.0), (3, 0, 15, 4.0)]]
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    for batch in rows:
        spark.createDataFrame([(u, at(s), e, v) for u, s, e, v in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        watch.write_changes(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/offsets")
    found = sorted((r["batch"], r["user_id"], r["event_id"], r["value"], r["change"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [(0, 1, 10, 1.0, "added"), (0, 2, 11, 2.0, "added"), (1, 2, 14, 3.0, "changed"), (2, 3, 15, 4.0, "added")]
