"""The registered PageRank against plain power iteration, at the operator's default rounds."""

import os

import pytest

import __spark_entry__
from tracelode.plans.registry import Data

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(ids, pairs, rounds):
    n, out, rank = len(ids), {}, dict.fromkeys(ids, 1 / len(ids))
    for u, v in pairs:
        out.setdefault(u, []).append(v)
    for _ in range(rounds):
        lost = sum(r for i, r in rank.items() if i not in out)
        new = dict.fromkeys(ids, 0.15 / n + 0.85 * lost / n)
        for u, targets in out.items():
            for v in targets:
                new[v] += 0.85 * rank[u] / len(targets)
        rank = new
    return rank


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_pagerank(spark):
    g = Data(spark, FOLDER).graph
    ids = [r["id"] for r in g.nodes.select("id").collect()]
    pairs = {(r["from_id"], r["to_id"]) for r in g.edges.select("from_id", "to_id").collect()}
    found = {r["id"]: r["rank"] for r in __spark_entry__.queries()["pagerank"](spark, FOLDER).collect()}
    apart = lambda rounds: max(abs(found[i] - r) for i, r in plain(ids, pairs, rounds).items())
    assert set(found) == set(ids) and apart(20) < 2e-9 < apart(5)
