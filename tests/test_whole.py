"""Registered queries do the whole job: on folders made so that a part of the job would show."""

import hashlib
import json
import os
from pathlib import Path

import pytest

import __spark_entry__
from tracelode.operators import export
from tracelode.plans.registry import Data

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture
def folder(spark, tmp_path):
    """The smallest tables, with orders of large keys added and the first ten parts in no line item."""
    for name in ("region", "nation", "customer", "supplier", "part"):
        os.symlink(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("orders", "lineitem"))
    later = orders.withColumn("o_orderkey", (orders["o_orderkey"] + 10**6).cast(orders.schema["o_orderkey"].dataType))
    orders.union(later).write.parquet(str(tmp_path / "orders.parquet"))
    items.where("l_partkey > 10").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_calls_of_all_orders(spark, folder):
    d = Data(spark, folder)
    assert d.bound("calls").count() == d.table("orders").count()
    assert __spark_entry__.queries()["join_local_symbol"](spark, folder).where("ord >= 1000000").count() == d.table("orders").where("o_orderkey >= 1000000").count()


def test_components_of_the_full_graph(spark, folder):
    d = Data(spark, folder)
    parent = {r["id"]: r["id"] for r in d.graph.nodes.select("id").collect()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in d.graph.edges.select("from_id", "to_id").collect():
        parent[find(r["from_id"])] = find(r["to_id"])
    want = len({find(x) for x in parent})
    assert want > 10 and __spark_entry__.queries()["wcc_count"](spark, folder).first()["full_count"] == want


def test_budget_of_the_whole_graph(spark, folder):
    d = Data(spark, folder)
    taken = __spark_entry__.queries()["prune_token_budget"](spark, folder).where("part = 'node'")
    kinds = {r["type"]: r["count"] for r in taken.join(d.graph.nodes, "id").groupBy("type").count().collect()}
    assert kinds.get("function", 0) > 0


def test_scan_of_the_whole_folder(spark):
    found = {r["path"]: (r["hash"], r["size"]) for r in __spark_entry__.queries()["scan_files"](spark, FOLDER).collect()}
    want = {str(f.relative_to(FOLDER)): (hashlib.sha256(f.read_bytes()).hexdigest(), f.stat().st_size) for f in Path(FOLDER).rglob("*.parquet") if f.is_file()}
    assert len(want) > 1 and found == want


def test_ai_bundle_of_the_whole_graph(spark, folder):
    document = json.loads(__spark_entry__.queries()["export_ai"](spark, folder).first()["document"])
    best = export.ai_result(Data(spark, folder).graph, 200).importance().collect()
    assert [r["id"] for r in document["ranking"]] == [r["id"] for r in sorted(best, key=lambda r: (-r["importance"], r["id"]))[:50]]
