"""Registered queries against DuckDB on the smallest data; and that every one is registered as it should be."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SOME = ["degree", "hubs", "importance", "dir_communities", "find_related_capped", "project_overview", "cycles_dedup", "call_chains", "pagerank", "betweenness", "scc_count", "edges_calls", "resolve_imports", "join_suffix", "edge_explanations", "semantic_role", "prune_token_budget", "snapshot_diff", "fingerprint", "page_links"]


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_equal(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 25
