"""Files to one graph, the store, and the endpoints over it."""

import pytest
from pyspark.sql import functions as F

from tracelode.operators import index as indexer
from tracelode.operators.endpoints import Endpoints, Refused
from tracelode.sources import files as sources
from tracelode.sources.store import SCHEMAS, Store

BASE = "export class Base {\n  close() { }\n}\n/** Makes one. */\nexport function make() {\n  return new Base();\n}\n"
MAIN = 'import { Base, make as build } from "./base.js";\nimport { log } from "@lib/log";\nimport ext from "left-pad";\n\n@Tagged\nexport class Main extends Base {\n  run() {\n    build();\n    log("x");\n    ext.pad();\n  }\n}\nexport function main() {\n  helper();\n}\nfunction helper() { }\n'
LOG = "export function log(text) { }\nexport function Tagged() { }\n"
SERVER = 'import { main } from "./main";\nexport * from "./base";\napp.get("/x", main);\n'
TEST = 'import { main } from "./main";\ndescribe("main", () => { it("runs", () => { main(); }); });\n'
FILES = {"/repo/base.ts": BASE, "/repo/main.ts": MAIN, "/repo/lib/log.ts": LOG, "/repo/server.ts": SERVER, "/repo/main.test.ts": TEST, "/repo/empty.ts": ""}


def listed(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    return df.select("*", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size"))


@pytest.fixture(scope="module")
def built(spark):
    aliases = spark.createDataFrame([("@lib/", "", "/repo/lib/*", 0)], "prefix string, suffix string, target string, priority int")
    return indexer.index(listed(spark, FILES), "demo", "/repo", aliases)


def test_edges_of_files(built):
    names = {r["id"]: r["name"] for r in built.nodes.collect()}
    found = {(r["type"], names[r["from_id"]], names[r["to_id"]], r["resolved"]) for r in built.edges.collect()}
    want = {
        ("EXTENDS", "Main", "Base", True), ("OWNS", "Main", "run", True), ("OWNS", "Base", "close", True), ("OWNS", "demo", "empty.ts", True),
        ("IMPORTS", "main.ts", "base.ts", True), ("IMPORTS", "main.ts", "lib/log.ts", True), ("IMPORTS", "main.ts", "left-pad", False), ("IMPORTS", "main.ts", "make", True),
        ("DEPENDS_ON", "main.ts", "base.ts", True), ("DEPENDS_ON", "server.ts", "main.ts", True), ("EXPORTS", "server.ts", "base.ts", True), ("EXPORTS", "base.ts", "make", True),
        ("CALLS", "run", "make", True), ("CALLS", "run", "log", True), ("CALLS_UNRESOLVED", "run", "ext.pad", False), ("CALLS", "main", "helper", True), ("CALLS", "make", "Base", True),
        ("TESTS", "main.test.ts", "main.ts", True), ("TESTS", "main.test.ts", "main", True), ("DECORATES", "Tagged", "Main", True), ("DOCUMENTS", "doc:make", "make", True),
        ("USES", "GET /x", "main", True), ("ENTRY_POINT", "demo", "main", True), ("ENTRY_POINT", "demo", "GET /x", True),
    }
    assert want <= found, want - found
    assert not [e for e in found if e[0] == "DEFINES" and e[1] == "empty.ts"]


def test_every_end_is_a_node_and_ids_are_unique(built):
    ids = [r["id"] for r in built.nodes.collect()]
    edges = built.edges.collect()
    assert len(ids) == len(set(ids)) and len({e["id"] for e in edges}) == len(edges)
    assert {e["from_id"] for e in edges} | {e["to_id"] for e in edges} <= set(ids)


def test_provenance_has_the_text(built):
    names = {r["id"]: r["name"] for r in built.nodes.collect()}
    spans = {(names[r["subject_id"]], r["source_file"]): r for r in built.provenance.where("subject = 'node'").collect()}
    run = spans["run", "/repo/main.ts"]
    assert (run["start_line"], run["end_line"], run["start_col"]) == (7, 11, 3) and run["text"].startswith("run() {") and run["text"].endswith("}")
    assert spans["Base", "/repo/base.ts"]["text"].startswith("class Base") and spans["Base", "/repo/base.ts"]["end_line"] == 3
    assert built.provenance.where("subject = 'edge' AND confidence < 1").count() == 1


def test_store_swaps_whole_graphs(spark, built, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "demo")
    store.create()
    assert all(store.read(t).count() == 0 for t in SCHEMAS)
    store.replace_graph(built.nodes, built.edges, built.provenance)
    graph = store.graph()
    assert graph.closed and graph.nodes.count() == built.nodes.count() and graph.edges.count() == built.edges.count()
    one = built.edges.where("type = 'EXTENDS'").first()
    assert {r["id"] for r in graph.incoming(one["to_id"]).collect()} == {r["id"] for r in built.edges.where(F.col("to_id") == one["to_id"]).collect()}
    store.replace_graph(built.nodes.where("type = 'file'"), built.edges.limit(0))
    assert store.read("nodes").count() == len(FILES) and store.read("edges_by_target").count() == 0 and store.read("provenance").count() == 0
    folders = [p.name for p in next((tmp_path / "s").iterdir()).iterdir() if p.is_dir()]
    assert len(folders) == len(SCHEMAS) + 1  # what was replaced is gone
    store.replace_graph(built.nodes.limit(1), built.edges)
    assert not store.graph().closed


def test_update_indexes_again_only_after_a_change(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "demo")
    indexer.rebuild(store, listed(spark, FILES), "/repo", time=5)
    before = store._current()["tables"]["nodes"]
    assert indexer.update(store, listed(spark, FILES), "/repo", time=6).count() == 0 and store._current()["tables"]["nodes"] == before
    fewer = {k: v for k, v in FILES.items() if k != "/repo/base.ts"} | {"/repo/new.ts": "export const A = 1;\n"}
    changes = {(r["path"], r["change"]) for r in indexer.update(store, listed(spark, fewer), "/repo", time=7).collect()}
    assert changes == {("/repo/base.ts", "removed"), ("/repo/new.ts", "added")}
    assert store.read("nodes").where("name = 'Base'").isEmpty() and not store.read("nodes").where("name = 'A'").isEmpty()
    state, project = store.read("index_state").first(), store.read("projects").first()
    assert (state["file_count"], state["updated_at"], project["created_at"]) == (len(FILES), 7, 5)


def test_scan_reads_what_is_supported(spark, tmp_path):
    for path, text in {"a/x.ts": "1", "a/y.txt": "2", "b/z.jsx": "3", "node_modules/q.ts": "4"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    rows = sources.scan(spark, f"file://{tmp_path}", exclude=["node_modules"]).collect()
    assert sorted((r["path"], r["content"], r["size"]) for r in rows) == [("a/x.ts", "1", 1), ("b/z.jsx", "3", 1)]
    assert sources.scan(spark, f"file://{tmp_path}", endings=[".txt"]).first()["path"] == "a/y.txt"


def test_json_document(spark):
    nodes, edges = sources.json_document(spark, '{"nodes": [{"id": "a", "type": "file", "name": "A"}], "edges": [{"from": "a", "to": "a", "type": "CALLS"}]}')
    assert nodes.first()["name"] == "A" and tuple(edges.first()) == ("CALLS:a:a", "CALLS", "a", "a", True)


def test_endpoints(spark, built, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "demo")
    store.replace_graph(built.nodes, built.edges, built.provenance)
    api = Endpoints(store.graph(), files=listed(spark, FILES), root="/repo")
    ids = {r["name"]: r["id"] for r in built.nodes.collect()}
    assert set(api.api_graph()) >= {"nodes", "edges", "ranking", "health", "hubs", "communities"} and api.api_graph()["nodes"].count() == built.nodes.count()
    assert api.node(ids["Main"])["node"].first()["name"] == "Main"
    assert "main" in {r["name"] for r in api.search("MAIN")["nodes"].collect()}
    assert api.related(ids["helper"], 1)["nodes"].count() >= 3
    path = api.path(ids["server.ts"], ids["base.ts"])
    assert [r["name"] for r in path["path"].orderBy("step").collect()] == ["server.ts", "base.ts"] and path["edges"].count() == 1
    assert api.path(ids["helper"], ids["demo"])["path"].count() == 0
    assert "main" in {r["name"] for r in api.entry_points()["nodes"].collect()}
    assert sum(r["n"] for r in api.stats()["nodes_by_type"].collect()) == built.nodes.count()
    assert api.analytics()["health"].first()["unresolved_count"] >= 2
    assert [r["line"] for r in api.source("main.ts", 7, 8, 1)["lines"].orderBy("line").collect()] == [6, 7, 8, 9]
    for status, call in ((404, lambda: api.node("none")), (400, lambda: api.search("  ")), (400, lambda: api.path("", "x")), (403, lambda: api.source("../etc/passwd")), (404, lambda: api.source("no.ts"))):
        with pytest.raises(Refused) as e:
            call()
        assert e.value.status == status
