"""Parsing, scanning, snippets and streams."""

import pytest

from tracelode.sources import files, parser
from tracelode.streaming import watch

#: Small sources in the languages that the parser reads.
SAMPLES = [
    ("/repo/src/main.ts", 'import { load, type Row } from "./store.js";\nimport cfg from "./settings.json";\nimport * as util from "../util";\n\n/** Starts it all. */\nexport async function main(argv: string[]): Promise<void> {\n  const rows = await load(process.env.DATA_DIR);\n  util.show(rows.map((r) => r.id));\n}\n\nexport default main;\n'),
    ("/repo/src/store.ts", 'import { Base, Closable } from "./base";\nexport interface Row { id: number; name?: string }\nexport type Rows = Row[];\nexport enum Mode { A, B }\nexport const LIMIT = 10;\nlet opened = false;\n\n@Injectable()\nexport class Store extends Base<Row> implements Closable, Countable {\n  private rows: Rows = [];\n  constructor(private path: string) { super(); }\n  /** Reads a file. */\n  async read(name: string): Promise<Rows> {\n    const x = new Reader(name);\n    this.rows = parseRows(await x.text());\n    return this.rows;\n  }\n  get size(): number { return this.rows.length; }\n  static of(p: string) { return new Store(p); }\n}\n\nexport const load = async (dir?: string) => {\n  const s = Store.of(dir ?? "/data");\n  return s.read("rows");\n};\nexport { opened as isOpen };\nexport * from "./base";\n'),
    ("/repo/src/server.ts", 'import express from "express";\nimport dotenv from "dotenv";\ndotenv.config();\nconst app = express();\nfunction listRows(req, res) { res.json(findRows()); }\napp.get("/rows", listRows);\napp.post("/rows", auth, createRow);\nexport function start() { app.listen(process.env["PORT"]); }\n'),
    ("/repo/src/store.test.ts", 'import { load } from "./store";\ndescribe("store", () => {\n  it("loads", async () => { expect(await load()).toEqual([]); });\n});\n'),
    ("/repo/src/empty.ts", ""),
]
ROWS = {path: parser.parse_source(path, text) for path, text in SAMPLES}


def named(path, record, kind=None):
    return [r[3] for r in ROWS[path] if r[1] == record and (kind is None or r[2] == kind)]


def test_symbols():
    main, store, server = "/repo/src/main.ts", "/repo/src/store.ts", "/repo/src/server.ts"
    assert named(main, "symbol", "function") == ["main"] and "env:DATA_DIR" in named(main, "symbol", "config")
    assert "config:./settings.json" in named(main, "symbol", "config")
    assert named(store, "symbol", "class") == ["Store"] and named(store, "symbol", "method") == ["read", "size", "of"]
    assert named(store, "symbol", "interface") == ["Row"] and named(store, "symbol", "type") == ["Rows"] and named(store, "symbol", "enum") == ["Mode"]
    assert named(store, "symbol", "constant") == ["LIMIT"] and named(store, "symbol", "variable") == ["opened"] and named(store, "symbol", "function") == ["load"]
    detail = next(r[5] for r in ROWS[store] if r[2] == "class")
    assert detail == "extends Base; implements Closable; implements Countable; @Injectable"
    assert named(server, "symbol", "route") == ["GET /rows", "POST /rows"] and "env:PORT" in named(server, "symbol", "config")
    assert named("/repo/src/store.test.ts", "symbol", "test") == ["describe:store", "it:loads"]
    assert ROWS["/repo/src/empty.ts"] == []


def test_imports_exports_calls_docs():
    main, store = "/repo/src/main.ts", "/repo/src/store.ts"
    assert {(r[2], r[3], r[4], r[5]) for r in ROWS[main] if r[1] == "import"} == {("named", "load", "./store.js", "load"), ("named", "Row", "./store.js", "Row"), ("default", "default", "./settings.json", "cfg"), ("namespace", "*", "../util", "util")}
    assert {(r[2], r[3]) for r in ROWS[store] if r[1] == "export"} == {("named", x) for x in ("Row", "Rows", "Mode", "Store", "load", "isOpen")} | {("reexport", "*")}
    calls = {(r[2], r[5], r[4]) for r in ROWS[store] if r[1] == "call"}
    assert {("new", "Reader", "Store.read"), ("call", "parseRows", "Store.read"), ("call", "x.text", "Store.read"), ("new", "Store", "Store.of"), ("call", "Store.of", "load"), ("call", "s.read", "load")} <= calls
    assert {r[5] for r in ROWS[main] if r[2] == "doc"} == {"Starts it all."} and {r[3] for r in ROWS[store] if r[2] == "doc"} == {"doc:Store.read"}
    assert "default" in named(main, "entry") and "main" in named(main, "entry")


@pytest.mark.parametrize("text", ["class {", "export", "import {", "const = ;", "function (", "`${", "/** x", "a.b.c(", "}}}", "export default {", "class A { x = ", None, "@", "for (;;) {"])
def test_broken_sources_end(text):
    parser.parse_source("/x.ts", text)


def test_scan(spark, tmp_path):
    for name in ("a.ts", "sub/b.js", "sub/skip/c.ts", "sub/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("export const x = 1;\n")
    found = files.scan(spark, str(tmp_path), exclude=["skip"])
    assert [r["path"] for r in found.collect()] == ["a.ts", "sub/b.js"]
    assert [r["path"] for r in files.scan(spark, str(tmp_path), include=["*.js"]).collect()] == ["sub/b.js"]
    assert parser.parse(found).where("record = 'symbol'").count() == 2


def test_snippet_and_settings(spark, tmp_path):
    df = spark.createDataFrame([("f", "1\n2\r\n3\n4\n5")], "path string, content string")
    assert [(r["line"], r["text"], r["highlighted"]) for r in files.snippet(df, 2, 2, 1).orderBy("line").collect()] == [(1, "1", False), (2, "2", True), (3, "3", False)]
    (tmp_path / "s.json").write_text('{"most_tokens": 5, "exclude": "x", "other": 1}')
    s = files.Settings.load(str(tmp_path / "s.json"))
    assert s.most_tokens == 5 and len(s.problems) == 2 and files.Settings.load(str(tmp_path / "none")).problems == []


def test_watch(spark, tmp_path):
    schema = "path string, hash string"
    seen = []
    for k, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.watch(stream, str(tmp_path / "known"), "path", "hash", lambda d: seen.append(sorted(map(tuple, d.collect()))), once=True).awaitTermination()
        assert len(seen) == k + 1
    assert seen == [[("a", "added"), ("b", "added")], [("a", "changed"), ("b", "removed"), ("c", "added")]]


def test_latest(spark):
    rows = [(1, 1, 1.0, "2024-01-01"), (1, 2, 2.0, "2024-01-03"), (1, 3, 3.0, "2024-01-02"), (2, 4, 4.0, "2024-01-01")]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double, ts string").selectExpr("user_id", "event_id", "value", "cast(ts as timestamp) AS ts")
    assert sorted(map(tuple, watch.latest_values(df).collect())) == [(1, 2, 2.0), (2, 4, 4.0)]
