"""Sources with every construct that the parser reads, one pair for each nation, and the records that they hold.

``@K`` stands for the nation's key.
"""

from __future__ import annotations

MODULE = """import fs, { readFile as rf, type Stat } from "fs";
import * as util from "../util@K";
import type { Opts } from "./opts";
import data from "./data@K.json";
import "./side@K";

/** Shape of
 *  number @K. */
export interface Shape@K { id: number; name?: string }
export type Alias@K = Shape@K[];
export enum Mode@K { A, B }
export const LIMIT@K = @K;
let opened@K = false;
const arrow@K = async (x: number) => { helper@K(x); return util.run(x); };

@Tagged("x")
export class Store@K extends Base.Inner implements Shape@K, Closable<string> {
  private rows: string[] = [];
  constructor(path: string) { super(); init(path); }
  /** Reads. */
  async read(name: string): Promise<string> {
    const r = new Reader(name);
    return this.parse(await r.text());
  }
  get size(): number { return count(this.rows); }
  static of(p: string) { return new Store@K(p); }
}

export default function main@K() { app.listen(process.env.PORT@K); }
app.get("/rows@K", auth, listRows);
dotenv.config();
config.get("db@K");
export { opened@K as isOpen };
export * from "./base@K";
export { a as b } from "./other";
"""
TEST = """import { main@K } from "./@K/index";
describe("suite@K", () => {
  it("works", () => { main@K(); });
});
"""

#: The records, as a reader of the two sources finds them: file, kind, name, owner, detail, line, column, exported, and how many keys stand
#: before the column in its line, which move it by their further digits.
SYMBOLS = [
    ("M", "config", "config:./data@K.json", "", "", 4, 1, False, 0),
    ("M", "doc", "doc:Shape@K", "", "Shape of number @K.", 9, 1, False, 0),
    ("M", "interface", "Shape@K", "", "", 9, 8, True, 0),
    ("M", "type", "Alias@K", "", "", 10, 8, True, 0),
    ("M", "enum", "Mode@K", "", "", 11, 8, True, 0),
    ("M", "constant", "LIMIT@K", "", "", 12, 14, True, 0),
    ("M", "variable", "opened@K", "", "", 13, 5, False, 0),
    ("M", "function", "arrow@K", "", "", 14, 7, False, 0),
    ("M", "class", "Store@K", "", "extends Base.Inner; implements Shape@K; implements Closable; @Tagged", 17, 8, True, 0),
    ("M", "method", "read", "Store@K", "", 21, 3, False, 0),
    ("M", "doc", "doc:Store@K.read", "", "Reads.", 21, 3, False, 0),
    ("M", "method", "size", "Store@K", "", 25, 3, False, 0),
    ("M", "method", "of", "Store@K", "", 26, 3, False, 0),
    ("M", "function", "main@K", "", "", 29, 16, True, 0),
    ("M", "config", "env:PORT@K", "", "", 29, 46, False, 1),
    ("M", "route", "GET /rows@K", "", "listRows", 30, 1, False, 0),
    ("M", "config", "config:dotenv.config", "", "", 31, 1, False, 0),
    ("M", "config", "config:config.get:db@K", "", "", 32, 1, False, 0),
    ("T", "test", "describe:suite@K", "", "", 2, 1, False, 0),
    ("T", "test", "it:works", "", "", 3, 3, False, 0),
]
#: file, kind, module, name, local, line
IMPORTS = [
    ("M", "default", "fs", "default", "fs", 1),
    ("M", "named", "fs", "readFile", "rf", 1),
    ("M", "named", "fs", "Stat", "Stat", 1),
    ("M", "namespace", "../util@K", "*", "util", 2),
    ("M", "type", "./opts", "Opts", "Opts", 3),
    ("M", "default", "./data@K.json", "default", "data", 4),
    ("M", "module", "./side@K", "", "", 5),
    ("T", "named", "./@K/index", "main@K", "main@K", 1),
]
#: file, kind, name, local, module, line
EXPORTS = [
    ("M", "named", "Shape@K", "Shape@K", "", 9),
    ("M", "named", "Alias@K", "Alias@K", "", 10),
    ("M", "named", "Mode@K", "Mode@K", "", 11),
    ("M", "named", "Store@K", "Store@K", "", 17),
    ("M", "default", "default", "main@K", "", 29),
    ("M", "named", "isOpen", "opened@K", "", 33),
    ("M", "reexport", "*", "*", "./base@K", 34),
    ("M", "reexport", "b", "a", "./other", 35),
]
#: file, kind, name, full name, caller, line, column, keys before the column
CALLS = [
    ("M", "call", "helper@K", "helper@K", "arrow@K", 14, 39, 1),
    ("M", "call", "run", "util.run", "arrow@K", 14, 58, 2),
    ("M", "new", "Reader", "Reader", "Store@K.read", 22, 19, 0),
    ("M", "call", "parse", "this.parse", "Store@K.read", 23, 12, 0),
    ("M", "call", "text", "r.text", "Store@K.read", 23, 29, 0),
    ("M", "call", "count", "count", "Store@K.size", 25, 31, 0),
    ("M", "new", "Store@K", "Store@K", "Store@K.of", 26, 37, 0),
    ("M", "call", "listen", "app.listen", "main@K", 29, 35, 1),
]
#: file, kind, name, line
ENTRIES = [("M", "interface", "Shape@K", 9), ("M", "type", "Alias@K", 10), ("M", "enum", "Mode@K", 11), ("M", "constant", "LIMIT@K", 12), ("M", "class", "Store@K", 17), ("M", "function", "default", 29), ("M", "route", "GET /rows@K", 30)]


def _literal(text: str) -> str:
    """Text as an SQL literal without braces, backslashes or quotes of its own."""
    return "replace(replace('" + text.replace("{", "«").replace("}", "»") + "', '«', chr(123)), '»', chr(125))"


#: Each nation's two sources, on both engines.
FILES = " UNION ALL ".join(f"SELECT replace('{path}', '@K', CAST(n_nationkey AS {{S}})) AS path, replace({_literal(text)}, '@K', CAST(n_nationkey AS {{S}})) AS content FROM {{nation}}" for path, text in (("/repo/n/@K/index.ts", MODULE), ("/repo/n/@K.test.ts", TEST)))


def expected(rows: list[tuple], names: str, shift: str | None = None) -> str:
    """SQL for DuckDB that lists ``rows`` for every nation, columns named; ``shift`` names the column that keys before it move."""
    columns = names.split(", ")
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)
    texts = {c for c, v in zip(columns, rows[0]) if isinstance(v, str)}
    out = ["CASE file WHEN 'M' THEN '/repo/n/' || n_nationkey || '/index.ts' ELSE '/repo/n/' || n_nationkey || '.test.ts' END AS path"]
    for c in columns[1:]:
        if c in texts:
            out.append(f"replace({c}, '@K', n_nationkey::VARCHAR) AS {c}")
        elif c == shift:
            out.append(f"CAST({c} + keys * (length(n_nationkey::VARCHAR) - 1) AS INTEGER) AS {c}")
        elif c != "keys":
            out.append(c)
    return f"SELECT {', '.join(out)} FROM nation CROSS JOIN (VALUES {values}) v({names})"
