"""Declarations, imports, exports and calls of TypeScript and JavaScript sources, as table functions.

A tokenizer that knows strings, templates, comments and regular expressions, and one pass over its tokens; no compiler is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.labels import CONFIG_FILE, ENTRY_FILE, ENTRY_NAMES, TEST_FILE

TOKEN = re.compile(
    r"(?P<doc>/\*\*(?!/).*?\*/)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<space>\s+)|(?P<template>`(?:\\.|[^`\\])*`)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>=>|\?\.|\.\.\.|[{}()\[\];,.<>=:?!@&|+\-*/%^~#\\])|(?P<other>.)",
    re.DOTALL,
)
#: Fixed values.
ROUTE_OBJECTS = {"app", "router", "server"}
ROUTE_VERBS = {"get", "post", "put", "delete", "patch", "options", "head", "all"}
TEST_CALLS = {"describe", "it", "test"}
IGNORED_CALLS = {"describe", "it", "test", "expect", "require"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "constructor", "void", "delete", "in", "of", "new"}
MODIFIERS = {"public", "private", "protected", "static", "async", "readonly", "abstract", "override", "declare", "get", "set"}
_TEST_FILE, _CONFIG_FILE, _ENTRY_FILE = re.compile(TEST_FILE), re.compile(CONFIG_FILE), re.compile(ENTRY_FILE)
COLUMNS = "path string, record string, kind string, name string, owner string, detail string, line int, col int, exported boolean, end_line int, end_col int, text string, error string"


@dataclass
class Token:
    kind: str
    text: str
    line: int
    col: int
    start: int = 0

    @property
    def end(self) -> int:
        return self.start + len(self.text)


def tokens(source: str) -> list[Token]:
    out, line, start = [], 1, 0
    for m in TOKEN.finditer(source):
        kind = m.lastgroup or "other"
        if kind not in ("space", "comment"):
            out.append(Token(kind, m[0], line, m.start() - start + 1, m.start()))
        breaks = m[0].count("\n")
        if breaks:
            line, start = line + breaks, m.start() + m[0].rindex("\n") + 1
    return out


class _Reader:
    """One pass over a file's tokens; ``rows`` are (record, kind, name, owner, detail, line, col, exported).

    ``spans`` has the first and last token of each row; what a statement or a class's member adds without an end of its own ends with it.
    """

    def __init__(self, path: str, source: str):
        self.path, self.source, self.all, self.rows = path.replace("\\", "/"), source, tokens(source), []
        self.spans: list[list[int | None]] = []
        self.docs = {id(self.all[i + 1]): t for i, t in enumerate(self.all[:-1]) if t.kind == "doc"}
        self.t = [t for t in self.all if t.kind != "doc"]
        self.is_test, self.is_config = bool(_TEST_FILE.search(self.path)), bool(_CONFIG_FILE.search(self.path))
        self.seen: set[tuple] = set()
        self.match = self._pairs()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.text in "([{" and t.kind == "sign":
                stack.append(i)
            elif t.text in ")]}" and t.kind == "sign" and stack:
                out[stack.pop()] = i
        return out

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def add(self, record: str, kind: str, name: str, i: int, owner: str = "", detail: str = "", exported: bool = False, end: int | None = None) -> None:
        t = self.t[min(i, len(self.t) - 1)]
        key = (record, kind, name, owner, t.line, t.col, detail if record != "symbol" else "")
        if key not in self.seen:
            self.seen.add(key)
            self.rows.append((record, kind, name, owner, detail, t.line, t.col, exported))
            self.spans.append([min(i, len(self.t) - 1), end])

    def close(self, since: int, end: int) -> None:
        """Rows from ``since`` on that have no end yet end before token ``end``."""
        for span in self.spans[since:]:
            if span[1] is None:
                span[1] = max(span[0], min(end, len(self.t)) - 1)

    def placed(self) -> list[tuple]:
        """The rows with their last line, the column after it, and the text between."""
        out = []
        for row, (first, last) in zip(self.rows, self.spans, strict=True):
            a, b = self.t[first], self.t[last if last is not None else first]
            breaks = b.text.count("\n")
            col = len(b.text) - b.text.rindex("\n") if breaks else b.col + len(b.text)
            out.append((*row, b.line + breaks, col, self.source[a.start : b.end]))
        return out

    def symbol(self, kind: str, name: str, i: int, owner: str = "", detail: str = "", exported: bool = False, default: bool = False) -> None:
        self.add("symbol", kind, name, i, owner, detail, exported)
        if not owner and (name in ENTRY_NAMES or default or (exported and _ENTRY_FILE.search(self.path))):
            self.add("entry", kind, "default" if default else name, i)

    def doc(self, first: int, name: str) -> None:
        note = self.docs.get(id(self.t[first])) if first < len(self.t) else None
        if note:
            lines = [re.sub(r"^\s*\*?\s?", "", x).strip() for x in note.text[3:-2].split("\n")]
            self.add("symbol", "doc", f"doc:{name}", first, detail=" ".join(x for x in lines if x))

    def body(self, i: int) -> int | None:
        """Where the next block begins, past a signature's types, or None before a statement's end."""
        while i < len(self.t):
            if self.at(i) == "{":
                if self.at(i - 1) not in (":", "|", "&", "<", ","):
                    return i
                i = self.match.get(i, i)
            elif self.at(i) == ";":
                return None
            elif self.at(i) in "([" and i in self.match:
                i = self.match[i]
            i += 1
        return None

    def dotted(self, i: int) -> tuple[str, int]:
        """A name with its members, and where it ends."""
        name = self.at(i)
        i += 1
        while self.at(i) in (".", "?.") and self.is_name(i + 1):
            name += "." + self.at(i + 1)
            i += 2
        return name, i

    def calls(self, start: int, end: int, caller: str, owner: str = "") -> None:
        i = start
        while i < end:
            if self.is_name(i) and self.at(i - 1) not in (".", "?."):
                new = self.at(i - 1) == "new"
                name, j = self.dotted(i)
                if self.at(j) == "<":
                    depth, k = 0, j
                    while k < min(end, j + 40):
                        depth += (self.at(k) == "<") - (self.at(k) == ">")
                        if depth == 0:
                            break
                        k += 1
                    j = k + 1 if self.at(k + 1) == "(" else j
                last = name.split(".")[-1]
                if self.at(j) == "(" and name not in NOT_CALLS and self.at(i - 1) != "function" and (new or last not in IGNORED_CALLS):
                    self.add("call", "new" if new else "call", last, i, owner=f"{owner}.{caller}" if owner else caller, detail=name, end=self.match.get(j, j))
                i = max(i + 1, j)
            else:
                i += 1

    def read(self) -> list[tuple]:
        i, depth = 0, 0
        while i < len(self.t):
            text = self.at(i)
            if depth == 0:
                since, i = len(self.rows), self.statement(i)
                self.close(since, i)
                continue
            depth += (text == "{") - (text == "}")
            i += 1
        self.anywhere()
        return self.placed()

    def anywhere(self) -> None:
        """What counts at any depth: environment variables, routes, tests, configuration calls."""
        for i in range(len(self.t)):
            if self.at(i) == "process" and self.at(i + 1) == "." and self.at(i + 2) == "env":
                if self.at(i + 3) == "." and self.is_name(i + 4):
                    self.symbol("config", f"env:{self.at(i + 4)}", i)
                    self.close(len(self.rows) - 1, i + 5)
                elif self.at(i + 3) == "[" and i + 4 < len(self.t) and self.t[i + 4].kind == "text":
                    self.symbol("config", f"env:{self.at(i + 4)[1:-1]}", i)
                    self.close(len(self.rows) - 1, i + 6)
            if not self.is_name(i) or self.at(i - 1) in (".", "?."):
                continue
            if self.at(i) in ROUTE_OBJECTS and self.at(i + 1) == "." and self.at(i + 2) in ROUTE_VERBS and self.at(i + 3) == "(" and i + 4 < len(self.t) and self.t[i + 4].kind == "text":
                end, handler = self.match.get(i + 3, i + 4), ""
                for j in range(end - 1, i + 4, -1):
                    if self.is_name(j):
                        handler = self.at(j) if self.at(j - 1) == "," else handler
                        break
                name = f"{self.at(i + 2).upper()} {self.at(i + 4)[1:-1]}"
                since = len(self.rows)
                self.symbol("route", name, i, detail=handler)
                self.add("entry", "route", name, i)
                self.close(since, end + 1)
            if self.is_test and self.at(i) in TEST_CALLS and self.at(i + 1) == "(" and i + 2 < len(self.t) and self.t[i + 2].kind in ("text", "template"):
                since = len(self.rows)
                self.symbol("test", f"{self.at(i)}:{self.at(i + 2)[1:-1]}", i)
                self.close(since, self.match.get(i + 1, i + 2) + 1)
            name, j = self.dotted(i)
            if self.at(j) == "(" and name in ("dotenv.config", "config.get"):
                label = self.at(j + 1)[1:-1] if j + 1 < len(self.t) and self.t[j + 1].kind == "text" else ""
                since = len(self.rows)
                self.symbol("config", f"config:{name}" + (f":{label}" if label else ""), i)
                self.close(since, self.match.get(j, j) + 1)

    def statement(self, i: int) -> int:
        """Reads a top-level statement and gives the place after it."""
        first, decorators = i, []
        while self.at(i) == "@" and self.is_name(i + 1):
            name, i = self.dotted(i + 1)
            decorators.append(name)
            i = self.match[i] + 1 if self.at(i) == "(" and i in self.match else i
        exported = default = False
        if self.at(i) == "import" and self.at(i + 1) not in ("(", "."):
            return self.imports(i)
        if self.at(i) == "export":
            exported = True
            i += 1
            if self.at(i) in ("{", "*") or (self.at(i) == "type" and self.at(i + 1) in ("{", "*")):
                return self.export_list(i + (self.at(i) == "type"))
            if self.at(i) == "default":
                default = True
                i += 1
                if self.at(i) not in ("function", "class", "async", "abstract"):
                    name = self.at(i) if self.is_name(i) else "default"
                    self.add("export", "default", "default", i, detail=name)
                    self.add("entry", "default", "default", i)
                    return self.skip(i)
            while self.at(i) == "@" and self.is_name(i + 1):
                name, i = self.dotted(i + 1)
                decorators.append(name)
                i = self.match[i] + 1 if self.at(i) == "(" and i in self.match else i
        while self.at(i) in ("declare", "abstract") or (self.at(i) == "async" and self.at(i + 1) == "function"):
            i += 1
        word = self.at(i)
        if word == "function":
            j = i + 1 + (self.at(i + 1) == "*")
            name = self.at(j) if self.is_name(j) else "default"
            self.declared("function", name, i, first, exported, default)
            begin = self.body(j)
            end = self.match.get(begin, len(self.t)) if begin is not None else None
            if begin is not None:
                self.calls(begin, end, name)
            return end + 1 if end is not None else self.skip(j)
        if word == "class":
            return self.class_(i, first, exported, default, decorators)
        if word == "const" and self.at(i + 1) == "enum":
            i += 1
            word = "enum"
        if word in ("interface", "enum", "type") and self.is_name(i + 1):
            self.declared(word, self.at(i + 1), i, first, exported, default)
            begin = self.body(i + 1) if word != "type" else None
            return self.match.get(begin, len(self.t)) + 1 if begin is not None else self.skip(i + 1)
        if word in ("const", "let", "var"):
            return self.variables(i, first, exported)
        return self.skip(i)

    def declared(self, kind: str, name: str, i: int, first: int, exported: bool, default: bool, detail: str = "") -> None:
        self.symbol(kind, name, i, detail=detail, exported=exported, default=default)
        self.doc(first, name)
        if exported:
            self.add("export", "default" if default else "named", "default" if default else name, i, detail=name)

    def imports(self, i: int) -> int:
        end = i + 1
        while end < len(self.t) and self.t[end].kind != "text" and self.at(end) != ";":
            end += 1
        module = self.at(end)[1:-1] if end < len(self.t) and self.t[end].kind == "text" else ""
        types = self.at(i + 1) == "type" and self.at(i + 2) not in ("from", ",")
        j, found = i + 1 + types, False
        if self.is_name(j) and self.at(j) != "from":
            self.add("import", "default", "default", j, owner=module, detail=self.at(j))
            found = True
        while j < end:
            if self.at(j) == "*" and self.at(j + 1) == "as":
                self.add("import", "namespace", "*", j, owner=module, detail=self.at(j + 2))
                found = True
            if self.at(j) == "{":
                for name, alias, at in self.bindings(j):
                    self.add("import", "type" if types else "named", name, at, owner=module, detail=alias)
                    found = True
                break
            j += 1
        if not found:
            self.add("import", "module", "", i, owner=module)
        if module.endswith(".json"):
            self.symbol("config", f"config:{module}", i)
        return end + 1 + (self.at(end + 1) == ";")

    def bindings(self, brace: int) -> Iterator[tuple[str, str, int]]:
        j, end = brace + 1, self.match.get(brace, len(self.t))
        while j < end:
            if self.at(j) == "type" and self.is_name(j + 1) and self.at(j + 1) != "as":
                j += 1
            if self.is_name(j):
                name, alias, at = self.at(j), self.at(j), j
                if self.at(j + 1) == "as":
                    alias, j = self.at(j + 2), j + 2
                yield name, alias, at
            j += 1

    def export_list(self, i: int) -> int:
        if self.at(i) == "*":
            name, j = "*", i + 1
            if self.at(j) == "as":
                name, j = self.at(j + 1), j + 2
            module = self.at(j + 1)[1:-1] if self.at(j) == "from" else ""
            self.add("export", "reexport", name, i, owner=module, detail="*")
            return j + 2 + (self.at(j + 2) == ";")
        end = self.match.get(i, len(self.t) - 1)
        again = self.at(end + 1) == "from"
        module = self.at(end + 2)[1:-1] if again else ""
        for name, alias, at in self.bindings(i):
            self.add("export", "reexport" if again else "named", alias, at, owner=module, detail=name)
        after = end + 3 if again else end + 1
        return after + (self.at(after) == ";")

    def class_(self, i: int, first: int, exported: bool, default: bool, decorators: list[str]) -> int:
        name = self.at(i + 1) if self.is_name(i + 1) and self.at(i + 1) not in ("extends", "implements") else "default"
        begin = self.body(i + 1)
        if begin is None:
            return self.skip(i)
        heritage, j = [], i + 1
        while j < begin:
            if self.at(j) == "extends":
                base, j = self.dotted(j + 1)
                heritage.append(f"extends {base}")
                continue
            if self.at(j) == "implements":
                j += 1
                while j < begin:
                    if self.is_name(j):
                        base, j = self.dotted(j)
                        heritage.append(f"implements {base}")
                        if self.at(j) == "<":
                            depth = 0
                            while j < begin:
                                depth += (self.at(j) == "<") - (self.at(j) == ">")
                                j += 1
                                if depth == 0:
                                    break
                    else:
                        j += 1
                break
            j += 1
        self.declared("class", name, i, first, exported, default, detail="; ".join(heritage + [f"@{d}" for d in decorators]))
        end = self.match.get(begin, len(self.t))
        j = begin + 1
        while j < end:
            start = j
            while self.at(j) == "@" and self.is_name(j + 1):
                _, j = self.dotted(j + 1)
                j = self.match[j] + 1 if self.at(j) == "(" and j in self.match else j
            while self.at(j) in MODIFIERS and self.at(j + 1) not in ("(", "=", ":", ";", "?"):
                j += 1
            j += self.at(j) == "*"
            if (self.is_name(j) or self.at(j) == "#") and (self.at(j + 1) == "(" or (self.at(j) == "#" and self.at(j + 2) == "(")):
                hidden = self.at(j) == "#"
                method, j = ("#" + self.at(j + 1), j + 1) if hidden else (self.at(j), j)
                block = self.body(j + 1)
                inside = block is not None and block < end
                since = len(self.rows)
                if method != "constructor":
                    self.symbol("method", method, start, owner=name)
                    self.doc(start, f"{name}.{method}")
                    if inside:
                        self.calls(block, self.match.get(block, end), method, name)
                j = self.match.get(block, end) + 1 if inside else self.skip(j)
                self.close(since, j)
            else:
                j = self.member(j, end)
        return end + 1

    def member(self, i: int, end: int) -> int:
        """Past a class's property: to its semicolon, or to the end of its line."""
        line = self.t[i].line
        while i < end:
            if self.at(i) in "([{" and i in self.match:
                i = self.match[i] + 1
                line = self.t[min(i, end) - 1].line
                continue
            if self.at(i) == ";":
                return i + 1
            if self.t[i].line != line and self.at(i - 1) not in ("=", "=>", ",", "+", "|", "&", ":"):
                return i
            line = self.t[i].line
            i += 1
        return end

    def variables(self, i: int, first: int, exported: bool) -> int:
        constant, end = self.at(i) == "const", self.skip(i)
        j = i + 1
        while j < end and self.is_name(j):
            name, at, k = self.at(j), j, j + 1
            depth = 0
            while k < end and not (depth == 0 and self.at(k) in ("=", ",", ";")):
                depth += (self.at(k) == "<") - (self.at(k) == ">")
                k = self.match[k] + 1 if self.at(k) in "([{" and k in self.match else k + 1
            arrow = None
            if self.at(k) == "=":
                v = k + 1 + (self.at(k + 1) == "async")
                if self.at(v) == "function":
                    arrow = self.body(v + 1)
                else:
                    w = self.match.get(v, v) + 1 if self.at(v) == "(" else v + 1 if self.is_name(v) else v
                    while w < end and self.at(w) == ":" and self.at(v) == "(":
                        while w < end and self.at(w) not in ("=>", ";"):
                            w += 1
                    arrow = w + 1 if self.at(w) == "=>" else None
            last = k
            while last < end and not (self.at(last) == "," or self.at(last) == ";"):
                last = self.match[last] + 1 if self.at(last) in "([{" and last in self.match else last + 1
            if arrow is not None:
                self.declared("function", name, at, first, exported, False)
                self.calls(arrow, last, name)
            else:
                self.symbol("config" if self.is_config else "constant" if constant else "variable", name, at, exported=exported)
            j = last + 1
        return end

    def skip(self, i: int) -> int:
        """Past a statement: a semicolon, a block that ends a line, or a line's end outside brackets."""
        line = self.t[i].line if i < len(self.t) else 0
        start = i
        while i < len(self.t):
            text = self.at(i)
            if text in "([{" and i in self.match:
                i = self.match[i]
                line = self.t[i].line
            elif text == ";":
                return i + 1
            elif self.t[i].line != line and i > start and text not in (".", "?.", "=>", "+", "|", "&", "?", ":", "=", ")", "]") and self.at(i - 1) not in ("=", "=>", ",", "+", "|", "&", "?", ":", "(", "."):
                return i
            else:
                line = self.t[i].line
            i += 1
        return max(i, start + 1)


def parse_source(path: str, content: str | None) -> list[tuple]:
    """Rows of COLUMNS for a file; a file that can't be read gives one row that says why."""
    try:
        return [(path, *row, None) for row in _Reader(path, content or "").read()]
    except Exception as e:  # a single bad file must not end the scan
        return [(path, "error", "", "", "", "", 0, 0, False, 0, 0, "", f"{type(e).__name__}: {e}")]


def parse(files: DataFrame) -> DataFrame:
    """COLUMNS for all ``files`` (path, content), file by file, without a shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for frame in frames:
            rows = [r for path, content in zip(frame["path"], frame["content"], strict=True) for r in parse_source(path, content)]
            yield pd.DataFrame(rows, columns=names).astype({"line": "int32", "col": "int32", "exported": bool, "end_line": "int32", "end_col": "int32"})

    return files.select("path", "content").mapInPandas(run, COLUMNS)
