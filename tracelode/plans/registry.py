"""The registered queries: each operator on relations bound to a data folder, beside SQL that says the same."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import PropertyGraph
from ..sources import bindings, store
from ..sources.tables import on_duckdb, on_spark, read

#: Relations that the SQL beside a query may name; each is given as a common table where it is used.
SHARED = {
    "nodes": bindings.NODES,
    "edges": bindings.EDGES,
    "trade": bindings.TRADE,
    "spans": bindings.SPANS,
    "old_files": bindings.OLD_FILES,
    "new_files": bindings.NEW_FILES,
    "files": bindings.FILES,
    "symbols": bindings.SYMBOLS,
    "calls": bindings.CALLS,
    "imports": bindings.IMPORTS,
    "exports": bindings.EXPORTS,
    "aliases": bindings.ALIASES,
    "labelled": bindings.LABELLED,
}
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


@dataclass(frozen=True)
class Data:
    """A data folder's relations, each a plan."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.sf_dir, name)

    def bound(self, name: str) -> DataFrame:
        text = SHARED[name].replace("sha256(", "sha2_256(")
        return on_spark(self.spark, self.sf_dir, re.sub(r"sha2_256\((.*)\) AS hash", r"sha2(\1, 256) AS hash", text))

    @cached_property
    def graph(self) -> PropertyGraph:
        """The folder's graph as views of its tables: a query reads what it asks for, and nothing is written for it first."""
        return PropertyGraph(self.bound("nodes"), self.bound("edges"))

    @cached_property
    def walked(self) -> PropertyGraph:
        """The same with its edges written, for walks that read them level by level: once an application."""
        return PropertyGraph(self.bound("nodes"), store.written(self.spark, self.sf_dir, "edges", lambda: self.bound("edges")))

    @cached_property
    def trade(self) -> PropertyGraph:
        """The dependencies among files alone."""
        return PropertyGraph(self.bound("nodes").where("type = 'file'"), self.bound("trade"))


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of ``Data``; ``sql`` is its counterpart over the tables and ``SHARED`` relations."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            _sql[name] = complete(sql)
        return f

    return register


def complete(sql: str) -> str:
    """``sql`` with the shared relations that it names as common tables before its own."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SHARED:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                needed.append(name)

    visit(sql)
    tables = [f"{n} AS MATERIALIZED ({on_duckdb(SHARED[n]).strip()})" for n in needed]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return "WITH RECURSIVE " + ", ".join([*tables, ""]) + sql[own.end() :]
    return ("WITH " + ", ".join(tables) + " " if tables else "") + sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def _load() -> None:
    for module in ("relations", "ranking", "walks", "names", "labels", "sources", "indexing"):
        importlib.import_module(f"{__package__}.{module}")
