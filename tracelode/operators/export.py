"""Exports: serialised relations, summaries, fingerprints and bundles as JSON, YAML or for an assistant."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .budget import edge_tokens, node_tokens, split_budget, take_fitting
from .components import checkpointed, stored
from .graph import SUMMARY_TYPES, PropertyGraph, export_rank
from .traverse import cycles

#: Fixed values. What a bundle tells its reader.
RULES = [
    "Use only nodes, edges, summaries, and provenance listed in this bundle.",
    "Do not infer behavior that is not explicitly represented here.",
    "Treat missing relationships as unknown.",
    "Treat unresolved relationships as unresolved.",
    "Do not fabricate APIs, flows, or modules.",
    "Use source spans as the ground truth for every fact.",
    "If evidence is absent, answer with unknown or not found.",
    "Do not widen scope beyond the declared query focus.",
]
#: Rows of a bundle's relations, at most: a bundle is one document.
BUNDLE_ROWS = 100_000


def canonical_name(semantic_path: Column, full_name: Column, name: Column) -> Column:
    """The first that isn't empty."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(semantic_path), blank(full_name), name)


def not_noise(name: Column, full_name: Column) -> Column:
    """False for environment variables and dotenv configuration."""
    noisy = lambda c: F.coalesce(c.startswith("env:") | c.startswith("config:dotenv"), F.lit(False))
    return ~noisy(name) & ~noisy(full_name)


def serialised_nodes(graph: PropertyGraph) -> DataFrame:
    out = graph.nodes.join(graph.importance(), "id")
    said = F.coalesce(F.nullif("summary", F.lit("")), F.lit("unknown"))
    return out.select("id", "type", canonical_name(F.lit(None).cast("string"), F.col("full_name"), F.col("name")).alias("canonical_name"), "importance", said.alias("summary"), F.lit(False).alias("inferred"))


def serialised_edges(graph: PropertyGraph) -> DataFrame:
    return graph.edges.select("id", "type", "from_id", "to_id", "resolved", F.lit(False).alias("inferred"))


def ai_nodes(graph: PropertyGraph, most: int | None = None) -> DataFrame:
    """Nodes without noise with their importance, the first ``most`` by it if given."""
    out = graph.nodes.where(not_noise(F.col("name"), F.col("full_name"))).join(graph.importance(), "id")
    return out if most is None else out.orderBy(F.desc("importance"), "type", "name", "id").limit(most)


def ai_result(graph: PropertyGraph, most: int | None = None) -> PropertyGraph:
    """What an assistant's bundle is made of: the chosen nodes, edges among them, and entry points to them.

    The chosen nodes are written once: both ends of every edge are looked up in them.
    """
    nodes = stored(ai_nodes(graph, most))
    return PropertyGraph(nodes.select(*graph.nodes.columns), graph.induced(nodes, keep_entry_points=True))


def file_summaries(graph: PropertyGraph, count: int = 20) -> DataFrame:
    """(id, label, summary) of the first files: what they define and depend on. Files are chosen before edges are counted."""
    files = graph.nodes_of("file").orderBy("type", "name", "id").limit(count)
    counts = graph.edges_of("DEFINES", "IMPORTS", "DEPENDS_ON").join(files.select(F.col("id").alias("from_id")), "from_id", "left_semi").groupBy("from_id").agg(F.count_if(F.col("type") == "DEFINES").alias("d"), F.count_if(F.col("type") != "DEFINES").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    text = F.concat("name", F.lit(" defines "), zero("d"), F.lit(" symbols and depends on "), zero("o"), F.lit(" modules/files."))
    return files.join(counts, files["id"] == counts["from_id"], "left").select("id", F.col("name").alias("label"), text.alias("summary"))


def symbol_summaries(graph: PropertyGraph, count: int = 25) -> DataFrame:
    """(id, label, summary) of the first symbols with their numbers of edges."""
    chosen = stored(graph.nodes_of(*SUMMARY_TYPES).orderBy("type", "name", "id").limit(count))
    degrees = PropertyGraph(chosen, graph.touching(chosen)).degrees()
    text = F.concat("type", F.lit(" "), "name", F.lit(" has "), F.col("out_degree").cast("string"), F.lit(" outgoing and "), F.col("in_degree").cast("string"), F.lit(" incoming relationships."))
    return chosen.join(degrees, "id").select("id", F.coalesce(F.nullif("full_name", F.lit("")), "name").alias("label"), text.alias("summary"))


def evidence(spans: DataFrame, count: int = 100) -> DataFrame:
    """The first different spans, without their text."""
    place = ["source_file", "start_line", "start_col", "end_line", "end_col"]
    return spans.select(*[F.col(c) if c in spans.columns else F.lit(1).alias(c) for c in place]).distinct().orderBy(*place).limit(count)


def fingerprint(graph: PropertyGraph, range_rows: int = 100_000) -> DataFrame:
    """(fingerprint): SHA-256 over the relations, whatever their partitions and order.

    Rows are hashed, the hashes of each range are sorted and hashed, and so are those, so that one task holds a range, not the
    relation. There are 4,096 ranges, and 16 times as many as often as their rows would be more than ``range_rows``: the number
    depends on the relations' size alone, so equal graphs have equal fingerprints.
    """
    rows, digits = graph.nodes.count() + graph.edges.count(), 3
    while rows > range_rows * 16**digits:
        digits += 1
    nodes = graph.nodes.select(F.concat_ws("|", F.lit("node"), "id", "type", canonical_name(F.lit(None).cast("string"), F.col("full_name"), F.col("name")), F.coalesce("file_path", F.lit(""))).alias("row"))
    edges = graph.edges.select(F.concat_ws("|", F.lit("edge"), "id", "type", "from_id", "to_id", F.col("resolved").cast("string")).alias("row"))
    hashes = nodes.union(edges).select(F.sha2("row", 256).alias("h"))
    ranges = hashes.groupBy(F.substring("h", 1, digits).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))


def pruned(graph: PropertyGraph, most_tokens: int, centrality: DataFrame | None = None) -> PropertyGraph:
    """The graph under a token budget: nodes in export order while they fit, then edges among them by id."""
    for_nodes, for_edges = split_budget(most_tokens)
    spark = graph.nodes.sparkSession
    scored = graph.nodes.join(centrality, "id", "left") if centrality is not None else graph.nodes.withColumn("score", F.lit(0.0))
    focus = F.when(F.col("type").isin("file", "class", "function"), 0).otherwise(1)
    items = scored.select("id", focus.alias("focus"), (-F.coalesce("score", F.lit(0.0))).alias("down"), export_rank(F.col("type")).alias("rank"), "name", F.col("id").alias("tie"), node_tokens(F.col("name"), F.col("full_name"), F.col("summary"), F.lit("{}")).alias("tokens"))
    nodes = take_fitting(items, for_nodes, ["focus", "down", "rank", "name", "tie"])
    ids = stored(spark.createDataFrame([(i,) for i in nodes], "id string"))
    inner = stored(graph.induced(ids))
    edges = take_fitting(inner.select("id", F.col("id").alias("tie"), edge_tokens(F.lit("{}")).alias("tokens")), for_edges, ["tie"])
    chosen = spark.createDataFrame([(i,) for i in edges], "id string")
    return PropertyGraph(graph.nodes.join(ids, "id", "left_semi"), inner.join(chosen, "id", "left_semi"))


def key_symbols(graph: PropertyGraph, count: int = 20) -> DataFrame:
    nodes = graph.nodes.where(~F.col("type").isin("project", "file", "module"))
    return nodes.join(graph.importance(), "id").orderBy(F.desc("importance"), "name", "id").limit(count)


def core_modules(graph: PropertyGraph, count: int = 12) -> DataFrame:
    chosen = graph.nodes_of("file", "module")
    return chosen.join(graph.importance(chosen), "id").orderBy(F.desc("importance"), "name", "id").limit(count)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """The rows of a relation small enough for a bundle."""
    rows = df.limit(BUNDLE_ROWS + 1).collect()
    if len(rows) > BUNDLE_ROWS:
        raise ValueError(f"a bundle holds at most {BUNDLE_ROWS} rows; give a focus or a budget")
    return [r.asDict(recursive=True) for r in rows]


def bundle(graph: PropertyGraph, project: dict[str, Any], query: dict[str, Any]) -> dict[str, Any]:
    """One document with the relations in order, summaries, rules and a fingerprint."""
    return {
        "version": "1.0",
        "project": project,
        "query": query,
        "nodes": _rows(serialised_nodes(graph).orderBy("type", "canonical_name", "id")),
        "edges": _rows(serialised_edges(graph).orderBy("type", "id")),
        "summaries": _rows(file_summaries(graph).orderBy("label")) + _rows(symbol_summaries(graph).orderBy("label", "id")),
        "rules": RULES,
        "fingerprint": fingerprint(graph).first()["fingerprint"],
    }


def _written(graph: PropertyGraph) -> PropertyGraph:
    return PropertyGraph(checkpointed(graph.nodes), checkpointed(graph.edges))


def ai_bundle(graph: PropertyGraph, project: dict[str, Any], query: dict[str, Any], most_tokens: int = 8000, most_nodes: int | None = None) -> dict[str, Any]:
    """The bundle of what fits the budget, with a summary and a ranking of what it was chosen from.

    The chosen graph and the pruned one are written once, as every part of the document reads them.
    """
    chosen = _written(ai_result(graph, most_nodes))
    entries = chosen.entry_points().select(canonical_name(F.lit(None).cast("string"), F.col("full_name"), F.col("name")).alias("n")).orderBy("n")
    ring = chosen.edges_of("IMPORTS", "DEPENDS_ON", "EXTENDS", "IMPLEMENTS").where("resolved")
    out = bundle(_written(pruned(chosen, most_tokens)), project, query)
    out["summary"] = {
        "entryPoints": [r["n"] for r in _rows(entries)],
        "coreModules": [r["full_name"] or r["name"] for r in _rows(core_modules(chosen))],
        "keySymbols": _rows(key_symbols(chosen).select("id", "name", "importance")),
        "cycles": [r["cycle"].split(">") for r in _rows(cycles(ring))],
        "unresolvedCount": chosen.unresolved().count(),
    }
    out["ranking"] = _rows(chosen.importance().orderBy(F.desc("importance"), "id").limit(50))
    return out


def to_json(document: dict[str, Any]) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)


def to_yaml(value: Any, indent: int = 0) -> str:
    """Block-style YAML of a bundle; scalars are in JSON's form, which YAML reads alike."""
    pad = "  " * indent
    if isinstance(value, dict) and value:
        lines = []
        for k, v in value.items():
            nested = isinstance(v, dict | list) and v
            lines.append(f"{pad}{k}:" + ("\n" + to_yaml(v, indent + 1) if nested else " " + to_yaml(v)))
        return "\n".join(lines)
    if isinstance(value, list) and value:
        lines = []
        for v in value:
            text = to_yaml(v, indent + 1)
            lines.append(f"{pad}- {text.lstrip()}" if isinstance(v, dict | list) and v else f"{pad}- {text}")
        return "\n".join(lines)
    return json.dumps(value, ensure_ascii=False)
