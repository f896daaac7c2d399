"""What a server of the graph answers: for each endpoint its payload as DataFrames by name; serving them is left to callers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname, editor_uri, inside, normalise
from ..sources.files import snippet
from . import traverse
from .graph import PropertyGraph, by_type
from .search import find_by_name


class Refused(ValueError):
    """A request that has no payload; ``status`` is what HTTP calls it."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


@dataclass(frozen=True)
class Endpoints:
    """Payloads over a graph. ``ranking`` has (node_id, score), ``files`` (path, content) below ``root``; both may be left out."""

    graph: PropertyGraph
    ranking: DataFrame | None = None
    files: DataFrame | None = None
    root: str = "/"

    def _shown(self, nodes: DataFrame) -> DataFrame:
        """Nodes as they are sent: no source text, ``unknown`` for what is missing, with rank and degrees."""
        known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
        ranks = self.graph.server_importance().toDF("id", "rank") if self.ranking is None else self.ranking.select(F.col("node_id").alias("id"), F.col("score").alias("rank"))
        out = nodes.join(self.graph.degrees(), "id").join(ranks, "id", "left")
        return out.select("id", "name", "type", "full_name", known("summary").alias("summary"), known("file_path").alias("file"), editor_uri(F.col("file_path"), F.lit(1), F.lit(1)).alias("vscode_uri"), "rank", "degree", F.col("in_degree").alias("incoming_count"), F.col("out_degree").alias("outgoing_count"))

    def api_graph(self) -> dict[str, DataFrame]:
        """Everything, with counts, the first 50 of the ranking, health, hubs and directories."""
        ranks = self.graph.server_importance().toDF("node_id", "score") if self.ranking is None else self.ranking.select("node_id", "score")
        return {"nodes": self._shown(self.graph.nodes), "edges": self.graph.edges, **self.stats(), "ranking": ranks.orderBy(F.desc("score"), "node_id").limit(50), **self.analytics()}

    def node(self, node_id: str) -> dict[str, DataFrame]:
        """A node, its edges by type and direction, and what each leads to."""
        own = self.graph.node(node_id)
        if own.isEmpty():
            raise Refused(404, "no such node")
        ways = self.graph.relations(node_id)
        return {"node": self._shown(own), "summary": ways.groupBy("direction", "edge_type").agg(F.count("*").alias("n")), "relations": ways}

    def search(self, text: str, most: int = 50) -> dict[str, DataFrame]:
        if not text.strip():
            raise Refused(400, "a text to search for is needed")
        return {"nodes": find_by_name(self.graph, text, most)}

    def related(self, node_id: str, depth: int = 2) -> dict[str, DataFrame]:
        found = traverse.find_related(self.graph, node_id, depth)
        return {"nodes": found.nodes, "edges": found.edges}

    def path(self, source: str, target: str) -> dict[str, DataFrame]:
        """The nodes of a shortest path in order, and all edges between neighbours; both empty where there is none."""
        if not source or not target:
            raise Refused(400, "both ends are needed")
        steps = traverse.find_path(self.graph, source, target)
        return {"path": steps.join(self._shown(self.graph.nodes), "id").orderBy("step"), "edges": traverse.path_edges(self.graph, steps)}

    def entry_points(self) -> dict[str, DataFrame]:
        return {"nodes": self.graph.entry_points()}

    def stats(self) -> dict[str, DataFrame]:
        return {"nodes_by_type": by_type(self.graph.nodes), "edges_by_type": by_type(self.graph.edges)}

    def analytics(self) -> dict[str, DataFrame]:
        return {"health": self.graph.health(), "hubs": self.graph.hubs(), "communities": self.graph.directory_groups(dirname(F.col("file_path"))), "centrality": self.graph.degree_centrality(), "importance": self.graph.server_importance()}

    def source(self, file: str, start: int = 1, end: int | None = None, context: int = 6) -> dict[str, DataFrame]:
        """The lines around a span of a file; a file outside the root is refused."""
        if not file:
            raise Refused(400, "a file is needed")
        path = file if file.startswith("/") else f"{self.root.rstrip('/')}/{file}"
        one = self.graph.nodes.sparkSession.range(1).select(normalise(F.lit(path)).alias("path"))
        if one.where(inside(F.col("path"), self.root)).isEmpty():
            raise Refused(403, "the file must be below the project's root")
        hit = None if self.files is None else self.files.join(F.broadcast(one), "path", "left_semi")
        if hit is None or hit.isEmpty():
            raise Refused(404, "no such file")
        return {"lines": snippet(hit, start, max(start, start if end is None else end), context)}
