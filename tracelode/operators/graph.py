"""A property graph as two DataFrames, and what joins, groups and sorts ask of it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import rounded
from .components import checkpointed, stored

#: Fixed values. Types that count as symbols of interest, and their order in exports.
IMPORTANT_TYPES = ["project", "file", "class", "function", "method", "route"]
EXPORT_ORDER = ["file", "class", "function", "method", "route", "interface", "type", "constant", "variable", "config"]
FOCUS_TYPES = ["file", "class", "function"]
SUMMARY_TYPES = ["class", "function", "method", "route", "config"]


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes`` (id, type, name, full_name, file_path, summary, is_exported), ``edges`` (id, type, from_id, to_id, resolved).

    Neither is held in memory; a method is a plan, or writes what it reads more than once. Order is by id wherever the rules leave it
    open. ``closed`` says that every edge's ends are nodes, as far as is known; ``reverse`` are the same edges, stored by target.
    """

    nodes: DataFrame
    edges: DataFrame
    closed: bool = False
    reverse: DataFrame | None = None

    # lookups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def outgoing(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("from_id") == node_id)

    def incoming(self, node_id: str) -> DataFrame:
        return (self.edges if self.reverse is None else self.reverse).where(F.col("to_id") == node_id)

    def edges_of(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def nodes_of(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("type").isin(*types))

    # changes

    def induced(self, ids: DataFrame, keep_entry_points: bool = False) -> DataFrame:
        """Edges with both ends among ``ids`` (id); with ``keep_entry_points`` also entry points whose target is."""
        ids = ids.select("id").distinct()
        at = lambda end, edges: edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
        columns = self.edges.columns
        both = at("from_id", at("to_id", self.edges)).select(*columns)
        if not keep_entry_points:
            return both
        entries = at("to_id", self.edges_of("ENTRY_POINT")).select(*columns)
        return both.where("type <> 'ENTRY_POINT'").unionByName(entries)

    def referential(self) -> DataFrame:
        """Edges whose ends both exist, one per id.

        Ends that are no nodes, and hashes of ids that come more than once, are found first: both are few as a rule, so edges stay where
        they are but for those that share a hash.
        """
        held = self._ends().select("id").distinct()
        missing = stored(held.join(self.nodes.select("id"), "id", "left_anti"))
        whole = self.edges.where("from_id IS NOT NULL AND to_id IS NOT NULL")
        for end in ("from_id", "to_id"):
            whole = whole.join(missing.withColumnRenamed("id", end), end, "left_anti")
        whole = whole.select(*self.edges.columns, F.xxhash64("id").alias("h"))
        often = stored(whole.groupBy("h").count().where("count > 1").select("h"))
        again = whole.join(often, "h", "left_semi").dropDuplicates(["id"])
        return whole.join(often, "h", "left_anti").unionByName(again).select(*self.edges.columns)

    def without(self, ids: DataFrame) -> PropertyGraph:
        """The graph without the nodes ``ids`` (id) and their edges."""
        ids = ids.select("id").distinct()
        nodes = self.nodes.join(ids, "id", "left_anti")
        edges = self.edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
        return PropertyGraph(nodes.select(*self.nodes.columns), edges.select(*self.edges.columns))

    def without_where(self, nodes: Column | None = None, edges: Column | None = None) -> PropertyGraph:
        """The graph without nodes and edges for which a predicate holds."""
        left = self.without(self.nodes.where(nodes)) if nodes is not None else self
        return left if edges is None else PropertyGraph(left.nodes, left.edges.where(~edges))

    # neighbours

    def both_ways(self, edges: DataFrame | None = None) -> DataFrame:
        """(at, other, edge_id, way) from each end of every edge; way is 0 from its source, 1 from its target."""
        e = self.edges if edges is None else edges
        return e.select(F.col("from_id").alias("at"), F.col("to_id").alias("other"), F.col("id").alias("edge_id"), F.lit(0).alias("way")).union(e.select("to_id", "from_id", "id", F.lit(1)))

    def neighbours(self, node_id: str) -> DataFrame:
        """A node and all it has an edge with."""
        near = self.edges.where((F.col("from_id") == node_id) | (F.col("to_id") == node_id))
        ids = near.select(F.when(F.col("from_id") == node_id, F.col("to_id")).otherwise(F.col("from_id")).alias("id")).distinct()
        own = self.node(node_id).select("id")
        return self.nodes.join(ids.union(own).distinct(), "id", "left_semi")

    def relations(self, node_id: str) -> DataFrame:
        """Every edge of a node with the node at its other end, if that exists."""
        out = self.outgoing(node_id).select(F.lit("outgoing").alias("direction"), F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("to_id").alias("other_id"))
        back = self.incoming(node_id).select(F.lit("incoming").alias("direction"), F.col("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("from_id").alias("other_id"))
        other = self.nodes.select(F.col("id").alias("other_id"), F.col("type").alias("other_type"), F.col("name").alias("other_name"))
        return out.union(back).join(other, "other_id", "left")

    def two_hops(self, node_id: str) -> DataFrame:
        """(middle, far) over two edges from a node."""
        first = self.outgoing(node_id).select(F.col("to_id").alias("middle")).distinct()
        second = self.edges.select(F.col("from_id").alias("middle"), F.col("to_id").alias("far"))
        return first.join(second, "middle").distinct()

    def file_symbols(self, file_path: str) -> DataFrame:
        """Symbols that the files at a path define."""
        files = self.nodes_of("file").where(F.col("full_name") == file_path).select(F.col("id").alias("from_id"))
        return self._targets(self.edges_of("DEFINES").join(files, "from_id", "left_semi"))

    def entry_points(self) -> DataFrame:
        return self._targets(self.edges_of("ENTRY_POINT"))

    def _targets(self, edges: DataFrame) -> DataFrame:
        return self.nodes.join(edges.select(F.col("to_id").alias("id")).distinct(), "id", "left_semi")

    # counts

    def degrees(self) -> DataFrame:
        """(id, in_degree, out_degree, degree) of every node; an edge to itself counts in both.

        Both directions are counted in one pass over the edges and one shuffle.
        """
        return _placed(self.nodes.select("id"), _counted(self._ends()))

    def with_degrees(self) -> DataFrame:
        return _placed(self.nodes, _counted(self._ends()))

    def _ends(self) -> DataFrame:
        """(id, other, o, i): both ends of every edge, o is 1 at its source and i at its target."""
        end = lambda a, b, o: F.struct(F.col(a).alias("id"), F.col(b).alias("other"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
        return self.edges.select(F.explode(F.array(end("from_id", "to_id", 1), end("to_id", "from_id", 0))).alias("x")).select("x.*")

    def touching(self, ids: DataFrame) -> DataFrame:
        """Edges with an end among ``ids`` (id), each once."""
        ids = ids.select("id").distinct()
        start, end, columns = ids.withColumnRenamed("id", "from_id"), ids.withColumnRenamed("id", "to_id"), self.edges.columns
        from_here = self.edges.join(start, "from_id", "left_semi").select(*columns)
        return from_here.union(self.edges.join(end, "to_id", "left_semi").join(start, "from_id", "left_anti").select(*columns))

    def health(self) -> DataFrame:
        """Counts of nodes, edges, unresolved edges and nodes without edges."""
        edges = self.edges.agg(F.count("*").alias("edge_count"), F.count_if(~F.col("resolved")).alias("unresolved_count"))
        nodes = self.degrees().agg(F.count("*").alias("node_count"), F.count_if(F.col("degree") == 0).alias("isolated_count"))
        return nodes.crossJoin(edges).select("node_count", "edge_count", "unresolved_count", "isolated_count")

    def unresolved(self) -> DataFrame:
        return self.edges.where((F.col("type") == "CALLS_UNRESOLVED") | ~F.col("resolved"))

    # importance

    def importance(self, of: DataFrame | None = None) -> DataFrame:
        """(id, importance): weighted degrees of the induced edges, a type's and an entry point's bonus, at most 1.

        With ``of``, some of the nodes, only theirs: no other node's edges are counted. Of a graph not known to be closed edges are counted
        first and once; only where that counts an end that is no node are they counted again, without such edges.
        """
        nodes = self.nodes if of is None else of
        if of is not None:
            ends = self._ends().join(of.select("id").distinct(), "id", "left_semi")
            counted = _counted(ends if self.closed else ends.join(self.nodes.select(F.col("id").alias("other")), "other", "left_semi"))
        else:
            counted = _counted(self._ends())
            if not self.closed:
                counted = stored(counted)
                if not counted.join(self.nodes.select("id"), "id", "left_anti").isEmpty():
                    counted = _counted(PropertyGraph(self.nodes, self.induced(self.nodes))._ends())
        entries = self.edges_of("ENTRY_POINT").select(F.col("to_id").alias("id")).distinct().withColumn("entry", F.lit(True))
        size = self.nodes.agg(F.greatest(F.lit(1.0), F.count("*") * F.lit(0.1)).alias("size"))
        raw = (F.col("in_degree") * 1.5 + F.col("out_degree")) / F.col("size")
        bonus = F.when(F.col("type").isin(*IMPORTANT_TYPES), 0.15).otherwise(0.0) + F.when(F.coalesce("entry", F.lit(False)), 0.35).otherwise(0.0)
        return _placed(nodes, counted).join(entries, "id", "left").crossJoin(size).select("id", F.least(F.lit(1.0), rounded(raw + bonus, 4)).alias("importance"))

    def degree_centrality(self) -> DataFrame:
        """(id, degree, centrality): the degree as a share of the largest, six places."""
        d = stored(self.degrees())
        most = d.agg(F.greatest(F.lit(1), F.max("degree")).alias("most"))
        return d.crossJoin(most).select("id", "degree", rounded(F.col("degree") / F.col("most"), 6).alias("centrality"))

    def server_importance(self) -> DataFrame:
        """(id, importance): incoming edges weigh 1.4, projects gain 2, as a share of 1.4 of the largest degree."""
        d = stored(_placed(self.nodes.select("id", "type"), _counted(self._ends())))
        most = d.agg(F.greatest(F.lit(1.0), F.max("degree") * F.lit(1.4)).alias("most"))
        raw = F.col("in_degree") * 1.4 + F.col("out_degree") + F.when(F.col("type") == "project", 2.0).otherwise(0.0)
        return d.crossJoin(most).select("id", rounded(raw / F.col("most"), 6).alias("importance"))

    def hubs(self, count: int = 25) -> DataFrame:
        """The nodes of largest degree; only those that can be among them meet their names."""
        d = stored(self.degrees())
        least = d.select("degree").orderBy(F.desc("degree")).limit(count).agg(F.min("degree").alias("least"))
        few = d.crossJoin(F.broadcast(least)).where(F.col("degree") >= F.col("least")).drop("least")
        return self.nodes.join(few, "id").orderBy(F.desc("degree"), "name", "id").limit(count)

    def directory_groups(self, directory: Column, count: int = 30, at_once: int = 10_000) -> DataFrame:
        """(directory, size, part, members): the largest groups of nodes by directory, with all their ids in order.

        A group's ids come in parts of up to ``at_once``, so that no row grows with its group; ids are ranked over ranges of
        a directory's ids that have about as many, not in one task.
        """
        placed = self.nodes.select("id", directory.alias("directory"))
        sizes = placed.groupBy("directory").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "directory").limit(count)
        few = placed.join(F.broadcast(sizes), "directory")  # one row a directory, ``count`` at most
        ordered = few.repartitionByRange("directory", "id").sortWithinPartitions("directory", "id").withColumn("task", F.spark_partition_id())
        ordered = checkpointed(ordered)
        held = ordered.groupBy("directory", "task").agg(F.count("*").alias("n"))
        before = held.withColumn("before", F.sum("n").over(Window.partitionBy("directory").orderBy("task")) - F.col("n")).drop("n")
        rank = F.row_number().over(Window.partitionBy("directory", "task").orderBy("id")) + F.col("before") - 1
        ranked = ordered.join(F.broadcast(before), ["directory", "task"]).withColumn("part", F.floor(rank / at_once).cast("int"))
        return ranked.groupBy("directory", "size", "part").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))


def _counted(ends: DataFrame) -> DataFrame:
    """(id, i, o): how often each id is a target and a source, combined map-side."""
    return ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))


def _placed(nodes: DataFrame, counted: DataFrame) -> DataFrame:
    """``nodes`` with in_degree, out_degree and degree; those without edges have 0."""
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.join(counted, "id", "left").select(*nodes.columns, n(F.col("i")).alias("in_degree"), n(F.col("o")).alias("out_degree"), (n(F.col("i")) + n(F.col("o"))).alias("degree"))


def by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the last by ``order``; a hot key is reduced map-side."""
    rest = [c for c in df.columns if c not in keys]
    chosen = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("x")).select(*keys, "x.*").select(*df.columns)


def export_rank(kind: Column) -> Column:
    """A type's place in exports; types without one come last."""
    return F.coalesce(reduce(lambda c, x: c.when(kind == x[1], x[0] + 1), list(enumerate(EXPORT_ORDER))[1:], F.when(kind == EXPORT_ORDER[0], 1)), F.lit(100))
