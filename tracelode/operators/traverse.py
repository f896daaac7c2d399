"""Traversals: bounded neighbourhoods, shortest paths, reachability, cycles and call chains.

Loops run one join per level and write each level as a table of known size, so a small one is broadcast and the edges stay where
they are; what they keep is rows of ids. Breadth-first order is made of
columns: a node's place is its discoverer's place, then whether the edge leads out or in, then the edge's id.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import checkpointed, stored
from .graph import PropertyGraph


@dataclass(frozen=True)
class Neighbourhood:
    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def _start(graph: PropertyGraph, node_id: str) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(node_id,)], "id string")


def find_related(graph: PropertyGraph, node_id: str, depth: int = 2) -> Neighbourhood:
    """Nodes at undirected distance ``depth`` or less are expanded: all their edges, and those edges' ends.

    So nodes up to distance depth + 1 are in it. An unknown id gives no nodes.
    """
    steps = graph.both_ways().select("at", "other")
    reached = frontier = stored(_start(graph, node_id))
    for _ in range(depth):
        new = steps.join(frontier.withColumnRenamed("id", "at"), "at", "left_semi").select(F.col("other").alias("id")).distinct()
        frontier = stored(new.join(reached, "id", "left_anti"))
        reached = reached.union(frontier)
    return _around(graph, reached, False)


def _around(graph: PropertyGraph, expanded: DataFrame, truncated: bool) -> Neighbourhood:
    mark = expanded.select("id").distinct()
    edges = graph.touching(mark)
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).union(mark).distinct()
    return Neighbourhood(graph.nodes.join(ids, "id", "left_semi"), edges, truncated)


def find_related_capped(graph: PropertyGraph, node_id: str, depth: int = 2, most_nodes: int = 250) -> Neighbourhood:
    """The same, expanding in breadth-first order while fewer than ``most_nodes`` nodes are known.

    The cap is tested before each expansion, so one expansion may overshoot it. Of a level, only as many nodes as the cap
    can still expand are ranked, so a level's window is small whatever its size.
    """
    steps = graph.both_ways()
    frontier = stored(_start(graph, node_id).withColumn("place", F.lit(1)))
    seen = expanded = stored(frontier.select("id"))
    size, truncated, first = 1, False, True
    for level in range(depth + 1):
        out = frontier.withColumnRenamed("id", "at").join(steps, "at").select("other", F.struct("place", "way", "edge_id").alias("by"))
        new = stored(out.join(seen.withColumnRenamed("id", "other"), "other", "left_anti").groupBy("other").agg(F.min("by").alias("by")))
        found = new.groupBy(F.col("by.place").alias("place")).agg(F.count("*").alias("n"))
        before = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        kept = stored(frontier.join(found, "place", "left").withColumn("before", F.lit(size) + F.coalesce(before, F.lit(0))).withColumn("kept", F.col("before") < most_nodes))
        chosen = kept.where("kept").select("id")
        expanded = chosen if first else expanded.union(chosen)
        first = False
        if not kept.where("NOT kept").isEmpty():
            truncated = True
            break
        size += int(new.count())
        if level == depth or new.isEmpty():
            break
        seen = seen.union(new.select(F.col("other").alias("id")))  # each level stands in a table of its own
        ahead = new.orderBy("by").limit(most_nodes + 1)
        frontier = stored(ahead.select(F.col("other").alias("id"), F.row_number().over(Window.orderBy("by")).alias("place")))
    return _around(graph, expanded, truncated)


def reach(edges: DataFrame, starts: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(id, distance) of all that ``starts`` (id) reach over (u, v), the starts at 0."""
    steps = stored(edges.select("u", "v"))
    frontier = stored(starts.select("id", F.lit(0).alias("distance")).distinct())
    found = frontier
    for distance in range(1, most_rounds):
        new = steps.join(frontier.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id")).distinct()
        frontier = stored(new.join(found, "id", "left_anti").withColumn("distance", F.lit(distance)))
        if frontier.isEmpty():
            return found
        found = found.union(frontier)
    raise RuntimeError(f"more than {most_rounds} levels")


def forward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("u"), F.col("from_id").alias("v"))


def closure(edges: DataFrame, node_id: str, reverse: bool = False) -> DataFrame:
    """(id, distance, direct): what a node depends on, or with ``reverse`` what depends on it; each once, itself not."""
    starts = edges.sparkSession.createDataFrame([(node_id,)], "id string")
    found = reach(backward(edges) if reverse else forward(edges), starts)
    return found.where("distance > 0").select("id", "distance", (F.col("distance") == 1).alias("direct"))


def impacted(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, distance): changed files (id) and all that import, depend on or test them, at any distance."""
    return reach(backward(edges.where(F.col("type").isin("IMPORTS", "DEPENDS_ON", "TESTS"))), changed)


def find_path(graph: PropertyGraph, source: str, target: str, most_hops: int = 64) -> DataFrame:
    """(step, id): the nodes of a shortest directed path, of which the first in breadth-first order; none if there is none.

    Layers grow from both ends, the smaller one at a time and of equal ones the target's, until they meet, and the edges that each step crosses are kept. The path is
    then chosen over those alone: every shortest path crosses them.
    """
    spark = graph.nodes.sparkSession
    none = spark.createDataFrame([], "step int, id string")
    steps = graph.edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("other"), F.col("id").alias("edge_id"))
    start = stored(spark.createDataFrame([(source, [], [source])], "id string, by array<string>, path array<string>"))
    ends = [start.select("id"), stored(spark.createDataFrame([(target,)], "id string"))]
    seen, sizes, crossed = list(ends), [1, 1], [[], []]
    while ends[0].join(ends[1], "id", "left_semi").isEmpty():
        if len(crossed[0]) + len(crossed[1]) == most_hops:
            return none
        k = int(sizes[0] >= sizes[1])
        near, far = ("at", "other") if k == 0 else ("other", "at")
        met = steps.join(ends[k].withColumnRenamed("id", near), near, "left_semi").join(seen[k].withColumnRenamed("id", far), far, "left_anti")
        crossed[k].append(stored(met.select("at", "other", "edge_id")))
        ends[k] = stored(crossed[k][-1].select(F.col(far).alias("id")).distinct())
        sizes[k], seen[k] = ends[k].count(), seen[k].union(ends[k])
        if not sizes[k]:
            return none
    frontier = start
    for n, edges in enumerate([*crossed[0], *reversed(crossed[1])], 1):
        out = frontier.withColumnRenamed("id", "at").join(edges, "at")
        if n == len(crossed[0]):  # here the layers have met: what lies on no shortest path goes
            out = out.join(ends[1].withColumnRenamed("id", "other"), "other", "left_semi")
        best = out.groupBy("other").agg(F.min(F.struct(F.array_append("by", F.col("edge_id")).alias("by"), F.array_append("path", F.col("other")).alias("path"))).alias("x"))
        frontier = stored(best.select(F.col("other").alias("id"), "x.by", "x.path"))
    return frontier.where(F.col("id") == target).select(F.posexplode("path").alias("step", "id"))


def path_edges(graph: PropertyGraph, path: DataFrame) -> DataFrame:
    """All edges, parallel ones too, between consecutive nodes of a path (step, id)."""
    next_ = path.select((F.col("step") - 1).alias("step"), F.col("id").alias("to_id"))
    hops = path.withColumnRenamed("id", "from_id").join(next_, "step")
    return graph.edges.join(hops, ["from_id", "to_id"]).select("step", *graph.edges.columns)


def all_shortest_paths(edges: DataFrame, source: str, target: str, most: int = 5, most_hops: int = 64) -> DataFrame:
    """(path): up to ``most`` of the shortest paths, in order of their ids joined by ``>``."""
    spark = edges.sparkSession
    steps = checkpointed(forward(edges).distinct())
    far = reach(steps.select(F.col("v").alias("u"), F.col("u").alias("v")), spark.createDataFrame([(target,)], "id string"))
    start = far.where(F.col("id") == source).select("distance").first()
    if start is None:
        return spark.createDataFrame([], "path string")
    paths = spark.createDataFrame([(source, source)], "at string, path string")
    for left in range(start["distance"] - 1, -1, -1):  # only nodes that still lie on a shortest path
        layer = far.where(F.col("distance") == left).select(F.col("id").alias("v"))
        onward = steps.join(layer, "v", "left_semi").withColumnRenamed("u", "at")
        grown = paths.join(onward, "at").select(F.col("v").alias("at"), F.concat("path", F.lit(">"), F.col("v")).alias("path"))
        # prefixes kept: the first by node are enough, as every one of them has the same ways on
        rank = F.row_number().over(Window.partitionBy("at").orderBy("path"))
        paths = checkpointed(grown.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank"))
    return paths.select("path").orderBy("path").limit(most)


def cycles(edges: DataFrame, most_length: int = 12, most: int = 25, by_nodes: bool = True, paths_at_once: int = 2_000_000) -> DataFrame:
    """(length, cycle): simple cycles up to ``most_length`` edges, from their least node on, the shortest first.

    With ``by_nodes`` one for each set of nodes is kept, the first in order. Only edges inside one strong component lie on a cycle, so
    the others are left out first. Paths only go on over nodes greater than the start, so every
    cycle is found once. Lengths are taken in turn and end as soon as ``most`` are found: shorter ones come first
    in the result. A graph whose paths of one length are more than ``paths_at_once`` is refused: take a neighbourhood, or fewer lengths.
    """
    from .analytics import strong_components

    steps = checkpointed(forward(edges).distinct())
    loops = steps.where("u = v")
    inner = steps.where("u <> v")
    parts = strong_components(inner.select(F.explode(F.array("u", "v")).alias("id")).distinct(), inner.select(F.col("u").alias("from_id"), F.col("v").alias("to_id")))
    a, b = parts.select(F.col("id").alias("u"), F.col("component").alias("of_u")), parts.select(F.col("id").alias("v"), F.col("component").alias("of_v"))
    steps = checkpointed(inner.join(a, "u").join(b, "v").where("of_u = of_v").select("u", "v"))
    paths = checkpointed(steps.where("u < v").select(F.col("u").alias("start"), F.col("v").alias("at"), F.array("u", "v").alias("path")))
    closed = checkpointed(loops.select(F.lit(1).alias("length"), F.array("u").alias("path")))
    for length in range(2, most_length + 1):
        back = paths.join(steps, (F.col("at") == F.col("u")) & (F.col("start") == F.col("v")))
        closed = checkpointed(closed.union(back.select(F.lit(length).alias("length"), "path")))
        if length == most_length or _named(closed, by_nodes).limit(most).count() == most or paths.isEmpty():
            break
        on = paths.join(steps, F.col("at") == F.col("u")).where((F.col("v") > F.col("start")) & ~F.array_contains("path", F.col("v")))
        paths = on.select("start", F.col("v").alias("at"), F.array_append("path", F.col("v")).alias("path"))
        if paths.limit(paths_at_once + 1).count() > paths_at_once:
            raise ValueError(f"more than {paths_at_once} paths of {length} edges; choose a neighbourhood or a smaller length")
        paths = checkpointed(paths)
    return _named(closed, by_nodes).orderBy("length", "cycle").limit(most)


def _named(closed: DataFrame, by_nodes: bool) -> DataFrame:
    named = closed.select("length", F.array_join("path", ">").alias("cycle"), F.array_join(F.array_sort("path"), ",").alias("nodes"))
    if by_nodes:
        named = named.groupBy("nodes").agg(F.min(F.struct("length", "cycle")).alias("x")).select("x.length", "x.cycle")
    return named.select("length", "cycle")


def call_chains(starts: DataFrame, calls: DataFrame, most_nodes: int = 5, fan_out: int = 6, most: int = 20) -> DataFrame:
    """(chain): simple call paths from ``starts`` (id) that end at a node without calls or at ``most_nodes`` nodes.

    Of each node's calls (from_id, to_id, id) the first ``fan_out`` by id are followed; a path whose every next node is on it already
    is given up. Each start gives at most fan_out ** (most_nodes - 1) paths; the first ``most`` in order stay.
    """
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy("id"))
    followed = checkpointed(calls.withColumn("rank", rank).where(F.col("rank") <= fan_out).select(F.col("from_id").alias("at"), F.col("to_id").alias("next")))
    paths = starts.select(F.col("id").alias("at"), F.array("id").alias("path"))
    done = []
    for size in range(1, most_nodes):
        on = paths.join(followed, "at", "left")
        done.append(on.where(F.col("next").isNull() & (F.lit(size) > 1)).select("path"))
        paths = on.where(F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))).select(F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path")).distinct()
    done.append(paths.select("path"))
    all_ = done[0]
    for d in done[1:]:
        all_ = all_.union(d)
    return all_.select(F.array_join("path", ">").alias("chain")).distinct().orderBy("chain").limit(most)


def overview(graph: PropertyGraph, seeds: DataFrame, most_nodes: int) -> Neighbourhood:
    """The union of the seeds' (id, seed) neighbourhoods of depth 1 in seed order, cut at ``most_nodes`` nodes.

    A seed's items are its nodes by (type, name, id). An item is taken while fewer than ``most_nodes`` different
    nodes were taken before it; edges are those of all seeds that begin before that point. Seeds are taken in turn, one, then two, then
    four, until the cut falls among them: those after it are never walked. Items are counted over ranks of seeds first, so only the
    seed where the cut falls is ordered item by item.
    """
    steps, columns = graph.both_ways(), "id string, type string, name string, seed int"
    seeds = stored(seeds.select("id", "seed"))
    fresh, walked, before, last, truncated = graph.nodes.sparkSession.createDataFrame([], columns), [], 0, None, False
    done, at_once, cut = None, 1, None
    while cut is None:
        some = seeds if done is None else seeds.where(F.col("seed") > done)
        some = stored(some.orderBy("seed").limit(at_once))
        done = some.agg(F.max("seed")).first()[0]
        if done is None:
            break
        some = seeds.where(F.col("seed") == done).union(some).distinct()
        at_once *= 2
        # two levels are expanded (a seed and those at distance 1), three are seen
        inner = stored(some.select(F.col("id").alias("at"), "seed").join(steps, "at").select("seed", F.col("other").alias("x")).union(some.select("seed", "id")).distinct())
        walked.append(stored(inner.withColumnRenamed("x", "at").join(steps, "at").select("seed", "at", "other", "edge_id")))
        seen = walked[-1].select("seed", F.col("other").alias("id")).union(inner.select("seed", F.col("x").alias("id"))).distinct()
        items = seen.join(graph.nodes.select("id", "type", "name"), "id")
        new = stored(items.join(fresh, "id", "left_anti").groupBy("id", "type", "name").agg(F.min("seed").alias("seed")))
        counts = new.groupBy("seed").agg(F.count("*").alias("n"))
        upto = F.lit(before) + F.coalesce(F.sum("n").over(Window.orderBy("seed").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = stored(some.select("seed").distinct().join(counts, "seed", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("before", upto))
        cut = starts.where(F.col("before") + F.col("n") >= most_nodes).orderBy("seed").first()
        if cut is None:
            before, fresh = before + new.count(), fresh.unionByName(new)
    if cut is not None:  # the first item past the cap ends the walk: in this seed, or else it is the next seed's first
        place = F.lit(cut["before"]) + F.row_number().over(Window.orderBy("type", "name", "id"))
        inside = new.where(F.col("seed") == cut["seed"]).orderBy("type", "name", "id").limit(most_nodes - cut["before"]).withColumn("place", place)
        end = items.where(F.col("seed") == cut["seed"]).orderBy(F.desc("type"), F.desc("name"), F.desc("id")).select("id").first()
        taken = inside.where(F.col("place") == most_nodes).select("id").first()
        fresh = fresh.unionByName(new.where(F.col("seed") < cut["seed"])).select("id").union(inside.select("id"))
        if cut["before"] + cut["n"] == most_nodes and end == taken:
            next_ = seeds.where(F.col("seed") > cut["seed"]).orderBy("seed").first()
            last, truncated = (next_["seed"] if next_ else cut["seed"]), next_ is not None
            if next_ is not None and last > done:  # its edges count: it begins where the last place is taken
                more = seeds.where(F.col("seed") == last)
                inner = stored(more.select(F.col("id").alias("at"), "seed").join(steps, "at").select("seed", F.col("other").alias("x")).union(more.select("seed", "id")).distinct())
                walked.append(stored(inner.withColumnRenamed("x", "at").join(steps, "at").select("seed", "at", "other", "edge_id")))
        else:
            last, truncated = cut["seed"], True
    every = reduce(DataFrame.union, walked) if walked else None
    if every is None:
        return Neighbourhood(graph.nodes.limit(0), graph.edges.limit(0), False)
    used = (every if last is None else every.where(F.col("seed") <= last)).select(F.col("edge_id").alias("id")).distinct()
    return Neighbourhood(graph.nodes.join(fresh.select("id"), "id", "left_semi"), graph.edges.join(used, "id", "left_semi"), truncated)


def overview_seeds(graph: PropertyGraph, routes: int = 20, files: int = 30) -> DataFrame:
    """(id, seed): the project, entry points, then the first routes and files by name; an id counts at its first place."""
    group = lambda df, n: df.select("id", F.lit(n).alias("group"), "name")
    first = lambda kind, count: graph.nodes_of(kind).orderBy("name", "id").limit(count)
    everything = group(graph.nodes_of("project"), 0).union(group(graph.entry_points(), 1)).union(group(first("route", routes), 2)).union(group(first("file", files), 3))
    once = everything.groupBy("id").agg(F.min(F.struct("group", "name", "id")).alias("x"))
    return once.select("id", F.row_number().over(Window.orderBy("x")).alias("seed"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with a column rank, for results small enough to be ordered as one."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
