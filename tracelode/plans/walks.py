"""Traversals of the whole graph from a node, and of the small cyclic graph of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traverse
from .registry import Data, query


def _parts(found: traverse.Neighbourhood) -> DataFrame:
    return found.nodes.select(F.lit("node").alias("part"), "id").union(found.edges.select(F.lit("edge"), "id"))


RELATED = """WITH b AS MATERIALIZED (SELECT from_id AS a, to_id AS o, id FROM edges UNION ALL SELECT to_id, from_id, id FROM edges),
    x AS MATERIALIZED (SELECT '{0}' AS n UNION SELECT o FROM b WHERE a = '{0}'),
    e AS MATERIALIZED (SELECT DISTINCT id, a, o FROM b WHERE a IN (SELECT n FROM x))
    SELECT 'edge' AS part, id FROM (SELECT DISTINCT id FROM e) UNION ALL SELECT 'node', n FROM (SELECT o AS n FROM e UNION SELECT n FROM x)"""


@query("find_related", RELATED.format("s3"))
def find_related(d: Data) -> DataFrame:
    return _parts(traverse.find_related(d.walked, "s3", 1))


@query(
    "find_related_capped",
    """WITH b AS MATERIALIZED (SELECT from_id AS a, to_id AS o, id, 0 AS way FROM edges UNION ALL SELECT to_id, from_id, id, 1 FROM edges),
    one AS MATERIALIZED (SELECT o AS n, row_number() OVER (ORDER BY way, id) AS place FROM (SELECT o, way, id, row_number() OVER (PARTITION BY o ORDER BY way, id) AS k FROM b WHERE a = 'c7') WHERE k = 1 AND o <> 'c7'),
    two AS (SELECT o, min(place) AS place FROM one JOIN b ON a = n WHERE o <> 'c7' AND o NOT IN (SELECT n FROM one) GROUP BY 1),
    found AS (SELECT one.place, n, (SELECT count(*) FROM one) + 1 + coalesce((SELECT count(*) FROM two WHERE two.place < one.place), 0) AS size_before FROM one),
    x AS MATERIALIZED (SELECT 'c7' AS n UNION SELECT n FROM found WHERE size_before < 60),
    e AS MATERIALIZED (SELECT DISTINCT id, o FROM b WHERE a IN (SELECT n FROM x))
    SELECT 'edge' AS part, id FROM (SELECT DISTINCT id FROM e) UNION ALL SELECT 'node', n FROM (SELECT o AS n FROM e UNION SELECT n FROM x)""",
)
def find_related_capped(d: Data) -> DataFrame:
    return _parts(traverse.find_related_capped(d.walked, "c7", 1, 60))


@query("module_graph", RELATED.format("s5"))
def module_graph(d: Data) -> DataFrame:
    from ..operators.search import resolve_focus

    hit = resolve_focus(d.graph, "supplier#000000005").first()
    return _parts(traverse.find_related(d.walked, hit["id"], 1))


@query(
    "project_overview",
    """WITH b AS MATERIALIZED (SELECT from_id AS a, to_id AS o, id FROM edges UNION ALL SELECT to_id, from_id, id FROM edges),
    x AS MATERIALIZED (SELECT 'p' AS n UNION SELECT o FROM b WHERE a = 'p'),
    e AS MATERIALIZED (SELECT DISTINCT id, o FROM b WHERE a IN (SELECT n FROM x))
    SELECT 'edge' AS part, id FROM (SELECT DISTINCT id FROM e) UNION ALL SELECT 'node', id FROM (SELECT id FROM nodes WHERE id IN (SELECT o FROM e UNION SELECT n FROM x) ORDER BY type, name, id LIMIT 133)""",
)
def project_overview(d: Data) -> DataFrame:
    return _parts(traverse.overview(d.walked, traverse.overview_seeds(d.graph), 133))


PATHS = """WITH RECURSIVE w AS (SELECT 'n0' AS here, ['n0'] AS path, CAST([] AS VARCHAR[]) AS via, 0 AS n UNION ALL
      SELECT e.to_id, list_append(w.path, e.to_id), list_append(w.via, e.id), w.n + 1 FROM w JOIN trade e ON e.from_id = w.here WHERE w.n < 4 AND NOT list_contains(w.path, e.to_id)),
    best AS (SELECT path, via, n FROM w WHERE here = '{0}' ORDER BY n, via LIMIT 1)"""


@query("find_path", PATHS.format("n7") + " SELECT CAST(i - 1 AS INTEGER) AS step, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM best)")
def find_path(d: Data) -> DataFrame:
    return traverse.find_path(d.trade, "n0", "n7")


@query("path_edges", PATHS.format("n7") + " SELECT CAST(i - 1 AS INTEGER) AS step, e.id, e.type, e.from_id, e.to_id, e.resolved FROM (SELECT path, unnest(range(1, len(path))) AS i FROM best) JOIN edges e ON e.from_id = path[i] AND e.to_id = path[i + 1]")
def path_edges(d: Data) -> DataFrame:
    return traverse.path_edges(d.graph, traverse.find_path(d.trade, "n0", "n7"))


@query("all_shortest_paths", PATHS.format("n7") + " SELECT array_to_string(path, '>') AS path FROM w WHERE here = 'n7' AND n = (SELECT n FROM best) ORDER BY 1 LIMIT 5")
def all_shortest_paths(d: Data) -> DataFrame:
    return traverse.all_shortest_paths(d.trade.edges, "n0", "n7")


REACH = "WITH RECURSIVE r AS (SELECT {0} AS id, 0 AS distance UNION SELECT {1}, r.distance + 1 FROM r JOIN trade e ON e.{2} = r.id WHERE r.distance < 25), m AS (SELECT id, min(distance) AS distance FROM r GROUP BY 1)"


@query("impacted_files", REACH.format("'n3'", "e.from_id", "to_id") + " SELECT id, distance FROM m")
def impacted_files(d: Data) -> DataFrame:
    return traverse.impacted(d.trade.edges, d.spark.createDataFrame([("n3",)], "id string"))


@query("dependencies", REACH.format("'n3'", "e.to_id", "from_id") + " SELECT id, distance, distance = 1 AS direct FROM m WHERE distance > 0")
def dependencies(d: Data) -> DataFrame:
    return traverse.closure(d.trade.edges, "n3")


@query("dependents", REACH.format("'n3'", "e.from_id", "to_id") + " SELECT id, distance, distance = 1 AS direct FROM m WHERE distance > 0")
def dependents(d: Data) -> DataFrame:
    return traverse.closure(d.trade.edges, "n3", reverse=True)


#: The first 25 cycles of this graph have up to 6 edges at every scale, so the SQL, which can't stop when it has enough, looks no further.
CYCLES = """WITH RECURSIVE w AS (SELECT from_id AS s, to_id AS at, [from_id, to_id] AS path FROM trade WHERE from_id < to_id UNION ALL
      SELECT w.s, e.to_id, list_append(w.path, e.to_id) FROM w JOIN trade e ON e.from_id = w.at WHERE e.to_id > w.s AND NOT list_contains(w.path, e.to_id) AND len(w.path) < 6),
    c AS (SELECT CAST(len(path) AS INTEGER) AS length, array_to_string(path, '>') AS cycle, list_sort(path) AS nodes FROM w JOIN trade e ON e.from_id = w.at AND e.to_id = w.s)"""


@query("cycles_dedup", CYCLES + " SELECT length, min(cycle) AS cycle FROM c GROUP BY nodes, length ORDER BY 1, 2 LIMIT 25")
def cycles_dedup(d: Data) -> DataFrame:
    return traverse.cycles(d.trade.edges)


@query("cycles_bounded", CYCLES + " SELECT length, cycle FROM c ORDER BY 1, 2 LIMIT 20")
def cycles_bounded(d: Data) -> DataFrame:
    return traverse.cycles(d.trade.edges, 12, most=20, by_nodes=False)


@query(
    "call_chains",
    """WITH RECURSIVE f AS MATERIALIZED (SELECT from_id, to_id FROM (SELECT from_id, to_id, row_number() OVER (PARTITION BY from_id ORDER BY id) AS r FROM trade) WHERE r <= 6),
    w AS (SELECT 'n0' AS here, ['n0'] AS path UNION ALL SELECT f.to_id, list_append(path, f.to_id) FROM w JOIN f ON f.from_id = w.here WHERE NOT list_contains(path, f.to_id) AND len(path) < 5)
    SELECT DISTINCT array_to_string(path, '>') AS chain FROM w WHERE len(path) = 5 OR (len(path) > 1 AND here NOT IN (SELECT from_id FROM f)) ORDER BY 1 LIMIT 20""",
)
def call_chains(d: Data) -> DataFrame:
    return traverse.call_chains(d.spark.createDataFrame([("n0",)], "id string"), d.trade.edges)


# the same walks over the whole graph, which grows with the data


@query(
    "find_path_full",
    """WITH RECURSIVE w AS (SELECT 'f10' AS here, ['f10'] AS path, CAST([] AS VARCHAR[]) AS via, 0 AS n UNION ALL
      SELECT e.from_id, list_prepend(e.from_id, w.path), list_prepend(e.id, w.via), w.n + 1 FROM w JOIN edges e ON e.to_id = w.here WHERE w.n < 5 AND NOT list_contains(w.path, e.from_id)),
    best AS (SELECT path, via, n FROM w WHERE here = 'p' ORDER BY n, via LIMIT 1) SELECT CAST(i - 1 AS INTEGER) AS step, path[i] AS id FROM (SELECT path, unnest(range(1, len(path) + 1)) AS i FROM best)""",
)
def find_path_full(d: Data) -> DataFrame:
    return traverse.find_path(d.walked, "p", "f10")


FULL_REACH = "WITH RECURSIVE r AS (SELECT '{0}' AS id, 0 AS distance UNION SELECT e.{1}, r.distance + 1 FROM r JOIN edges e ON e.{2} = r.id AND e.type IN ('OWNS', 'DEFINES', 'CALLS', 'CALLS_UNRESOLVED', 'USES') WHERE r.distance < 9), m AS (SELECT id, min(distance) AS distance FROM r GROUP BY 1) SELECT id, distance, distance = 1 AS direct FROM m WHERE distance > 0"


@query("dependencies_full", FULL_REACH.format("n4", "to_id", "from_id"))
def dependencies_full(d: Data) -> DataFrame:
    return traverse.closure(d.graph.edges_of("OWNS", "DEFINES", "CALLS", "CALLS_UNRESOLVED", "USES"), "n4")


@query("dependents_full", FULL_REACH.format("f3", "from_id", "to_id"))
def dependents_full(d: Data) -> DataFrame:
    return traverse.closure(d.graph.edges_of("OWNS", "DEFINES", "CALLS", "CALLS_UNRESOLVED", "USES"), "f3", reverse=True)


#: Who buys in whose country: a cyclic graph whose nodes are customers and suppliers, as many as the data has.
ROUNDS = """SELECT DISTINCT concat('c', o_custkey) AS from_id, concat('s', l_suppkey) AS to_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 40
    UNION SELECT concat('s', s_suppkey), concat('c', c_custkey) FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey AND s_acctbal > 0 AND c_acctbal > 8000"""


#: The same graph where every supplier of a country sells to its customers by way of the country: edges grow with the tables and not with
#: suppliers times customers. A way over a country stands for one edge, and there is one, so what reaches what and how many shortest
#: paths there are stays as it is; countries are no nodes of the graph.
BY_COUNTRY = """SELECT DISTINCT concat('c', o_custkey) AS from_id, concat('s', l_suppkey) AS to_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 40
    UNION ALL SELECT DISTINCT concat('s', s_suppkey), concat('via:', s_nationkey) FROM {supplier} LEFT SEMI JOIN {customer} ON s_nationkey = c_nationkey AND c_acctbal > 8000 WHERE s_acctbal > 0
    UNION ALL SELECT DISTINCT concat('via:', c_nationkey), concat('c', c_custkey) FROM {customer} LEFT SEMI JOIN {supplier} ON s_nationkey = c_nationkey AND s_acctbal > 0 WHERE c_acctbal > 8000"""


def _rounds(d: Data) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and what is only passed of that graph, by way of countries."""
    from ..operators.components import stored
    from ..sources.tables import on_spark

    edges = stored(on_spark(d.spark, d.sf_dir, BY_COUNTRY))
    every = stored(edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct())
    return every.where("id NOT LIKE 'via:%'"), edges, every.where("id LIKE 'via:%'")


@query("scc_sizes")
def scc_sizes(d: Data) -> DataFrame:
    """Sizes of the strong components of that graph, and how many there are of each."""
    from ..operators.analytics import strong_components

    nodes, edges, passed = _rounds(d)
    return strong_components(nodes.union(passed), edges).join(passed, "id", "left_anti").groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query("betweenness_rounds")
def betweenness_rounds(d: Data) -> DataFrame:
    """The nodes of that graph through which most shortest paths lead."""
    from ..operators.analytics import betweenness

    nodes, edges, passed = _rounds(d)
    return betweenness(nodes, edges, passed=passed).orderBy(F.desc("betweenness"), "id").limit(50)


# search


@query("find_by_name", "SELECT id, name FROM nodes WHERE contains(lower(name), 'red') OR contains(lower(full_name), 'red') OR contains(lower(file_path), 'red') ORDER BY name, id LIMIT 50")
def find_by_name(d: Data) -> DataFrame:
    from ..operators.search import find_by_name as search

    return search(d.graph, " ReD ").select("id", "name")


@query("find_by_type", "SELECT id, name FROM nodes WHERE type = 'interface' ORDER BY name, id LIMIT 100")
def find_by_type(d: Data) -> DataFrame:
    from ..operators.search import find_by_type as search

    return search(d.graph, "interface").select("id", "name")


@query("resolve_focus", "SELECT id, 2 AS tier FROM nodes WHERE lower(name) = 'supplier#000000005' OR lower(full_name) = 'supplier#000000005'")
def resolve_focus(d: Data) -> DataFrame:
    from ..operators.search import resolve_focus as resolve

    return resolve(d.graph, "supplier#000000005").select("id", "tier")


